"""Baseline classifiers by pyspark.ml over imputed, scaled features, and label propagation over a similarity graph."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.evidence import confidence
from skyledger.operators.graph import both_ways
from skyledger.operators.metrics import stratified
from skyledger.operators.quality import impute_scale
from skyledger.plans.shared import dropped, materialised

#: Rows that a task of a fit holds, unless there are fewer than that for each core.
FIT_ROWS = 500_000


def estimator(name: str, width: int):
    return {
        "logistic_regression": lambda: LogisticRegression(maxIter=100, regParam=1e-4, standardization=False, weightCol="weight"),
        "random_forest": lambda: RandomForestClassifier(numTrees=100, minInstancesPerNode=2, maxDepth=8, weightCol="weight", seed=42, cacheNodeIds=True),
        "gradient_boosting": lambda: GBTClassifier(maxIter=20, stepSize=0.08, weightCol="weight", seed=42),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[width, 32, 2], maxIter=200, seed=42),
    }[name]()


def without_summary(model: PipelineModel) -> PipelineModel:
    """``model`` without its training summaries.

    A summary holds the session, which can't be sent to tasks once it has observed a write, and nothing reads it.
    """
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """``df`` of about ``n`` rows dealt out for a fit: a task for each core, or as many times more as ``FIT_ROWS`` asks for.

    A fit reads all rows in each of its rounds, and each task makes and sends the sums of all nodes of all trees; that
    work grows with the tasks, not with the rows, and a shuffle or a table's files are more or fewer tasks than cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, math.ceil(n / (cores * FIT_ROWS))), key)


def predictions(df: DataFrame, model: str, features: list[str], key: str = "object_key", label: str = "label") -> DataFrame:
    """(key, label, split, model, score, predicted, confidence): trained on 75 % of each class, balanced by weights."""
    split = stratified(df.select(key, label).where(F.col(label).isNotNull()), label, key).withColumnRenamed(label, "label")
    frame = materialised(impute_scale(df, features, key).join(split, key), "frame")
    counts = frame.where("split = 'train'").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    weights = counts.crossJoin(F.broadcast(total)).select("label", (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))
    frame = frame.join(F.broadcast(weights), "label")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), estimator(model, len(features))])
    train = frame.where("split = 'train'")
    train = dealt(train, train.count(), key).persist()
    try:
        fitted = without_summary(pipe.fit(train))
    finally:
        train.unpersist()
    out = fitted.transform(frame)
    score = vector_to_array("probability")[1]
    return out.select(key, "label", "split", F.lit(model).alias("model"), score.alias("score"), F.col("prediction").cast("int").alias("predicted"), confidence(score).alias("confidence"))


def label_propagation(nodes: DataFrame, edges: DataFrame, key: str, label: str, steps: int = 1000, tolerance: float = 1e-3) -> DataFrame:
    """(key, score): labels known in ``nodes`` (others null) spread along edges by similarity, known ones held fixed.

    An unknown score starts at 0.5 and becomes the mean of its neighbours' by similarity, until no score moves by more
    than ``tolerance`` or after ``steps`` rounds. A round computes only the frontier: unknown nodes beside one that moved
    in the round before, which is one whose score is further than ``tolerance`` from where it last moved to. So no node
    ever computes with a neighbour's score that is off by more. Nodes without edges keep 0.5. ``edges`` holds a pair once.
    """
    known = nodes.select(key, F.col(label).cast("double").alias("fixed"))
    free = known.where("fixed is null").select(key)
    links = both_ways(edges).select("src", "dst", "similarity").join(free.withColumnRenamed(key, "src"), "src", "left_semi")
    links = materialised(links, "links")  # (src, dst): only unknown nodes listen
    state = materialised(known.select(key, F.coalesce("fixed", F.lit(0.5)).alias("score"), F.coalesce("fixed", F.lit(0.5)).alias("told"), F.lit(True).alias("moved")), "scores")
    for _ in range(steps):
        told = links.join(state.where("moved").select(F.col(key).alias("dst")), "dst", "left_semi").select("src").distinct()
        heard = links.join(told, "src", "left_semi").join(state.select(F.col(key).alias("dst"), "score"), "dst")
        near = heard.groupBy(F.col("src").alias(key)).agg((F.sum(F.col("similarity") * F.col("score")) / F.sum("similarity")).alias("near"))
        moved = F.coalesce(F.abs(F.col("near") - F.col("told")) > tolerance, F.lit(False))
        after = state.join(near, key, "left").select(key, F.coalesce("near", "score").alias("score"), F.when(moved, F.col("near")).otherwise(F.col("told")).alias("told"), moved.alias("moved"))
        before, state = state, materialised(after, "scores")
        dropped(before)
        if state.where("moved").isEmpty():
            break
    return state.select(key, "score")
