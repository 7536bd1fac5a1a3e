"""Experiment grids: many models over one prepared table, evaluated together.

The table holds each object once, with its split, class weight and one vector of all features of all sets: missing values
are the medians of the training rows, and columns are centred and scaled by them. A feature set is a slice of that
vector, so no cell imputes, scales or splits anew. The rows to learn from are dealt out over the cores once for all cells,
which are fitted in concurrent Spark jobs, as many as can hold their rows. Their predictions are one long table, and the
metrics of all cells come from one pass over it.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import flag, number, rule_label
from skyledger.operators import features as fs
from skyledger.operators import metrics
from skyledger.operators.evidence import confidence
from skyledger.operators.models import dealt, without_summary
from skyledger.operators.quantiles import medians
from skyledger.plans.shared import materialised

# Models of a grid, cells of the evidence run, sets and features of the rule, least rows of either.
MODELS = ["dummy_most_frequent", "logistic_regression", "random_forest", "hist_gradient_boosting"]
RULE, RULE_SETS, RULE_FEATURES = "rule_based_pha", ["full_features", "definition_features_only"], ["h", "moid"]
EVIDENCE = [("random_forest", "no_definition_features"), ("logistic_regression", "orbital_only"), ("random_forest", "orbital_only"), ("random_forest", "full_features"), ("random_forest", "definition_features_only")]
MIN_ROWS, MIN_POSITIVE, MIN_EVIDENCE = 100, 5, 20
#: Cells that are fitted at the same time, and the rows that all of these may learn from (a forest holds 1 to 2 KB of each).
AT_ONCE, ROWS_AT_ONCE = 4, 4_000_000
CONTEXT = ["des", "risk_score_0_100", "risk_category"]


@dataclass
class Prepared:
    """The table of an experiment: (object_key, label, split, weight, h, moid, all, context) and what its vector holds."""

    frame: DataFrame
    columns: list[str]
    counts: dict[tuple[str, int], int]
    key: str
    available: list[str] = field(default_factory=list)

    def size(self, split: str | None = None, label: int | None = None) -> int:
        return sum(n for (s, y), n in self.counts.items() if split in (None, s) and label in (None, y))


@dataclass
class Run:
    """results: a row for each cell; predictions: a row for each cell and object it predicts; lost: cells that predict none of the labelled rows."""

    results: DataFrame
    predictions: DataFrame
    status: str
    lost: list[str] = field(default_factory=list)


def grid(sets: Iterable[str] = tuple(fs.SETS), models: Iterable[str] = tuple(MODELS)) -> list[tuple[str, str]]:
    """(model, feature set) of every cell, the rule beside the sets that hold the definition."""
    return [(m, s) for s in sets for m in [*models, *([RULE] if s in RULE_SETS else [])]]


def prepared(df: DataFrame, sets: Iterable[str], key: str = "object_key", target: str = fs.TARGET) -> Prepared:
    """The rows of ``df`` with a label, ready for every cell of ``sets``; split 75 to 25 within each label."""
    wanted = dict.fromkeys(c for s in sets for c in fs.resolved(df.columns, s, target)[0])
    context = [c for c in CONTEXT if c in df.columns and c not in wanted and c != key]
    narrow = df.select(F.col(key), flag(target).cast("int").alias("label"), *[number(c).alias(c) for c in dict.fromkeys([*wanted, *(x for x in RULE_FEATURES if x in df.columns)])], *context)
    labelled = materialised(narrow.where("label is not null"), "labelled")
    rows = materialised(metrics.stratified(labelled, "label", key), "experiment")
    counts = {(r.split, r.label): r["count"] for r in rows.groupBy("split", "label").count().collect()}
    train = rows.where("split = 'train'")
    middle = {c: m for c, m in medians(train, list(wanted)).items() if m is not None}
    columns = list(middle)
    filled = [F.coalesce(c, F.lit(m)) for c, m in middle.items()]
    vector = F.array().cast("array<double>")
    if columns:
        stats = train.agg(*[F.avg(x).alias(f"a{k}") for k, x in enumerate(filled)], *[F.stddev_pop(x).alias(f"s{k}") for k, x in enumerate(filled)]).first()
        vector = F.array(*[(x - stats[f"a{k}"]) / (stats[f"s{k}"] or 1.0) for k, x in enumerate(filled)])
    held = {y: sum(n for (s, x), n in counts.items() if s == "train" and x == y) for y in (0, 1)}
    weight = F.lit(1.0)
    for y, n in held.items():
        if n:
            weight = F.when(F.col("label") == y, sum(held.values()) / (sum(v > 0 for v in held.values()) * n)).otherwise(weight)
    rule = [F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in RULE_FEATURES]
    frame = materialised(rows.select(key, "label", "split", weight.alias("weight"), array_to_vector(vector).alias("all"), *rule, *context), "vectors")
    return Prepared(frame, columns, counts, key, df.columns)


def _estimator(model: str):
    return {
        "logistic_regression": lambda: LogisticRegression(maxIter=1000, regParam=1e-4, standardization=False, weightCol="weight"),
        "random_forest": lambda: RandomForestClassifier(numTrees=100, minInstancesPerNode=2, maxDepth=8, weightCol="weight", seed=42, cacheNodeIds=True),
        "hist_gradient_boosting": lambda: GBTClassifier(maxIter=100, maxDepth=4, stepSize=0.08, seed=42),
    }[model]()


def _scores(p: Prepared, model: str, own: list[str], train: DataFrame, on: DataFrame) -> DataFrame:
    """``on`` with score (probability of label 1) by ``model`` fitted to ``train`` over the features ``own``."""
    if model == RULE:
        return on.withColumn("score", rule_label().cast("double"))
    if model == "dummy_most_frequent":  # ties go to the smaller label
        return on.withColumn("score", F.lit(float(p.size("train", 1) > p.size("train", 0))))
    pick = VectorSlicer(inputCol="all", outputCol="features", indices=[p.columns.index(c) for c in own])
    fitted = without_summary(Pipeline(stages=[pick, _estimator(model)]).fit(train))
    return fitted.transform(on).withColumn("score", vector_to_array("probability")[1])


def _learned(p: Prepared, mode: str) -> DataFrame:
    """The rows that the cells of a mode learn from, dealt out; kept until it is unpersisted."""
    rows, n = (p.frame.where("split = 'train'"), p.size("train")) if mode == "eval" else (p.frame, p.size())
    return dealt(rows.select(p.key, "label", "weight", "all"), n, p.key).persist()


def _cell(p: Prepared, model: str, feature_set: str, own: list[str], learned: dict[str, DataFrame]) -> list[DataFrame]:
    """Predictions of one cell: held-out rows by the training rows' model (eval), all rows by all rows' model (full)."""
    out = []
    for mode, train in learned.items():
        on = p.frame.where("split = 'test'") if mode == "eval" else p.frame
        found = _scores(p, model, own, train, on)
        context = [c for c in CONTEXT if c in p.frame.columns]
        found = found.select(p.key, "label", F.lit(model).alias("model"), F.lit(feature_set).alias("feature_set"), F.lit(mode).alias("prediction_mode"), "score", *context)
        out.append(materialised(found, "predictions"))
    return out


_RESULT = "model string, feature_set string, status string, n_features int, missing array<string>, refused array<string>"


def run(df: DataFrame, cells: list[tuple[str, str]], key: str = "object_key", target: str = fs.TARGET, modes: tuple[str, ...] = ("eval",),
        min_rows: int = MIN_ROWS, min_positive: int = MIN_POSITIVE) -> Run:
    """Fits and evaluates every cell (model, feature set).

    A cell is success or skipped (no usable feature); all are insufficient_data below ``min_rows`` rows or
    ``min_positive`` positives, and single_class without both labels. A fit that fails ends the run with its error: a
    grid without that cell would look whole. The run's status is that of its cells if they agree, else partial_success.
    Results hold counts, confusion, ranking metrics and recalls at 10, 25 and 50; those of held-out rows.
    """
    spark = df.sparkSession
    p = prepared(df, dict.fromkeys(s for _, s in cells), key, target)
    blocked = "insufficient_data" if p.size() < min_rows or p.size(label=1) < min_positive else "single_class" if 0 in (p.size(label=1), p.size(label=0)) else None
    rows, frames, learned = [], [], {mode: _learned(p, mode) for mode in modes}

    def one(cell: tuple[str, str]) -> tuple[tuple, list[DataFrame]]:
        model, feature_set = cell
        usable, missing, refused = fs.resolved(p.available, feature_set, target)
        own = [c for c in usable if c in p.columns]
        missing = [c for c in dict.fromkeys([*missing, *usable]) if c not in own]
        if model == RULE:
            own, missing = [c for c in RULE_FEATURES if c in p.available], [c for c in RULE_FEATURES if c not in p.available]
        facts = (len(own), missing, refused)
        if blocked or not own:
            return (model, feature_set, blocked or "skipped", *facts), []
        try:
            return (model, feature_set, "success", *facts), _cell(p, model, feature_set, own, learned)
        except Exception as error:
            raise RuntimeError(f"{model} on {feature_set} failed: {str(error)[:500]}") from error

    try:
        with ThreadPoolExecutor(max(1, min(AT_ONCE, ROWS_AT_ONCE // max(1, p.size())))) as pool:
            for row, found in pool.map(inheritable_thread_target(spark)(one), cells):
                rows.append(row)
                frames += found
    finally:
        for train in learned.values():
            train.unpersist()
    listed = spark.createDataFrame(rows, _RESULT)
    states = {r[2] for r in rows}
    status = states.pop() if len(states) == 1 else "partial_success" if "success" in states else "failed"
    predictions = _described(frames, p, key)
    lost = [f"{model} on {feature_set}: {state}" for model, feature_set, state, *_ in rows if state != "success" and p.size()]
    sizes = {"n_train": p.size("train"), "n_test": p.size("test"), "test_positive": p.size("test", 1)}
    return Run(_evaluated(listed, predictions, key).withColumns({k: F.lit(v).cast("long") for k, v in sizes.items()}), predictions, status, lost)


def _described(frames: list[DataFrame], p: Prepared, key: str) -> DataFrame:
    """All cells' predictions with predicted label, confidence, error kind, risk and role."""
    context = [c for c in CONTEXT if c in p.frame.columns]
    whole = p.frame.select(key, "label", F.lit("").alias("model"), F.lit("").alias("feature_set"), F.lit("").alias("prediction_mode"), F.lit(0.0).alias("score"), *context).where("false")
    for f in frames:
        whole = whole.unionByName(f)
    predicted = (F.col("score") > 0.5).cast("int")
    risk = fs.set_risk(F.col("feature_set"))
    kind = F.when(F.col("label") == predicted, "none").when(predicted == 1, "false_positive").otherwise("false_negative")
    strategy = F.when(F.col("prediction_mode") == "eval", "holdout_train_test_split").otherwise("full_labeled_dataset_after_holdout_evaluation")
    return whole.withColumns({
        "predicted": predicted, "confidence": confidence(F.col("score")), "error_kind": kind, "leakage_risk": risk,
        "evidence_role": F.when(risk == "high", "diagnostic").otherwise("secondary_evidence"), "training_strategy": strategy,
    })


def _evaluated(listed: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    by, held = ["model", "feature_set"], predictions.where("prediction_mode = 'eval'")
    recalls = metrics.top_k_recall(held, by, key).groupBy(*by).pivot("k", [10, 25, 50]).agg(F.first("recall"))
    recalls = recalls.select(*by, *[F.col(str(k)).alias(f"recall_at_{k}") for k in (10, 25, 50)])
    out = listed.join(metrics.confusion(held, by), by, "left").join(metrics.ranked(held, by), by, "left").join(recalls, by, "left")
    return out.withColumnRenamed("average_precision", "pr_auc")


def summary(results: DataFrame) -> DataFrame:
    """(n_cells, n_success, metric, value, model, feature_set): the best cell by PR-AUC and by F1, ties by name."""
    counts = results.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("status") == "success").alias("n_success"))
    long = results.where("status = 'success'").select("model", "feature_set", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("pr_auc", "f1")])).alias("m")).select("model", "feature_set", "m.*")
    order = F.struct("value", "model", "feature_set")
    best = long.where("value is not null").groupBy("metric").agg(F.max(order).alias("b")).select("metric", "b.*")
    return best.join(F.broadcast(counts))
