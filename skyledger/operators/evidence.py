"""Model evidence: confidence, disagreements, error subsets, leakage classes, best models, attempt accounting, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.operators.features import set_risk
from skyledger.plans.shared import spread

def confidence(p: Column) -> Column:
    top = F.greatest(p, 1.0 - p)
    return F.when(top >= 0.85, "high").when(top >= 0.65, "medium").otherwise("low")


def errors(df: DataFrame, actual: int, predicted: int) -> DataFrame:
    """False positives are (0, 1), false negatives (1, 0)."""
    return df.where((F.col("label") == actual) & (F.col("predicted") == predicted))


def disagreements(df: DataFrame, key: str = "object_key") -> DataFrame:
    """Objects with several predicted labels or a confident error, with reason and counts.

    A key has few rows, so a first aggregate would hold nearly every row: they are dealt out before it. The sets of a key's
    labels and models are small, and counted in the same tasks.
    """
    wrong = (F.col("confidence") == "high") & (F.col("label") != F.col("predicted"))
    rows = spread(df.select(key, "predicted", "model", "score", "confidence", "label"), key)
    out = rows.groupBy(key).agg(*[F.size(F.collect_set(c)).cast("long").alias(name) for c, name in (("predicted", "labels"), ("model", "models"))], F.count_if(wrong).alias("confident_errors"), F.max("score").alias("max_score"))
    out = out.where("labels > 1 or confident_errors > 0")
    return out.withColumn("reason", F.when(F.col("labels") > 1, "model_family_disagreement").otherwise("high_confidence_error"))


def best_bucket(df: DataFrame, key: str = "object_key") -> DataFrame:
    """The best confidence of each object, without high-leakage rows."""
    order = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    return df.where("leakage_risk <> 'high'").groupBy(key).agg(F.max_by("confidence", order).alias("best_confidence"))


def leakage_signals(metrics: DataFrame) -> DataFrame:
    """Best PR-AUC (else F1) of each feature set, side by side, and the three signals."""
    best = metrics.groupBy().pivot("feature_set", ["full_features", "no_definition_features", "definition_features_only"]).agg(F.max(F.coalesce("pr_auc", "f1")))
    full, rest, only = (F.col(c) for c in ("full_features", "no_definition_features", "definition_features_only"))
    return best.withColumns({"full_gap": full - rest >= 0.20, "definition_strong": only >= 0.85, "definition_gap": only - rest >= 0.20})


def best_models(metrics: DataFrame) -> DataFrame:
    """(scope, model, feature_set, value): the best overall and the best of low leakage."""
    value = F.coalesce("pr_auc", "f1")
    rows = metrics.withColumn("value", value).where("value is not null").withColumn("scope", F.explode(F.array(F.lit("overall"), F.when(set_risk(F.col("feature_set")) == "low", "defensible")))).where("scope is not null")
    first = F.row_number().over(W.partitionBy("scope").orderBy(F.desc("value"), "model", "feature_set"))
    return rows.withColumn("_n", first).where("_n = 1").select("scope", "model", "feature_set", "value")


def summary(df: DataFrame, key: str = "object_key") -> DataFrame:
    """Objects and models of each mode."""
    return df.groupBy("prediction_mode").agg(F.count_distinct(key).alias("objects"), F.count_distinct("model").alias("models"), F.count(F.lit(1)).alias("n_rows"))


def coverage(df: DataFrame, objects: DataFrame, key: str = "object_key") -> DataFrame:
    """(rows_full, objects_full, rows_eval, coverage_ratio): predictions of each mode, and the share of objects in the full one."""
    full = F.col("prediction_mode") == "full"
    counts = df.agg(F.count_if(full).alias("rows_full"), F.count_distinct(F.when(full, F.col(key))).alias("objects_full"), F.count_if(~full).alias("rows_eval"))
    total = objects.agg(F.count_distinct(key).alias("n"))
    return counts.join(F.broadcast(total)).withColumn("coverage_ratio", F.round(F.coalesce(F.try_divide(F.col("objects_full").cast("double"), F.col("n")), F.lit(0.0)), 6)).drop("n")


def attempts(log: DataFrame) -> DataFrame:
    """Counts of each status, coverage of the target and the run's status."""
    out = log.agg(F.count(F.lit(1)).alias("target"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped")])
    run = F.when(F.col("failed") == 0, "success").when(F.col("success") + F.col("skipped") > 0, "partial_success").otherwise("failed")
    return out.withColumns({"coverage": F.try_divide((F.col("success") + F.col("skipped")).cast("double"), F.col("target")), "run_status": run})


def finding(group: str, title: str, metric: str, value: Column) -> Column:
    return F.struct(F.lit(group).alias("finding_group"), F.lit(title).alias("title"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))


def findings(scored: DataFrame) -> DataFrame:
    """(finding_group, title, metric, value) rows of a scored table, in one pass."""
    flat = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("pha").alias("pha"), F.count_if("sentry_flag").alias("sentry"), F.count("diameter").alias("dia"), F.count("close_approach_count").alias("ca"),
        F.avg("risk_score").alias("mean"), F.max("risk_score").alias("max"), F.count_if(F.col("risk_score_0_100") >= 40).alias("high"),
    )
    c = F.col
    rows = [finding("dataset", "objects", "count", c("n")), finding("dataset", "hazardous", "count", c("pha")), finding("dataset", "impact monitoring", "count", c("sentry")),
            finding("dataset", "size coverage", "ratio", F.round(c("dia") / c("n"), 6)), finding("dataset", "approach coverage", "ratio", F.round(c("ca") / c("n"), 6)),
            finding("risk", "score", "mean", F.round(c("mean"), 6)), finding("risk", "score", "max", F.round(c("max"), 6)), finding("risk", "elevated or above", "count", c("high"))]
    return flat.select(F.explode(F.array(*rows)).alias("f")).select("f.*")
