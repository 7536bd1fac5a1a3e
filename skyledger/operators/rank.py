"""Rankings, lookups and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions.columns import flag
from skyledger.operators.quantiles import medians
from skyledger.operators.score import dominant_driver
from skyledger.plans.shared import materialised

ORDER = ["risk_score_0_100", "uncertainty_risk_component", "sentry_risk_component"]
PROBES = ["object_key", "spkid", "des", "full_name", "name"]


def order(df: DataFrame, key: str = "object_key") -> list[Column]:
    """Score, uncertainty and sentry components, descending (missing columns count as 0), then the key."""
    return [F.desc_nulls_last(c) for c in ORDER if c in df.columns] + [F.col(key)]


def rank(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in rank order; with a limit one top-k, not a sort of everything."""
    out = df.orderBy(*order(df))
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def top_by_category(df: DataFrame, limit: int = 20, category: str | None = None) -> DataFrame:
    """The best rows of each category (or of one, whatever its case), with their place."""
    if category is not None:
        df = df.where(F.lower("risk_category") == category.lower())
    place = F.row_number().over(W.partitionBy("risk_category").orderBy(*order(df)))
    return df.withColumn("place", place).where(F.col("place") <= limit)


def selected(df: DataFrame, category: str | None = None, sentry: bool | None = None, pha_only: bool = False, min_score: float | None = None, contains: str | None = None) -> DataFrame:
    """Rows by category, sentry flag (null counts as false), hazard flag, least score and a substring of key or name."""
    if category is not None:
        df = df.where(F.lower("risk_category") == category.lower())
    if sentry is not None:
        df = df.where(F.coalesce(flag("sentry_flag"), F.lit(False)) == sentry)
    if pha_only:
        df = df.where(F.coalesce(flag("pha"), F.lit(False)))
    if min_score is not None:
        df = df.where(F.col("risk_score_0_100") >= min_score)
    if contains:
        names = [c for c in ("object_key", "des", "full_name") if c in df.columns]
        df = df.where(F.contains(F.lower(F.concat_ws("\n", *names)), F.lit(contains.lower())))
    return df


def page(df: DataFrame, limit: int = 50, offset: int = 0, **how) -> DataFrame:
    return rank(selected(df, **how), limit, offset).withColumn("dominant_driver", dominant_driver())


def lookup(df: DataFrame, probes: DataFrame, probe: str = "probe") -> DataFrame:
    """For each probe the row of the first column (of key, ids and names) that holds it; one join for all columns."""
    columns = [c for c in PROBES if c in df.columns]
    sought = F.explode(F.array(*[F.struct(F.lit(k).alias("priority"), F.col(c).cast("string").alias("_v")) for k, c in enumerate(columns)]))
    found = df.withColumn("_s", sought).where("_s._v is not null").withColumns({"_v": F.col("_s._v"), "priority": F.col("_s.priority")}).drop("_s")
    hit = probes.select(probe).distinct().join(found, F.col(probe) == F.col("_v"))
    first = F.row_number().over(W.partitionBy(probe).orderBy("priority", "object_key"))
    return hit.withColumn("_n", first).where("_n = 1").drop("_n", "_v")


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key by ``by``."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in by]))
    return df.withColumn("_n", last).where("_n = 1").drop("_n")


def summary(df: DataFrame) -> DataFrame:
    """Rows, least, mean, median (exact) and greatest score (null counts as 0) and the top object."""
    narrow = materialised(df.select("object_key", F.coalesce("risk_score_0_100", F.lit(0.0)).alias("s")), "ranked")
    middle = medians(narrow, ["s"])["s"]
    return narrow.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("s").alias("min_score"), F.avg("s").alias("mean_score"), F.lit(middle).cast("double").alias("median_score"), F.max("s").alias("max_score"),
        F.min(F.struct((-F.col("s")).alias("s"), "object_key"))["object_key"].alias("top_object"),
    )


def value_counts(df: DataFrame, column: str, missing: str | None = "unknown") -> DataFrame:
    """Rows of each value; nulls under ``missing``, or left out."""
    value = F.col(column).cast("string")
    df = df.where(value.isNotNull()) if missing is None else df
    return df.groupBy((value if missing is None else F.coalesce(value, F.lit(missing))).alias("value")).agg(F.count(F.lit(1)).alias("n"))
