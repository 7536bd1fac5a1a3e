"""Data-quality checks and profiles, each in one pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import flag, number
from skyledger.operators.quantiles import medians
from skyledger.plans.shared import materialised


def _long(df: DataFrame, rows: list[tuple[str, str, str]], kinds: list[str]) -> DataFrame:
    """One row for each named aggregate of a one-row frame: (check, column, metric, value)."""
    cells = [F.struct(F.lit(a).alias("check"), F.lit(b).alias("column_name"), F.lit(c).alias("metric"), F.col(k).cast("double").alias("value")) for (a, b, c), k in zip(rows, kinds)]
    return df.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def report(df: DataFrame, keys: list[str], required: list[str], null_columns: list[str], ranges: dict[str, tuple[float | None, float | None]], max_null: float = 0.95) -> DataFrame:
    """(check, column_name, metric, value, status): required columns, rows, null ratios, duplicate keys and ranges.

    All but the duplicates come from one aggregate. fail: a required column is missing or there is no row; warn: a
    column is missing or mostly null, keys repeat, or values lie outside their range.
    """
    aggs, rows = [F.count(F.lit(1)).alias("m0")], [("non_empty", "", "row_count")]
    for c in null_columns:
        rows.append(("null_ratio", c, "ratio"))
        aggs.append((F.avg(F.col(c).isNull().cast("double")) if c in df.columns else F.lit(None).cast("double")).alias(f"m{len(aggs)}"))
    for c, (low, high) in ranges.items():
        for name, bad in (("below_min", None if low is None else F.col(c) < low), ("above_max", None if high is None else F.col(c) > high)):
            if bad is not None:
                rows.append(("range", c, name))
                aggs.append((F.sum(F.when(bad, 1).otherwise(0)) if c in df.columns else F.lit(None).cast("double")).alias(f"m{len(aggs)}"))
    out = _long(df.agg(*aggs), rows, [f"m{k}" for k in range(len(aggs))])
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum((F.col("n") > 1).cast("int")).alias("m0"))
    out = out.unionByName(_long(repeated, [("duplicate_keys", ",".join(keys), "keys")], ["m0"]))
    present = df.sparkSession.createDataFrame([("required", c, "present", float(c in df.columns)) for c in required] or [("required", "", "present", 1.0)], out.schema)
    value = F.col("value")
    status = F.when((F.col("check") == "required") & (value == 0), "fail").when((F.col("check") == "non_empty") & (value == 0), "fail")
    status = status.when(value.isNull(), "warn").when((F.col("check") == "null_ratio") & (value > max_null), "warn")
    status = status.when(F.col("check").isin("duplicate_keys", "range") & (value > 0), "warn").otherwise("pass")
    return out.unionByName(present).withColumn("status", status)


def verdict(checks: DataFrame) -> DataFrame:
    """The worst status of a report."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    return checks.agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("n_checks")).select(
        F.when(F.col("r") == 2, "fail").when(F.col("r") == 1, "warn").otherwise("pass").alias("status"), "n_checks"
    )


def missingness(df: DataFrame, columns: list[str], limit: int | None = 20) -> DataFrame:
    """(column_name, missing, ratio) of the columns with missing values, the most missing first."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("long").alias("missing"), (F.col(c) / F.col("_n")).alias("ratio")) for c in columns])).alias("r")
    out = wide.select(cells).select("r.*").where("missing > 0").orderBy(F.desc("ratio"), "column_name")
    return out if limit is None else out.limit(limit)


def bool_distribution(df: DataFrame, column: str) -> DataFrame:
    f = flag(column)
    return df.agg(F.count_if(f).alias("n_true"), F.count_if(~f).alias("n_false"), F.count_if(f.isNull()).alias("n_unknown"))


def coverage(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(name, covered, ratio): rows in which any of a group's columns has a value."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(*[F.col(c).cast("string") for c in cs]).isNotNull()).alias(g) for g, cs in groups.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("name"), F.col(g).alias("covered"), F.try_divide(F.col(g), F.col("_n")).alias("ratio")) for g in groups])).alias("r")
    return wide.select(cells).select("r.*")


def target_volume(df: DataFrame, target: str, min_rows: int = 100, min_positive: int = 5) -> DataFrame:
    """Rows, positives, negatives, missing, rate, status and warnings of a binary target."""
    y = flag(target)
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(y).alias("positive"), F.count_if(~y).alias("negative"), F.count_if(y.isNull()).alias("missing"))
    labelled = F.col("positive") + F.col("negative")
    status = F.when(labelled == 0, "missing_target").when((F.col("positive") == 0) | (F.col("negative") == 0), "single_class")
    status = status.when(labelled < min_rows, "insufficient_data").otherwise("ok")
    warnings = F.filter(F.array(F.when(F.col("n_rows") < min_rows, "few_rows"), F.when(F.col("positive") < min_positive, "few_positives")), lambda x: x.isNotNull())
    return out.withColumns({"positive_rate": F.try_divide(F.col("positive"), labelled), "status": status, "warnings": F.concat_ws(",", warnings)})


def readiness_band(n) -> object:
    return F.when(n >= 4000, "strong").when(n >= 300, "usable").when(n >= 100, "minimal").otherwise("not_ready")


def readiness(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, n_rows, band) of each table."""
    out = None
    for name, df in layers.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("layer"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("band", readiness_band(F.col("n_rows")))


# Columns that a graph is built from, and how many of them it needs.
GRAPH_COLUMNS, GRAPH_NEEDS, LEAST_ROWS = ["e", "a", "q", "i", "moid"], 3, 100


def consumers(features: DataFrame, scored: DataFrame, target: str = "pha") -> DataFrame:
    """(consumer, n_rows, status): how ready the tables are for each of their uses, by the bands of ``readiness_band``.

    Models need both labels, graphs also enough of ``GRAPH_COLUMNS``; with too few rows neither is ready.
    """
    y = flag(target) if target in features.columns else F.lit(None).cast("boolean")
    one = features.agg(F.count(F.lit(1)).alias("gold"), F.count_if(y).alias("yes"), F.count_if(~y).alias("no"))
    one = one.join(F.broadcast(scored.agg(F.count(F.lit(1)).alias("risk"))))  # one row beside one row
    ranked = F.when(F.col("risk") > 0, F.col("risk")).otherwise(F.col("gold"))
    both = (F.col("yes") > 0) & (F.col("no") > 0)
    columns = F.lit(sum(c in features.columns for c in GRAPH_COLUMNS) >= GRAPH_NEEDS)
    needs = lambda n, ok: F.when(n < LEAST_ROWS, "not_ready").when(~ok, "minimal").otherwise(readiness_band(n))
    uses = {"overall": (F.col("gold"), readiness_band(F.col("gold"))), "models": (F.col("gold"), needs(F.col("gold"), both)), "leakage": (F.col("gold"), needs(F.col("gold"), both)),
            "ranking": (ranked, readiness_band(ranked)), "simulation": (F.col("risk"), readiness_band(F.col("risk"))), "graph": (ranked, needs(ranked, columns & both)), "reports": (ranked, readiness_band(ranked))}
    cells = F.array(*[F.struct(F.lit(k).alias("consumer"), n.alias("n_rows"), s.alias("status")) for k, (n, s) in uses.items()])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def targets(df: DataFrame, sizes: tuple[int, ...] = (1000, 4000)) -> DataFrame:
    """(target, n_rows, available): whether the table has as many rows as each target asks for."""
    have = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array(*[F.lit(s) for s in sizes])).alias("target"), "n_rows")
    return have.withColumn("available", F.col("n_rows") >= F.col("target"))


def impute_scale(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``key`` and the columns with medians for missing values, centred and divided by the population deviation (or 1).

    Columns without any value are dropped. The statistics are one row, so they are part of the plan as literals.
    """
    values = materialised(df.select(key, *[number(c).alias(c) for c in columns]), "numbers")
    middle = {c: m for c, m in medians(values, columns).items() if m is not None}
    filled = values.select(key, *[F.coalesce(c, F.lit(m)).alias(c) for c, m in middle.items()])
    if not middle:
        return filled
    stats = filled.agg(*[F.avg(c).alias(f"a_{c}") for c in middle], *[F.stddev_pop(c).alias(f"s_{c}") for c in middle]).first()
    return filled.select(key, *[((F.col(c) - stats[f"a_{c}"]) / (stats[f"s_{c}"] or 1.0)).alias(c) for c in middle])
