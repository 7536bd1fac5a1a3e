"""Composed runs: captures to silver tables, those to gold features and scores, each run with a manifest in the run log."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.columns import flag
from skyledger.operators import gold, quality, score
from skyledger.sources import bronze, files, silver, sinks

#: Tables of each source, and what makes them from its captures.
SOURCES: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {
    "objects": {"objects": silver.objects}, "approaches": {"approaches": silver.approaches}, "sentry": {"sentry": silver.summaries, "impactors": silver.impactors},
}
# Least rows and positives of a table to learn from; checks of the gold table.
MIN_ROWS, MIN_POSITIVE, TARGET = 100, 5, "pha"
REQUIRED, NULLS, RANGES = ["object_key", "h", "diameter", "moid"], ["h", "diameter", "moid", "min_close_approach_dist"], {"e": (0.0, None), "moid": (0.0, None), "diameter": (0.0, None), "feature_completeness_ratio": (0.0, 1.0)}


@dataclass
class Step:
    """What a layer wrote: (layer, name, status, row_count) of each table, and what went amiss."""

    tables: list[tuple[str, str, str, int]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def wrote(self, layer: str, name: str, df: DataFrame, root: str) -> int:
        done = sinks.write_table(df, f"{root}/{name}")
        self.tables.append((layer, name, done["status"], done["row_count"]))
        return done["row_count"]

    def status(self) -> str:
        """failed with errors and nothing written, partial_success with errors or warnings, else success."""
        written = any(t[2] == "written" for t in self.tables)
        return "failed" if self.errors and not written else "partial_success" if self.errors or self.warnings else "success"


def combined(first: str, second: str) -> str:
    """The status of two runs, one after the other."""
    both = {first, second}
    if "failed" in both:
        return "failed"
    if "insufficient_data" in both:
        return "partial_success" if first == "success" else "insufficient_data"
    return "partial_success" if "partial_success" in both else "success"


def to_silver(spark: SparkSession, bronze_root: str, silver_root: str, source: str | None = None) -> Step:
    """Every table of every source (or of one), and a row for each capture. A source without captures is a warning."""
    step, found = Step(), None
    for name in SOURCES if source is None else [source]:
        try:
            captures = bronze.read(spark, bronze_root, source=name)
        except bronze.SourceNotFound as missing:
            (step.warnings if source is None else step.errors).append(str(missing))
            continue
        own = silver.events(captures)
        found = own if found is None else found.unionByName(own)
        for table, make in SOURCES[name].items():
            if not step.wrote("silver", table, make(captures), silver_root):
                step.warnings.append(f"{name} has no rows for {table}")
    if found is not None:
        step.wrote("silver", "events", found, silver_root)
    return step


def to_gold(spark: SparkSession, silver_root: str, gold_root: str, min_rows: int = MIN_ROWS, min_positive: int = MIN_POSITIVE, target: str = TARGET) -> Step:
    """Gold features, their quality report and scores, from the silver tables that are there."""
    step = Step()
    there = {t: spark.read.parquet(f"{silver_root}/{t}") if files.exists(spark, f"{silver_root}/{t}") else None for t in ("objects", "approaches", "sentry")}
    if not any(df is not None for df in there.values()):
        step.errors.append("there is no silver table to build features from")
        return step
    base = gold.base_relation(there["objects"], there["sentry"], there["approaches"])
    rows = step.wrote("gold", "features", gold.derived(gold.with_sentry(gold.with_approaches(base, there["approaches"]), there["sentry"], unique=True)), gold_root)
    if not rows:
        step.errors.append("the gold table is empty")
        return step
    features = spark.read.parquet(f"{gold_root}/features")
    checks = quality.report(features, ["object_key"], REQUIRED, NULLS, RANGES)
    step.wrote("gold", "quality", checks, gold_root)
    verdict = quality.verdict(spark.read.parquet(f"{gold_root}/quality")).first().status
    if verdict != "pass":
        (step.errors if verdict == "fail" else step.warnings).append(f"quality checks: {verdict}")
    positive = features.where(flag(target)).count()
    if rows < min_rows:
        step.warnings.append(f"{rows} rows, {min_rows} are needed to learn from")
    if positive < min_positive:
        step.warnings.append(f"{positive} positives, {min_positive} are needed to learn from")
    step.wrote("gold", "scores", score.scored(features), gold_root)
    return step


def run_all(spark: SparkSession, bronze_root: str, out_root: str, log: str | None = None) -> dict:
    """Silver, gold and scores under ``out_root``; the manifest is appended to the run log and returned.

    What raises ends the run as failed, with the tables written before it and the error in the manifest.
    """
    started, steps = datetime.now(UTC), []
    try:
        steps.append(to_silver(spark, bronze_root, f"{out_root}/silver"))
        steps.append(to_gold(spark, f"{out_root}/silver", f"{out_root}/gold"))
        whole = Step(*[[x for s in steps for x in getattr(s, part)] for part in ("tables", "warnings", "errors")])
        status = whole.status()
    except Exception as error:  # the manifest of a failed run is what tells of it
        whole = Step(*[[x for s in steps for x in getattr(s, part)] for part in ("tables", "warnings", "errors")])
        whole.errors.append(str(error)[:1000])
        status = "failed"
    run = {"run_id": f"etl_{started:%Y%m%dT%H%M%S%f}_{uuid.uuid4().hex[:8]}", "run_type": "etl", "started_at": started, "ended_at": datetime.now(UTC), "status": status,
           "tables": whole.tables, "warnings": whole.warnings, "errors": whole.errors}
    sinks.log_run(spark, log or f"{out_root}/runs", run)
    return run


def rollup(log: DataFrame) -> DataFrame:
    """(run_id, run_type, status, layer, n_tables, n_written, row_count) of each layer of each run."""
    rows = log.select("run_id", "run_type", "status", F.explode_outer("tables").alias("t"))
    return rows.groupBy("run_id", "run_type", "status", F.col("t.layer").alias("layer")).agg(
        F.count("t").alias("n_tables"), F.count_if(F.col("t.status") == "written").alias("n_written"), F.sum("t.row_count").alias("row_count")
    )
