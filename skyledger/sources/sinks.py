"""Table sinks: data and row count, append history, top-n CSV, prediction bundles and run logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.evidence import disagreements
from skyledger.operators.rank import latest, rank
from skyledger.sources import files

LOG = """run_id string, run_type string, started_at timestamp, ended_at timestamp, status string,
 tables array<struct<layer:string,name:string,status:string,row_count:bigint>>, warnings array<string>, errors array<string>"""


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> dict:
    """Writes ``df``; returns path, mode, row_count and status. An empty ``df`` is skipped and leaves the old table alone.

    Rows are counted by the job that writes them. An overwrite goes to a folder beside the table, which takes its place
    only when it is whole and not empty, so a failure leaves the old table and ``df`` may read it.
    """
    spark, seen = df.sparkSession, Observation()
    target = path if mode == "append" else f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    rows = seen.get.get("n") or 0
    if mode != "append":
        if rows:
            files.swapped(spark, target, path)
        else:
            files.removed(spark, target)
    return {"path": path, "mode": mode, "row_count": rows, "status": "written" if rows else "skipped_empty"}


def append_latest(spark: SparkSession, frames: list[DataFrame], path: str, keys: list[str], by: list[str]) -> DataFrame:
    """Appends frames to a history and reads the latest row of each key."""
    for df in frames:
        df.write.mode("append").parquet(path)
    return latest(spark.read.schema(frames[0].schema).parquet(path), keys, by)


def write_results(df: DataFrame, path: str, without: tuple[str, ...] = ("distance_trace",)) -> dict:
    """Results without their traces."""
    return write_table(df.drop(*without), path)


def write_scored(df: DataFrame, path: str, limit: int = 50) -> dict:
    """The scored table, beside it its best rows as one CSV, and a summary of one JSON row: rows, categories, greatest score."""
    done = write_table(df, f"{path}/scores")
    if done["row_count"]:
        saved = df.sparkSession.read.schema(df.schema).parquet(f"{path}/scores")
        plain = [c for c, t in df.dtypes if not t.startswith(("array", "struct", "map"))]
        rank(saved, limit).select(*plain).coalesce(1).write.mode("overwrite").csv(f"{path}/top", header=True)
        kinds = saved.groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"), F.max("risk_score_0_100").alias("max_score"))
        whole = kinds.agg(F.sum("n").alias("n_rows"), F.max("max_score").alias("max_score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_category", "n")))).alias("categories"))
        whole.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return done


def write_metrics(df: DataFrame, path: str, struct: str = "metrics") -> None:
    """One CSV of results, the metrics struct flattened into columns."""
    rest = [c for c in df.columns if c != struct]
    df.select(*rest, f"{struct}.*").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges, a table each."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


#: Columns of a bundle's folders; a reader of a subset reads only its folders. A folder has a file for so many tasks.
SUBSETS, TASKS_A_FILE = ["prediction_mode", "confidence", "error_kind"], 8


def write_bundle(predictions: DataFrame, path: str, key: str = "object_key") -> dict:
    """Predictions in one pass by mode, confidence and error kind, and the disagreements of the full mode beside them.

    A task sorts its rows by folder, so they are dealt out to as many tasks as a shuffle has, in parts of folders.
    """
    label, predicted = F.col("label"), F.col("predicted")
    kind = F.when(label == predicted, "none").when(predicted == 1, "false_positive").when(predicted == 0, "false_negative").otherwise("unknown")
    rows = predictions if "error_kind" in predictions.columns else predictions.withColumn("error_kind", kind)
    tasks = int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, *SUBSETS, F.pmod(F.xxhash64(key), F.lit(-(-tasks // TASKS_A_FILE))))
    done = write_table(dealt, f"{path}/predictions", partition_by=SUBSETS)
    if done["row_count"]:
        found = disagreements(read_bundle(predictions.sparkSession, path, rows), key)
        done["disagreements"] = write_table(found, f"{path}/disagreements")["row_count"]
    return done


def read_bundle(spark: SparkSession, path: str, like: DataFrame | str, mode: str = "full", confidence: str | None = None, error: str | None = None, defensible: bool = False) -> DataFrame:
    """Saved predictions of a mode (any but ``eval`` is full), of a confidence, of an error kind, without high leakage risk.

    ``like`` is their schema. A bundle that isn't there reads as no rows.
    """
    schema = like.schema if isinstance(like, DataFrame) else like
    if not files.exists(spark, f"{path}/predictions"):
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema).parquet(f"{path}/predictions").where(F.col("prediction_mode") == ("eval" if mode == "eval" else "full"))
    for column, value in (("confidence", confidence), ("error_kind", error)):
        out = out if value is None else out.where(F.col(column) == value)
    return out.where("leakage_risk <> 'high'") if defensible else out


def read_disagreements(spark: SparkSession, path: str) -> DataFrame | None:
    """Saved disagreements; None if there are none."""
    return spark.read.parquet(f"{path}/disagreements") if files.exists(spark, f"{path}/disagreements") else None


def object_evidence(spark: SparkSession, path: str, like: DataFrame | str, objects: DataFrame, key: str = "object_key", mode: str = "full") -> DataFrame:
    """(key, predictions, reason, status) of each of ``objects``: what the bundle holds of them, not_found where nothing."""
    rows = read_bundle(spark, path, like, mode).join(objects.select(key).distinct(), key, "left_semi")
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("model", "feature_set", "score", "predicted", "confidence"))).alias("predictions"))  # as many as there are models
    saved = read_disagreements(spark, path)
    reasons = objects.select(key, F.lit(None).cast("string").alias("reason")).where("false") if saved is None else saved.select(key, "reason")
    out = objects.select(key).distinct().join(held, key, "left").join(reasons, key, "left")
    return out.withColumn("status", F.when(F.col("predictions").isNotNull() | F.col("reason").isNotNull(), "success").otherwise("not_found"))


def log_run(spark: SparkSession, path: str, run: dict) -> None:
    """Appends a run (a dict of ``LOG``'s columns) to the run log."""
    spark.createDataFrame([run], LOG).coalesce(1).write.mode("append").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], LOG)


def first_available(spark: SparkSession, frames: list[DataFrame | str | None], schema: str) -> DataFrame:
    """The first relation (a DataFrame or the path of a table) that is there and has a row, else an empty one of ``schema``."""
    for df in frames:
        if isinstance(df, str):
            df = spark.read.schema(schema).parquet(df) if files.exists(spark, df) else None
        if df is not None and not df.isEmpty():
            return df
    return spark.createDataFrame([], schema)
