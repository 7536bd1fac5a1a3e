"""Helpers shared by the corpus operators: shared-folder tables, checked joins and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Table ``name`` of ``sf_dir``; with ``columns``, only those (so that clashing extra columns never reach an operator)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or f"{tempfile.gettempdir()}/checkpoints")
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(table: DataFrame) -> None:
    """Removes a table of ``written`` that nothing reads any more, so that disk is free for the next ones."""
    spark, files = table.sparkSession, table.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> str | list[str]:
    """For each name one like it that no column of ``df`` has, whatever its case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}".lower() in have:
            name = f"_{name}"
        out.append(f"_{name}")
    return out[0] if len(out) == 1 else out


def crc32_of(column: Column | str) -> Column:
    """Unsigned CRC-32 of a value's text in UTF-8; of no bytes for null."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``: the split of documents into learned and held-out ones."""
    return crc32_of(doc_id) % modulus


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (id, component), the component being its smallest id.

    Each round hooks every node to its smallest smaller neighbour, then contracts the edges to the hooked nodes, so
    edges only shrink and a star is done in one round. All groupings are minima, combined before the shuffle, and each
    round's tables are written to the shared folder. Only ids that have an edge to another id are returned.
    """
    edges = written(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges"
    )
    labels = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = labels.withColumn("component", F.col("id"))
    while not edges.isEmpty():
        parents = written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents")
        hop = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parents = written(
            parents.join(hop, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")), "parents"
        )
        labels = written(
            labels.join(parents, labels.component == parents.node, "left").select(
                "id", F.coalesce("parent", "component").alias("component")
            ),
            "labels",
        )
        to_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        to_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(to_b, "b").join(to_a, "a", "left").select(F.coalesce("pa", "a").alias("x"), F.col("pb").alias("y"))
        edges = written(
            moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
    return labels
