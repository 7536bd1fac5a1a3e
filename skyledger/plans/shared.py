"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir (in local mode, where that is unset, in a folder of our own)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or f"{tempfile.gettempdir()}/checkpoints")
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Removes a table of ``materialised`` that nothing reads any more."""
    spark, files = table.sparkSession, table.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, key: str, least: int = 0) -> DataFrame:
    """``df`` by ``key`` in as many tasks as a shuffle has (``least`` or more), however small its rows are: each stands for much work."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


@contextlib.contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs started within run projections of many columns as small methods, which the JVM compiles.

    Fused to one method of over 8000 bytes of code they stay interpreted, at ten times the time.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, 8000)
    try:
        yield
    finally:
        spark.conf.set(name, before)
