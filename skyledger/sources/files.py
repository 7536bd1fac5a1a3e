"""Paths of any file system that Spark reads: whether one is there, and tables swapped in after they are written."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path) as Hadoop sees it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, found = _at(spark, path)
    return system.exists(found)


def removed(spark: SparkSession, path: str) -> None:
    system, found = _at(spark, path)
    system.delete(found, True)


def swapped(spark: SparkSession, new: str, path: str) -> None:
    """``new`` in the place of ``path``; the old table is there until the new one is whole."""
    system, target = _at(spark, path)
    system.delete(target, True)
    if not system.rename(_at(spark, new)[1], target):
        raise OSError(f"{new} could not be renamed to {path}")
