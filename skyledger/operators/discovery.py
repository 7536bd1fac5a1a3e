"""Candidates for intake: seeds, columns of tables, unpacked records; one row for each designation, by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions.columns import designation
from skyledger.sources.bronze import unique_by_priority

# Seed designations, in order.
SEED = "99942 433 101955 162173 3200 1862 4179 3122 1685 2101".split()
# Identifiers of a record, the preferred first.
PREFERRED = ["spkid", "pdes", "des", "full_name", "name"]


def seed(spark: SparkSession, limit: int | None = None) -> DataFrame:
    """(place, row, candidate) of the curated objects, the first ``limit`` of them."""
    names = SEED if limit is None else SEED[:limit]
    return spark.createDataFrame([(0, k, name) for k, name in enumerate(names)], "place int, row long, candidate string")


def from_columns(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """(place, row, candidate): the columns one after the other, each in the order of ``row``; blank values are left out."""
    cells = df.select(F.col(row).cast("long").alias("row"), F.posexplode(F.array(*[designation(c) for c in columns])).alias("place", "candidate"))
    return cells.where("candidate is not null").select("place", "row", "candidate")


def from_records(df: DataFrame, fields: list[str], row: str, record: str = "record") -> DataFrame:
    """``from_columns`` over a column of unpacked records (maps by lower-case field name)."""
    named = df.select(row, *[F.try_element_at(record, F.lit(f)).alias(f"f{k}") for k, f in enumerate(fields)])
    return from_columns(named, [f"f{k}" for k in range(len(fields))], row)


def preferred(record: str = "record", fields: list[str] = PREFERRED) -> Column:
    """The first identifier of a record that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(record, F.lit(f))), F.lit("")) for f in fields])


def extended(frames: list[DataFrame]) -> DataFrame:
    """(source, place, row, candidate): each candidate once, from the first frame, column and row that has it."""
    union = None
    for k, df in enumerate(frames):
        one = df.select(F.lit(k).alias("source"), F.col("place").cast("int").alias("place"), "row", "candidate")
        union = one if union is None else union.unionByName(one)
    return unique_by_priority(union, F.col("candidate"), [F.col("source"), F.col("place"), F.col("row")])


def filled(candidates: DataFrame, existing: DataFrame, key: str, target: int) -> DataFrame:
    """New candidates by priority, as many as ``existing`` lacks of ``target`` objects."""
    have = existing.select(F.col(key).cast("string").alias("candidate")).distinct()
    room = max(0, target - have.count())
    return candidates.join(have, "candidate", "left_anti").orderBy("source", "place", "row").limit(room)


def new_counts(candidates: DataFrame, sources: int) -> DataFrame:
    """(source, n_new, n_so_far): the candidates that each of so many sources adds to those before it, 0 too."""
    spark = candidates.sparkSession
    found = candidates.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(sources).select(F.col("id").cast("int").alias("source")).join(found, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n_new"))
    return every.withColumn("n_so_far", F.sum("n_new").over(W.orderBy("source")))  # a row for each source
