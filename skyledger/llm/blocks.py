"""All members of a bucket against each other, in blocks: no task holds more than two blocks, however large the bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
#: Weight of a block of ``across``.
WIDE = 4096


def dealt(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (bucket, node, size, ...) for each pair (i, j) of blocks, i <= j, with side 0 for block i and 1 for block j."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = members.withColumn("_mine", F.pmod(F.xxhash64("node", F.lit(17)), blocks).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns(
        {"i": F.least("_mine", "_other"), "j": F.greatest("_mine", "_other"), "side": (F.col("_mine") > F.col("_other")).cast("int")}
    ).drop("_mine", "_other", "size")


def across(members: DataFrame, block: int = WIDE) -> DataFrame:
    """Rows (bucket, node, label, i, j, side) for the pairs of blocks that can hold rows of unlike labels.

    members: (bucket, node, label, weight). A bucket's weight gives its number of blocks. The rows of its heaviest label
    have blocks of their own, which are not paired with each other; a bucket of one block's weight is one block.
    """
    of_label = members.groupBy("bucket", "label").agg(F.sum("weight").alias("weight"))
    of_bucket = of_label.groupBy("bucket").agg(F.sum("weight").alias("all"), F.max(F.struct("weight", "label")).alias("top"))
    count = lambda weight: F.ceil(weight / block).cast("int")
    single = F.col("all") <= block
    shape = of_bucket.select(
        "bucket", F.when(single, F.lit(None)).otherwise(F.col("top.label")).alias("top"), F.when(single, 0).otherwise(count(F.col("top.weight"))).alias("tops"),
        F.when(single, 1).otherwise(count(F.col("all") - F.col("top.weight"))).alias("others"),
    )
    rows = members.join(shape, "bucket").withColumn("is_top", F.coalesce(F.col("label") == F.col("top"), F.lit(False)))
    draw = F.xxhash64("node", F.lit(17))
    rows = rows.withColumn("mine", F.when(F.col("is_top"), F.pmod(draw, "tops")).otherwise(F.col("tops") + F.pmod(draw, F.greatest("others", F.lit(1)))).cast("int"))
    partners = F.when(F.col("is_top"), F.sequence("tops", F.col("tops") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("tops") + F.col("others") - 1))
    rows = rows.withColumn("other", F.explode(partners))
    return rows.select(
        "bucket", "node", "label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side")
    )


def arranged(rows: DataFrame) -> DataFrame:
    """Dealt rows with those of a pair of blocks together, for ``each``."""
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def each(batches: Iterator[pa.RecordBatch], kernel: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """kernel(rows, a, b) for each pair of blocks of sorted rows; a and b are the row numbers of its two sides.

    Within one block a and b are the same rows.
    """
    held: pa.Table | None = None

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sides = rows.column("side").to_numpy()
        same = rows.column("i")[0] == rows.column("j")[0]
        a, b = (np.arange(len(sides)),) * 2 if same else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
        out = kernel(rows, a, b) if len(a) and len(b) and rows.num_rows > 1 else None
        if out is not None:
            yield out

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        key = np.stack([held.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")])
        starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for s, e in zip(starts, starts[1:]):
            yield from compared(held.slice(s, e - s))
        held = held.slice(starts[-1])
    if held is not None:
        yield from compared(held)
