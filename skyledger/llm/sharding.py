"""Sharding (native): a Feistel permutation with cycle walking over global row numbers.

Every row gets a dense global number, a keyed permutation of [0, N) moves it to a position, and position p lies in
shard ``p mod n_shards`` at slot ``p div n_shards``. So shard sizes differ by one row at most, slots have no gaps, the
same rows give the same shards under any partitioning, and the place of a row number is computable both ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import crc32_of

#: Hash buckets of the row numbering: rows are only ever sorted within one of them.
BUCKETS = 4096
#: Copies of a row that are expanded at a time.
PIECE = 65_536
ROUNDS = 6
#: Walks tried on any position before the loop that covers a cycle of any length.
WALKS = 3


def _digest(text: Column) -> Column:
    """The first 52 bits of md5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _div(x: Column, y: Column) -> Column:
    """Whole-number division; a double quotient would lose the last digits of large longs."""
    return F.call_function("div", x.cast("long"), y.cast("long"))


def row_numbers(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``df`` reduced to ``keys`` plus row_number (from 0, dense) and n_rows (N).

    The order is (hash bucket, keys). Rows equal in all keys are counted before the shuffle and expanded after it, so a
    row that repeats often stays one row in the sort; they take consecutive numbers. Nulls in keys are values of their
    own. The bucket offsets are one row for each of ``buckets`` buckets, so their broadcast is bounded.
    """
    named = [F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in keys]
    bucket = (_digest(F.concat_ws("\1", *named)) % buckets).cast("int")
    rows = df.select(*keys).withColumn("_bucket", bucket).groupBy("_bucket", *keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = rows.groupBy("_bucket").agg(F.sum("_n").alias("_size")).select(
        "_bucket",
        F.expr("coalesce(sum(_size) over (order by _bucket rows between unbounded preceding and 1 preceding), 0)").alias("_first"),
        F.expr("sum(_size) over ()").alias("n_rows"),
    )
    order = ", ".join(f"`{k}`" for k in keys)
    before = F.expr(f"coalesce(sum(_n) over (partition by _bucket order by {order} rows between unbounded preceding and 1 preceding), 0)")
    placed = rows.withColumn("_before", before).join(F.broadcast(sizes), "_bucket")
    # In two steps, so that the numbers of a row that repeats very often are never one array.
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(PIECE).cast("long"))).alias("_from")
    pieces = placed.select(*keys, (F.col("_first") + F.col("_before")).alias("_start"), "_n", "n_rows", piece)
    last = F.least(F.col("_from") + PIECE, F.col("_n")) - 1
    return pieces.select(*keys, F.explode(F.sequence(F.col("_start") + F.col("_from"), F.col("_start") + last)).alias("row_number"), "n_rows")


def _sides(n: Column) -> tuple[Column, Column]:
    """a * b >= n with b = ceil(n / a), a near the root of n; a * b - n < a, so few positions fall outside [0, n)."""
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("long"))
    return a, F.greatest(F.lit(1), _div(n + a - 1, a))


def _once(x: Column, a: Column, b: Column, seed: int, rounds: int, back: bool = False) -> Column:
    """One pass of the alternating Feistel network over pairs (i, j) = (x mod a, x div a), i < a, j < b."""
    order = range(rounds - 1, -1, -1) if back else range(rounds)
    pair = F.struct((x % a).alias("i"), _div(x, a).alias("j"))
    keys = F.array(*[F.lit(k) for k in order])

    def turn(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        other = F.when(even, s["j"]).otherwise(s["i"])
        width = F.when(even, a).otherwise(b)
        shift = _digest(F.concat_ws(":", F.lit(str(seed)), k.cast("string"), other.cast("string"))) % width
        moved = F.when(even, s["i"]).otherwise(s["j"])
        moved = (moved - shift + width if back else moved + shift) % width
        return F.struct(
            F.when(even, moved).otherwise(s["i"]).alias("i"), F.when(even, s["j"]).otherwise(moved).alias("j")
        )

    return F.aggregate(keys, pair, turn, lambda s: s["i"] + s["j"] * a)


def permuted(df: DataFrame, number: str, n: str, out: str, seed: int = 7, rounds: int = ROUNDS, back: bool = False) -> DataFrame:
    """``df`` with column ``out``: where the permutation of [0, n) moves ``number`` (with ``back``: the inverse).

    A value that leaves [0, n) is passed through the network again until it returns. It meets values outside [0, n)
    fewer than a times, so the loop after the first walks, over a rows at most, always ends inside.
    """
    a, b, last = *_sides(F.col(n)), F.col(n)
    walks = F.array(F.lit(WALKS).cast("long"), a)

    def walk(s: Column, most: Column) -> Column:
        turns = F.when(s >= last, F.sequence(F.lit(1).cast("long"), most)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(turns, s, lambda x, _: F.when(x >= last, _once(x, a, b, seed, rounds, back)).otherwise(x))

    return df.withColumn(out, F.aggregate(walks, _once(F.col(number).cast("long"), a, b, seed, rounds, back), walk))


def shards(df: DataFrame, keys: list[str], n_shards: int = 24, seed: int = 7) -> DataFrame:
    """``keys`` of ``df`` with row_number, position, shard and slot. An empty table gives no rows."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    placed = permuted(row_numbers(df, keys), "row_number", "n_rows", "position", seed)
    return placed.select(
        *keys, "row_number", "position",
        (F.col("position") % n_shards).cast("int").alias("shard"),
        _div(F.col("position"), F.lit(n_shards)).alias("slot"),
    )


def located(places: DataFrame, n_rows: int, n_shards: int = 24, seed: int = 7) -> DataFrame:
    """(shard, slot) of ``places`` with the row_number that lies there, without reading the data."""
    df = places.withColumns({"_n": F.lit(n_rows).cast("long"), "position": F.col("slot") * n_shards + F.col("shard")})
    return permuted(df.where("position < _n"), "position", "_n", "row_number", seed, back=True).drop("_n")


def documents_sharded(documents: DataFrame, n_shards: int = 24, seed: int = 7) -> DataFrame:
    """Shards of documents by (doc_id, size, text_crc32): size is the UTF-8 bytes of the text (null: none) plus 8.

    Null and empty texts have size 8 and the CRC of no bytes, 0. Repeated rows take places of their own. Other columns
    are not read.
    """
    narrow = documents.select(
        F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), crc32_of("text").alias("text_crc32")
    )
    return shards(narrow, ["doc_id", "size", "text_crc32"], n_shards, seed)
