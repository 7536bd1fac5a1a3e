"""Near-duplicate vectors by Euclidean p-stable hashing, then exact cosine checks.

Vectors are normalised, so a cosine of 0.98 is a distance of 0.2. Each of several tables quantises a few random normal
projections, floor((a.x + b) / w), into a bucket; vectors of one label that share a bucket in any table are compared
by cosine in double precision. The number of projections grows with the logarithm of the rows, so that unrelated
vectors rarely meet, and the number of tables follows so that a pair at the threshold is missed with ``miss`` at most.

Hot groups: equal vectors become one before hashing and come back as a count. A large bucket is dealt into blocks, and
pairs of blocks are compared, each in a task's own numpy product; what leaves a block is one row for each vector (its
number of links, counted in the first table in which a pair meets, and its block's component), never a pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import blocks, textnum
from skyledger.llm.common import components, written

COSINE = 0.98
#: Quantisation width for unit vectors.
WIDTH = 1.0
#: Share of projections on which orthogonal unit vectors agree at that width.
FAR = 0.2709


def _agreement(distance: float, width: float) -> float:
    """Probability that one quantised projection agrees for two points at ``distance``."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, cosine: float = COSINE, miss: float = 5e-4) -> tuple[int, int]:
    """(projections of a bucket, tables) for so many rows."""
    near = _agreement(math.sqrt(max(1e-12, 2 - 2 * cosine)), WIDTH)
    k = max(6, math.ceil(math.log(max(2, rows)) / -math.log(FAR)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


def _unit(lists: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision scaled to length 1; None for null, empty, zero, null or non-finite components."""
    out = []
    for x in lists:
        v = None if not x.is_valid or x.values.null_count or not len(x.values) else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if v is not None and np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
            v = v / top  # no overflow or underflow in the squares
            out.append(v / np.sqrt(v @ v))
        else:
            out.append(None)
    return out


def hashed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, k: int, tables: int, seed: int = 5) -> DataFrame:
    """(id, node, vector, keys) of each row: node and keys are null where a row can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                units, labels = _unit(part.column(1)), part.column(2).to_pylist()
                nodes, keys, kept = [None] * len(units), [None] * len(units), [None] * len(units)
                groups: dict[int, list[int]] = {}
                for i, v in enumerate(units):
                    if v is not None and labels[i] is not None:
                        groups.setdefault(len(v), []).append(i)
                for dim, members in groups.items():
                    if dim not in planes:
                        rng = np.random.default_rng([seed, dim])
                        planes[dim] = rng.standard_normal((dim, tables * k)), rng.uniform(0, WIDTH, tables * k)
                    x = np.stack([units[i] for i in members])
                    cells = np.floor((x @ planes[dim][0] + planes[dim][1]) / WIDTH).astype(np.int64).view(np.uint64)
                    cells = cells.reshape(len(members), tables, k)
                    marks = [int.from_bytes(hashlib.md5(f"{labels[i]}\1{dim}".encode()).digest()[:8], "little") for i in members]
                    # Mixed first: else cells of one table that differ by a constant from another's give the same bucket.
                    value = textnum.mixed(np.array(marks, np.uint64)[:, None] + textnum.mixed(np.arange(1, tables + 1, dtype=np.uint64))[None, :])
                    for c in range(k):
                        value = textnum.mixed(value * np.uint64(3) + cells[:, :, c])
                    value = value.view(np.int64)
                    for row, i in enumerate(members):
                        nodes[i] = hashlib.md5(x[row].tobytes() + f"{labels[i]}".encode()).digest()
                        keys[i], kept[i] = value[row], units[i]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes, pa.binary()), pa.array(kept, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "node", "vector", "keys"],
                )

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("l"))
    return source.mapInArrow(run, "id long, node binary, vector array<double>, keys array<bigint>")


def _compared(rows: DataFrame, cosine: float) -> DataFrame:
    """(node, links, root) of each node of each pair of blocks that has links there."""

    def kernel(t: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        vectors, keys = np.stack(t.column("vector").to_numpy()), np.stack(t.column("keys").to_numpy())
        copies, bucket = t.column("copies").to_numpy(), t.column("bucket")[0].as_py()
        i, j = np.nonzero(vectors[a] @ vectors[b].T >= cosine)
        one_block = a is b
        i, j = a[i], b[j]
        if one_block:
            i, j = i[i < j], j[i < j]
        links, label = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
        for lo in range(0, len(i), 100_000):
            x, y = i[lo : lo + 100_000], j[lo : lo + 100_000]
            first = keys[x, (keys[x] == keys[y]).argmax(axis=1)] == bucket  # a pair counts in the first table where it meets
            np.add.at(links, x[first], copies[y[first]])
            np.add.at(links, y[first], copies[x[first]])
        while len(i):
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            low = low[low]
            if (low == label).all():
                break
            label = low
        hit = np.unique(np.concatenate([i, j]))
        nodes = t.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(hit)), pa.array(links[hit]), nodes.take(pa.array(label[hit]))], ["node", "links", "root"])

    return blocks.arranged(rows).mapInArrow(lambda batches: blocks.each(batches, kernel), "node binary, links long, root binary")


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
          miss: float = 5e-4) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id (smallest id reachable by links, itself included).

    Two rows link if their labels are equal and not null and their cosine is at least ``cosine``. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, and neither do vectors of unlike lengths.
    Rows that repeat are linked as any equal vectors. An empty table gives no rows. Other columns are not read.
    """
    k, tables = plan(vectors.count(), cosine, miss)
    rows = written(hashed(vectors, id_col, vector_col, label_col, k, tables), "hashed")
    whole = rows.where("node is not null")
    nodes = whole.groupBy("node").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.first("keys").alias("keys")
    )
    nodes = written(nodes, "nodes")
    members = nodes.select("node", F.explode(F.array_distinct("keys")).alias("bucket"))
    sizes = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    dealt = written(blocks.dealt(members.join(sizes, "bucket")), "dealt").join(nodes.select("node", "copies", "vector", "keys"), "node")
    found = written(_compared(dealt, cosine), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select("node", "root"), "node", "root").select(F.col("id").alias("node"), "component")
    named = nodes.select("node", "id", "copies").join(labels, "node", "left").join(counts, "node", "left")
    named = written(named.select("node", "id", "copies", F.coalesce("component", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of_node = named.join(least, "label").select("node", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return rows.select("id", "node").join(of_node, "node", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
