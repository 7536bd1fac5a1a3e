"""Approximate nearest neighbours by multi-index hashing of learned binary codes, reranked by exact cosines.

Codes: several rotations of the vectors' space, each learned by iterative quantisation (alternately the signs of the
rotated sample and the rotation nearest to them), give SUBSTRINGS * WIDTH sign bits. A code is split into substrings,
and each shard of the index keeps one table for each substring: the codes in the order of its values.

A query probes every table at all values within f flipped bits, f = 0, 1, ... By the pigeonhole principle that finds
every code within a Hamming radius of SUBSTRINGS * (f + 1) - 1. It stops at the first f whose radius holds ``ENOUGH``
codes, and from f = FLIPS on once it has found so many within any distance (a shard of fewer is found whole). Of those, all codes within the least radius that holds ``ENOUGH`` (ties included) are reranked
by the cosine of the original vectors in double precision, and the shard returns the best.

Equal vectors are one entry with their smallest ids, as many as can be returned: a vector that a third of all rows repeat
takes one place. Entries are dealt evenly over shards by hash, at about 16 sqrt(rows) entries each and at most 2^22
components, so a shard never outgrows a task; queries go to all shards and stream through them. A shard sends a query's
best rows only, never its candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import written

SUBSTRINGS, WIDTH, FLIPS, ENOUGH = 24, 12, 2, 1024
BITS = SUBSTRINGS * WIDTH
#: Distinct vectors from which the rotations are learned, those of the smallest hashes, and the components they may have.
SAMPLE, SAMPLE_COMPONENTS = 10_000, 1 << 22
#: Components of a shard at most, and alternations of the learning.
SHARD, TURNS = 1 << 22, 30
#: Stands for a null id: after all others.
_LAST = (1 << 63) - 1
#: For each number of flipped bits the patterns of a substring that have so many.
_FLIPS = [np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), f)]) for f in range(WIDTH + 1)]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to components of at most 1: cosines stay as they are, squares don't overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _rotation(units: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The rotation nearest to the signs it gives, by alternation from ``start``."""
    for _ in range(TURNS):
        u, _, v = np.linalg.svd(units.T @ np.where(units @ start >= 0, 1.0, -1.0), full_matrices=False)
        start = u @ v
    return start


def projection(dim: int, sample: np.ndarray | None, seed: int = 12) -> np.ndarray:
    """(dim, BITS) directions whose signs are the code; without a sample random rotations."""
    rng, out = np.random.default_rng([seed, dim]), []
    width = min(dim, BITS)
    if sample is not None:
        scaled = _scaled(sample)
        sample = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    while sum(r.shape[1] for r in out) < BITS:
        start = np.linalg.qr(rng.standard_normal((dim, width)))[0]
        out.append(start if sample is None else _rotation(sample, start))
    return np.concatenate(out, axis=1)[:, :BITS]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector in doubles) of the distinct rows whose vector isn't null, empty, zero or with null or non-finite components."""
    v = F.col("vector")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.transform(vector_col, lambda e: e.cast("double") + 0.0).alias("vector"))
    whole = (F.size(v) > 0) & F.forall(v, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))) & F.exists(v, lambda e: e != 0)
    return rows.where(whole).distinct()


def learned(entries: DataFrame) -> dict[int, np.ndarray]:
    """Projections by number of components, from a bounded sample; vectors of other lengths get random rotations."""
    size = entries.agg(F.max("dim").alias("widest"), F.count(F.lit(1)).alias("n")).first()
    sample = max(1, min(SAMPLE, SAMPLE_COMPONENTS // (size.widest or 1)))
    # Twice as many have a hash below this, so tasks send few rows that aren't in the sample.
    below = -(1 << 63) + min((1 << 64) - 1, (2 * sample + 1000) * (1 << 64) // max(1, size.n))
    rows = entries.where(F.xxhash64("vector") <= F.lit(below)).orderBy(F.xxhash64("vector"), "vector").limit(sample).select("vector").collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(len(r.vector), []).append(r.vector)
    return {d: projection(d, np.array(x)) for d, x in found.items()}


def coded(rows: DataFrame, model: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with column code: the packed bits of each vector."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few matrices of a fixed number of columns
    at = rows.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(shared.value)
        for batch in batches:
            codes: list[bytes] = [b""] * batch.num_rows
            vectors = [v.values.to_numpy() for v in batch.column(at)]
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes).tolist():
                if dim not in known:
                    known[dim] = projection(dim, None)
                where = np.flatnonzero(sizes == dim)
                bits = _scaled(np.stack([vectors[i] for i in where])) @ known[dim] >= 0
                for i, code in zip(where.tolist(), np.packbits(bits, axis=1)):
                    codes[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "code"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{types}, code binary")


class Shard:
    """Entries of one shard: a table for each substring, and the vectors."""

    def __init__(self, ids: list[list[int]], vectors: np.ndarray, codes: np.ndarray):
        self.ids = np.full((len(ids), max(map(len, ids))), -1, np.int64)
        self.real = np.zeros(self.ids.shape, bool)
        for i, own in enumerate(ids):
            self.ids[i, : len(own)] = own
            self.real[i, : len(own)] = True
        self.vectors = _scaled(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.codes = codes
        values = substrings(codes)
        self.order = np.argsort(values, axis=0, kind="stable").T
        self.starts = np.stack([np.searchsorted(values[:, j][self.order[j]], np.arange((1 << WIDTH) + 1)) for j in range(SUBSTRINGS)])

    def found(self, code: np.ndarray, enough: int = ENOUGH) -> np.ndarray:
        """Row numbers of the codes to rerank."""
        own = substrings(code[None])[0]
        hit, far = np.zeros(len(self.codes), bool), None
        table = np.arange(SUBSTRINGS)[:, None]
        for f, patterns in enumerate(_FLIPS):
            cells = own[:, None] ^ patterns[None]
            low, size = self.starts[table, cells], self.starts[table, cells + 1] - self.starts[table, cells]
            first, n = (low + table * len(self.codes)).ravel(), size.ravel()
            ends = np.cumsum(n)
            places = np.arange(ends[-1]) + np.repeat(first - ends + n, n)
            hit[self.order.ravel()[places]] = True
            near = np.flatnonzero(hit)
            far = np.bitwise_count(self.codes[near] ^ code).sum(axis=1, dtype=np.int64)
            if (far <= SUBSTRINGS * (f + 1) - 1).sum() >= enough or f >= FLIPS and len(near) >= enough or len(near) == len(hit):
                break
        if len(near) > enough:
            near = near[far <= np.partition(far, enough - 1)[enough - 1]]
        return near

    def best(self, query: int, vector: np.ndarray, code: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the best ``top`` rows but the query's own; ties to the smaller id."""
        near = self.found(code)
        v = _scaled(vector[None])[0]
        score = np.clip(self.vectors[near] @ v / (self.norms[near] * np.sqrt(v @ v)), -1, 1)
        real = self.real[near] & (self.ids[near] != query)
        ids, score = self.ids[near][real], np.repeat(score, real.sum(axis=1))
        first = np.lexsort((ids, -score))[:top]
        return ids[first], score[first]


def substrings(codes: np.ndarray) -> np.ndarray:
    """(n, SUBSTRINGS) values of packed codes."""
    bits = np.unpackbits(codes, axis=1)[:, :BITS].reshape(len(codes), SUBSTRINGS, WIDTH)
    return bits.astype(np.int64) @ (1 << np.arange(WIDTH))


def _searched(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The best rows of each query in each shard; rows come by (dim, shard, side), entries before queries."""
    key, shard, held = None, None, []
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        marks = np.stack([cols[c].to_numpy().astype(np.int64) for c in ("dim", "shard", "side")])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for s, e in zip(cuts, cuts[1:]):
            here = marks[:2, s].tolist()
            if here != key:
                key, shard, held = here, None, []
            vectors = cols["vector"].slice(s, e - s).flatten().to_numpy().reshape(e - s, here[0])
            codes = np.frombuffer(b"".join(cols["code"].slice(s, e - s).to_pylist()), np.uint8).reshape(e - s, -1)
            if marks[2, s] == 0:
                held.append((cols["ids"].slice(s, e - s).to_pylist(), vectors, codes))
                continue
            if shard is None:
                if not held:
                    continue
                shard, held = Shard([i for h in held for i in h[0]], *(np.concatenate([h[k] for h in held]) for k in (1, 2))), []
            queries, ids, scores = [], [], []
            for q, v, c in zip(cols["query"].slice(s, e - s).to_pylist(), vectors, codes):
                found, score = shard.best(q, v, c, top)
                queries += [q] * len(found)
                ids.append(found)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["query_id", "id", "score"])


def indexed(rows: DataFrame, top: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(index, projections) of ``usable`` rows: (dim, n_shards, shard, ids, vector, code), one row for each distinct vector."""
    by_id = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    entries = rows.withColumn("r", by_id).where(F.col("r") <= top + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = written(entries.withColumn("dim", F.size("vector")), "entries")
    model = learned(entries)
    n = entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    size = F.least(F.ceil(16 * F.sqrt("n")), F.greatest(F.lit(1), F.floor(F.lit(SHARD) / F.col("dim"))))
    placed = entries.join(n.select("dim", F.ceil(F.col("n") / size).cast("int").alias("n_shards")), "dim")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("vector", F.lit(3)), "n_shards").cast("int"))
    return written(coded(placed, model), "index"), model


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 5) -> DataFrame:
    """(query_id, rank, id, score): the ``top`` nearest rows of ``vectors`` found for each row of ``queries``, by cosine.

    A row is never its own query's neighbour: those with the query's id are passed over. Ties go to the smaller id, a
    null id comes last. Vectors that are null, empty, zero or hold null or non-finite components take no part, and
    vectors meet only those of the same length. Rows equal in id and vector count once. Ids are longs. Empty tables give
    no rows. Other columns are not read.
    """
    index, model = indexed(usable(vectors, id_col, vector_col), top)
    asked = coded(usable(queries, id_col, vector_col).withColumn("dim", F.size("vector")), model)
    shards = index.select("dim", "n_shards").distinct()
    sent = asked.join(shards, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1)).alias("shard"), F.lit(1).alias("side"), F.col("id").alias("query"),
        F.lit(None).cast("array<bigint>").alias("ids"), "vector", "code",
    )
    kept = index.select("dim", "shard", F.lit(0).alias("side"), F.lit(None).cast("long").alias("query"), "ids", "vector", "code")
    together = kept.unionByName(sent).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "side")
    found = together.mapInArrow(lambda batches: _searched(batches, top), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select(
        F.nullif("query_id", F.lit(_LAST)).alias("query_id"), F.col("rank").cast("int").alias("rank"), F.nullif("id", F.lit(_LAST)).alias("id"), "score"
    )
