"""Centroid clustering over integer vectors with an incremental distance matrix.

Components become integers, so that every product and distance is exact. Each vector keeps its dot products with all
centroids in a table of the shared folder. When centroids move, a product changes by the vector's components at the
nonzero changes of that centroid only; the squared distance is |x|^2 + |c|^2 - 2 x.c, and argmin is taken anew. A
round is one pass over the table and one sum for each cluster, combined before the shuffle; the driver sees k rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import discarded, written

DIM, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
_STATE = "id long, x array<bigint>, dots array<bigint>, cluster int, distance long"


def lattice(vectors: DataFrame, id_col: str, vector_col: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, x): vectors of exactly ``dim`` finite components, as integers floor(scale * component).

    An integer is held at a bound at which squared distances still fit a long (2^27.5 for 64 components).
    """
    v, bound = F.col(vector_col), math.isqrt((1 << 61) // dim)
    usable = (F.size(v) == dim) & F.forall(v, lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(v, lambda e: F.floor(F.greatest(F.lit(-float(bound)), F.least(F.lit(float(bound)), e.cast("double") * scale))).cast("long"))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"))


def seeds(rows: DataFrame, k: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The vectors of the ``k`` smallest sha256 of '<seed>:<id>', in that order; fewer if there are fewer."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in rows.orderBy(mark, "x").select("x").limit(k).collect()], np.int64)


def updated(state: DataFrame, before: np.ndarray | None, now: np.ndarray) -> DataFrame:
    """``state`` with dot products, cluster and distance for centroids ``now``; its products are those with ``before``."""
    change = now if before is None else now - before
    moved = [(k, nz, change[k, nz]) for k in range(len(now)) if len(nz := np.flatnonzero(change[k]))]
    lengths = (now * now).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy().reshape(n, now.shape[1])
            dots = np.zeros((n, len(now)), np.int64) if before is None else batch.column(2).flatten().to_numpy().reshape(n, len(now)).copy()
            for k, nz, step in moved:
                dots[:, k] += x[:, nz] @ step
            far = lengths - 2 * dots
            cluster = far.argmin(axis=1)  # the first of equals
            distance = far[np.arange(n), cluster] + (x * x).sum(axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(now), pa.int32()), pa.array(dots.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), flat, pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "x", "dots", "cluster", "distance"]
            )

    source = state.withColumn("dots", F.lit(None).cast("array<bigint>")) if before is None else state
    return source.select("id", "x", "dots").mapInArrow(run, _STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each cluster's componentwise floor(sum / count); a cluster without vectors keeps its centroid."""
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row for each cluster
        out[r.cluster] = [s // r.n for s in r[2:]]
    return out


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM,
              scale: int = SCALE, seed: int = 1) -> DataFrame:
    """One row for each usable vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Usable vectors have exactly ``dim`` components, none null or non-finite; others are left out. Ids are longs; a null
    id hashes like an empty one. With fewer than ``k`` vectors there are as many centroids. Repeated rows are rows of
    their own, so equal seeds may stand twice, and the smaller number gets their vectors; of rows with one id the
    smaller vector comes first. No usable vector, no rows. An inertia beyond a long is null. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(lattice(vectors, id_col, vector_col, dim, scale), "lattice")
    before, now = None, seeds(rows, k, seed)
    state = rows
    if not len(now):
        return rows.selectExpr("id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    for turn in range(rounds + 1):
        last, state = state, written(updated(state, before, now), "products")
        discarded(last)
        if turn < rounds:
            before, now = now, means(state, now)
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).select(
        "cluster", F.col("s").try_cast("long").alias("cluster_inertia"), F.sum("s").over(Window.partitionBy()).try_cast("long").alias("inertia")
    )
    names = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(now.tolist())]
    named = sums.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    return state.select("id", "cluster", "distance").join(F.broadcast(named), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
