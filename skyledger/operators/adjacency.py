"""A graph as matrices over dense node numbers: compressed adjacency, standardised features, labels and split masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.operators.graph import both_ways
from skyledger.operators.metrics import stratified
from skyledger.operators.reports import NODE_FEATURES, dense_ids
from skyledger.plans.shared import materialised

#: Neighbours of one row of the adjacency at most.
CHUNK = 4096


def edge_index(nodes: DataFrame, edges: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """(node_id, offset, degree, part, neighbours): the compressed adjacency of ``edges`` in both directions.

    nodes: (node_id, key). The whole index is the concatenation of all ``neighbours`` by (node_id, part), sorted within
    a node; ``offset`` is where a node's begin in it. Places in it are dense numbers of the pairs of node numbers, counted
    in ranges, so a node with very many neighbours is several rows made by several tasks. Nodes without edges have one
    row without neighbours and the offset of the next. Edges that repeat count once; loops and unknown ends are left out.
    """
    ids = nodes.select(F.col(key).alias("k"), F.col("node_id").cast("long").alias("n"))
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    numbered = pairs.join(ids.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(ids.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    ends = both_ways(numbered.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    placed = materialised(dense_ids(ends, ["src", "dst"], "place"), "places")
    starts = placed.groupBy("src").agg(F.min("place").alias("offset"), F.count(F.lit(1)).alias("degree"))
    of = F.floor((F.col("place") - F.col("offset")) / chunk).cast("int")
    parts = placed.join(starts, "src").groupBy("src", "offset", "degree", of.alias("part")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))
    lonely = ids.join(starts, F.col("n") == F.col("src"), "left_anti").select(F.col("n").alias("src"))
    # A node without edges starts where the next one with edges does: its place among the starts, by a range of numbers.
    at = _next_offset(lonely, starts, placed.agg(F.max("place")).first()[0])
    empty = at.select("src", "offset", F.lit(0).cast("long").alias("degree"), F.lit(0).alias("part"), F.array().cast("array<bigint>").alias("neighbours"))
    return parts.unionByName(empty).withColumnRenamed("src", "node_id")


def _next_offset(lonely: DataFrame, starts: DataFrame, last: int | None) -> DataFrame:
    """(src, offset) of nodes without edges. Node numbers are cut into ranges; a range's first start serves those before."""
    width = 65_536
    both = starts.select("src", "offset").unionByName(lonely.select("src", F.lit(None).cast("long").alias("offset"))).withColumn("r", F.floor(F.col("src") / width))
    firsts = both.groupBy("r").agg(F.min("offset").alias("first"))
    later = F.first("first", ignorenulls=True).over(W.orderBy("r").rowsBetween(1, W.unboundedFollowing))  # one row for each 65 536 nodes
    firsts = firsts.select("r", F.coalesce(later, F.lit(0 if last is None else last + 1)).alias("later"))
    own = F.first("offset", ignorenulls=True).over(W.partitionBy("r").orderBy("src").rowsBetween(1, W.unboundedFollowing))
    return both.withColumn("own", own).where("offset is null").join(firsts, "r").select("src", F.coalesce("own", "later").cast("long").alias("offset"))


def node_matrix(df: DataFrame, key: str = "object_key", target: str = "pha", features: list[str] = NODE_FEATURES, shares: tuple[float, float] = (0.6, 0.2)) -> tuple[DataFrame, list[str]]:
    """((node_id, key, features, label, mask), names): standardised features of every node, by dense number.

    A feature is a column that holds a number somewhere; missing and non-finite values are 0, then each feature is
    centred and divided by its population deviation (or 1). label is 1, 0 or -1 (unknown); mask splits the labelled
    nodes of each label into train, val and test by ``shares`` (the rest is test), others have none.
    """
    own = [c for c in features if c in df.columns]
    finite = lambda c: F.when(F.abs(F.col(c).try_cast("double")) < float("inf"), F.col(c).try_cast("double"))
    label = F.coalesce(F.col(target).cast("int"), F.lit(-1))
    rows = materialised(dense_ids(df.select(key, label.alias("label"), *[finite(c).alias(f"f{k}") for k, c in enumerate(own)]), key, "node_id"), "nodes")
    cells = {k: F.coalesce(f"f{k}", F.lit(0.0)) for k in range(len(own))}
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"{s}{k}") for k, c in cells.items() for s, x in (("h", F.count(f"f{k}")), ("a", F.avg(c)), ("s", F.stddev_pop(c)))]).first()
    held = [k for k in cells if stats[f"h{k}"]]
    matrix = F.array(*[(cells[k] - stats[f"a{k}"]) / (stats[f"s{k}"] or 1.0) for k in held]).cast("array<double>")
    split = stratified(rows.where("label >= 0").select("node_id", "label"), "label", "node_id", shares=(("train", shares[0]), ("val", shares[1]), ("test", None)))
    out = rows.select("node_id", key, matrix.alias("features"), "label").join(split.select("node_id", F.col("split").alias("mask")), "node_id", "left")
    return out, [own[k] for k in held]
