"""Similarity graphs: links of nearest neighbours and within a radius, degrees, components, neighbourhood features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.neighbours import linked, nearest, within
from skyledger.plans.shared import materialised


def undirected(directed: DataFrame) -> DataFrame:
    """(a, b, distance, similarity) with a < b: each pair once, with its least distance."""
    pairs = directed.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("distance").alias("distance"))
    return pairs.withColumn("similarity", 1.0 / (1.0 + F.col("distance")))


def knn_edges(df: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    return undirected(nearest(df, key, vector, k).rows)


def radius_edges(df: DataFrame, key: str, vector: str, radius: float) -> DataFrame:
    return undirected(within(df, key, vector, radius).rows)


def radius_components(df: DataFrame, key: str, vector: str, radius: float) -> DataFrame:
    """``components`` of the rows by ``radius_edges``, without a pair for every two copies of a vector."""
    return components(df.select(key), undirected(linked(df, key, vector, radius).rows), key)


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, ...) in both directions."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest).union(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), *rest))


def degrees(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    counted = both_ways(edges).groupBy(F.col("src").alias(key)).agg(F.count(F.lit(1)).alias("neighbours"))
    return nodes.select(key).join(counted, key, "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)).cast("long"))


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, component): the smallest key that can be reached.

    Each round every node hooks to the neighbour (or itself) of the least priority, a hash that changes with the round,
    so that chains of hooks stay short whatever the keys; two jumps shorten them further, and the edges are contracted to
    where their ends got. Edges shrink by a constant share a round: the number of rounds grows with the logarithm of the
    nodes, not with the length of paths. A round's table holds only the nodes that still have edges, with the least key
    merged into each; at the end the rounds are followed backwards, each table joined once.
    """
    edges = materialised(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while not edges.isEmpty():
        mark = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), F.col(c)).alias("p"), F.col(c).alias("to"))
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        hooks = ends.groupBy(F.col("a").alias("node")).agg(F.min(mark("b")).alias("m"))
        hooks = materialised(hooks.select("node", F.least("m", mark("node"))["to"].alias("to")), "hooks")
        for _ in range(2):
            jump = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
            hooks = materialised(hooks.join(jump, "to").select("node", F.col("further").alias("to")), "hooks")
        known = hooks.withColumn("low", F.col("node")) if not rounds else hooks.join(rounds[-1][1], "node")
        least = materialised(known.groupBy(F.col("to").alias("node")).agg(F.min("low").alias("low")), "least")
        rounds.append((hooks, least))
        to_a, to_b = (hooks.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("to_a <> to_b")
        edges = materialised(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    found = None  # (node, component) of the nodes of a round; a target without edges in the next keeps the least of its own
    for hooks, least in reversed(rounds):
        ends = least.withColumnRenamed("low", "component") if found is None else least.join(found, "node", "left").select("node", F.coalesce("component", "low").alias("component"))
        found = hooks.join(ends.withColumnRenamed("node", "to"), "to").select("node", "component")
    if found is None:
        return nodes.select(key, F.col(key).alias("component"))
    return nodes.select(key).join(found.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("component"))


def summary(nodes: DataFrame, edges: DataFrame, key: str, min_nodes: int = 10) -> DataFrame:
    """Nodes, edges, density, mean degree, status."""
    out = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))
    n, e = F.col("n_nodes"), F.col("n_edges")
    return out.withColumns({"density": F.coalesce(F.try_divide(2.0 * e, n * (n - 1)), F.lit(0.0)), "mean_degree": F.coalesce(F.try_divide(2.0 * e, n), F.lit(0.0)),
                            "status": F.when(n < min_nodes, "insufficient_data").otherwise("ok")})


def neighbours_of(edges: DataFrame, nodes: DataFrame, key: str, probes: DataFrame) -> DataFrame:
    """The neighbours of the probes' keys with their attributes."""
    return both_ways(edges).join(probes.select(F.col(key).alias("src")).distinct(), "src").join(nodes.withColumnRenamed(key, "dst"), "dst")


def induced(nodes: DataFrame, edges: DataFrame, key: str, n: int = 500) -> DataFrame:
    """Edges among the first ``n`` nodes by key."""
    first = nodes.select(key).orderBy(key).limit(n)
    return edges.join(first.withColumnRenamed(key, "a"), "a", "left_semi").join(first.withColumnRenamed(key, "b"), "b", "left_semi")


def neighbour_means(nodes: DataFrame, edges: DataFrame, key: str, features: list[str], hops: int = 2) -> DataFrame:
    """Each node's features with the mean of its neighbours', one and more hops away (names end in _1, _2 ...)."""
    out, last = nodes.select(key, *features), nodes.select(key, *features)
    for hop in range(1, hops + 1):
        mean = both_ways(edges.select("a", "b")).join(last.withColumnRenamed(key, "dst"), "dst").groupBy(F.col("src").alias(key)).agg(*[F.avg(f).alias(f) for f in features])
        out = out.join(mean.select(key, *[F.col(f).alias(f"{f}_{hop}") for f in features]), key, "left")
        last = mean
    return out
