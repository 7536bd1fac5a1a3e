"""Exact nearest neighbours and radius links by a metric index: pivots, triangle inequality, and bounds between rounds.

Pivots (about the root of the rows, at most ``PIVOTS``) are rows picked by hash; each row lies in the cell of its nearest
pivot, cells are sliced by the distance to the pivot, and slices are dealt into leaves of bounded size. A first round
compares rows within their leaf, which bounds the distance of each row's k-th neighbour. In a second round a row visits
only leaves that may hold something nearer: by the triangle inequality on the distances to pivots, and by the plane
halfway between its own pivot and another. Within a leaf only the members whose distance to the pivot differs by no more
than the bound are compared. In data without clusters (many independent dimensions) few leaves can be ruled out; so leaves
next to each other form shelves of bounded size, a row is sent once for each shelf, and blocks of rows meet a leaf by a
matrix product that only picks what may be near: distances are computed from differences. The work is that of all pairs
then, the memory of a task and the rows sent are not.

Equal vectors are one entry with their smallest keys, as many as can be asked for. What the driver sees are the pivots and
a row for each slice, both of bounded number; leaves grow beyond ``LEAVES`` times their least size instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.plans.shared import materialised

PIVOTS, LEAF, LEAVES = 1024, 1000, 16_384
#: Bytes of the members that a task holds, least number of tasks over large tables, rows that ask together, pairs at once,
#: links that a task holds back before it sends them.
SHELF, TASKS, ROWS, PAIRS, HELD = 64 << 20, 64, 512, 32_768, 262_144
_FOUND = "node long, id long, distance double, compared long"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    """A list for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of one point to rows; differences first, so that equal points are exactly 0 apart."""
    return np.sqrt(((y - x) ** 2).sum(axis=1))


@dataclass
class Index:
    """placed: (node, ids, v, cell, d, leaf); the rest describes pivots and slices, an entry each."""

    placed: DataFrame | None
    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    parts: np.ndarray


def _points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v) of the rows whose vector isn't null and holds finite numbers only; vectors must be of one length."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.transform(F.col(vector).cast("array<double>"), lambda e: e + 0.0).alias("v"))
    return rows.where(F.forall("v", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))))


def built(entries: DataFrame, leaf: int = LEAF) -> Index | None:
    """The index of entries (node, ids, v); None if there is none."""
    n = entries.count()
    if not n:
        return None
    most = min(PIVOTS, math.ceil(math.sqrt(n)))
    below = -(1 << 63) + min((1 << 64) - 1, (2 * most + 500) * (1 << 64) // n)  # more than enough; the others stay where they are
    some = entries.where(F.xxhash64("v") <= F.lit(below)).orderBy(F.xxhash64("v"), "v").select("v").limit(most).collect()
    pivots = np.array([r.v for r in some])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(2))
                cell = np.concatenate([_about(v[at : at + ROWS], pivots)[0].argmin(axis=1) for at in range(0, len(v), ROWS)])
                far = np.sqrt(((pivots[cell] - v) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], ["node", "ids", "v", "cell", "d"])

    spark, leaf = entries.sparkSession, max(leaf, math.ceil(n / LEAVES))
    cells = materialised(entries.select("node", "ids", "v").mapInArrow(assign, "node long, ids array<bigint>, v array<double>, cell int, d double"), "cells")
    ends = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / leaf).alias("slices"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    ends = spark.createDataFrame(ends.collect(), ends.schema)  # a row for each pivot
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("d") - F.col("lo"), F.col("hi") - F.col("lo")) * F.col("slices")), F.lit(0)), F.col("slices") - 1)
    sliced = cells.join(F.broadcast(ends), "cell").select("node", "ids", "v", "cell", "d", at.alias("slice"))
    found = sliced.groupBy("cell", "slice").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("cell", "slice").collect()
    parts = np.array([math.ceil(r.n / leaf) for r in found])
    first = np.cumsum(parts) - parts
    numbers = spark.createDataFrame([(r.cell, r.slice, int(f), int(p)) for r, f, p in zip(found, first, parts)], "cell int, slice long, first int, parts int")
    leaf_ = (F.col("first") + F.pmod(F.xxhash64("node"), "parts")).cast("int")
    placed = materialised(sliced.join(F.broadcast(numbers), ["cell", "slice"]).select("node", "ids", "v", "cell", "d", leaf_.alias("leaf")), "placed")
    return Index(placed, pivots, np.array([r.cell for r in found]), np.array([r.lo for r in found]), np.array([r.hi for r in found]), np.array([r.n for r in found]), first, parts)


def _grid(index: Index, least: int, once: bool) -> tuple[DataFrame, int, Callable[[DataFrame], DataFrame]]:
    """(members, tasks, visitors): the index in shelves of leaves next to each other, and who visits which.

    A task holds the members of one shelf and lets one share of the visitors pass, so the members are copied once for each
    share and a visitor once for each shelf where it may find something, not once for each leaf. Shelves are of bounded
    size; shares only fill the tasks. ``once``: a pair of leaves is met from the first of them only.
    """
    pivots, cell, high, rows, parts = index.pivots, index.cell, index.high, index.rows, index.parts
    n, width = int(rows.sum()), pivots.shape[1] * 8 + 64
    tasks = max(1, min(max(TASKS, 4 * index.placed.sparkSession.sparkContext.defaultParallelism), n // 2000))
    shelves = min(max(math.ceil(n * width / SHELF), math.ceil(math.sqrt(tasks))), int(parts.sum()))
    shares = math.ceil(tasks / shelves)
    of_leaf = np.repeat(rows / parts, parts).cumsum()
    shelf_of = np.minimum((of_leaf - of_leaf[0]) * shelves // of_leaf[-1], shelves - 1).astype(np.int64)  # by leaf, never falling
    starts = np.searchsorted(shelf_of, np.arange(shelves + 1))
    seen = replace(index, placed=None)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_of = np.repeat(np.arange(len(parts)), parts)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                v, own, home = _matrix(part.column(1)), part.column(2).to_numpy(), part.column(4).to_numpy()
                d, u = part.column(3).to_numpy(), part.column(5).to_numpy(zero_copy_only=False).astype(float)
                to, slack = _about(v, pivots)
                for r in np.flatnonzero(np.isnan(u)):  # the distance within which enough must lie, by sizes and outer radii
                    outer = to[r, cell] + high
                    order = np.argsort(outer)
                    enough = np.searchsorted(np.cumsum(rows[order]), least)
                    u[r] = outer[order[enough]] + slack[r] if enough < len(order) else np.inf
                open_ = _open(seen, slice(None), to[:, cell], d, own, u, slack)[:, slice_of]
                open_[np.arange(len(v)), home] = False
                if once:
                    open_ &= np.arange(len(slice_of)) > home[:, None]
                who, where = np.nonzero(np.logical_or.reduceat(open_, starts[:-1], axis=1))
                cut = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*cut.columns[:5], pa.array(u[who]), pa.array(where, pa.int64())], ["node", "v", "cell", "d", "leaf", "u", "shelf"])

    def visitors(bounded: DataFrame) -> DataFrame:
        asked = bounded.select("node", "v", "cell", "d", "leaf", "u").mapInArrow(route, "node long, v array<double>, cell int, d double, leaf int, u double, shelf long")
        task = F.col("shelf") * shares + F.pmod(F.xxhash64("node"), F.lit(shares))
        return asked.select(task.cast("int").alias("task"), F.lit(1).alias("side"), "node", F.lit(None).cast("array<bigint>").alias("ids"), "v", "cell", "d", "leaf", "u")

    shelf = F.element_at(F.lit(shelf_of.tolist()).cast("array<bigint>"), F.col("leaf") + 1) if shelves > 1 else F.lit(0)
    held = index.placed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    held = held.select((shelf * shares + F.col("share")).cast("int").alias("task"), F.lit(0).alias("side"), "node", "ids", "v", "cell", "d", "leaf", F.lit(None).cast("double").alias("u"))
    return held, shelves * shares, visitors


def _about(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances of rows to rows by one product, how far those of a row of x may be off)."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    slack = _slack(xx, yy, x.shape[1])
    if not np.isfinite(slack).all():
        return np.stack([_far(row, y) for row in x]), np.zeros(len(x))
    return np.sqrt(np.maximum(xx[:, None] + yy - 2 * (x @ y.T), 0.0)), slack


def _slack(xx: np.ndarray, yy: np.ndarray, width: int) -> np.ndarray:
    """How far the root of |x|^2 + |y|^2 - 2 xy may be off, for each x: the rounding of a sum of ``width`` products."""
    with np.errstate(over="ignore"):
        return 2.0 * np.sqrt(4.0 * (width + 8) * np.finfo(float).eps * (xx + yy.max(initial=0.0)))


def _open(index: Index, slices: slice | int, to: np.ndarray, d: np.ndarray, own: np.ndarray, u: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Which slices may hold something within u of a row that is ``to`` from their pivots and d from its own."""
    wide = lambda x: x[:, None] if to.ndim == 2 else x
    plane = np.where(index.cell[slices] == wide(own), 0.0, (to - wide(d)) / 2)
    nearest = np.maximum(np.maximum(to - index.high[slices], index.low[slices] - to), plane)
    return ~(nearest > wide(u + slack + 1e-9 * (1 + u)))  # rounding never rules a leaf out


class _Leaf:
    """Members of a leaf by their distance to its pivot."""

    def __init__(self, rows: pa.Table):
        d = rows.column("d").to_numpy()
        order = np.argsort(d, kind="stable")
        self.d, self.v, self.node = d[order], _matrix(rows.column("v"))[order], rows.column("node").to_numpy()[order]
        self.yy = (self.v * self.v).sum(axis=1)
        self.ids = rows.column("ids").combine_chunks().take(pa.array(order))


class _Asking:
    """Rows that ask one leaf after the other; found are (row, distance, node, ids), the ``most`` nearest or all within u."""

    def __init__(self, node: np.ndarray, v: np.ndarray, u: np.ndarray, most: int | None):
        self.node, self.v, self.u, self.most, self.pairs = node, v, u.copy(), most, 0
        self.xx = (v * v).sum(axis=1)
        self._emptied()

    def _emptied(self) -> None:
        none = np.empty(0, np.int64)
        self.row, self.far, self.by, self.ids = none, np.empty(0), none, pa.array([], pa.list_(pa.int64()))

    def sent(self) -> Iterator[pa.RecordBatch]:
        """What was found so far, once it is much, and then held no longer: within a radius nothing is taken back."""
        if self.most is None and len(self.row) >= HELD:
            yield self.answers()
            self._emptied()
            self.pairs = 0

    def meet(self, leaf: _Leaf, rows: np.ndarray, to: np.ndarray | None, slack: np.ndarray) -> None:
        """The rows at ``rows`` meet the members; those whose distance to the pivot rules them out aren't compared."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(leaf.d))
        if to is not None:
            reach = self.u[rows] + slack + 1e-9 * (1 + self.u[rows])
            lo, hi = np.searchsorted(leaf.d, to - reach), np.searchsorted(leaf.d, to + reach, "right")
        size, from_, end = np.maximum(hi - lo, 0), int(lo.min()), int(hi.max())
        if size.sum() < 0.85 * len(rows) * (end - from_):  # rows at like distances from the pivot ask together
            if len(rows) > 16:
                order = np.argsort(to, kind="stable")
                for half in np.array_split(order, 2):
                    self.meet(leaf, rows[half], to[half], slack[half])
                return
            self.pairs += int(size.sum())
            i = np.repeat(np.arange(len(rows)), size)
            self._compare(leaf, rows[i], np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + lo[i])
            return
        if end <= from_:
            return
        v, yy = leaf.v[from_:end], leaf.yy[from_:end]
        self.pairs += len(rows) * len(v)
        off = _slack(self.xx[rows], yy, self.v.shape[1])
        if not np.isfinite(off).all():
            i, j = np.divmod(np.arange(len(rows) * len(v)), len(v))
            self._compare(leaf, rows[i], j + from_)
            return
        ones = np.ones((len(rows), 1))
        squares = np.hstack([-2.0 * self.v[rows], ones, self.xx[rows, None]]) @ np.vstack([v.T, yy[None], np.ones((1, len(yy)))])
        bound = self.u[rows]
        if self.most is not None and len(v) > self.most and np.isinf(bound).any():
            nth = np.sqrt(np.maximum(np.partition(squares, self.most - 1, axis=1)[:, self.most - 1], 0.0)) + off
            bound = np.minimum(bound, nth)
        i, j = np.nonzero(squares <= ((bound + off) ** 2)[:, None])
        self._compare(leaf, rows[i], j + from_)

    def _compare(self, leaf: _Leaf, row: np.ndarray, j: np.ndarray) -> None:
        """Distances by differences, a bounded number of pairs at once; u falls to the distance of the ``most``-th."""
        for at in range(0, len(row), PAIRS):
            r, m = row[at : at + PAIRS], j[at : at + PAIRS]
            far = np.sqrt(((leaf.v[m] - self.v[r]) ** 2).sum(axis=1))
            near = far <= self.u[r]
            r, m, far = r[near], m[near], far[near]
            if not len(r):
                continue
            self.row, self.far, self.by = np.append(self.row, r), np.append(self.far, far), np.append(self.by, leaf.node[m])
            self.ids = pa.concat_arrays([self.ids, leaf.ids.take(pa.array(m))])
            if self.most is not None:
                order = np.lexsort((self.by, self.far, self.row))
                place = np.arange(len(order)) - np.searchsorted(self.row[order], self.row[order])
                keep = order[place < self.most]
                last = order[place == self.most - 1]
                self.u[self.row[last]] = np.minimum(self.u[self.row[last]], self.far[last])
                self.row, self.far, self.by, self.ids = self.row[keep], self.far[keep], self.by[keep], self.ids.take(pa.array(keep))

    def answers(self) -> pa.RecordBatch:
        """A row for each key found, and one without id that says how many pairs were compared."""
        long = np.asarray(pa.compute.list_value_length(self.ids), np.int64)
        ids = self.ids.flatten()
        columns = [np.append(np.repeat(self.node[self.row], long), 0), pa.concat_arrays([ids, pa.nulls(1, pa.int64())]), np.append(np.repeat(self.far, long), 0.0), pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array([self.pairs], pa.int64())])]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["node", "id", "distance", "compared"])


def _within_leaves(index: Index, most: int | None, u: float) -> DataFrame:
    """(node, id, distance, compared): the members of each leaf ask in their own."""
    names = ["leaf", "node", "ids", "v", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                leaf = _Leaf(pa.concat_tables(held))
                for s in range(0, len(leaf.d), ROWS):
                    ask = _Asking(leaf.node[s : s + ROWS], leaf.v[s : s + ROWS], np.full(len(leaf.d[s : s + ROWS]), u), most)
                    ask.meet(leaf, np.arange(len(ask.node)), None, np.zeros(len(ask.node)))
                    yield ask.answers()

        for batch in batches:
            marks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for s, e in zip(cuts, cuts[1:]):
                if marks[s] != at:
                    yield from closed()
                    at, held = marks[s], []
                held.append(pa.Table.from_batches([batch.slice(s, e - s)], batch.schema).rename_columns(names))
        yield from closed()

    return index.placed.select(*names).repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, _FOUND)


def _across_leaves(index: Index, bounded: DataFrame, most: int | None, once: bool) -> DataFrame:
    """(node, id, distance, compared): the rows of ``bounded`` (node, v, cell, d, leaf, u) ask in other leaves than their own."""
    names = ["side", "node", "ids", "v", "cell", "d", "leaf", "u"]
    members, tasks, visitors = _grid(index, most or 0, once)
    slice_of = np.repeat(np.arange(len(index.parts)), index.parts)
    seen = replace(index, placed=None)  # what tasks need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leaves = [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).rename_columns(names)
            side = rows.column("side").to_numpy()
            first = int(np.searchsorted(side, 1))
            if first:
                held.append(rows.slice(0, first))
            if first == rows.num_rows:
                continue
            if leaves is None:
                leaves, whole = {}, pa.concat_tables(held).combine_chunks() if held else rows.slice(0, 0)
                marks = whole.column("leaf").to_numpy()
                cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), len(marks)] if len(marks) else []
                for s, e in zip(cuts, cuts[1:]):
                    leaves[int(marks[s])] = _Leaf(whole.slice(s, e - s))
                held, whole = [], None
            for at in range(first, rows.num_rows, ROWS):
                part = rows.slice(at, ROWS)
                v, own, d, home = _matrix(part.column("v")), *(part.column(c).to_numpy() for c in ("cell", "d", "leaf"))
                ask = _Asking(part.column("node").to_numpy(), v, part.column("u").to_numpy(), most)
                cells = np.unique(seen.cell[slice_of[list(leaves)]])
                to, slack = _about(v, seen.pivots[cells])
                for name, leaf in leaves.items():
                    s = slice_of[name]
                    away = to[:, np.searchsorted(cells, seen.cell[s])]
                    asks = _open(seen, s, away, d, own, ask.u, slack) & (home < name if once else home != name)
                    who = np.flatnonzero(asks)
                    if len(who):
                        ask.meet(leaf, who, away[who], slack[who])
                        yield from ask.sent()
                yield ask.answers()

    rows = members.unionByName(visitors(bounded)).repartitionById(tasks, "task").sortWithinPartitions("side", "leaf")
    return rows.select(*names).mapInArrow(run, _FOUND)


def _entries(points: DataFrame, most: int) -> DataFrame:
    """(node, ids, v): one row for each distinct vector with its ``most`` smallest keys; node is the first of them."""
    ranked = points.distinct().withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("k"))).where(F.col("r") <= most)
    entries = ranked.groupBy("v").agg(F.sort_array(F.collect_list("k")).alias("ids"))
    return entries.select(F.col("ids")[0].alias("node"), "ids", "v")


@dataclass
class Found:
    """rows: what was found; compared: (round, pairs), the pairs whose distance was computed."""

    rows: DataFrame
    compared: DataFrame


def _work(*rounds: DataFrame) -> DataFrame:
    out = None
    for k, found in enumerate(rounds):
        one = found.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("pairs")).select(F.lit(k + 1).alias("round"), "pairs")
        out = one if out is None else out.union(one)
    return out


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, leaf: int = LEAF) -> Found:
    """(src, dst, distance, place): the ``k`` nearest others of each row by Euclidean distance, exact, ties by key.

    Keys are longs and name a row; rows with null or non-finite vectors take no part.
    """
    points = _points(df, key, vector)
    entries = materialised(_entries(points, k + 1), "entries")
    index = built(entries, leaf)
    if index is None:
        none = df.sparkSession.createDataFrame([], "src long, dst long, distance double, place int")
        return Found(none, _work(df.sparkSession.createDataFrame([], _FOUND)))

    one = materialised(_within_leaves(index, k + 1, math.inf), "near")
    bound = one.where("id is not null").groupBy("node").agg(F.when(F.count(F.lit(1)) > k, F.max("distance")).alias("u"))
    two = materialised(_across_leaves(index, index.placed.join(bound, "node"), k + 1, False), "near")
    both = one.unionByName(two).where("id is not null")
    place = F.row_number().over(W.partitionBy("node").orderBy("distance", "id"))
    top = both.withColumn("r", place).where(F.col("r") <= k + 1).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("top"))
    of_vector = entries.join(top, "node").select("v", "top")
    others = F.posexplode(F.slice(F.filter("top", lambda x: x["id"] != F.col("k")), 1, k))
    rows = points.distinct().join(of_vector, "v").select(F.col("k").alias("src"), others.alias("at", "t"))
    return Found(rows.select("src", F.col("t.id").alias("dst"), F.col("t.distance").alias("distance"), (F.col("at") + 1).alias("place")), _work(one, two))


def within(df: DataFrame, key: str, vector: str, radius: float, leaf: int = LEAF) -> Found:
    """(src, dst, distance), src < dst: all pairs of rows at a distance of at most ``radius``, exact."""
    return _linked(_points(df, key, vector).distinct().select(F.col("k").alias("node"), F.array("k").alias("ids"), "v"), radius, leaf)


def linked(df: DataFrame, key: str, vector: str, radius: float, leaf: int = LEAF) -> Found:
    """(src, dst, distance) that connect the same rows as ``within`` does: copies of a vector are linked with the smallest
    key among them, and only that one with other vectors. So a group of copies is as many links as rows, not all pairs."""
    points = materialised(_points(df, key, vector).distinct(), "points")
    first = points.groupBy("v").agg(F.min("k").alias("node"))
    found = _linked(first.select("node", F.array("node").alias("ids"), "v"), radius, leaf)
    copies = points.join(first, "v").where((F.col("k") > F.col("node")) & F.lit(radius >= 0))
    return Found(found.rows.unionByName(copies.select(F.col("node").alias("src"), F.col("k").alias("dst"), F.lit(0.0).alias("distance"))), found.compared)


def _linked(entries: DataFrame, radius: float, leaf: int) -> Found:
    entries = materialised(entries, "entries")
    index = built(entries, leaf)
    if index is None:
        empty = entries.sparkSession.createDataFrame([], _FOUND)
        return Found(empty.select(F.col("node").alias("src"), F.col("id").alias("dst"), "distance"), _work(empty))

    one = materialised(_within_leaves(index, None, float(radius)), "near")
    two = materialised(_across_leaves(index, index.placed.withColumn("u", F.lit(float(radius))), None, True), "near")
    own, other = one.where("id > node"), two.where("id <> node")  # two leaves meet once, from either side
    rows = own.unionByName(other).select(F.least("node", "id").alias("src"), F.greatest("node", "id").alias("dst"), "distance")
    return Found(rows, _work(one, two))
