"""Near-duplicates by Order MinHash: several minimum occurrence-labelled k-mers, kept in text order.

A text is its lower-cased words; its k-mers are runs of words, each labelled with how often it occurred before in the
text. Each of many hash orders picks the two smallest labelled k-mers and hashes them in the order in which they stand, so
two texts share a sketch the likelier the smaller their edit distance is. Texts that share a sketch are candidates; a
banded alignment of their words decides: near-duplicates have an edit similarity 1 - distance / longer length of 0.8 or
more. Linked texts form classes, named by their smallest doc_id.

K-mers have three words, and two where the longer text of a pair has up to 100, since an edit destroys as many k-mers as
these have words. How many sketches there are follows, at every length, from the share ``miss`` of pairs that are lost
just at that similarity: with two-word k-mers for edits that stand as badly as they can, with three-word ones for edits
at random places (edits spread so evenly that they spare the fewest k-mers are lost more often, about 3 % just at 0.8).

Hot groups: equal texts become one text before anything else. A bucket's members are first aligned with its smallest
member only, so a group of near copies costs one row for each member. Buckets that then still hold several classes
mostly come of passages that unlike texts share. Their members are compared across classes, in blocks, each pair in one
bucket only: counts of words bound the distance from below, and what the bound can't tell apart is aligned in the block
itself, which joins classes as it goes. What leaves a block is a link for each join, never a pair that was looked at, and
no pair that shares a bucket is given up.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import blocks, textnum
from skyledger.llm.common import components, discarded, fresh, written

WORDS = 3
SIMILARITY = 0.8
#: Share of pairs just at the similarity that share no sketch.
MISS = 5e-4
#: K-mers of a sketch.
PICKS = 2
#: Words of a pair's longer text up to which k-mers are a word shorter.
SHORT = 100
#: Diagonals of the band that is tried before a wider one.
NARROW = 24
#: Bins of a text's word counts.
BINS = 256
#: Words by which a row counts as one more in the size of a block.
WORDS_OF_WEIGHT = 512


def _edits(n: int, similarity: float) -> int:
    """Edits allowed to a pair whose longer text has ``n`` words."""
    return int(n * (1 - similarity) + 1e-9)


@functools.cache
def needed(n: int, similarity: float = SIMILARITY, miss: float = MISS, words: int = WORDS) -> int:
    """Sketches that pairs whose longer text has ``n`` words need; 0 where only equal texts are similar."""
    edits = _edits(n, similarity)
    if not edits:
        return 0
    size = words - 1 if n <= SHORT else words
    grams = max(1, n - size + 1)
    worst, random = grams - size * edits, grams * (1 - edits / n) ** size
    shared = worst if n <= SHORT and worst >= PICKS else random
    # Of all k-mers of two texts (2 * grams - shared) both have the shared ones; a sketch agrees if its picks are such.
    agree = math.prod(max(shared - k, 0.5) / max(2 * grams - shared - k, 1) for k in range(PICKS))
    return math.ceil(math.log(miss) / math.log(1 - min(agree, 1 - miss)))


@functools.cache
def plan(n: int, similarity: float = SIMILARITY, miss: float = MISS, words: int = WORDS) -> tuple[int, int]:
    """(sketches of shorter k-mers, sketches of k-mers of ``words``) of a text of ``n`` words.

    A pair is met by the sketches that its longer text's length needs; both texts have these, as its shorter text has
    ``similarity`` times as many words at least. Beyond ``SHORT`` words the need hardly changes with the length.
    """
    longest = int(n / similarity + 1e-9)
    short = max((needed(k, similarity, miss, words) for k in range(n, min(longest, SHORT) + 1)), default=0)
    return short, needed(10 * SHORT, similarity, miss, words) + 1 if longest > SHORT else 0


def marks(hashes: np.ndarray, similarity: float = SIMILARITY, miss: float = MISS, words: int = WORDS) -> np.ndarray:
    """The marks of one text, given its words' hashes, as signed longs: near-duplicates share one.

    None for texts so short that only equal ones are similar.
    """
    short, long = plan(len(hashes), similarity, miss, words)
    out = [sketch(hashes, n, PICKS, size, seed) for n, size, seed in ((short, words - 1, 1), (long, words, 2)) if n]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def sketch(hashes: np.ndarray, sketches: int, picks: int, words: int = WORDS, seed: int = 1) -> np.ndarray:
    """Sketches of one text, given its words' hashes, as signed longs; none for a text without words."""
    grams = textnum.windows(hashes, words)
    if not len(grams):
        return np.zeros(0, np.int64)
    labelled = textnum.mixed(grams + textnum.occurrence(grams).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    # A text with more sketches has those of one with fewer: the keys are drawn one sketch after the other.
    keys = np.random.default_rng(seed).integers(1, 1 << 63, (sketches, 2), dtype=np.int64).astype(np.uint64).T[:, :, None]
    out = np.arange(sketches, dtype=np.uint64) + np.uint64(seed << 32)
    step = max(1, 2_000_000 // len(labelled))  # orders held at once: bounded for very long texts
    for lo in range(0, sketches, step):
        order = (labelled[None, :] ^ keys[0, lo : lo + step]) * (keys[1, lo : lo + step] | np.uint64(1))
        order ^= order >> np.uint64(29)
        chosen = np.empty((len(order), min(picks, len(labelled))), np.int64)
        for p in range(chosen.shape[1]):
            chosen[:, p] = order.argmin(axis=1)
            order[np.arange(len(order)), chosen[:, p]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        chosen.sort(axis=1)
        for p in range(chosen.shape[1]):
            out[lo : lo + step] = textnum.mixed(out[lo : lo + step] * np.uint64(3) + labelled[chosen[:, p]])
    return out.view(np.int64)


def edit_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences by furthest-reaching points within the band of ``most`` diagonals; None beyond it."""
    lo, na, nb = 0, len(a), len(b)
    while lo < na and lo < nb and a[lo] == b[lo]:
        lo += 1
    while na > lo and nb > lo and a[na - 1] == b[nb - 1]:
        na, nb = na - 1, nb - 1
    a, b = a[lo:na], b[lo:nb]
    na, nb = len(a), len(b)
    if abs(na - nb) > most:
        return None
    goal = nb - na
    reach = {0: 0}
    x = 0
    while x < na and x < nb and a[x] == b[x]:
        x += 1
    reach[0] = x
    d = 0
    while reach.get(goal, -1) < na:
        d += 1
        if d > most:
            return None
        new = {}
        for k in range(max(-d, -na, goal - (most - d)), min(d, nb, goal + (most - d)) + 1):
            x = max(reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1, reach.get(k - 1, -2))
            if x < 0:
                continue
            x = min(x, na, nb - k)
            while x < na and x + k < nb and a[x] == b[x + k]:
                x += 1
            new[k] = x
        reach = new
    return d


def wide_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences for wide bands: columns of differences as bits of long integers; None beyond ``most``."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = every, 0, len(a)
    for left, x in zip(range(len(b) - 1, -1, -1), b):
        equal = at.get(x, 0)
        level = equal | down
        cross = ((equal & up) + up ^ up) | equal
        plus, minus = down | (every & ~(cross | up)), up & cross
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        if score - left > most:
            return None
        plus, minus = plus << 1 & every | 1, minus << 1 & every
        up, down = minus | (every & ~(level | plus)), plus & level
    return score if score <= most else None


def similar(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two texts, given their words' hashes, have an edit similarity of at least ``similarity``."""
    longer = max(len(x), len(y))
    if not longer:
        return False
    most = int(longer * (1 - similarity) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    # Equal words at either end cost nothing; the rest's words in common bound the distance from below.
    shorter = min(len(x), len(y))
    unlike = np.flatnonzero(x[:shorter] != y[:shorter])
    lo = int(unlike[0]) if len(unlike) else shorter
    unlike = np.flatnonzero(x[::-1][: shorter - lo] != y[::-1][: shorter - lo])
    hi = int(unlike[0]) if len(unlike) else shorter - lo
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    if max(len(x), len(y)) <= most:
        return True
    both = np.concatenate([x, y])
    order = np.argsort(both, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
    ones = np.add.reduceat((order < len(x)).astype(np.int64), edge)
    common = int(np.minimum(ones, np.diff(np.append(edge, len(both))) - ones).sum())
    if max(len(x), len(y)) - common > most:
        return False
    x, y = x.tolist(), y.tolist()
    if edit_distance(x, y, min(most, NARROW)) is not None:
        return True
    return most > NARROW and wide_distance(x, y, most) is not None


def sketched(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, miss: float = MISS, words: int = WORDS) -> DataFrame:
    """(id, text_key, node, n_words, bins, marks) of every row. node: md5 of the words' hashes, null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                nodes, met, sizes, bins = [], [], [], []
                for hashes in textnum.word_hashes_of(part.column(2).to_pylist()):
                    nodes.append(hashlib.md5(hashes.tobytes()).digest() if len(hashes) else None)
                    met.append(marks(hashes, similarity, miss, words))
                    sizes.append(len(hashes))
                    bins.append(counted(hashes))
                columns = [part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bins, pa.binary()), pa.array(met, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "node", "n_words", "bins", "marks"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "id long, text_key long, node binary, n_words int, bins binary, marks array<bigint>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _hashed(texts: DataFrame) -> DataFrame:
    """``texts`` with the words' hashes, eight bytes each, in place of its last column, the text."""
    names = texts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                hashes = [h.tobytes() for h in textnum.word_hashes_of(part.column(len(names)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hashes, pa.binary())], [*names, "hashes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(run, f"{kinds}, hashes binary")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. texts: (node, hashes, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x, y = ([np.frombuffer(h, np.uint64) for h in part.column(k).to_pylist()] for k in (2, 3))
                keep = pa.array([similar(*pair, similarity) for pair in zip(x, y)], pa.bool_())
                yield part.select(["a", "b"]).filter(keep)

    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    # Both sides of each join are written tables, so that a representative of very many members can be split.
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b"
    )
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, label, weight) of the buckets of three or more that still hold different classes."""
    named = members.where("size > 2").select("bucket", "node", "n_words").join(labels.withColumnRenamed("id", "node"), "node", "left")
    weight = F.lit(1) + F.floor(F.col("n_words") / WORDS_OF_WEIGHT)
    named = named.select("bucket", "node", F.coalesce("component", "node").alias("label"), weight.cast("long").alias("weight"))
    several = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return written(named.join(several.select("bucket"), "bucket"), "open")


def counted(hashes: np.ndarray) -> bytes:
    """How many words fall in each of ``BINS`` bins, by hash; counts over 255 stay 255."""
    return np.minimum(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


class _Block:
    """The rows of one pair of blocks of a bucket: which pairs are to be compared here, and their bounds."""

    def __init__(self, t: pa.Table, similarity: float) -> None:
        self.similarity, self.bucket = similarity, t.column("bucket")[0].as_py()
        self.bins = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
        self.words = t.column("n_words").to_numpy().astype(np.int64)
        _, self.label = np.unique(np.array(t.column("label").to_pylist(), dtype=object), return_inverse=True)
        met = t.column("marks").combine_chunks()
        values, row = met.flatten().to_numpy(), np.repeat(np.arange(len(met)), np.diff(met.offsets.to_numpy()))
        before = values < self.bucket
        values, row = values[before], row[before]
        order = np.argsort(values, kind="stable")
        values, row = values[order], row[order]
        edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
        # Of each row, the lists of rows that share one of its smaller marks.
        self.rows, self.edge = row, np.append(edge, len(values))
        nth = np.repeat(np.arange(len(edge)), np.diff(self.edge))
        shared = np.diff(self.edge)[nth] > 1
        by_row = np.argsort(row[shared], kind="stable")
        self.lists, self.first = nth[shared][by_row], np.searchsorted(row[shared][by_row], np.arange(len(met) + 1))

    def pairs(self, x: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``y`` that may be similar to ``x`` and meet it in no smaller bucket, likeliest first, and their bounds."""
        y = y[self.label[y] != self.label[x]]
        most = np.maximum(self.words[y], self.words[x]) * (1 - self.similarity) + 1e-9
        near = np.abs(self.words[y] - self.words[x]) <= most
        y, most = y[near], most[near]
        bound = np.abs(self.bins[y] - self.bins[x]).sum(axis=1, dtype=np.int64) // 2
        fits = bound <= most
        y, bound = y[fits], bound[fits]
        if len(y) and self.first[x] < self.first[x + 1]:
            elsewhere = np.zeros(len(self.words), bool)
            for k in self.lists[self.first[x] : self.first[x + 1]].tolist():
                elsewhere[self.rows[self.edge[k] : self.edge[k + 1]]] = True
            y, bound = y[~elsewhere[y]], bound[~elsewhere[y]]
        order = np.argsort(bound, kind="stable")
        return y[order], bound[order]


def _across(open_: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between unlike classes of a bucket: enough of them to join whatever is similar, one a text at most.

    A pair is compared in the smallest bucket that both texts are in. Every edit changes the words' bin counts by two at
    most, so half the difference of two texts' counts is a lower bound of their distance. Rows that no pair of a block
    needs are left out before the words come. A block keeps the classes that it has joined, so texts that are of one
    class by then are not aligned.
    """

    def needed(t: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
        block, hit = _Block(t, similarity), np.zeros(t.num_rows, bool)
        for x in a.tolist():
            y, _ = block.pairs(x, b[b > x] if a is b else b)
            hit[y] = True
            hit[x] |= len(y) > 0
        if not hit.any():
            return None
        return t.select(["bucket", "i", "j", "side", "node", "label"]).filter(pa.array(hit)).combine_chunks().to_batches()[0]

    def aligned(t: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
        block, found = _Block(t, similarity), []
        hashes = [np.frombuffer(h, np.uint64) for h in t.column("hashes").to_pylist()]
        for x in a.tolist():
            y, _ = block.pairs(x, b[b > x] if a is b else b)
            while len(y):
                one = int(y[0])
                if similar(hashes[x], hashes[one], similarity):
                    found.append((x, one))
                    block.label[block.label == block.label[one]] = block.label[x]
                y = y[1:]
                y = y[block.label[y] != block.label[x]]
        if not found:
            return None
        left, right = (t.column("node").combine_chunks().take(pa.array(side)) for side in zip(*found))
        return pa.RecordBatch.from_arrays([left, right], ["a", "b"])

    rows = written(blocks.across(open_), "dealt").join(texts.select("node", "n_words", "bins", "marks"), "node")
    kind = "bucket long, i int, j int, side int, node binary, label binary"
    rows = written(blocks.arranged(rows).mapInArrow(lambda batches: blocks.each(batches, needed), kind), "needed")
    rows = rows.join(texts.select("node", "n_words", "bins", "marks", "hashes"), "node")
    return blocks.arranged(rows).mapInArrow(lambda batches: blocks.each(batches, aligned), "a binary, b binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
            miss: float = MISS, words: int = WORDS) -> DataFrame:
    """One row for each row of ``docs``: id, text_key (xxhash64 of the text), class_id (smallest id of its class).

    Texts that are null, empty or without words belong to no group: each is a class of its own, named by its own id.
    Texts of the same words, whatever their case and
    punctuation, are one text. Rows with a null id take part; a class of null ids only has a null class_id. Rows that
    share an id but not the text are told apart by text_key; rows equal in both get the same class. Other columns are
    not read. An empty table gives no rows.
    """
    rows = written(sketched(docs, id_col, text_col, similarity, miss, words), "sketches")
    distinct = rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_key")).alias("first"), F.first("n_words").alias("n_words"), F.first("bins").alias("bins"), F.first("marks").alias("marks")
    )
    distinct = written(distinct.select("node", "first.id", "first.text_key", "n_words", "bins", "marks"), "texts")
    sketches, rows = rows, written(rows.select("id", "text_key", "node"), "rows")
    discarded(sketches)
    members = distinct.select("node", "n_words", F.explode("marks").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n_words")).alias("rep")).where("size > 1")
    members = written(members.join(written(sizes, "buckets"), "bucket"), "members")
    # Only texts that share a bucket are read again, each by one of its rows.
    # Of rows that repeat one is taken within the join's own partitioning, so texts are shuffled once.
    wanted = members.select("node").distinct().join(distinct, "node").withColumn("key", F.coalesce("id", F.lit(-1))).drop("id")
    found = _keyed(docs, id_col, text_col).select(F.coalesce("id", F.lit(-1)).alias("key"), "text_key", "text").join(wanted, ["key", "text_key"])
    found = found.groupBy("key", "text_key").agg(*(F.first(c).alias(c) for c in ("node", "n_words", "bins", "marks", "text"))).drop("key", "text_key")
    texts = written(_hashed(found), "candidates")

    # Texts whose lengths alone differ by more than the edits allowed are not read.
    longer = F.greatest("n_words", "rep.n_words")
    alike = F.abs(F.col("n_words") - F.col("rep.n_words")) <= longer * (1 - similarity) + 1e-9
    pairs = members.where((F.col("node") != F.col("rep.node")) & alike).select(F.col("rep.node").alias("a"), F.col("node").alias("b"))
    links = written(_verified(pairs, texts, similarity), "links")
    more = written(_across(_open(members, components(links)), texts, similarity), "across")
    labels = components(links.union(more))
    named = distinct.join(labels.withColumnRenamed("id", "node"), "node", "left").select(
        "node", "id", F.coalesce("component", "node").alias("label")
    )
    least = named.groupBy("label").agg(F.min("id").alias("class_id"))
    of_node = written(named.join(least, "label").select("node", "class_id"), "classes")
    return rows.select("id", "text_key", "node").join(of_node, "node", "left").select(
        "id", "text_key", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class, that of its smallest id, all columns as they were."""
    of_rows = classes(docs, id_col, text_col, **how).where("id <=> class_id")
    kept = written(of_rows.groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("times")), "kept")
    name = fresh(docs, "key")
    marked = docs.withColumn(name, F.xxhash64(F.col(text_col).cast("string"))).alias("d")
    out = marked.join(kept.alias("k"), F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("k.id")) & (F.col(f"d.{name}") == F.col("k.text_key")), "left_semi")
    if not kept.where("times > 1").isEmpty():
        out = out.dropDuplicates([id_col, name])
    return out.drop(name)
