"""LM scoring by a hashed maximum-entropy model: n-gram and skip features, a class-factored softmax.

Tokens are runs without ASCII white space, A-Z in lower case, and one end token for each text. Counts of all tokens of
all training texts give the base (unigram) model and the vocabulary: the most frequent tokens are words, in about as many
classes as the root of their number (each of about the same sum of roots of counts, of words of like frequency and
ending); all others fall in ``TAILS`` classes by their last two bytes. The model is

    P(token) = P(class | previous token, token before that) * P(token | class, previous token),

both factors log-linear. The class factor has a bias, the previous token (n-gram) and the token two places back (skip);
the word factor has a bias and the previous token with the word, hashed into the weights of its class. Tokens of a
context are hashed into buckets: half are for one frequent word each, half are for endings. In a tail class a token's
share is that of its count.

What the model holds grows with the training tokens N: words as 16 N^1/2, classes as its root, buckets of previous tokens
as 3 N^1/3, weights as words times buckets (see ``Shape``); memory sets bounds far above. Events are counted over all
training texts, exactly. The class factor is fitted by gradient steps over all events in parallel, the word factor by
gradient steps in one task for each class, whose events are at most buckets times its words. A token is scored by looking
up its few weights and two normalisers, in sparse numpy batches.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import textnum
from skyledger.llm.common import written

TAILS = 64
SKIPS = 64
STEPS = 12
#: Part of a full step, and the prior's weight in counts.
RATE = 0.5
PRIOR = 1.0
#: Bounds set by memory of a task: words (about 100 bytes each), buckets, weights (4 bytes each).
MOST_WORDS = 1_000_000
MOST_BUCKETS = 4096
MOST_WEIGHTS = 1 << 24
#: Class events of a task (about 40 bytes each while it sorts them).
EVENTS = 2_000_000
END = b""


@dataclass(frozen=True)
class Shape:
    """How large a model of so many training tokens is."""

    words: int
    buckets: int

    @classmethod
    def of(cls, total: int) -> Shape:
        buckets = 1 << max(4, round(np.log2(max(1, total)) / 3 + 1.5))
        return cls(min(MOST_WORDS, max(256, int(16 * total**0.5))), min(MOST_BUCKETS, buckets))


def tokens(text: str | None) -> list[bytes]:
    """Tokens of a text without the end token."""
    return (text or "").encode("utf-8", "replace").lower().split()


def tail(token: bytes) -> int:
    return ending(token) % TAILS


def ending(token: bytes) -> int:
    """Hash of the last two bytes of a token."""
    return zlib.crc32(token[-2:])


def counted(texts: DataFrame) -> DataFrame:
    """(token, n) over the column ``text``; the end token is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens(text))
                seen[END] += 1
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Lexicon:
    """Words by class and the sizes of the model."""

    ids: dict[bytes, int]
    contexts_of: np.ndarray  # of each word and at last of the start of a text: its bucket as previous and as skipped token
    log_count: np.ndarray  # of each word, and of a count of 0 at last
    firsts: np.ndarray  # first word of each class, and the number of words at last
    buckets: int
    total: int
    distinct: int
    tail_log: np.ndarray

    @property
    def n_words(self) -> int:
        return len(self.ids)

    @property
    def n_classes(self) -> int:
        return len(self.firsts) - 1 + TAILS

    def classes(self, outcome: np.ndarray) -> np.ndarray:
        """Class of each outcome: a word, then the tail classes, then the start of a text."""
        word = np.searchsorted(self.firsts, outcome, side="right") - 1
        return np.where(outcome < self.n_words, word, outcome - self.n_words + len(self.firsts) - 1)

    def read(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """(word or -1, outcome, buckets) of all tokens, where each text's tokens begin and at last the end, tokens that are no words."""
        words = [[*tokens(t), END] for t in texts]
        begins = np.cumsum([0, *map(len, words)])
        get = self.ids.get
        row = np.fromiter((get(w, -1) for w in chain.from_iterable(words)), np.int64, int(begins[-1]))
        outcome, others, codes = row.copy(), [[] for _ in texts], self.contexts_of[row]
        rare = np.flatnonzero(row < 0)
        text = np.searchsorted(begins, rare, side="right") - 1
        for k, n in zip(rare.tolist(), text.tolist()):
            word = words[n][k - begins[n]]
            others[n].append(word)
            end = ending(word)
            outcome[k] = self.n_words + end % TAILS
            codes[k] = _coded(end, self.buckets), _coded(end, SKIPS)
        return row, outcome, codes, begins, others

    def contexts(self, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of the previous token, bucket of the token two places back) of each token."""
        start = self.contexts_of[-1]
        bucket, skip = np.full(len(codes), start[0]), np.full(len(codes), start[1])
        bucket[1:], skip[2:] = codes[:-1, 0], codes[:-2, 1]
        bucket[begins[:-1]], skip[begins[:-1]] = start
        second = begins[:-1] + 1
        skip[second[second < begins[1:]]] = start[1]
        return bucket, skip

    def weights_of(self, word_class: int) -> int:
        """Hashed weights of a class's word factor: one for eight pairs of bucket and word, within the bound of all."""
        m = int(self.firsts[word_class + 1] - self.firsts[word_class])
        return max(1, min(self.buckets * m // 8, MOST_WEIGHTS * m // self.n_words))


def _coded(end: int | np.ndarray, buckets: int) -> int | np.ndarray:
    """Bucket of a token that has none of its own, given its ending."""
    return buckets // 2 + end % (buckets // 2)


def _place(bucket: np.ndarray, word: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Where in its class's weights the feature (bucket, word of the class) lies."""
    value = textnum.mixed(bucket.astype(np.uint64) * np.uint64(1 << 32) + word.astype(np.uint64))
    return (value % np.asarray(size, np.uint64)).astype(np.int64)


def lexicon(counts: DataFrame) -> tuple[Lexicon, int]:
    """The lexicon of (token, n) and the least count that makes a token a word."""
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(totals["n"] or 0), int(totals["v"])
    shape = Shape.of(total)
    # The least count is taken from a histogram, so that no task sorts the vocabulary.
    level = F.floor(F.log2("n") * 8).cast("int")
    least, have = 1, 0
    levels = {r["level"]: r["k"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()}
    for at in sorted(levels, reverse=True):
        have += levels[at]
        if have > shape.words:
            least = int(2 ** ((at + 1) / 8)) + 1
            break
    is_word = (F.col("n") >= least) | (F.col("token") == F.lit(END))
    top = counts.where(is_word).toPandas()
    words, n = [bytes(t) for t in top["token"]], top["n"].to_numpy(np.int64)
    ranked = sorted(range(len(words)), key=lambda k: (words[k] != END, -n[k], words[k]))
    rank = np.empty(len(words), np.int64)
    rank[ranked] = np.arange(len(words))
    # Like frequency: the same rank up to 256, then the same power of two. Classes are stretches of this order.
    order = sorted(ranked, key=lambda k: (rank[k] if rank[k] < 256 else 256 + int(rank[k]).bit_length(), words[k][-2:]))
    words, n, rank = [words[k] for k in order], n[order], rank[order]
    mass = np.cumsum(np.sqrt(n))
    classes = max(1, round(len(n) ** 0.5))
    class_of = np.minimum((mass - np.sqrt(n)) / mass[-1:] * classes, classes - 1).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    firsts = np.append(np.flatnonzero(np.diff(class_of, prepend=-1)), len(n))
    ends = np.array([ending(w) for w in words], np.int64)
    contexts_of = np.array([np.where(rank < size // 2 - 1, rank, _coded(ends, size)) for size in (shape.buckets, SKIPS)], np.int64).T.reshape(-1, 2)
    contexts_of = np.concatenate([contexts_of, [[shape.buckets // 2 - 1, SKIPS // 2 - 1]]])
    kind = F.crc32(F.expr("substring(token, -2, 2)")) % TAILS
    rest = counts.where(~is_word).groupBy(kind.alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    tail_log = np.full(TAILS, np.log10(0.1))
    for r in rest.collect():
        tail_log[int(r["tail"])] = np.log10(r["n"] + 0.1 * (r["v"] + 1))
    log_count = np.log10(np.append(n, 0) + 0.1)
    return Lexicon({w: k for k, w in enumerate(words)}, contexts_of, log_count, firsts, shape.buckets, total, distinct, tail_log), least


def events(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """(key, part, n) of all tokens of the column ``text``, each counted in both factors.

    Word factor: key = word * buckets + bucket, part = class. Class factor: key = -1 - ((bucket * SKIPS + skip) * classes
    + class), part = bucket.
    """
    shared = texts.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, held, size = shared.value, [], 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part = np.where(key < 0, (-1 - key) // (SKIPS * lex.n_classes), lex.classes(np.maximum(key, 0) // lex.buckets))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.astype(np.int32)), pa.array(n.astype(np.int64))], ["key", "part", "n"])

        for batch in batches:
            for group in textnum.groups(batch.column(0).to_pylist(), 2_000_000):
                _, outcome, codes, begins, _ = lex.read(group)
                bucket, skip = lex.contexts(codes, begins)
                word = outcome < lex.n_words
                held.append(outcome[word] * lex.buckets + bucket[word])
                held.append(-1 - ((bucket * SKIPS + skip) * lex.n_classes + lex.classes(outcome)))
                size += len(outcome)
                if size > 2_000_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    found = texts.select(F.col("text").cast("string")).mapInArrow(run, "key long, part int, n long")
    return found.groupBy("key", "part").agg(F.sum("n").alias("n"))


def _moved(weights: np.ndarray, observed_less_expected: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Weights after one step along the gradient, each scaled by its own curvature's bound."""
    return weights + np.clip(RATE * (observed_less_expected - PRIOR * weights) / (expected + PRIOR), -1, 1)


def _soft(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(softmax of each row, logarithm of each row's sum of exponentials)."""
    top = z.max(axis=1, keepdims=True)
    p = np.exp(z - top)
    total = p.sum(axis=1, keepdims=True)
    return p / total, (np.log(total) + top)[:, 0]


def word_factors(found: DataFrame, lex: Lexicon, steps: int = STEPS) -> DataFrame:
    """(part, bias, weights, norms): of each class, its words' biases, hashed weights and a normaliser for each bucket."""
    shared = found.sparkSession.sparkContext.broadcast(lex)

    def fit(table: pa.Table) -> pa.Table:
        lex, part = shared.value, table.column("part")[0].as_py()
        first, last = int(lex.firsts[part]), int(lex.firsts[part + 1])
        word, bucket = np.divmod(table.column("key").to_numpy(), lex.buckets)
        seen = np.bincount(bucket * (last - first) + word - first, table.column("n").to_numpy(), lex.buckets * (last - first))
        seen = seen.reshape(lex.buckets, last - first)
        size = lex.weights_of(part)
        place = _place(np.arange(lex.buckets)[:, None], np.arange(last - first)[None, :], size)
        bias, weights, rows = np.log(seen.sum(axis=0) + 0.1), np.zeros(size), seen.sum(axis=1, keepdims=True)
        for _ in range(steps if last - first > 1 else 0):
            expected = _soft(bias + weights[place])[0] * rows
            change = seen - expected
            bias = _moved(bias, change.sum(axis=0), expected.sum(axis=0))
            weights = _moved(weights, np.bincount(place.ravel(), change.ravel(), size), np.bincount(place.ravel(), expected.ravel(), size))
        bias, weights = bias.astype(np.float32), weights.astype(np.float32)
        norms = _soft((bias + weights[place]).astype(np.float64))[1]
        columns = [pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (bias, weights, norms))]
        return pa.table(columns, names=["part", "bias", "weights", "norms"])

    return found.where("key >= 0").groupBy("part").applyInArrow(fit, "part int, bias binary, weights binary, norms binary")


def class_factor(found: DataFrame, lex: Lexicon, steps: int = STEPS) -> np.ndarray:
    """Weights of the class factor: a row for each bucket, for each hashed skip, and the biases."""
    spark = found.sparkSession
    rows = found.where("key < 0").select("key", "part", "n")
    # A task holds and sorts its events, so their number is bounded, not that of the tasks.
    parts = max(8, spark.sparkContext.defaultParallelism, math.ceil(rows.count() / EVENTS))
    rows = written(rows.repartition(parts, "part"), "class-events")
    weights = np.zeros((lex.buckets + SKIPS + 1, lex.n_classes))

    def stepped(weights: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast((weights, lex.buckets, lex.n_classes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, buckets, width = shared.value
            change, expected, touched = np.zeros_like(weights), np.zeros_like(weights), np.zeros(len(weights), bool)
            table = [b for b in batches if b.num_rows]
            if not table:
                return
            key = -1 - np.concatenate([b.column(0).to_numpy() for b in table])
            n = np.concatenate([b.column(2).to_numpy() for b in table]).astype(np.float64)
            context, at = np.unique(key // width, return_inverse=True)
            order = np.argsort(at, kind="stable")
            edge = np.searchsorted(at[order], np.arange(0, len(context) + 1024, 1024))
            for lo, s, e in zip(range(0, len(context), 1024), edge, edge[1:]):
                bucket, skip = np.divmod(context[lo : lo + 1024], SKIPS)
                own = order[s:e]
                seen = np.bincount((at[own] - lo) * width + key[own] % width, n[own], len(bucket) * width).reshape(-1, width)
                if first:
                    guess = np.zeros_like(seen)
                else:
                    guess = _soft(weights[bucket] + weights[buckets + skip] + weights[-1])[0] * seen.sum(axis=1, keepdims=True)
                kinds, which = np.unique(bucket, return_inverse=True)
                for places, of in ((kinds, which), (buckets + np.arange(SKIPS), skip), (np.array([len(weights) - 1]), np.zeros(len(skip), np.int64))):
                    one = np.zeros((len(places), len(of)))
                    one[of, np.arange(len(of))] = 1
                    change[places] += one @ (seen - guess)
                    expected[places] += one @ guess
                    touched[places] = True
            at = np.flatnonzero(touched)  # a bucket's events are in one task, so few rows are sent
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array([x[k].tobytes() for k in at], pa.binary()) for x in (change, expected))], ["at", "change", "expected"])

        change, expected = np.zeros_like(weights), np.zeros_like(weights)
        for row in rows.mapInArrow(run, "at long, change binary, expected binary").toLocalIterator():
            change[row["at"]] += np.frombuffer(row["change"])
            expected[row["at"]] += np.frombuffer(row["expected"])
        shared.destroy()
        return change, expected

    seen, _ = stepped(weights, True)
    weights[-1] = np.log(seen[-1] + 0.1)
    for _ in range(steps):
        weights = _moved(weights, *stepped(weights, False))
    return weights


@dataclass(frozen=True)
class Model:
    """Weights and normalisers of both factors, natural logarithms."""

    lex: Lexicon
    classes: np.ndarray
    class_norms: np.ndarray  # buckets x skips
    bias: np.ndarray
    weights: np.ndarray
    first_weight: np.ndarray  # of each class
    word_norms: np.ndarray  # classes of words x buckets

    def class_logs(self, bucket: np.ndarray, skip: np.ndarray, kind: np.ndarray) -> np.ndarray:
        w = self.classes
        return w[bucket, kind] + w[self.lex.buckets + skip, kind] + w[-1, kind] - self.class_norms[bucket, skip]

    def word_logs(self, bucket: np.ndarray, word: np.ndarray, kind: np.ndarray) -> np.ndarray:
        first = self.first_weight[kind]
        place = first + _place(bucket, word - self.lex.firsts[kind], self.first_weight[kind + 1] - first)
        return self.bias[word] + self.weights[place] - self.word_norms[kind, bucket]

    def scores(self, row: np.ndarray, outcome: np.ndarray, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log10 counts of its words, log10 probability less the rare tokens' counts) of each text."""
        lex = self.lex
        bucket, skip = lex.contexts(codes, begins)
        kind = lex.classes(outcome)
        logs = self.class_logs(bucket, skip, kind)
        word = outcome < lex.n_words
        logs[word] += self.word_logs(bucket[word], outcome[word], kind[word])
        logs /= np.log(10)
        logs[~word] -= lex.tail_log[outcome[~word] - lex.n_words]
        counts = np.where(row < 0, 0.0, lex.log_count[row])
        return np.add.reduceat(counts, begins[:-1]), np.add.reduceat(logs, begins[:-1])


def trained(found: DataFrame, lex: Lexicon, steps: int = STEPS) -> Model:
    """The model of the events ``found`` of a lexicon that has words."""
    found = written(found, "events")
    weights = class_factor(found, lex, steps)
    norms = np.empty((lex.buckets, SKIPS))
    for k in range(lex.buckets):
        norms[k] = _soft(weights[k] + weights[lex.buckets : lex.buckets + SKIPS] + weights[-1])[1]
    n = len(lex.firsts) - 1
    first_weight = np.concatenate([[0], np.cumsum([lex.weights_of(k) for k in range(n)])])
    bias, hashed, word_norms = np.zeros(lex.n_words, np.float32), np.zeros(int(first_weight[-1]), np.float32), np.zeros((n, lex.buckets))
    for row in written(word_factors(found, lex, steps), "word-factors").toLocalIterator():
        k = row["part"]
        bias[lex.firsts[k] : lex.firsts[k + 1]] = np.frombuffer(row["bias"], np.float32)
        hashed[first_weight[k] : first_weight[k + 1]] = np.frombuffer(row["weights"], np.float32)
        word_norms[k] = np.frombuffer(row["norms"])
    return Model(lex, weights.astype(np.float32), norms, bias, hashed, first_weight, word_norms)


def scored(docs: DataFrame, id_col: str, text_col: str, counts: DataFrame, lex: Lexicon, least: int, model: Model | None) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each row of ``docs``, logarithms to base 10.

    Null and empty texts have the end token only. Tokens that no training text has count 0. Without training texts
    both scores are 0. Repeated rows and null ids give rows of their own; other columns are not read. An empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        for batch in batches:
            at = 0
            for group in textnum.groups(batch.column(1).to_pylist(), 1_000_000):
                row, outcome, codes, begins, rare = lex.read(group)
                common, logs = model.scores(row, outcome, codes, begins) if model else (np.zeros(len(group)),) * 2
                known = np.add.reduceat((row >= 0).astype(np.int64), begins[:-1]) if len(group) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(group)), pa.array(np.diff(begins)), pa.array(known), pa.array(common), pa.array(logs), pa.array(rare, pa.list_(pa.binary()))],
                    ["id", "n_tokens", "n_common", "common_log", "model_log", "rare"],
                )
                at += len(group)

    kinds = "id long, n_tokens long, n_common long, common_log double, model_log double, rare array<binary>"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(source.mapInArrow(run, kinds).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("k"))
    known = rare.join(counts.where(F.col("n") < least), "token", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("rare_log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"),
    )
    floor = float(np.log10(lex.total + 0.1 * (lex.distinct + 1)))
    logs = F.coalesce("rare_log", F.lit(0.0))
    base = F.col("common_log") + logs - F.col("n_tokens") * F.lit(floor)
    if not lex.n_words:  # nothing learned: every token counts 0 of 0
        base = F.lit(0.0)
    return rows.join(known, "row", "left").select(
        "id", "n_tokens", (F.col("n_common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), base.alias("base_score"),
        (F.col("model_log") + logs if lex.n_words else base).alias("score"),
    )


def learned_and_scored(train: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(scores of ``docs`` by a model learned from all of ``train``, its number of training tokens)."""
    texts = train.select(F.col(text_col).alias("text"))
    counts = written(counted(texts), "counts")
    lex, least = lexicon(counts)
    model = trained(events(texts, lex), lex) if lex.n_words else None
    return scored(docs, id_col, text_col, counts, lex, least, model), lex.total
