"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated.

Words and runs of punctuation are hashed to a fixed number of rows. Each row has a sparse random index vector; its
context vector is the sum of the index vectors of its neighbours, two to either side, over the training sample. A
document is the mean of its words' index and context vectors, the length of the first mean (which tells repetitive
texts), how alike the index vectors of words one and two places apart are, and its logarithmic size. A network of one
hidden layer is trained on a bounded sample of labelled rows, and its logit is divided by a temperature fitted on rows
that it wasn't trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm import textnum
from skyledger.llm.common import crc32_of

ROWS = 1 << 14
DIM = 48
HIDDEN = 32
FEATURES = 2 * DIM + 4
#: Expected number of labelled rows that the model is fitted on; with fewer, all of them.
TRAIN_ROWS = 12_000
EPOCHS = 25
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def index_vectors(seed: int = 3) -> np.ndarray:
    """Sparse ternary vectors, six ones of random sign in each row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS, DIM), np.float32)
    for _ in range(6):
        out[np.arange(ROWS), rng.integers(0, DIM, ROWS)] = rng.choice([-1.0, 1.0], ROWS)
    return out


def word_rows(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word or punctuation run of the texts, where each text's begin and at last the end)."""
    data, begins = textnum.joined([(t or "").encode("utf-8", "replace") for t in texts])
    kind = np.where(_SPACE[data], 0, np.where(textnum.WORD_BYTE[data], 1, 2))
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    starts, ends = edge[:-1], edge[1:]
    ink = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[ink], ends[ink]
    rows = (textnum.span_hashes(data, starts, ends) >> np.uint64(50)).astype(np.int64)
    return rows, np.searchsorted(starts, begins)


def pooled(texts: list, context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The features of each text; zeros for texts without words."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    at = 0
    for group in textnum.groups(texts):
        rows, first = word_rows(group)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            sizes = np.diff(first)[full].astype(np.float32)
            for k, vectors in enumerate((index, context)):
                out[at + full, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[rows], first[full], axis=0) / sizes[:, None]
            out[at + full, -2] = np.linalg.norm(out[at + full, :DIM], axis=1)
            owner = np.repeat(np.arange(len(group)), np.diff(first))
            for gap in (1, 2):
                pairs = np.flatnonzero(owner[gap:] == owner[:-gap])
                alike = np.einsum("ij,ij->i", index[rows[pairs]], index[rows[pairs + gap]])
                out[at : at + len(group), -2 - gap] = np.bincount(owner[pairs], alike, len(group)) / np.maximum(np.bincount(owner[pairs], minlength=len(group)), 1)
            out[at + full, -1] = np.log1p(sizes)
        at += len(group)
    return out


def _context(sample: DataFrame, index: np.ndarray) -> np.ndarray:
    """Context vectors over the sample: each task adds up a matrix of fixed size, and the driver adds up those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((ROWS, DIM), np.float32), False
        for batch in batches:
            for group in textnum.groups(batch.column("text").to_pylist()):
                rows, first = word_rows(group)
                owner = np.repeat(np.arange(len(group)), np.diff(first))
                for gap in (1, 2):
                    same = np.flatnonzero(owner[gap:] == owner[:-gap])
                    for one, other in ((same, same + gap), (same + gap, same)):
                        order = np.argsort(rows[one], kind="stable")
                        word = rows[one][order]
                        starts = np.flatnonzero(np.diff(word, prepend=-1))
                        if len(starts):
                            total[word[starts]] += np.add.reduceat(index[rows[other]][order], starts, axis=0)
                seen |= len(rows) > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = np.zeros((ROWS, DIM), np.float32)
    for row in sample.select("text").repartition(8).mapInArrow(run, "total binary").collect():
        total += np.frombuffer(bytes(row["total"]), np.float32).reshape(ROWS, DIM)
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)


@dataclass(frozen=True)
class Model:
    context: np.ndarray
    index: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, texts: list) -> np.ndarray:
        z = self.logits(pooled(texts, self.context, self.index)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _network(x: np.ndarray, y: np.ndarray, seed: int) -> tuple:
    """A two-layer network trained by Adam on the mean log loss."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            a, b = x[order[lo : lo + 128]], y[order[lo : lo + 128]]
            h = np.tanh(a @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - b) / len(a)
            back = d[:, None] * p[2] * (1 - h * h)
            grads, t = [a.T @ back + 1e-3 * p[0], back.sum(0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])], t + 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def fitted(labelled: DataFrame, text_col: str, label_col: str, key: Column, train_rows: int = TRAIN_ROWS, seed: int = 3) -> Model:
    """A model from rows with label 0 or 1 (others are left out); the sample is chosen by a hash of ``key``.

    Without rows of both labels every text gets the share of label 1 (0.5 without any row).
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label"), crc32_of(key).alias("key"))
    rows = rows.where("label in (0, 1)")
    total = labelled.where(F.col(label_col).cast("int").isin(0, 1)).count()
    mark = F.crc32(F.concat_ws(":", F.lit("sample"), "key").cast("binary"))
    sample = rows.where(mark * F.lit(total) < F.lit(train_rows) * F.lit(2**32)).select("text", "label", (mark % 5 == 0).alias("apart"))
    index = index_vectors(seed)
    context = _context(sample, index)
    shared = labelled.sparkSession.sparkContext.broadcast((context, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pooled(batch.column("text").to_pylist(), *shared.value)
            flat = pa.array(found.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(flat, found.shape[1]).cast(pa.list_(pa.float32())), batch.column("label"), batch.column("apart")], ["x", "label", "apart"])

    got = sample.mapInArrow(run, "x array<float>, label int, apart boolean").toPandas()
    x = np.stack(got["x"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, FEATURES))
    y, apart = got["label"].to_numpy().astype(np.float64), got["apart"].to_numpy().astype(bool)
    order = np.lexsort((x[:, 0], x[:, -1]))  # the rows' order is Spark's; the fit must not depend on it
    x, y, apart = x[order], y[order], apart[order]
    if len(set(y.tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        zero = np.zeros((x.shape[1], HIDDEN))
        prior = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1 - 1e-6)))
        return Model(context, index, np.zeros(x.shape[1]), np.ones(x.shape[1]), zero, np.zeros(HIDDEN), np.zeros(HIDDEN), prior, 1.0)
    mean, scale = x[~apart].mean(0), np.maximum(x[~apart].std(0), 1e-6)
    net = _network((x[~apart] - mean) / scale, y[~apart], seed)
    model = Model(context, index, mean, scale, *net, 1.0)
    z, own = (model.logits(x[apart]), y[apart]) if apart.any() else (model.logits(x), y)
    # Platt's targets, (n + 1) / (n + 2): a few rows that the network separates don't prove that it never errs.
    ones, zeros = own.sum(), (1 - own).sum()
    target = np.where(own == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    steps = np.exp(np.linspace(np.log(0.2), np.log(50), 120))
    losses = [np.mean(np.logaddexp(0, z / t) - target * z / t) for t in steps]
    return Model(context, index, mean, scale, *net, float(steps[int(np.argmin(losses))]))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability of label 1 of each whole text (a column of that name is replaced).

    Null and empty texts get the score of a text without words. Equal texts have equal scores, repeated rows stay, other
    columns stay as they are whatever their names, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts.to_pylist()).astype(np.float64), pa.float64())

    return docs.withColumn(score, F.arrow_udf(run, "double").asNondeterministic()(F.col(text_col).cast("string")))
