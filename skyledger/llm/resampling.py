"""Importance resampling towards a target distribution, with exact weights by bit-sliced aggregation.

Features are runs of one or two words, hashed into buckets. A bucket's gain is the log-ratio of its smoothed shares in
target and source, as an integer. A document's bucket counts become bit planes: plane p has a bit for each bucket, set
where the count has bit p. The gains are bit planes too, in two's complement. The sum of count times gain is then the sum
over pairs of planes of 2^(p+q) times the bits that both have (the sign plane counts negative): ANDs and popcounts only,
and exact. Adding Gumbel noise to the mean gain and taking the highest draws without replacement.

What the driver sees is one row for each bucket. Ranks come from the counts of each score (scores are whole thousandths
of logarithms, so there are some ten thousand of them whatever the number of rows) and a window within each score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm import textnum
from skyledger.llm.common import written

BUCKETS = 10_000
#: Documents whose planes are made at a time, and bytes of a word after which zlib takes over from numpy.
AT_A_TIME, SHORT_WORD = 64, 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, by the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
_START = np.uint32(0xFFFFFFFF)


def _fed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes data[start:end] of each, a column of bytes at a time."""
    order = np.argsort(starts - ends, kind="stable")
    state, at, size = state[order], starts[order], (ends - starts)[order]
    for k in range(min(SHORT_WORD, int(size[0]) if len(size) else 0)):
        m = int(np.searchsorted(-size, -k))  # sizes fall: the first m are longer than k
        state[:m] = _CRC[(state[:m] ^ data[at[:m] + k]) & 255] ^ state[:m] >> 8
    for i in range(int(np.searchsorted(-size, -SHORT_WORD))):
        rest = data[at[i] + SHORT_WORD : at[i] + size[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i] ^ _START)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def features(texts: list, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, bucket) of each feature of the texts, and the words of each text."""
    data, begins = textnum.joined([(t or "").encode("utf-8", "replace") for t in texts])
    data = _LOWER[data]
    starts, ends = textnum.spans(data, textnum.WORD_BYTE[data])
    of = np.searchsorted(begins, starts, "right") - 1
    one = _fed(np.full(len(starts), _START), data, starts, ends)
    first = np.flatnonzero(of[1:] == of[:-1])
    two = _CRC[(one[first] ^ 32) & 255] ^ one[first] >> 8
    two = _fed(two, data, starts[first + 1], ends[first + 1])
    found = (np.concatenate([one, two]) ^ _START) % buckets
    return np.concatenate([of, of[first]]), found.astype(np.int64), np.bincount(of, minlength=len(texts))


def bucket_counts(df: DataFrame, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any; each task sends its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for group in textnum.groups(batch.column(0).to_pylist()):
                total += np.bincount(features(group, buckets)[1], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], ["bucket", "n"])

    found = df.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain in thousandths: floor(1000 ln(share in target / share in source)), both with one added to each bucket."""
    counts = []
    for table in (source, target):
        n = np.zeros(buckets)
        for r in table.collect():  # a row for each bucket at most
            n[r.bucket] = r.n
        counts.append(n)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def planes(numbers: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(packed bit planes, weight of each) of integers in two's complement: the last plane is the sign and counts negative."""
    size = max(1, *(int(n).bit_length() for n in (numbers.max(initial=0), ~numbers.min(initial=0))))
    bits = (numbers[None, :] >> np.arange(size + 1)[:, None]) & 1
    return _packed(bits.astype(bool)), [*(1 << q for q in range(size)), -(1 << size)]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    short = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, short))), axis=1).view(np.uint64)


def totals(of: np.ndarray, bucket: np.ndarray, n_docs: int, gain_planes: tuple[np.ndarray, list[int]], buckets: int = BUCKETS) -> list[int]:
    """Sum of gains over the features of each document, by ANDs of bit planes and popcounts."""
    sliced, weights = gain_planes
    key, count = np.unique(of * buckets + bucket, return_counts=True)
    out = []
    for lo in range(0, n_docs, AT_A_TIME):
        n = min(AT_A_TIME, n_docs - lo)
        part = slice(*np.searchsorted(key, [lo * buckets, (lo + n) * buckets]))
        doc, at, c = key[part] // buckets - lo, key[part] % buckets, count[part]
        total = [0] * n
        for p in range(int(c.max(initial=0)).bit_length()):
            on = c >> p & 1 == 1
            docs, row = np.unique(doc[on], return_inverse=True)
            bits = np.zeros((len(docs), buckets), bool)
            bits[row, at[on]] = True
            common = np.bitwise_count(_packed(bits)[:, None, :] & sliced[None]).sum(axis=2, dtype=np.int64)
            for d, hits in zip(docs.tolist(), common.tolist()):
                total[d] += sum(h * w for h, w in zip(hits, weights)) << p
        out += total
    return out


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight) of each row: weight is the floored mean of its features' gains, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = planes(gain)
        for batch in batches:
            words, n, weight = [], [], []
            for group in textnum.groups(batch.column(1).to_pylist()):
                of, bucket, w = features(group, buckets)
                f = np.bincount(of, minlength=len(group)).tolist()
                words += w.tolist()
                n += f
                weight += [s // k if k else 0 for s, k in zip(totals(of, bucket, len(group), sliced, buckets), f)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, n, weight))], ["id", "n_words", "n_features", "weight"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 25,
          least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_features, weight, score and rank (null where not drawn).

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) of the highest scores are drawn, ties to
    the smaller id (a null id comes last, and its noise is that of an empty one). Ids keep their type. Null and empty
    texts have no features and weight 0. Repeated rows are rows of their own with equal scores and take ranks one after
    another. Texts of any length are read whole. An empty ``docs`` gives no rows; an empty ``target`` has equal shares.
    Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets), buckets)
    noise = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(noise, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = written(weighed(docs, gain, id_col, text_col, buckets).withColumn("score", F.col("weight") + gumbel), "weighed")
    able = F.col("n_words") >= least_words
    of_score = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    ahead = of_score.select(
        "score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("ahead"), (F.sum("n").over(Window.partitionBy()) * percent / 100).cast("long").alias("most")
    ).where("ahead < most")
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("score", "able").orderBy(F.asc_nulls_last("id"), "n_features"))
    ranked = rows.withColumn("able", able).join(ahead, "score", "left").withColumn("place", place)
    return ranked.select("id", "n_words", "n_features", "weight", "score", F.when(F.col("able") & (F.col("place") <= F.col("most")), F.col("place")).cast("long").alias("rank"))
