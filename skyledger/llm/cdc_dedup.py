"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash runs over a text's bytes; it depends on the last 16 bytes only. A chunk may begin where a word begins (or,
inside a run of over 64 bytes without white space, where a character begins), and does where the hash there is the
smallest within four such places on either side. So chunks have at least five words, nine on average, and an insertion
moves only the boundaries beside it. Chunks are deduplicated by a 64-bit digest: of the documents that hold a chunk, that of the
smallest id keeps it, once. Runs of duplicate chunks of at least ``min_words`` words are cut; shorter ones stay, so
that stock phrases and chance repeats change nothing; in runs of over 64 bytes without white space (scripts without
spaces, encoded data) every six bytes count as a word. A passage of over 50 words that another document holds loses
about five words at either end to unlike boundaries and leaves such a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import textnum
from skyledger.llm.common import fresh, written

RADIUS = 4
MIN_WORDS = 20
LONG_RUN = 64
BYTES_OF_WORD = 6
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: h = 2 h + G[byte] over the last 16 bytes, summed by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step) if len(h) > step else 0
        h = h + shifted
    return h


def boundaries(data: np.ndarray) -> np.ndarray:
    """Starts of the chunks of a text's bytes; the first is 0."""
    if not len(data):
        return np.zeros(0, np.int64)
    ink = ~_SPACE[data]
    starts, ends = textnum.spans(data, ink)
    long = ends - starts > LONG_RUN
    if long.any():
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, ends[long], -1)
        begins = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
        begins[starts] = True
        starts = np.flatnonzero(begins)
    starts = starts[starts > 0]
    if not len(starts):
        return np.zeros(1, np.int64)
    value = textnum.mixed(gear(data)[starts - 1].astype(np.uint64))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.ones(len(value), bool)
    for k in range(1, RADIUS + 1):
        left, right = np.full(len(value), top), np.full(len(value), top)
        left[k:], right[:-k] = value[:-k], value[k:]
        low &= (value < left) & (value <= right)
    return np.concatenate([[0], starts[low]])


def chunked(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, chunk starts with the end appended, digest of each chunk as signed longs)."""
    data = textnum.as_bytes(text)
    edges = np.append(boundaries(data), len(data))
    return data, edges, textnum.span_hashes(data, edges[:-1], edges[1:]).view(np.int64) if len(data) else np.zeros(0, np.int64)


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, id, text_key, place, again) of every chunk; again: an earlier chunk of the same text has its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [chunked(t)[2] for t in part.column(2).to_pylist()]
                sizes = np.array([len(x) for x in found])
                if not sizes.sum():
                    continue
                again = np.concatenate([textnum.occurrence(x) > 0 for x in found if len(x)])
                rows = np.repeat(np.arange(len(found)), sizes)
                places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(places), pa.array(again)],
                    ["digest", "id", "text_key", "place", "again"],
                )

    return _keyed(docs, id_col, text_col).mapInArrow(run, "digest long, id long, text_key long, place int, again boolean")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, places): the chunks of each text that another document keeps, or that repeat in the text."""
    all_ = written(chunks(docs, id_col, text_col), "chunks")
    firsts = all_.where("not again")
    shared = firsts.groupBy("digest").agg(F.min("id").alias("keeper"), F.max("id").alias("_last")).where("keeper < _last")
    shared = written(shared.select("digest", "keeper"), "shared")
    elsewhere = firsts.join(shared, "digest").where("id > keeper").select("id", "text_key", "place")
    places = elsewhere.union(all_.where("again").select("id", "text_key", "place"))
    return places.groupBy("id", "text_key").agg(F.collect_set("place").alias("places"))


def words_before(data: np.ndarray) -> np.ndarray:
    """How many words begin before each byte and at last the end; long runs have one for every six bytes."""
    starts, ends = textnum.spans(data, ~_SPACE[data])
    begins = np.zeros(len(data), np.int64)
    begins[starts] = 1
    for a, b in zip(*(x[ends - starts > LONG_RUN] for x in (starts, ends))):
        begins[a:b:BYTES_OF_WORD] = 1
    return np.concatenate([[0], np.cumsum(begins)])


def cut(text: str, places: list[int], min_words: int = MIN_WORDS) -> tuple[str, list[tuple[int, int]], int]:
    """(text without its long runs of the chunks at ``places``, their byte spans, their words)."""
    data = textnum.as_bytes(text)
    edges = np.append(boundaries(data), len(data))
    dup = np.zeros(len(edges) - 1, bool)
    dup[[p for p in places if p < len(dup)]] = True
    words = words_before(data)
    first, last = textnum.spans(data, dup)
    spans = [(int(edges[a]), int(edges[b])) for a, b in zip(first, last) if words[edges[b]] - words[edges[a]] >= min_words]
    kept, at = [], 0
    raw = data.tobytes()
    for a, b in [*spans, (len(raw), len(raw))]:
        kept.append(raw[at:a])
        at = b
    return b"".join(kept).decode("utf-8", "replace"), spans, int(sum(words[b] - words[a] for a, b in spans))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, out: str = "cdc") -> DataFrame:
    """``docs`` with ``text_col`` cut and a column ``out``: struct of spans (byte start and stop in the old text), words.

    Rows of one id are one document: passages that they share stay. Null ids come last and count as one document. A
    null text stays null and an empty one empty; a text all of whose chunks stand elsewhere becomes empty. Very long
    texts are cut whole. ``out`` is replaced if the table has such a column; other columns stay as they are, whatever
    their names. An empty table gives no rows.
    """
    kind = "struct<text:string,spans:array<struct<start:int,stop:int>>,words:int>"

    def run(texts: pa.Array, places: pa.Array) -> pa.Array:
        rows = []
        for text, at in zip(texts.to_pylist(), places.to_pylist()):
            if text is None or at is None:
                rows.append(None)
                continue
            new, spans, words = cut(text, at, min_words)
            rows.append({"text": new if spans else None, "spans": [{"start": a, "stop": b} for a, b in spans], "words": words})
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        return pa.array(rows, pa.struct([("text", pa.string()), ("spans", pa.list_(span)), ("words", pa.int32())]))

    cut_udf = F.arrow_udf(run, kind).asNondeterministic()
    id_, key, places, new = fresh(docs, "id", "key", "places", "cut")
    found = written(duplicates(docs, id_col, text_col), "places")
    found = found.select(F.col("id").alias(id_), F.col("text_key").alias(key), F.col("places").alias(places))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({id_: F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), key: F.xxhash64(text)})
    joined = keyed.join(found, [id_, key], "left")
    joined = joined.withColumn(new, cut_udf(F.when(F.col(places).isNotNull(), text), F.col(places)))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    spans = F.struct(F.coalesce(f"{new}.spans", none).alias("spans"), F.coalesce(f"{new}.words", F.lit(0)).alias("words"))
    return joined.withColumns({out: spans, text_col: F.coalesce(F.col(f"{new}.text"), text)}).drop(id_, key, places, new)
