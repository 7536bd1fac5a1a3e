"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (n = 1 to 4, words padded with a blank), by rank.
A document's own most frequent n-grams are compared with each profile: every n-gram costs the difference of its two
ranks, or the length of the profile if it isn't there; the language with the smallest out-of-place distance wins.

The score is 1 - distance / greatest possible distance, so a text that shares no n-gram with any profile scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm import textnum
from skyledger.llm.common import crc32_of, fresh

RANKS = 300
MAX_N = 4
#: Expected number of documents of each language that profiles are made from; with fewer, all of them.
TRAIN_DOCS = 2000
#: A label column of more values than this names no languages; the driver and each task hold profiles of this many at most.
MAX_LANGUAGES = 2000
UND = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
        table[codes] = codes
        _letters.append(table)
    return _letters[0]


def _padded(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the lower-cased texts, one 0 between words and at the ends; and the text of each place."""
    lower = ["" if t is None else t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "replace"), np.uint32)
    letters = _letter_table()[np.minimum(codes, 0x10FFFF)]
    owner = np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])
    ink = letters != 0
    keep = ink.copy()
    keep[1:] |= ink[:-1]
    return letters[keep], owner[keep]


def _grams(letters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hash of the n-gram that ends at each place from n - 1 on); a word's blanks are those beside it."""
    padded = letters.astype(np.uint64) + np.uint64(1)
    value = padded
    for n in range(1, MAX_N + 1):
        if n > 1:
            value = value[:-1] * np.uint64(0x100000001B3) + padded[n - 1 :]
        yield n, value


def ranked(texts: list, ranks: int = RANKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its most frequent n-grams and their counts, most frequent first (ties by hash)."""
    letters, owner = _padded(texts)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k in range(len(texts)):
        # Each text's letters come with the blank that ends each word; the blank before the first word is added here.
        own = np.concatenate([[0], letters[first[k] : first[k + 1]]]).astype(np.uint64)
        if len(own) < 2:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        found = []
        blank = own == 0
        for n, value in _grams(own):
            ends = np.arange(n - 1, len(own))
            # No n-gram has a blank inside, and a blank alone is none.
            good = ~blank[ends] if n == 1 else np.ones(len(ends), bool)
            for inner in range(1, n - 1):
                good &= ~blank[ends - inner]
            found.append(textnum.mixed(value[good] + np.uint64(n)))
        out.append(_top(np.concatenate(found), ranks))
    return out


def _top(values: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    values.sort()
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.append(edge, len(values)))
    if len(counts) > ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        some = np.flatnonzero(counts >= least)
        edge, counts = edge[some], counts[some]
    order = np.argsort(-counts, kind="stable")[:ranks]
    return values[edge[order]], counts[order]


@dataclass(frozen=True)
class Profiles:
    """Languages (sorted) and, for each n-gram of any profile, its rank in each (``ranks`` where it isn't there)."""

    languages: tuple[str, ...]
    grams: np.ndarray
    places: np.ndarray
    ranks: int

    def predict(self, texts: list) -> list[tuple[str, float]]:
        out = []
        for group in textnum.groups(texts):
            for grams, _ in ranked(group, self.ranks):
                if not len(grams) or not self.languages:
                    out.append((UND, 0.0))
                    continue
                at = np.searchsorted(self.grams, grams).clip(max=len(self.grams) - 1)
                known = self.grams[at] == grams
                cost = np.where(known[:, None], np.abs(self.places[at] - np.arange(len(grams))[:, None]), self.ranks)
                cost = np.minimum(np.where(self.places[at] >= self.ranks, self.ranks, cost), self.ranks).sum(axis=0)
                best = int(cost.argmin())
                score = 1.0 - float(cost[best]) / (self.ranks * len(grams))
                out.append((self.languages[best], score))
        return out


def learned(docs: DataFrame, text_col: str, lang_col: str, key: Column, ranks: int = RANKS, train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles from the labelled rows of ``docs`` (null labels are left out).

    About ``train_docs`` documents of each language are read, chosen by a hash of ``key``, so the sample is the same in
    every run and is spread over the table. What reaches the driver is ``ranks`` n-grams of each language; more than
    MAX_LANGUAGES different labels are a ValueError. Repeated rows count as often as they occur; no rows, no profiles.
    """
    spark = docs.sparkSession
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), crc32_of(key).alias("key"))
    labelled = labelled.where("lang is not null and text is not null")
    sizes = docs.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("docs")).where("lang is not null")
    known = sizes.limit(MAX_LANGUAGES + 1).collect()
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"column {lang_col} has more than {MAX_LANGUAGES} different values")
    chosen = labelled.join(F.broadcast(spark.createDataFrame(known, "lang string, docs long")), "lang").where(F.crc32(F.concat_ws(":", F.lit("profile"), "key").cast("binary")) * F.col("docs") < F.lit(train_docs) * F.lit(2**32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, (grams, counts) in zip(langs, ranked(texts, 1 << 60)):
                mine = total.setdefault(lang, {})
                for g, c in zip(grams.tolist(), counts.tolist()):
                    mine[g] = mine.get(g, 0) + c
                if len(mine) > 500_000:
                    yield from _counts(lang, total.pop(lang))
        for lang, mine in total.items():
            yield from _counts(lang, mine)

    def _counts(lang: str, mine: dict[int, int]) -> Iterator[pa.RecordBatch]:
        grams = np.fromiter(mine.keys(), np.uint64, len(mine)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine)), pa.array(grams), pa.array(list(mine.values()), pa.int64())], ["lang", "gram", "n"])

    counted = chosen.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Spark keeps the best of each task before the shuffle, so no task sees all n-grams of a language.
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).select("lang", "gram", "rank").toPandas()
    languages = tuple(sorted(best["lang"].unique()))
    grams = np.unique(best["gram"].to_numpy().astype(np.int64).view(np.uint64)) if len(best) else np.zeros(0, np.uint64)
    places = np.full((len(grams), len(languages)), ranks, np.int64)
    for k, lang in enumerate(languages):
        own = best[best["lang"] == lang]
        places[np.searchsorted(grams, own["gram"].to_numpy().astype(np.int64).view(np.uint64)), k] = own["rank"].to_numpy() - 1
    return Profiles(languages, grams, places, ranks)


def identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (columns of those names are replaced).

    A text that is null, empty or without letters is ``und`` with score 0, as is every text if no language was learned.
    Ties go to the language first in alphabetical order. Each text is read whole, however long. Repeated rows stay; the
    other columns stay as they are, whatever their names. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(texts: pa.Array) -> pa.Array:
        found = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang", "score"])

    predict = F.arrow_udf(run, "struct<lang:string,score:double>").asNondeterministic()
    found = fresh(docs, "found")
    out = docs.withColumn(found, predict(F.col(text_col).cast("string")))
    return out.withColumns({lang: F.col(f"{found}.lang"), score: F.col(f"{found}.score")}).drop(found)
