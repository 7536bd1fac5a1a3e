"""Benchmark decontamination by template windows with typed slots.

Words are canonicalised: numbers (in digits or words) become <number>, units after a number <unit>, and capitalised words
inside a sentence <name>; other words are lower-cased. Names are also read as plain words, so that a text without capitals matches too,
and in a further reading capitalised words that begin a sentence are <name> as well, function words excepted.
Windows of 13 such tokens of every document are hash-joined with those of the
benchmark, so a question whose numbers, names or units were changed still meets its item. An item of fewer tokens is one
window, and documents have windows of each such length. A match counts if its slots
agree: over the matched stretch of document and item, equal values of one side stand for equal values of the other
(a one-to-one renaming). A stretch of consecutive matching windows starts anew at a slot that contradicts an earlier
one, and parts that are the same on both sides always count. A document is contaminated by an item if such a stretch covers at least 13 tokens,
or the whole item if that is shorter, and holds five words or more that are literal or equal on both sides. An item of
fewer than five tokens is met only by a document that is nothing else.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import textnum
from skyledger.llm.common import fresh, written

MIN_TOKENS = 13
MIN_LITERALS = 5
#: Benchmark windows whose hashes are sent to every task (8 bytes each); with more, all windows are joined instead.
MAX_SENT = 2_000_000

# Unit words.
UNITS = (
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz "
    "ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months "
    "year years cent cents dollar dollars euro euros percent degree degrees"
).split()
# Words that begin sentences and are no names.
FUNCTION_WORDS = (
    "a an the this that these those there here it its he she they we you i his her their our your my who whom whose what which "
    "when where why how if then so as at by in on of for from to into onto over under with without within about after before "
    "since until till while during between among through across against and or but nor yet because although though unless "
    "whether is are was were be been am do does did has have had can could will would shall should may might must let not no "
    "each every all any some both either neither one two three four five six seven eight nine ten many much more most few "
    "several such same other another only also just now suppose given find determine calculate compute show prove assume"
).split()
# Number words.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
NUMBER, NAME, UNIT = (np.uint64(k) for k in (1, 2, 3))
_UNIT_HASHES = np.sort(np.array([textnum.word_hashes(u)[0] for u in UNITS], np.uint64))
_NUMBER_HASHES = np.sort(np.array([textnum.word_hashes(w)[0] for w in NUMBER_WORDS], np.uint64))
_FUNCTION_HASHES = np.array([textnum.word_hashes(w)[0] for w in FUNCTION_WORDS], np.uint64)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 59, 63]] = True


def lowered(text: str) -> str:
    """``text`` in lower case, but for characters whose lower case has another number of bytes."""
    low = text.lower()
    if len(low.encode("utf-8", "replace")) == len(text.encode("utf-8", "replace")):
        return low
    odd = sorted(c for c in set(text) if len(c.lower().encode("utf-8", "replace")) != len(c.encode("utf-8", "replace")))
    return "".join(part if part in odd else part.lower() for part in re.split(f"([{re.escape(''.join(odd))}])", text))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``."""
    return known[np.searchsorted(known, values).clip(max=len(known) - 1)] == values


def canonical(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, values, where each text's tokens begin and at last the end, tokens with names that begin sentences) of some texts.

    A token is a placeholder or its word's hash; its value is the hash of the word that stands there.
    """
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    lower = [lowered(t or "").encode("utf-8", "replace") for t in texts]
    data, begins = textnum.joined(parts)
    low, _ = textnum.joined(lower)
    digit = _DIGIT[data]
    # Points and commas between digits belong to the number.
    mark = np.zeros(len(data), bool)
    mark[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    inside, begin_word = textnum.ink(data)
    starts, ends = textnum.spans(data, inside | mark, begin_word)
    first = np.searchsorted(starts, begins)
    values = textnum.span_hashes(low, starts, ends)
    tokens = values.copy()
    if not len(starts):
        return tokens, values, first, tokens
    numeric = digit[starts] | _among(values, _NUMBER_HASHES)
    tokens[numeric] = NUMBER
    after = np.flatnonzero(numeric[:-1]) + 1
    tokens[after[_among(values[after], _UNIT_HASHES) & ~numeric[after]]] = UNIT
    # A capital letter inside a sentence: no full stop, colon, question mark or line end since the word before.
    # A capital is a character that lower case changes. Words all in capitals are no names, and number words neither.
    changed = np.concatenate([[0], np.cumsum(data != low)])
    second = np.minimum(starts + _size(data[starts]), len(data) - 1)
    upper = (changed[second] > changed[starts]) & (changed[np.minimum(second + _size(data[second]), len(data))] == changed[second])
    capital = np.flatnonzero(upper & ~numeric)
    stops = np.flatnonzero(_STOP[data])
    same = (capital > 0) & (np.searchsorted(stops, starts[capital]) == np.searchsorted(stops, ends[capital - 1]))
    tokens[capital[same]] = NAME
    opened = tokens.copy()
    opening = capital[~same]
    opened[opening[~np.isin(values[opening], _FUNCTION_HASHES)]] = NAME
    return tokens, values, first, opened


def _size(lead: np.ndarray) -> np.ndarray:
    """Bytes of the characters that begin with these bytes."""
    return np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def _hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` tokens, by differences of their running polynomial sum."""
    n = len(sums) - size
    return textnum.mixed((sums[size:] - sums[:-size]) * textnum._power(n, inverse=True) + np.uint64(size)).view(np.int64) if n > 0 else np.zeros(0, np.int64)


def _rows(keys: list[tuple], texts: list, size: int, lengths: list[int] | None, wanted: np.ndarray | None, typed_only: bool = False) -> Iterator[dict]:
    """Windows of texts: their keys, hash, place, number of tokens, slots, the values there and whether names begin sentences.

    Where a window is slots only, its hash is that of the values, and ``typed`` is that of the slots. With ``typed_only``
    there are such windows only, and their hash is ``typed``.

    Without ``lengths`` a text of fewer than ``size`` tokens is one window; with them, every text has windows of these too.
    """
    at = 0
    for group in textnum.groups(texts):
        typed, values, first, opened = canonical(group)
        for tokens in (typed, np.where(typed == NAME, values, typed), opened):
            other = None if tokens is typed else tokens != typed
            if other is not None and not other.any():
                continue  # both readings are the same
            for k, p, window, n, alike in _found(tokens, values, first, size, lengths, wanted, other, typed_only):
                begin, end = int(first[k]), int(first[k + 1])
                slots = np.flatnonzero(tokens[p : p + n] <= UNIT) + p
                id_, text_key = keys[at + k]
                yield {"id": id_, "text_key": text_key, "window": window, "place": p - begin, "n_tokens": end - begin, "typed": alike,
                       "slots": (slots - begin).tolist(), "values": values[slots].view(np.int64).tolist(), "opened": tokens is opened}
        at += len(group)


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(textnum.mixed(values + np.uint64(1)) * textnum._power(len(values)))])


def _found(tokens: np.ndarray, values: np.ndarray, first: np.ndarray, size: int, lengths: list[int] | None, wanted: np.ndarray | None, within: np.ndarray | None,
           typed_only: bool) -> list[tuple[int, int, int, int, int | None]]:
    """(text, place among all tokens, hash, length, hash of the slots if all are) of the windows that are wanted.

    With ``within`` only those with such a token.
    """
    sums, slots = _sums(tokens), np.concatenate([[0], np.cumsum(tokens <= UNIT)])
    of_values = None
    seen = None if within is None else np.concatenate([[0], np.cumsum(within)])
    long = np.diff(first)
    found = []
    for n in [size, *(range(1, size) if lengths is None else lengths)]:
        typed = _hashes(sums, n)
        pure = slots[n:] - slots[:-n] == n if len(typed) else np.zeros(0, bool)
        hashes = typed
        if pure.any() and not typed_only:
            of_values = _sums(values) if of_values is None else of_values
            hashes = np.where(pure, _hashes(of_values, n), typed)
        if wanted is None:
            hit = np.arange(len(hashes))
        else:
            hit = np.flatnonzero(_among(hashes, wanted)) if len(wanted) else np.zeros(0, np.int64)
        if typed_only:
            hit = hit[pure[hit]]
        if seen is not None:
            hit = hit[seen[hit + n] > seen[hit]]
        text = np.searchsorted(first, hit, side="right") - 1
        good = hit + n <= first[text + 1]  # windows over two texts are none
        if n < size and (lengths is None or n < MIN_LITERALS):
            good &= long[text] == n
        hit = hit[good]
        found += zip(text[good].tolist(), hit.tolist(), hashes[hit].tolist(), [n] * len(hit), [t if p else None for t, p in zip(typed[hit].tolist(), pure[hit].tolist())])
    return found


_KIND = pa.schema(
    [("id", pa.int64()), ("text_key", pa.int64()), ("window", pa.int64()), ("place", pa.int32()), ("n_tokens", pa.int32()),
     ("typed", pa.int64()), ("slots", pa.list_(pa.int32())), ("values", pa.list_(pa.int64())), ("opened", pa.bool_())]
)
_SQL = "id long, text_key long, window long, place int, n_tokens int, typed long, slots array<int>, values array<bigint>, opened boolean"


def windows(texts: DataFrame, id_col: str, text_col: str, size: int, lengths: list[int] | None = None, wanted: np.ndarray | None = None, typed_only: bool = False) -> DataFrame:
    """Windows of every text (see ``_rows``); with ``wanted`` (sorted hashes) only those among them."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, keys = [], list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                for row in _rows(keys, part.column(2).to_pylist(), size, lengths, shared.value, typed_only):
                    rows.append(row)
                    if len(rows) == 50_000:  # a very long text is sent on in pieces
                        yield pa.RecordBatch.from_pylist(rows, schema=_KIND)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_KIND)

    return _keyed(texts, id_col, text_col).mapInArrow(run, _SQL)


def _keyed(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return texts.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text: str = "text", min_tokens: int = MIN_TOKENS, max_sent: int = MAX_SENT) -> DataFrame:
    """(id, text_key, item_id, tokens, n_tokens): each item found in each document, with the tokens of the longest stretch.

    A document is its id and its text (text_key is the text's xxhash64): rows that share an id but not the text are told
    apart, rows that share both are one. A null id is an id of its own. Texts that are null, empty or without words match
    nothing; items without an id are left out. Repeated items count once. Other columns are not read. Very long texts
    are read whole. Without documents or items there are no rows.
    """
    size = min_tokens
    items = written(windows(benchmark, item_col, item_text, size).where("id is not null").dropDuplicates(["id", "text_key", "window", "place"]), "items")
    lengths = sorted(r["n_tokens"] for r in items.where(F.col("n_tokens") < size).select("n_tokens").distinct().collect())  # fewer than 13
    wanted = None
    hashes = items.select("window").distinct()
    if hashes.limit(max_sent + 1).count() <= max_sent:
        wanted = np.sort(np.array(hashes.toPandas()["window"].to_numpy(), np.int64))
    of_docs = windows(docs, id_col, text_col, size, lengths, wanted)
    item = items.select("window", "typed", F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), F.col("place").alias("item_place"), F.col("n_tokens").alias("item_tokens"),
                        F.col("values").alias("item_values"), F.col("slots").alias("item_slots"), F.col("opened").alias("item_opened"))
    met = _paired(of_docs.drop("typed").join(item.drop("typed"), "window"))
    alike = items.where(F.col("typed").isNotNull())
    if not alike.isEmpty():
        met = written(met, "met")
        met = met.unionByName(_paired(_slots_along(docs, met, alike, item, id_col, text_col, size, lengths, max_sent)))
    # Windows of one diagonal that follow each other are a stretch; each row's stretch starts where none precedes it.
    # Stretches are sought with and without the windows in which names begin sentences, whose slots may contradict others.
    either = F.col("opened") | F.col("item_opened")
    met = met.withColumn("with_opened", F.explode(F.when(either, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))))
    along = met.groupBy("id", "text_key", "item_id", "item_key", "shift", "item_tokens", "with_opened").agg(
        F.sort_array(F.collect_set("item_place")).alias("places"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")
    )
    along = along.select("id", "text_key", "item_id", "shift", "item_tokens", "places", "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [
                longest([k + shift for k in places], [(x["at"], x["here"], x["there"]) for x in pairs], size, n, min(min_tokens, n))
                for shift, n, places, pairs in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best, pa.int32()), batch.column(4)], ["id", "text_key", "item_id", "tokens", "item_tokens"])

    good = along.mapInArrow(run, "id long, text_key long, item_id long, tokens int, item_tokens int").where("tokens > 0")
    return good.groupBy("id", "text_key", "item_id").agg(F.max("tokens").alias("tokens"), F.max("item_tokens").alias("n_tokens"))


def _paired(met: DataFrame) -> DataFrame:
    """Windows of document and item beside each other, with the values of their slots in pairs."""
    return met.select(
        "opened", "item_opened", "id", "text_key", "item_id", "item_key", "place", "item_place", "item_tokens", (F.col("place") - F.col("item_place")).alias("shift"),
        F.arrays_zip(F.col("slots").alias("at"), F.col("values").alias("here"), F.col("item_values").alias("there")).alias("pairs"),
    )


def _slots_along(docs: DataFrame, met: DataFrame, alike: DataFrame, item: DataFrame, id_col: str, text_col: str, size: int, lengths: list[int], max_sent: int) -> DataFrame:
    """Windows of slots only that lie on a diagonal of ``met`` and are alike on both sides, whatever their values."""
    diagonals = written(met.select("id", "text_key", "item_id", "item_key", "shift").distinct(), "diagonals")
    found = diagonals.select(F.col("id").alias("_id"), F.col("text_key").alias("_k")).distinct()
    mine = _keyed(docs, id_col, text_col).join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_k")), "left_semi")
    hashes, wanted = alike.select("typed").distinct(), None
    if hashes.limit(max_sent + 1).count() <= max_sent:
        wanted = np.sort(np.array(hashes.toPandas()["typed"].to_numpy(), np.int64))
    there = windows(mine.select("id", "text"), "id", "text", size, lengths, wanted, typed_only=True).drop("window", "n_tokens").dropDuplicates(["id", "text_key", "place", "opened", "typed"])
    d = diagonals.select(F.col("id").alias("_id"), F.col("text_key").alias("_k"), "item_id", "item_key", "shift")
    there = there.join(d, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_k"))).withColumn("item_place", F.col("place") - F.col("shift")).drop("_id", "_k", "shift")
    return there.join(item.where(F.col("typed").isNotNull()).drop("window"), ["typed", "item_id", "item_key", "item_place"])


def longest(places: list[int], pairs: list[tuple[int, int, int]], size: int, item_tokens: int, least: int) -> int:
    """Tokens of the longest stretch whose slots agree, 0 if none has ``least`` tokens and ``MIN_LITERALS`` words (or the item's, if fewer).

    places: sorted places where windows of one diagonal match; pairs: (place, value here, value there) of slots. Each
    run of places is a stretch, which starts anew at a slot that contradicts an earlier one of the stretch. Parts
    between slots of unlike values are the same on both sides, so they count too.
    """
    best, pairs = 0, sorted(pairs)
    at = [x for x, _, _ in pairs]
    ends = [n for n, p in enumerate(places) if n + 1 == len(places) or places[n + 1] != p + 1]
    for first, last in zip([0, *(n + 1 for n in ends)], ends):
        begin, end = places[first], min(places[last] + size, places[first] + item_tokens)
        same, renamed = begin, 0
        there_of: dict[int, int] = {}
        here_of: dict[int, int] = {}
        stretches = []
        for x, here, there in pairs[bisect_left(at, begin) : bisect_left(at, end)]:
            if there_of.get(here, there) != there or here_of.get(there, here) != here:
                stretches.append((x - begin, renamed))
                begin, renamed, there_of, here_of = x, 0, {}, {}
            there_of[here], here_of[there] = there, here
            if here != there:
                stretches.append((x - same, 0))
                same, renamed = x + 1, renamed + 1
        stretches += [(end - begin, renamed), (end - same, 0)]
        best = max(best, *(n for n, r in stretches if n >= least and n - r >= min(MIN_LITERALS, item_tokens)), 0)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of ``docs``: id, contaminated, item_ids (sorted), max_tokens of a stretch (0 if none). See ``matches``."""
    found = matches(docs, benchmark, id_col, text_col, **how).groupBy("id", "text_key").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("tokens").alias("max_tokens")
    )
    found, rows = written(found, "contaminated").alias("f"), _keyed(docs, id_col, text_col).drop("text").alias("d")
    joined = rows.join(found, F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.text_key") == F.col("f.text_key")), "left")
    return joined.select(
        F.col("d.id").alias("id"), F.col("max_tokens").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("max_tokens", F.lit(0)).alias("max_tokens"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns as they were, whatever their names. See ``matches``."""
    id_, key = fresh(docs, "id", "key")
    found = matches(docs, benchmark, id_col, text_col, **how).select(F.col("id").alias(id_), F.col("text_key").alias(key)).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(key))
    return docs.join(written(found, "contaminated"), same, "left_anti")
