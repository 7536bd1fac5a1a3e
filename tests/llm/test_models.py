"""Language ID, quality, SentencePiece and the language model: held-out accuracy, round trips, brute force; edge rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import langid, maxent_lm, quality, sp_codec, textnum
from skyledger.llm.queries import QUERIES
from tests.conftest import SF

EDGE = [(None, "word here"), (1, None), (2, ""), (3, "123 !!"), (4, "the " * 40_000), (4, "the the")]


def edge(spark):
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in EDGE], "doc_id long, text string, lang_pred string, score double")


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op3_language"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95
    profiles = langid.learned(docs, "text", "lang", F.col("doc_id"))
    got = {(r.doc_id, r.text): r for r in langid.identified(edge(spark), profiles).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in [(1, None), (2, ""), (3, "123 !!")]) and all(0 <= r.score <= 1 for r in got.values())
    none = langid.learned(docs.where("false"), "text", "lang", F.col("doc_id"))
    assert {r.lang_pred for r in langid.identified(edge(spark), none).collect()} == {"und"}
    assert langid.identified(edge(spark).where("false"), profiles).isEmpty()


def test_languages_by_a_plain_distance(spark):
    """Profiles and distances of strings in dictionaries; ties of a count go by the n-gram's hash, as documented."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    hashes = {}

    def hashed(gram):
        if gram not in hashes:
            value = 0
            for c in gram:
                value = (value * 0x100000001B3 + (0 if c == " " else ord(c)) + 1) % 2**64
            hashes[gram] = int(textnum.mixed(np.array([(value + len(gram)) % 2**64], np.uint64))[0])
        return hashes[gram]

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        padded = [f" {w} " for w in words]
        found = Counter(c for w in words for c in w)
        found.update(w[k : k + n] for w in padded for n in range(2, langid.MAX_N + 1) for k in range(len(w) - n + 1))
        return found

    total = {}
    for d in docs:
        if d.lang is not None and d.text is not None:
            total.setdefault(d.lang, Counter()).update(grams(d.text))
    places = {}
    for lang, found in total.items():
        order = sorted(found, key=lambda g: (-found[g], (hashed(g) + 2**63) % 2**64))[: langid.RANKS]
        places[lang] = {g: k for k, g in enumerate(order)}
    profiles = langid.learned(spark.createDataFrame(docs), "text", "lang", F.col("doc_id"))
    texts = [d.text for d in docs[:150]] + ["Ein Haus", "a", "a b a b", "ÄÖ ü", "x1y2", "the " * 3000]
    for text, (lang, score) in zip(texts, profiles.predict(texts)):
        found = grams(text)
        own = sorted(found, key=lambda g: (-found[g], hashed(g)))[: langid.RANKS]
        cost = {x: sum(min(abs(p[g] - k), langid.RANKS) if g in p else langid.RANKS for k, g in enumerate(own)) for x, p in places.items()}
        assert lang == min(sorted(cost), key=cost.get) and math.isclose(score, 1 - cost[lang] / langid.RANKS / len(own))


def test_too_many_languages(spark):
    many = spark.range(langid.MAX_LANGUAGES + 1).selectExpr("id as doc_id", "'word' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="different values"):
        langid.learned(many, "text", "lang", F.col("doc_id"))


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op8_quality"](spark, SF).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) / len(rows) >= 0.9 and all(0 <= r.score <= 1 for r in rows)
    model = quality.fitted(docs.join(labels, "doc_id").where("false"), "text", "quality", F.col("doc_id"))
    assert {r.score for r in quality.scored(edge(spark), model).collect()} == {0.5}
    assert quality.scored(edge(spark).where("false"), model).isEmpty()


def test_quality_of_held_out_documents(spark):
    """Ranks and probabilities of documents that weren't learned from; a plain forward pass gives the same scores."""
    big = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet").where("quality in (0, 1)")
    rows = QUERIES["op8_quality"](spark, big).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert len(good) > 10 and len(bad) > 10 and auc >= 0.95
    loss = -sum(math.log(max(r.score if r.quality == 1 else 1 - r.score, 1e-12)) for r in rows) / len(rows)
    share = len(good) / len(rows)
    assert loss < 0.7 * -(share * math.log(share) + (1 - share) * math.log(1 - share))

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fitted(docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id"), "text", "quality", F.col("doc_id"))
    texts = [r.text for r in docs.limit(40).collect()] + ["", None, "one", "!!", "a, a, a, a", "word " * 5000]
    for text, score in zip(texts, model.scores(texts)):
        words = list(quality.word_rows([text])[0])
        x = np.zeros(quality.FEATURES)
        if words:
            mean = sum(model.index[w].astype(float) for w in words) / len(words)
            alike = [[float(model.index[a] @ model.index[b]) for a, b in zip(words, words[gap:])] for gap in (2, 1)]
            about = [sum(v) / max(1, len(v)) for v in alike]
            x = np.concatenate([mean, sum(model.context[w].astype(float) for w in words) / len(words), about, [np.linalg.norm(mean), math.log1p(len(words))]])
        hidden = [math.tanh(sum((x[i] - model.mean[i]) / model.scale[i] * model.w1[i, j] for i in range(len(x))) + model.b1[j]) for j in range(quality.HIDDEN)]
        z = (sum(h * w for h, w in zip(hidden, model.w2)) + model.b2) / model.temperature
        assert math.isclose(score, 1 / (1 + math.exp(-z)), abs_tol=2e-3)


def test_sentencepiece(spark):
    pieces = sp_codec.read_model(spark)
    codec = sp_codec.Codec(pieces)
    score = {p: s for p, _, s in pieces.matched}
    for text in ("▁the▁of", "▁word", "▁other", "▁ab▁c"):  # every segmentation
        best = max(sum(score.get(text[a:b], float("-inf")) for a, b in itertools.pairwise([0, *cuts, len(text)])) for n in range(len(text)) for cuts in itertools.combinations(range(1, len(text)), n))
        names = {i: p for p, i, _ in pieces.matched}
        assert math.isclose(sum(score[names[i]] for i in codec.viterbi(text)), best)
    texts = ["", None, "a  b ", " lead", "tab\tand\nline", "emoji 🙂 文字 \u0000", "é" * 3000, "word " * 20_000]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, ids int")
    got = sp_codec.decoded(sp_codec.encoded(df, pieces), pieces).collect()
    assert [r.decoded for r in got] == texts and got[1].ids is None and got[0].ids == []


def test_language_model_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in QUERIES["op10_language_model"](spark, SF).collect()}
    counts = Counter()
    for d in docs:
        if zlib.crc32(str(d.doc_id).encode()) % 10:
            counts.update([*d.text.encode().lower().split(), b""])
    total, floor = sum(counts.values()), math.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    for d in docs:
        words, r = [*d.text.encode().lower().split(), b""], rows[d.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), total)
        assert math.isclose(r.base_score, sum(math.log10(counts[w] + 0.1) - floor for w in words), rel_tol=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_of_edge_rows(spark):
    df = edge(spark)
    found, total = maxent_lm.learned_and_scored(df, df)
    got = found.collect()
    assert len(got) == len(EDGE) and total == sum(r.n_tokens for r in got) and all(r.score <= 0 for r in got)
    found, total = maxent_lm.learned_and_scored(df.where("false"), df)
    assert total == 0 and all(r.n_known == 0 and r.base_score == r.score == 0 for r in found.collect())


def test_language_model_scores_by_a_plain_loop(spark):
    """Both factors sum to one, and a text's score is the product of its tokens' shares."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("text")).limit(60)
    counts = maxent_lm.counted(docs)
    lex, least = maxent_lm.lexicon(counts)
    model = maxent_lm.trained(maxent_lm.events(docs, lex), lex, 3)
    every = np.arange(lex.n_classes)
    for bucket, skip in ((0, 0), (3, 40), (lex.buckets - 1, 63)):
        logs = model.class_logs(np.full(len(every), bucket), np.full(len(every), skip), every)
        assert math.isclose(float(np.exp(logs.astype(float)).sum()), 1, abs_tol=1e-4)
    for kind in range(0, lex.n_classes - maxent_lm.TAILS, 5):
        words = np.arange(lex.firsts[kind], lex.firsts[kind + 1])
        logs = model.word_logs(np.full(len(words), 5), words, np.full(len(words), kind))
        assert math.isclose(float(np.exp(logs.astype(float)).sum()), 1, abs_tol=1e-4)
    n = {bytes(r.token): r.n for r in counts.collect()}
    text = docs.first().text + " neverseen Neverseen"
    want, kept = 0.0, [*maxent_lm.tokens(text), maxent_lm.END]
    start = lex.contexts_of[-1]

    def buckets(word):
        return lex.contexts_of[lex.ids[word]] if word in lex.ids else [s // 2 + zlib.crc32(word[-2:]) % (s // 2) for s in (lex.buckets, maxent_lm.SKIPS)]

    tails = {}
    for w, c in n.items():
        if w not in lex.ids:
            tails.setdefault(zlib.crc32(w[-2:]) % maxent_lm.TAILS, []).append(c)
    for k, word in enumerate(kept):
        bucket = buckets(kept[k - 1])[0] if k else start[0]
        skip = buckets(kept[k - 2])[1] if k > 1 else start[1]
        row = model.classes[bucket].astype(float) + model.classes[lex.buckets + skip] + model.classes[-1]
        if word in lex.ids:
            kind = int(np.searchsorted(lex.firsts, lex.ids[word], side="right")) - 1
        else:
            tail = zlib.crc32(word[-2:]) % maxent_lm.TAILS
            kind = len(lex.firsts) - 1 + tail
            own = tails.get(tail, [])
            want += math.log10((n.get(word, 0) + 0.1) / (sum(own) + 0.1 * (len(own) + 1)))
        want += math.log10(math.exp(row[kind]) / np.exp(row).sum())
        if word in lex.ids:
            members = range(lex.firsts[kind], lex.firsts[kind + 1])
            z = {y: float(model.bias[y] + model.weights[model.first_weight[kind] + maxent_lm._place(np.array([bucket]), np.array([y - lex.firsts[kind]]), lex.weights_of(kind))[0]]) for y in members}
            want += math.log10(math.exp(z[lex.ids[word]]) / sum(map(math.exp, z.values())))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = maxent_lm.scored(df, "doc_id", "text", counts, lex, least, model).first()
    assert math.isclose(got.score, want, rel_tol=1e-4) and got.n_tokens == len(kept) and got.n_known == len(kept) - 2
    assert maxent_lm.scored(df.where("false"), "doc_id", "text", counts, lex, least, model).isEmpty()


def test_repeated_rows_are_rows_of_their_own(spark):
    """A row that repeats exactly, and a text of a million characters, give equal rows as often."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    twice = docs.where("doc_id < 6")
    more = docs.where("doc_id < 100").union(twice).union(twice)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    pieces = sp_codec.read_model(spark)
    profiles, model = langid.learned(docs, "text", "lang", F.col("doc_id")), quality.fitted(docs.join(labels, "doc_id"), "text", "quality", F.col("doc_id"))
    runs = {
        "lang": langid.identified(more.drop("lang"), profiles).select("doc_id", "lang_pred", "score"), "pieces": sp_codec.encoded(more, pieces).select("doc_id", F.col("ids").cast("string")),
        "quality": quality.scored(more, model).select("doc_id", "score"), "model": maxent_lm.learned_and_scored(docs, more)[0].select("id", "n_tokens", "score"),
    }
    for name, df in runs.items():
        rows = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]  # sums of batches differ in their last digits
        assert len(rows) == more.count(), name
        found = Counter(rows)
        assert all(n == (3 if row[0] < 6 else 1) for row, n in found.items()), name
    assert {name: df.where("false").count() for name, df in runs.items()} == dict.fromkeys(runs, 0)
