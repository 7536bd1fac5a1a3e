"""Near-duplicates, chunks, vectors and benchmark windows against brute force; edge rows."""

import random

import numpy as np

from skyledger.llm import cdc_dedup, decontam, embed_dedup, minhash, textnum

rng = random.Random(5)
WORDS = [f"w{k}" for k in range(2000)]


def words(n):
    return [rng.choice(WORDS) for _ in range(n)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_alignments_by_brute_force():
    for _ in range(400):
        a, b, k = [rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(1, 12))], rng.randint(0, 12)
        d = plain_distance(a, b)
        assert minhash.edit_distance(a, b, k) == minhash.wide_distance(a, b, k) == (d if d <= k else None)


def corpus():
    base, out = words(150), []
    for k in range(12):  # a group of near copies
        copy = list(base)
        for _ in range(k % 4):
            copy[rng.randrange(150)] = "changed"
        out.append((100 + k, " ".join(copy)))
    passage = " ".join(words(60))
    out += [(200 + k, " ".join(words(100)) + " " + passage + " " + " ".join(words(100))) for k in range(8)]
    out += [(300 + k, " ".join(words(120))) for k in range(10)]
    out += [(400, out[-1][1]), (400, out[-1][1]), (401, None), (402, ""), (403, "one two"), (404, "One, two!"), (None, "one two"), (405, "¿? ..."), (406, " ".join(words(30_000)))]
    return out


def test_near_duplicates_by_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = minhash.classes(df).collect()
    assert len(got) == len(rows)
    hashes = [textnum.word_hashes(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            longer = max(len(hashes[x]), len(hashes[y]))
            if min(len(hashes[x]), len(hashes[y])) >= 0.8 * longer > 0 and minhash.similar(hashes[x], hashes[y]):
                parent[find(x)] = find(y)
    ids = {}
    for k, (i, t) in enumerate(rows):
        if len(hashes[k]):
            ids.setdefault(find(k), []).append(i)
    want = sorted((str(i), str(i if not len(hashes[k]) else min(x for x in ids[find(k)] if x is not None))) for k, (i, _) in enumerate(rows))
    assert sorted((str(r.id), str(r.class_id)) for r in got) == want
    kept = minhash.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len({c for _, c in want})
    assert minhash.classes(df.where("false")).isEmpty()


def test_near_duplicates_are_met_at_every_similarity_and_length():
    for n in (5, 6, 8, 9, 10, 11, 12, 14, 15, 16, 18, 20, 25, 40, 80, 81, 100, 101, 120, 124, 200, 400):
        for similarity in (0.8, 0.85, 0.88, 0.9, 0.92):
            edits, missed = int(n * (1 - similarity) + 1e-9), 0
            for turn in range(40):
                a = words(n)
                b = list(a)
                for k, p in enumerate(rng.sample(range(n), edits)):
                    b[p] = f"new{k}"
                if turn % 4 == 0:  # words left out instead
                    gone = set(rng.sample(range(n), edits))
                    b = [w for k, w in enumerate(a) if k not in gone]
                x, y = textnum.word_hashes(" ".join(a)), textnum.word_hashes(" ".join(b))
                assert minhash.similar(x, y)
                missed += not np.isin(minhash.marks(x), minhash.marks(y)).any()
            assert missed <= (n > 100), (n, similarity, missed)


def test_one_word_changed_in_a_short_text(spark):
    rows = [(10 * n + k, " ".join([*t[: n // 2], *(["changed"] if k else [t[n // 2]]), *t[n // 2 + 1 :]])) for n in range(5, 16) for t in [words(n)] for k in (0, 1)]
    got = {r.id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_a_mixed_bucket_is_compared_in_full(spark):
    shared = words(70)  # texts of which a passage is nearly all, so that they share sketches
    rows = [(k, " ".join(shared + words(40))) for k in range(40)] + [(k + 100, " ".join(shared[:-1] + ["x"] + words(3))) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.class_id for r in minhash.classes(df).collect()}
    assert all(got[100 + k] == 100 for k in range(5)) and all(got[k] == k for k in range(40))


def test_cdc_resists_insertions_and_keeps_the_first(spark):
    passage = " ".join(words(60))
    rows = [(1, "intro " + passage + " end of one"), (2, " ".join(words(30)) + " " + passage + " " + " ".join(words(25))), (3, " ".join(words(80))), (4, None), (5, ""), (2, "other text of two"), (6, "文" * 400), (7, "x" + "文" * 400)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, cdc string")
    got = {(r.doc_id, r.text): r for r in cdc_dedup.deduplicated(df).collect()}
    texts = {i: [t for j, t in got if j == i] for i, _ in rows}
    assert rows[0][1] in texts[1] and rows[2][1] in texts[3] and texts[4] == [None] and texts[5] == [""] and "other text of two" in texts[2]
    cut = next(t for t in texts[2] if t != "other text of two")
    assert len(cut.split()) < 85 and cut.split()[:25] == rows[1][1].split()[:25] and cut.split()[-20:] == rows[1][1].split()[-20:]
    missed = 0
    for _ in range(200):
        p, a, b = words(51), words(rng.randint(0, 60)), words(rng.randint(0, 60))
        have = set(cdc_dedup.chunked(" ".join(a + p + b))[2].tolist())
        other = " ".join(b + p + a)
        missed += not cdc_dedup.cut(other, [k for k, x in enumerate(cdc_dedup.chunked(other)[2].tolist()) if x in have])[1]
    assert missed <= 2
    assert cdc_dedup.deduplicated(df.where("false")).isEmpty()


def test_vectors_by_brute_force(spark):
    r = np.random.default_rng(2)
    centre = r.standard_normal((20, 16))
    rows = [(k, (centre[k % 20] + 0.06 * r.standard_normal(16)).tolist(), int(k % 20 % 3)) for k in range(300)]
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], 99), (1002, None, 1), (1003, [0.0] * 16, 1), (1004, [float("nan")] * 16, 1), (1005, rows[0][1], None), (1006, [], 1), (1007, [1.0, None], 1), (1000, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(i, v, y, "z") for i, v, y in rows], "vec_id long, embedding array<double>, label int, node string")
    got = embed_dedup.links(df).collect()
    assert len(got) == len(rows)
    ok = [v is not None and len(v) == 16 and np.isfinite(np.array(v, float)).all() and any(v) and y is not None for _, v, y in rows]
    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(rows, ok)]
    n = [sum(1 for y in range(len(rows)) if y != x and ok[x] and ok[y] and rows[x][2] == rows[y][2] and unit[x] @ unit[y] >= 0.98) for x in range(len(rows))]
    assert sorted(r_.n_links for r_ in got) == sorted(n)
    assert {r_.id: r_.n_links for r_ in got} == {rows[x][0]: n[x] for x in range(len(rows))}
    assert all(r_.component_id <= r_.id for r_ in got) and next(r_ for r_ in got if r_.id == 1001).component_id == 1001
    assert embed_dedup.links(df.where("false")).isEmpty()


def test_benchmark_by_templates(spark):
    items = [(1, "Mary has 12 apples and gives 5 apples to her friend Tom how many apples does Mary have left after that"), (2, "a train goes 60 km in 2 hours then stops for a very long while at the old station"), (3, None), (4, "short one")]
    docs = [(1, "so it is: Anna has 31 apples and gives 7 apples to her friend Bob how many apples does Anna have left after that. bye"), (2, items[0][1].upper()), (3, " ".join(words(60))), (4, None), (5, ""),
            (6, "yes a train goes 75 miles in 9 days then stops for a very long while at the old station ok"), (7, "a train goes 75 miles"), (8, "x " * 50_000 + items[1][1])]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    for sent in (decontam.MAX_SENT, 0):  # windows filtered in the tasks, and all windows joined
        got = {r.id: list(r.item_ids) for r in decontam.contaminated(d, b, max_sent=sent).collect()}
        assert got == {1: [1], 2: [1], 3: [], 4: [], 5: [], 6: [2], 7: [], 8: [2]}
    assert sorted(r.doc_id for r in decontam.decontaminated(d, b).collect()) == [3, 4, 5, 7]
    slots = spark.createDataFrame([(1, "give 3 of 4 parts and then 3 of 4 parts again to the other side of town")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "give 8 of 9 parts and then 8 of 9 parts again to the other side of town"), (2, "give 8 of 9 parts and then 7 of 9 parts again to the other side of town")], "doc_id long, text string")
    assert {r.id: r.contaminated for r in decontam.contaminated(texts, slots).collect()} == {1: True, 2: False}
    assert decontam.contaminated(d.where("false"), b).isEmpty() and decontam.contaminated(d, b.where("false")).where("contaminated").isEmpty()


def test_slots_that_contradict_cut_a_stretch(spark):
    item = words(15) + ["12"] + words(12) + ["12"] + words(11)
    changed = [*item[:28], "15", *item[29:]]
    other = "a box of 3 red pens and 4 blue pens stood there on a table near the open window of the old school house by the river"
    items = spark.createDataFrame([(1, " ".join(item)), (2, other)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, other.replace("3", "5").replace("4", "5"))], "doc_id long, text string")
    got = {r.id: (list(r.item_ids), r.max_tokens) for r in decontam.contaminated(docs, items).collect()}
    assert got == {1: ([1], 28), 2: ([2], 20)}


def test_longest_stretches():
    run = list(range(33))  # 40 tokens in windows of eight
    assert decontam.longest(run, [(5, 1, 1), (20, 2, 1)], 8, 40, 13) == 20
    assert decontam.longest(run, [(5, 1, 1), (9, 2, 1), (14, 1, 1), (20, 2, 1)], 8, 40, 13) == 20
    assert decontam.longest(run, [(5, 1, 1), (9, 2, 1), (14, 3, 1), (20, 3, 2), (25, 3, 1)], 8, 40, 13) == 15
    assert decontam.longest(run, [(5, 3, 4), (20, 3, 4)], 8, 40, 13) == 40
    assert decontam.longest([*range(9), *range(20, 33)], [(1, 3, 4), (22, 3, 5), (24, 3, 5)], 8, 40, 13) == 20
    assert decontam.longest([*range(20), 25], [(2, 3, 3), (9, 3, 4), (16, 3, 5), (22, 3, 6)], 8, 40, 13) == 0


def test_names_that_begin_sentences_are_slots(spark):
    items = [(1, "Mary buys 12 pens. Tom buys 5 pens. Mary gives Tom 3 pens. How many pens does Mary have?"), (2, "Mary walks slowly down to the old harbour and buys a red boat"), (3, "mary and tom walk slowly down to the old harbour and sell a blue boat")]
    docs = [(1, "Anna buys 31 pens. Bob buys 7 pens. Anna gives Bob 4 pens. How many pens does Anna have?"), (2, "Once more. Zoe walks slowly down to the old harbour and buys a red boat. The end."), (3, items[2][1].upper()),
            (4, items[0][1].lower()), (5, "Anna buys 31 pens. Bob buys 7 pens. Bob gives Anna 4 pens. How many pens does Zoe have?")]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for sent in (decontam.MAX_SENT, 0):
        got = {r.id: list(r.item_ids) for r in decontam.contaminated(d, b, max_sent=sent).collect()}
        assert got == {1: [1], 2: [2], 3: [3], 4: [1], 5: []}


def test_documents_are_told_apart_by_id_and_text(spark):
    item = " ".join(words(20))
    docs = [(None, item, 1), (None, "a clean text", 2), (7, "so " + item, 3), (7, "another clean text", 4), (8, "clean again", 5), (8, "clean again", 6)]
    d = spark.createDataFrame([(i, t, k, "x", "y", "z") for i, t, k in docs], "doc_id long, text string, k int, _id string, _key string, id string")
    b = spark.createDataFrame([(1, item), (None, "a clean text"), (2, None), (1, item)], "item_id long, text string")
    got = decontam.contaminated(d, b).collect()
    assert sorted((str(r.id), r.contaminated) for r in got) == [("7", False), ("7", True), ("8", False), ("8", False), ("None", False), ("None", True)]
    left = decontam.decontaminated(d, b)
    assert left.columns == d.columns and sorted(r.k for r in left.collect()) == [2, 4, 5, 6] and all((r._id, r._key, r.id) == ("x", "y", "z") for r in left.collect())


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "what colour is the clear sky"), (2, "name 3 big red dogs"), (3, "yes or no"), (4, "今天的天气非常好我们去公园散步吧")]
    docs = [(1, "He asked: What colour is the clear sky? Nobody knew."), (2, "please name 4 big red dogs now"), (3, "say yes or no to it"), (4, "Yes or no?"), (5, "他说今天的天气非常好我们去公园散步吧。"), (6, "今天的天气不好"), (7, "please name 3 big red dogs now")]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for sent in (decontam.MAX_SENT, 0):
        assert {r.id: list(r.item_ids) for r in decontam.contaminated(d, b, max_sent=sent).collect()} == {1: [1], 2: [], 3: [], 4: [3], 5: [4], 6: [], 7: [2]}


def test_benchmark_by_brute_force(spark):
    """Every placement of every item beside every document, in plain Python, for texts of literal words."""
    few = [f"v{k}" for k in range(4)]
    pick = lambda n: [rng.choice(few) if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(n)]
    items = [pick(rng.randint(5, 30)) for _ in range(25)]
    docs = []
    for k in range(60):
        item = items[k % 25]
        a = rng.randint(0, max(0, len(item) - 10))
        docs.append(pick(rng.randint(0, 20)) + item[a : a + rng.randint(5, 30)] + pick(rng.randint(0, 20)))
    got = decontam.contaminated(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string"))
    want = {}
    for d, text in enumerate(docs):
        found = []
        for i, item in enumerate(items):
            best = 0
            for shift in range(-len(item), len(text)):
                run = 0
                for k, w in enumerate(item):
                    run = run + 1 if 0 <= k + shift < len(text) and text[k + shift] == w else 0
                    best = max(best, run)
            if best >= min(13, len(item)):
                found.append(i)
        want[d] = found
    assert {r.id: list(r.item_ids) for r in got.collect()} == want and any(want.values())


def test_changed_numbers_names_and_letters(spark):
    tom = "Tom buys {} pens and then {} more pens for the small school near the old town hall"
    names = "the girl {} and her sister {} gave {} apples to the friend {} who lives near the old mill by the river"
    apples = "die äpfel sind heute im laden sehr teuer und niemand kauft sie mehr ausser dem alten koch"
    items = [(1, tom.format("three", "seven")), (2, names.format("Émile", "Zoé", "3", "Renée")), (3, apples)]
    docs = [(1, tom.format("four", "nine")), (2, names.format("Élodie", "Éva", "8", "Íris")), (3, "İ " + apples.upper()), (4, tom.format("4", "9")), (5, tom.format("four", "four"))]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for sent in (decontam.MAX_SENT, 0):
        got = {r.id: list(r.item_ids) for r in decontam.contaminated(d, b, max_sent=sent).collect()}
        assert got == {1: [1], 2: [2], 3: [3], 4: [1], 5: []}


def test_tables_of_numbers_meet_in_proportion(spark):
    number = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    table, own = number(300), "prices of all the goods in the old shop are listed in this table"
    docs = [(k, number(3000)) for k in range(5)] + [(9, "so: " + table), (10, f"{own} {number(300)}"), (11, number(100) + " " + " ".join(table.split()[50:63]) + " " + number(100))]
    b = spark.createDataFrame([(1, table), (2, f"{own} {table}")], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for sent in (decontam.MAX_SENT, 0):
        got = {r.id: (list(r.item_ids), r.max_tokens) for r in decontam.contaminated(d, b, max_sent=sent).collect()}
        assert got == {**{k: ([], 0) for k in range(5)}, 9: ([1, 2], 300), 10: ([2], 314), 11: ([1, 2], 163)}
    size = decontam.windows(d, "doc_id", "text", 13).join(decontam.windows(b, "item_id", "text", 13).select("window"), "window").count()
    assert size < 2 * 3 * 700  # three readings at most; all tables against each other would be millions


def test_slots_by_brute_force(spark):
    """Every stretch of every placement, in plain Python, for texts of words and numbers."""
    few = [str(k) for k in range(4)]
    pick = lambda n: [rng.choice(few) if rng.random() < 0.45 else rng.choice(WORDS[:300]) for _ in range(n)]
    items = [pick(rng.randint(6, 26)) for _ in range(20)] + [pick(8) + [rng.choice(few) for _ in range(20)] + pick(6)]
    docs = []
    for k in range(80):
        item, turn = items[k % len(items)], rng.sample(few, 4)
        changed = [turn[int(w)] if w in few and rng.random() < 0.95 else w for w in item]
        a = rng.randint(0, 3)
        docs.append(pick(rng.randint(0, 12)) + changed[a : a + rng.randint(5, 40)] + pick(rng.randint(0, 12)))

    def stretch(text, item, shift):
        """Whether a part of a run of alike tokens is long enough; parts begin anew at contradictions, or are the same on both sides."""
        least, slot = min(13, len(item)), lambda w: w in few
        alike = [0 <= k + shift < len(text) and (text[k + shift] == w or slot(w) and slot(text[k + shift])) for k, w in enumerate(item)]
        at = 0
        while at < len(item):
            end = at
            while end < len(item) and alike[end]:
                end += 1
            there, here, equal, same = {}, {}, 0, 0
            for b in range(at, end if end - at >= least else at):
                x, y = text[b + shift], item[b]
                if slot(y) and (there.get(x, y) != y or here.get(y, x) != x):
                    there, here, equal, at = {}, {}, 0, b
                there[x], here[y] = y, x
                equal, same = equal + (x == y), same + 1 if x == y else 0
                if max(same, b + 1 - at if equal >= min(5, len(item)) else 0) >= least:
                    return True
            at = end + 1
        return False

    want = {d: [i for i, item in enumerate(items) if any(stretch(text, item, shift) for shift in range(-len(item), len(text)))] for d, text in enumerate(docs)}
    rows = [(k, " ".join(t)) for k, t in enumerate(docs)]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string"))
    assert {r.id: list(r.item_ids) for r in got.collect()} == want and sum(map(bool, want.values())) > 20


def test_words_beyond_ascii():
    count = lambda t: len(textnum.word_hashes(t))
    assert [count(t) for t in ("¿? ...", "l’été — «oui»", "文字です。", "x文y", "ไทย", "naïve æther", "𠀀𠀁", "한국 말")] == [0, 3, 4, 3, 3, 2, 2, 2]
    assert textnum.word_hashes("文字")[0] == textnum.word_hashes("a文")[1] and [len(h) for h in textnum.word_hashes_of(["文", "", "a b"])] == [1, 0, 2]


def test_chunks_by_brute_force(spark):
    def plain(data):
        """Starts of chunks by a byte-by-byte gear loop."""
        h, at = 0, []
        for k, byte in enumerate(data):
            at.append(h)  # the hash over the bytes before this one
            h = ((h << 1) + int(cdc_dedup.GEAR[byte])) & 0xFFFFFFFF
        starts = [k for k in range(1, len(data)) if data[k] not in b" \n" and data[k - 1] in b" \n"]
        value = [int(textnum.mixed(np.array([sum(int(cdc_dedup.GEAR[data[k - 1 - j]]) << j for j in range(min(16, k))) & 0xFFFFFFFF], np.uint64))[0]) for k in starts]
        assert all(at[k] & 0xFFFF == sum(int(cdc_dedup.GEAR[data[k - 1 - j]]) << j for j in range(min(16, k))) & 0xFFFF for k in starts)
        return [0] + [s for n, s in enumerate(starts) if all(value[n] < v for v in value[max(0, n - 4) : n]) and all(value[n] <= v for v in value[n + 1 : n + 5])]

    shared = [words(60) for _ in range(4)]
    rows = [(k // 2 if k % 5 else None, " ".join(words(30) + shared[k % 4] + words(25))) for k in range(14)] + [(3, "a b"), (3, "a b"), (50, " ".join(shared[0] + shared[0]))]
    for _, text in rows:
        assert cdc_dedup.boundaries(text.encode() and np.frombuffer(text.encode(), np.uint8)).tolist() == plain(text.encode())
    # The kept chunks by a dictionary: of each digest the smallest id, null last; within a text its first place.
    keeper, want = {}, {}
    key = lambda i: 2**63 - 1 if i is None else i
    for i, text in rows:
        for chunk in cdc_dedup.chunked(text)[2].tolist():
            keeper[chunk] = min(keeper.get(chunk, 2**63), key(i))
    for i, text in rows:
        seen = set()
        for place, chunk in enumerate(cdc_dedup.chunked(text)[2].tolist()):
            if chunk in seen or keeper[chunk] < key(i):
                want.setdefault((key(i), text), set()).add(place)
            seen.add(chunk)
    df = spark.createDataFrame([(i, t, "p", "q", "r") for i, t in rows], "doc_id long, text string, _places string, _key string, _id string")
    new = {(i, t): cdc_dedup.cut(t, sorted(want[key(i), t]))[0] if (key(i), t) in want else t for i, t in rows}
    got = cdc_dedup.deduplicated(df)
    assert got.columns == [*df.columns, "cdc"]
    assert sorted((str(r.doc_id), r.text, r._places, r._key, r._id) for r in got.collect()) == sorted((str(i), new[i, t], "p", "q", "r") for i, t in rows)


def test_repeats_in_scripts_without_spaces(spark):
    letters = [chr(0x4E00 + k) for k in range(3000)]
    pick = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, blob = pick(150), "".join(rng.choice("abcdefghijklmnop") for _ in range(600))
    near = pick(120)
    rows = [(1, pick(80) + passage + pick(80)), (2, pick(70) + passage + pick(60)), (3, "data " + blob), (4, "more data " + blob), (5, near), (6, near[:50] + "文" + near[51:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in cdc_dedup.deduplicated(df).collect()}
    assert [got[k].cdc.words > 0 for k in (1, 2, 3, 4)] == [False, True, False, True] and len(got[2].text) < 180 and len(got[4].text) < 200
    assert {r.id: r.class_id for r in minhash.classes(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 3 if minhash.similar(*textnum.word_hashes_of([rows[2][1], rows[3][1]])) else 4, 5: 5, 6: 5}


def test_near_duplicates_keep_columns_of_any_name(spark):
    text = " ".join(words(30))
    df = spark.createDataFrame([(2, text, "a", "b"), (1, text, "c", "d"), (None, text, "e", "f"), (3, None, "g", "h")], "doc_id long, text string, _key string, id string")
    left = minhash.one_of_each(df)
    assert left.columns == df.columns and sorted((r.doc_id, r._key, r.id) for r in left.collect()) == [(1, "c", "d"), (3, "g", "h")]
