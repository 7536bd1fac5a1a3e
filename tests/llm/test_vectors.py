"""Centroids, neighbours and resampling against brute force; edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skyledger.llm import centroids, mih, resampling
from skyledger.llm.queries import QUERIES
from tests.conftest import SF

ODD = [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, None, 0.0, 1.0]), (904, [1.0, float("nan"), 0.0, 1.0]), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, cluster int")


def plain_clusters(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    c = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for turn in range(rounds + 1):
        placed = [min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c)) for _, x in kept]
        if turn < rounds:
            for j in range(len(c)):
                own = [x for (_, x), (_, p) in zip(kept, placed) if p == j]
                c[j] = [sum(col) // len(own) for col in zip(*own)] if own else c[j]
    sums = Counter()
    for d, j in placed if kept else ():
        sums[j] += d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, placed)), key=str) if kept else []


def test_centroids_by_plain_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.standard_normal(4) * 3).tolist()) for k in range(80)] + [(5, [9.0, 9.0, 9.0, 9.0]), (5, [9.0, 9.0, 9.0, 9.0]), (None, [-1.0, 0.5, 0.0, 2.0])]
    rows += [(100 + k, [0.25, -0.25, 1.0, 0.0]) for k in range(60)] + ODD
    for k, rounds in ((5, 3), (16, 1), (1, 2)):
        got = centroids.clustered(frame(spark, rows), k=k, rounds=rounds, dim=4, scale=8)
        assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, k, rounds, 4, 8)
    few = rows[:3]
    assert sorted(map(tuple, centroids.clustered(frame(spark, few), dim=4).collect()), key=str) == plain_clusters(few, 16, 3, 4, 64)
    assert centroids.clustered(frame(spark, ODD[:2] + ODD[3:]), dim=4).isEmpty() and centroids.clustered(frame(spark, []), dim=4).isEmpty()
    huge = centroids.clustered(frame(spark, [(1, [1e300] * 4), (2, [-1e300] * 4)]), k=1, rounds=0, dim=4).collect()
    assert sorted(r.distance for r in huge)[1] > 0


def plain_neighbours(rows, asked, top):
    good = [(i, np.array(v, float) / max(map(abs, v))) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q in asked:
            found = {(-float(v @ w) / math.sqrt(float(v @ v) * float(w @ w)), i) for i, w in good if i != q and len(w) == len(v)}
            out[q] = [(i, -s) for s, i in sorted(found)[:top]]
    return out


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(1000 + k, (base[k // 10] + 0.05 * rng.standard_normal(16)).tolist()) for k in range(300)]
    rows += [(2000 + k, base[7].tolist()) for k in range(40)] + [(7, base[7].tolist())] + ODD + [(3000, [3.0, 1.0]), (3001, [1e200, 1e-200])]
    df = frame(spark, rows)
    got = {}
    for r in mih.nearest(df, df.where("vec_id % 10 = 0 or vec_id in (7, 906)")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = plain_neighbours(rows, {i for i, _ in rows if i % 10 == 0} | {7, 906}, 5)
    assert set(got) == {q for q, found in want.items() if found}
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found}) for q, found in got.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, found in got.items():
        exact = dict(plain_neighbours(rows, {q}, len(rows))[q])
        assert all(math.isclose(exact[i], s, abs_tol=1e-12) for i, s in found)
    assert [i for i, _ in got[7]] == [2000, 2001, 2002, 2003, 2004] and [i for i, _ in got[2000]][:2] == [7, 2001]
    assert mih.nearest(df.where("false"), df).isEmpty() and mih.nearest(df, df.where("vec_id = 902")).isEmpty()


def test_probes_find_every_code_within_the_radius():
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2, (3000, mih.BITS), np.uint8)
    for k in range(1, 400):  # near codes, at every distance up to the guarantee
        bits[k] = bits[0]
        bits[k, rng.choice(mih.BITS, k % (mih.SUBSTRINGS * (mih.FLIPS + 1)), replace=False)] ^= 1
    codes = np.packbits(bits, axis=1)
    shard = mih.Shard([[k] for k in range(3000)], rng.standard_normal((3000, 4)), codes)
    far = (bits ^ bits[0]).sum(axis=1)
    found = set(shard.found(codes[0], enough=3000).tolist())
    assert {k for k in range(3000) if far[k] <= mih.SUBSTRINGS * (mih.FLIPS + 1) - 1} <= found
    assert len(found) == 3000
    for enough in (5, 50, 200):
        found = shard.found(codes[0], enough)
        assert len(found) >= enough and set(found.tolist()) == {k for k in range(3000) if far[k] <= max(far[found])}


def test_neighbours_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = plain_neighbours([(r.vec_id, r.embedding) for r in rows], {r.vec_id for r in rows if r.vec_id % 50 == 0}, 5)
    got = QUERIES["op12_neighbours"](spark, SF).collect()
    assert Counter(r.query_id for r in got) == {q: 5 for q in want}
    assert sum(r.vec_id in dict(want[r.query_id]) for r in got) >= 0.9 * len(got)


def test_totals_by_planes_are_sums():
    rng = np.random.default_rng(2)
    for gain in (rng.integers(-9000, 9000, 500), np.zeros(500, int), -np.ones(500, int), np.arange(500)):
        of, bucket = rng.integers(0, 150, 60_000), rng.integers(0, 500, 60_000) ** 2 // 500
        of[:40_000] = 3  # counts of many bits
        want = [int(gain[bucket[of == k]].sum()) for k in range(160)]
        assert resampling.totals(of, bucket, 160, resampling.planes(gain), 500) == want


def test_resampling_by_plain_loops(spark):
    texts = ["The CAT sat on the mat " * k for k in range(12)] + [None, "", " ?! ", "É é ß " + "y" * 300 + " " + "z" * 64, "a " * 50_000, "solve for x the number of cats " * 5] + [f"w{k} q{k * k} on the mat. " * 9 for k in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(20, texts[20]), (20, texts[20]), (None, texts[25]), (None, None)]
    target = ["How many cats sat on the mat?", None, "solve for x"]

    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return w, Counter(zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    def plain(rows, target):
        s, t = (sum((feats(x)[1] for x in side), Counter()) for side in ([t for _, t in rows], target))
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
        out = []
        for i, text in rows:
            w, f = feats(text)
            weight = sum(n * gain[b] for b, n in f.items()) // f.total() if f else 0
            h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
            out.append([i, len(w), f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
        for k, r in enumerate(able[: 25 * len(able) // 100]):
            r[5] = k + 1
        return sorted(map(tuple, out), key=str)

    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, score int, rank int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted(map(tuple, resampling.drawn(df.repartition(3), goal).collect()), key=str) == plain(rows, target)
    assert sorted(map(tuple, resampling.drawn(df, goal.where("false")).collect()), key=str) == plain(rows, [])
    assert resampling.drawn(df.where("false"), goal).isEmpty()
    named = resampling.drawn(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), goal)
    assert dict(named.dtypes)["id"] == "string" and named.count() == len(rows)
