"""Sharding and licence scans against brute force; edge rows."""

import textwrap
import zlib
from collections import Counter

from pyspark.sql import functions as F

from skyledger.llm import licenses, sharding

DOCS = [(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "é" * 50, "y"), (4, "é" * 50, "y"), (None, "a b c", None)]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, row_number string")


def test_shards_are_even_gapless_and_reproducible(spark):
    runs = [sorted(sharding.documents_sharded(docs(spark).repartition(p), 4).select("doc_id", "size", "text_crc32", "shard", "slot").collect(), key=str) for p in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == len(DOCS)
    sizes = Counter(r.shard for r in runs[0])
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(4)) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in runs[0] if r.shard == shard) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in DOCS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in runs[0]) == want


def test_permutation_is_a_bijection_and_its_inverse_locates(spark):
    for n in (1, 2, 3, 24, 97, 1000):
        rows = sharding.shards(spark.range(n), ["id"], 24)
        assert sorted(r.position for r in rows.collect()) == list(range(n))
        back = sharding.located(rows.select("shard", "slot", F.col("row_number").alias("want")), n)
        assert back.where("row_number <> want").isEmpty()
    assert sharding.shards(spark.range(0), ["id"]).isEmpty()


def test_a_row_that_repeats_very_often(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 100)
    df = spark.range(1050).select(F.lit(7).alias("doc_id"), F.lit("x").alias("text")).union(spark.createDataFrame([(1, "y" * 1_000_000), (2, None)], "doc_id int, text string"))
    rows = sharding.documents_sharded(df, 24).collect()
    places = {(r.shard, r.slot) for r in rows}
    assert len(rows) == len(places) == 1052 and sorted(r.row_number for r in sharding.row_numbers(df, ["doc_id", "text"]).collect()) == list(range(1052))
    assert {r["size"] for r in rows} == {9, 8, 1_000_008}


def brute_licence(text, files):
    import math
    import re

    split = lambda s: re.findall(r"[^\W_]+(?:\.[^\W_]+)*", s.lower())
    vocab = {t for _, n in licenses.TEMPLATES for t in split(n)}
    df = Counter(t for f in files for t in set(split(f or "")) & vocab)
    idf = lambda t: math.log((1 + len(files)) / (1 + df.get(t, 0))) + 1
    best = ((False, 0, 0), None)
    text = text or ""
    gap = r"\r?\n[^a-zA-Z0-9\n]*\r?\n"
    for line in dict.fromkeys([*text.split("\n"), *re.split(gap, text), *re.split(r"[.!?]+\s+|" + gap, text), text]):
        a = {t: n * idf(t) for t, n in Counter(split(line)).items()}
        for lic, notice in licenses.TEMPLATES:
            b = {t: n * idf(t) for t, n in Counter(split(notice)).items()}
            shared = sum(a[t] * b.get(t, 0) for t in a)
            cosine = shared / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if a else 0
            if cosine >= licenses.THRESHOLD and (rank := (lic != licenses.RESERVED, round(shared, 6), round(cosine, 6))) > best[0]:
                best = (rank, lic)
    return best[1]


def test_licences_by_brute_force_and_inheritance(spark):
    files = [("a/LICENSE", "hello\nReleased under the MIT License."), ("a/b/x.txt", "plain text of the work"), ("a/b/c/y.txt", "Licensed under CC BY-NC 4.0."), ("a/b/c/z.txt", None),
             ("q/z.txt", ""), ("a/b/c/LICENSE.md", "This work is licensed under the GNU General Public License, version 3."), (None, "x"), ("top.txt", "the license of the public domain is free")]
    df = spark.createDataFrame([(k, p, t, "clash") for k, (p, t) in enumerate(files)], "id long, path string, text string, license string")
    rows = {r.id: r for r in licenses.scanned(df).collect()}
    texts = [t for _, t in files]
    for k, (_, text) in enumerate(files):
        own = brute_licence(text, texts)
        assert (rows[k].license if rows[k].how == "own" else None) == own
    assert (rows[1].license, rows[1].how, rows[1].licence_dir) == ("MIT", "inherited", "a")
    assert (rows[3].license, rows[3].licence_dir) == ("GPL-3.0", "a/b/c")
    assert rows[4].how == rows[6].how == rows[7].how == "none"
    assert licenses.scanned(df.where("false")).isEmpty()


def test_wrapped_notices_and_whole_files(spark):
    text_of = {}
    for lic, text in licenses.TEMPLATES:
        text_of.setdefault(lic, []).append(text)
    wrap = lambda t, mark: "\n".join(f"{mark} {x}" for x in textwrap.wrap(t, 60))
    full = {lic: max(texts, key=len) for lic, texts in text_of.items()}
    files = [("gpl.c", "/*\n" + wrap("My program, a tool for things.", " *") + "\n *\n" + wrap(text_of["GPL-3.0"][2], " *") + "\n *\n * more\n */\nint main;"), ("bsd.py", "# Copyright 2020 A. Person\n#\n" + wrap(text_of["BSD-3-Clause"][0], "#") + "\n\nimport os"),
             ("m/LICENSE", "MIT License\n\nCopyright (c) 2024 Someone\n\n" + "\n\n".join(textwrap.fill(x, 70) for x in (full["MIT"],))), ("b2/LICENSE", textwrap.fill(full["BSD-2-Clause"], 70)), ("b3/LICENSE", textwrap.fill(full["BSD-3-Clause"], 70)),
             ("inside.txt", "The tool does this and more. Released under the MIT License. See docs for all the rest of it."), ("right.txt", "Copyright (c) 2024 Acme Inc. All rights reserved."), ("isc.txt", textwrap.fill(text_of["ISC"][1], 50)),
             ("long.txt", "word and more. " * 30_000 + "\n\nReleased under the MIT License.\n"), ("none.txt", "the licence of a driver is a card"), ("none.txt", "the licence of a driver is a card")]
    df = spark.createDataFrame([(k, p, t, 1) for k, (p, t) in enumerate(files)], "id long, path string, text string, _part int")
    got = {r.id: r.license for r in licenses.scanned(df).collect()}
    want = ["GPL-3.0", "BSD-3-Clause", "MIT", "BSD-2-Clause", "BSD-3-Clause", "MIT", "proprietary", "ISC", "MIT", None, None]
    assert [got[k] for k in range(len(files))] == want
    texts = [t for _, t in files]
    assert [brute_licence(t, texts) for t in texts] == want and licenses.scanned(df).count() == len(files)


def test_licences_by_an_expected_table(spark):
    """Files as they are found, each with the licence that a reader would name; no rule of the operator is repeated here."""
    of = lambda lic: max((t for k, t in licenses.TEMPLATES if k == lic), key=len)
    body = textwrap.fill
    bsd = body(of("BSD-3-Clause"), 72).replace("THE\nCOPYRIGHT", "THE COPYRIGHT").replace("COPYRIGHT HOLDERS AND\nCONTRIBUTORS", "COPYRIGHT HOLDERS AND CONTRIBUTORS")
    named = of("BSD-3-Clause").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "FOO INC")
    gpl2 = "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version."
    files = [
        ("Copyright (c) 2020, Foo Inc\nAll rights reserved.\n\n" + body(named, 72), "BSD-3-Clause"),
        ("Copyright (c) 2020, Foo Inc\n\n" + body(named, 72), "BSD-3-Clause"),
        ("Copyright 1999 A. Person\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"),
        ("Copyright (c) 2024 B\nAll rights reserved.\n\n" + body(of("MIT").replace("charge", "cost"), 72), "MIT"),
        ("Copyright (C) 2003 C. All rights reserved.\n\n" + gpl2, "GPL-2.0"),
        ("Copyright (c) 2024 Acme Inc.\nAll rights reserved.", "proprietary"),
        ("// SPDX-License-Identifier: MIT\nint main;", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-or-later\nimport os", "GPL-2.0"), ("/* SPDX-License-Identifier: BSD-4-Clause */", "BSD-4-Clause"),
        ("   Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n  The licenses for most software are designed", "GPL-3.0"),
        ("Attribution 4.0 International\n\nCreative Commons Attribution 4.0 International Public License\n\nBy exercising the Licensed Rights", "CC-BY-4.0"),
        ("Creative Commons Attribution-NonCommercial 4.0 International Public\nLicense\n\nBy exercising", "CC-BY-NC-4.0"),
        ("Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE (AGREEMENT). ANY USE", "EPL-2.0"),
        ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------", "MPL-2.0"),
        ("MIT License\n\nCopyright (c) 2024 Someone\n\n" + body(of("MIT"), 70) + "\n\nLogo: Licensed under CC BY-NC 4.0.", "MIT"),
        ("The committee reserved all rooms and the rights were discussed.", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(k, f"d{k}/f.txt", t) for k, (t, _) in enumerate(files)], "id long, path string, text string")
    got = {r.id: r.license for r in licenses.scanned(df).collect()}
    assert [got[k] for k in range(len(files))] == [want for _, want in files]
