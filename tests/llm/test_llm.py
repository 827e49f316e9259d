"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, cover_topk, decontaminate, hmm, licenses, line_crf, ngram_join, packing, pii, token_counts, url_filter

DOCS = "doc_id long, text string, sig string, cls string, comp string"  # with names that operators use themselves


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "c", "k") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rnd = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(words, rnd.integers(4, 120))) for _ in range(60)]
    out = list(base)
    for t in base[:25]:
        w = t.split()
        for _ in range(4):
            x = list(w)
            x[rnd.integers(len(x))] = "zz" + str(rnd.integers(99))
            out.append(" ".join(x))
    line = " ".join(words[:60])
    out += [line + f" tail{i}" for i in range(30)] + [base[0]] * 5
    return [(i, t) for i, t in enumerate([*out, None, "", " \t\n", "one", "One", "one two", "x " * 30_000])]


def forest(nodes, links):
    up = {n: n for n in nodes}

    def root(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def shingle_set(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_ngram_join(spark, texts, monkeypatch, width, num, den):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)  # many blocks, so that visitors travel
    monkeypatch.setattr(ngram_join, "LARGE_SETS", 6)
    monkeypatch.setattr(ngram_join, "TOUR", 2)
    sets = {i: shingle_set(t, width) for i, t in texts}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = forest(sets, links)
    got = ngram_join.component_table(docs(spark, texts), width, num, den).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}


def test_prefix_rule():
    """The scheme's own conditions: k shared shingles cover one of M classes twice, for every size."""
    for num, den in ((9, 10), (8, 10)):
        rule, last = ngram_join.Rule(num, den), (0, 0)
        for n in range(1, 5000):
            o, k = rule.overlap(n), rule.inner(n)
            assert 1 <= k <= o and k >= last[1] and o - k >= last[0]
            assert n == 1 or max(rule.bands(n)) <= k - 1 or o == 1
            last = (o - k, k)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rnd = np.random.default_rng(1)
    letters = list("abz19 '  \n\t.!stremvl  é中😀ß²")
    rows = [None, "", "  ", "a  ", "''s don't we'll", "x<|endoftext|> y<|endoftext|>", "a" * 5000, " " * 900 + "x", "中文" * 300] + ["".join(rnd.choice(letters, rnd.integers(1, 700))) for _ in range(150)]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in rows], add_special_tokens=False)]
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs(spark, list(enumerate(rows))), path).collect()}
    assert [got[i]["n_tokens"] for i in range(len(rows))] == want
    assert all(got[i]["over_limit"] == (n > 1024) and got[i]["n_bytes"] == len((rows[i] or "").encode()) for i, n in enumerate(want))


def test_chunk_maps_compose():
    """Entry states from the prefix scan equal those of a walk from the start."""
    rnd = np.random.default_rng(2)
    grid = rnd.choice([0, 0, 0, 1, 2, 3, 4, 7], (16, 40)).astype(np.uint8)
    grid[:, 3] = 0
    want, state = [], 0
    for lane in grid.T:
        want.append(state)
        for s in lane:
            state = token_counts.NEXT[state * 9 + s]
    assert token_counts.entry_states(grid).tolist() == want


def test_top_k(spark):
    rnd = np.random.default_rng(0)
    v = rnd.normal(size=(700, 6)).round(2)
    v[300:420] = v[0]  # one common vector
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 6), (None, [1.0] * 6), (1300, [1e30] * 6), (1400, []), (200, [float(x) for x in v[200]])]
    good = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = {}
    for q, a in {i: e for i, e in good if i % 100 == 0}.items():
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, e, strict=True)))), i) for i, e in good if i != q and len(e) == len(a))
        want[q] = [(i, -s) for s, i in scored[:10]]
    got: dict = {}
    for r in sorted(cover_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: x for q, x in want.items() if x}
    assert cover_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_prunes_clusters(spark, monkeypatch):
    """In clustered data few pairs are scored; in small blocks queries travel only to blocks that may matter."""
    rnd = np.random.default_rng(20)
    centres = rnd.normal(size=(40, 16)) * 4
    v = (centres[rnd.integers(0, 40, 6000)] + rnd.normal(size=(6000, 16)) * 0.05).round(3)
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    whole = np.floor(v * 1024)
    scores = whole[::100] @ whole.T
    for block in (cover_topk.BLOCK_NUMBERS, 16 * 500):
        monkeypatch.setattr(cover_topk, "BLOCK_NUMBERS", block)
        got: dict = {}
        for r in cover_topk.top_k(table).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for row, q in enumerate(range(0, 6000, 100)):
            order = [i for i in np.lexsort((np.arange(6000), -scores[row])).tolist() if i != q][:10]
            assert got[q] == [(i, int(scores[row, i])) for i in order]
        assert cover_topk.compared(table) < 0.3


def test_decontamination(spark):
    rnd = np.random.default_rng(4)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(9000)]

    def text(n):
        return [str(rnd.choice(common)) if rnd.random() < 0.5 else str(rnd.choice(rare)) for _ in range(n)]

    items = [(i, " ".join(text(int(rnd.integers(15, 60)))) + ".") for i in range(40)] + [(90, None), (91, "!!"), (92, "Short one.")]
    rows = []
    for i in range(200):
        w = text(int(rnd.integers(5, 400)))
        if i % 4 == 0:
            own = [x.upper() if rnd.random() < 0.3 else x for x in decontaminate.plain_words(items[i % 40][1].encode()) and items[i % 40][1].split()]
            if i % 8 == 0:
                own[len(own) // 2] = "changed"
            at = int(rnd.integers(len(w) + 1))
            w[at:at] = own
        rows.append((i, ("\n" if i % 3 else " ").join(w)))
    rows += [(300, None), (301, ""), (302, "x " * 20_000)]
    got = decontaminate.leaked_pairs(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    want = {(i, i % 40) for i in range(0, 200, 4)}
    assert len(want - pairs) <= 0.1 * len(want)  # recall of planted passages, whole and altered
    exact = {(i, i % 40) for i in range(4, 200, 8)}
    assert exact <= pairs and not pairs - want
    kept = {r["doc_id"] for r in decontaminate.keep_clean(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in pairs}
    assert decontaminate.leaked_pairs(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_of_many_and_long_items(spark):
    """Copies are found when the benchmark has many more items than the projection has directions, and in long items."""
    rnd = np.random.default_rng(14)
    share = 1 / np.arange(1, 8001)
    share /= share.sum()

    def text(n):
        return [f"w{x}" for x in rnd.choice(8000, n, p=share)]

    items = [(i, " ".join(text(38))) for i in range(2500)] + [(5000 + i, " ".join(text(n))) for i, n in enumerate([49, 90, 300, 600, 1500])]
    planted = items[::25] + items[2500:]
    rows, want, altered = [], set(), set()
    for i, (item, t) in enumerate(planted):
        w, own = text(200), t.split()
        at = int(rnd.integers(200))
        rows.append((i, " ".join(w[:at] + own + w[at:])))
        want.add((i, item))
        own = [x if rnd.random() > 0.1 else "changed" for x in own]
        rows.append((1000 + i, " ".join(w[:at] + own + w[at:])))
        altered.add((1000 + i, item))
    rows += [(3000 + i, " ".join(text(300))) for i in range(50)]
    got = decontaminate.leaked_pairs(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert want <= pairs
    assert len(altered - pairs) <= 0.05 * len(altered)
    assert not pairs - want - altered


def test_exact_cosines():
    rnd = np.random.default_rng(15)
    index = decontaminate.Index([(i, " ".join(f"w{x}" for x in rnd.integers(0, 60, 20)).encode()) for i in range(50)])
    index.weigh(rnd.integers(1, 90, len(index.vocab)).astype(float), 100)
    index.settle(np.zeros((len(index.vocab), 1)))
    texts = [[f"w{x}".encode() for x in rnd.integers(0, 75, n)] for n in (40, 9, 1, 100, 33)]
    feature, sizes = np.concatenate([index.features(w) for w in texts]), np.array([40, 9, 1, 100, 33])
    got = {(t, at, i): c for t, at, i, _, c in index.candidates(feature, sizes)}
    want = {}
    for t, w in enumerate(texts):
        for at in range(0, len(w), decontaminate.STEP):
            own = w[at : at + decontaminate.WINDOW]
            norm = math.sqrt(sum(float(index.idf[index.vocab[x]]) ** 2 if x in index.vocab else index.other for x in own))
            for i, other in enumerate(index.words):
                both = sum(own.count(x) * other.count(x) * float(index.idf[index.vocab[x]]) ** 2 for x in set(own) & set(other))
                cos = both / norm / math.sqrt(sum((other.count(x) * float(index.idf[index.vocab[x]])) ** 2 for x in set(other)))
                if cos >= decontaminate.COSINE:
                    want[t, at, i] = cos
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_lcs():
    assert decontaminate.lcs(list("abcbdab"), list("bdcaba")) == 4 and decontaminate.lcs([], [1]) == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = np.random.default_rng(6)
    letters = list("abzT19 '\n.!stre é÷×ßİΣ中²<|>")
    rows = [None, "", "word " * 9000, "x<|endoftext|>y ''s"] + ["".join(rnd.choice(letters, rnd.integers(1, 4000))) for _ in range(120)]
    ids = [[*e.ids, 1] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in rows], add_special_tokens=False)]
    got = packing.packed(docs(spark, list(enumerate(rows))), path).collect()
    fill, parts = Counter(), {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
        parts.setdefault(r["doc_id"], []).append(r)
    for i, own in enumerate(ids):
        at = 0
        for r in sorted(parts[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    assert max(fill.values()) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in fill.values())
    assert padding < 0.03 * sum(fill.values())
    assert packing.packed(docs(spark, [])).count() == 0


def test_licenses(spark):
    rows = [(1, "Hello. Released under the MIT License.\nMore"), (2, "Licensed under the Apache License, Version 2.0."), (3, None), (4, "no"), (5, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.\n" * 3), (6, ", ".join(["x"] * 20_000))]
    got = {r["doc_id"]: (r["license"], r["licenses"], r["n_known"]) for r in licenses.license_table(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", "MIT", 1), 2: ("Apache-2.0", "Apache-2.0", 1), 3: (None, "", 0), 4: (None, "", 0), 5: ("GPL", "GPL,CC-BY-NC", 6), 6: (None, "", 0)}
    assert all(any(c in s for c in licenses.CUES) or s.startswith(("you can", "you may", "this source", "the mit")) for s in licenses.SENTENCES.values())


MIT_TEXT = """MIT License

Copyright (c) 2021 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE_TEXT = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
BSD_TEXT = """Copyright (c) 2021, A. Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_TEXT = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""
MPL_TEXT = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""


def test_licenses_in_original_texts(spark):
    lesser = GPL_TEXT.replace("GNU General", "GNU Lesser General").replace("program", "library")
    rows = [MIT_TEXT, APACHE_TEXT, BSD_TEXT, BSD_TEXT + BSD_NAMES, GPL_TEXT, MPL_TEXT, lesser, "This project is released under the MIT License.", "This project is not released under the MIT License.", MIT_TEXT.replace("\n", "\r\n")]
    got = {r["doc_id"]: (r["license"], r["sentence_ids"]) for r in licenses.license_table(docs(spark, list(enumerate(rows)))).collect()}
    assert [got[i][0] for i in range(len(rows))] == ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL", "MPL-2.0", "LGPL", "MIT", None, "MIT"]
    assert got[0][1] == got[9][1] == "mit_name,mit_grant,mit_keep" and got[1][1] == "apache_notice,apache_terms,apache_copy"


def test_licenses_equal_their_sql(spark):
    """Wrapped, flattened and mixed texts, nulls and repeats: the SQL for DuckDB gives the same rows."""
    import duckdb
    import pandas as pd

    flat = [re.sub(r"[ \n*#/]+", " ", t).strip() for t in (MIT_TEXT, APACHE_TEXT, BSD_TEXT, BSD_TEXT + BSD_NAMES, GPL_TEXT, MPL_TEXT, GPL_TEXT.replace("GNU General", "GNU Lesser General"))]
    rows = [MIT_TEXT, APACHE_TEXT, BSD_TEXT + BSD_NAMES, GPL_TEXT, MPL_TEXT, *flat, *flat[:2], None, "", "Licensed under CC BY 4.0.\nmore\nMIT License\n", "license \u212a v. 2", "Licensed under: the MIT License! " * 3]
    table = [(i % 12, t) for i, t in enumerate(rows)]
    got = [tuple(r) for r in licenses.license_table(docs(spark, table)).collect()]
    documents = pd.DataFrame(table, columns=["doc_id", "text"])
    want = duckdb.connect().register("documents", documents).sql(licenses.oracle()).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    named = [r[1] for r in got[5:12]]
    assert named == ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL", "MPL-2.0", "LGPL"]
    assert licenses.license_table(docs(spark, [])).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = [int(c) for c in re.sub("[^0-9]", "", m)]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    return kind == "email" or 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0


def test_pii(spark):
    rnd = np.random.default_rng(8)
    letters = list("0123456789.+@ -()ab\né😀%_,")
    rows = [None, "", "1 " * 8000, "1" * 20_000 + "@", "4111 1111-1111 1111", "00255.1.1.1 1.2.3.4.5.6.7.8 256.1.1.1.2.3.4.5", "a@b.c_d@e.f.g@h.i x@y@z.w", "a.b" * 9000] + ["".join(rnd.choice(letters, rnd.integers(0, 250))) for _ in range(500)]
    rows += ['said token = "%s" and' % hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)] + ["plain words only here"] * 20
    d = docs(spark, list(enumerate(rows)))
    for r in pii.pii_table(d).collect():
        want = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, rows[r["doc_id"]] or "") if valid(k, m.group())]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in want) for k in BASE]
        assert r["spans"].startswith(joined)
    out = {r["doc_id"]: r["text"] for r in pii.redacted(d).collect()}
    assert out[0] is None and out[4] == "[CARD]" and out[1] == "" and len(out) == len(rows)
    assert not any(hashlib.sha1(str(i).encode()).hexdigest() in (t or "") for i in range(40) for t in out.values())


def test_url_filter(spark):
    urls = ["http://a.net/x", "https://A.Example.net/en/1", "http://www.example.com/de/2?q", "http://b.org/fr/1", "http://net", "x", None, "http://notnet/", "http://shop.casino-win.example.org/it/1", "http://ok.example.org/it/2"]
    more = [f"http://s{i}.casino-win.example.org/en/{i}" for i in range(20)] + [f"http://t{i}.example.org/en/{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls + more)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(u, "casino" in u) for u in more] + [(None, True), ("http://a.b/c", None)], "url string, bad boolean")
    got = {r["page_id"]: r for r in url_filter.judged(pages, labels).collect()}
    want = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow")]
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(10)] == want
    assert (got[1]["host"], got[1]["path"], got[4]["path"], got[5]["host"]) == ("a.example.net", "/en/1", "", "")
    assert url_filter.judged(pages.limit(0), labels.limit(0)).count() == 0


def url_tables(spark, pages):
    rows = [(i, u, "") for i, (u, _) in enumerate(pages)]
    marks = [(u, q == 0) for u, q in pages if q is not None]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(marks, "url string, bad boolean")


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(url_filter, "ROWS", 4)


def test_url_labels(spark):
    """A URL is labelled by the documents whose first line is its title, whole or cut; nulls and other labels teach nothing."""
    start = "Some words that open the document & go on for long"
    html = "<html><title>" + start.replace("&", "&amp;") + "</title>"
    line = "A first line of more than sixty characters, which titles show cut after sixty of them"
    pages = spark.createDataFrame([(1, "http://a.b/1", html), (2, "http://a.b/2", "<title> short </title>"), (3, None, html), (4, "http://a.b/4", None), (5, "http://a.b/5", f"<title>{line[:60]}</title>"), (6, "http://a.b/6", "<title>Some words</title>"), (7, "http://a.b/7", "<title></title>")], "page_id long, url string, html string")
    texts = spark.createDataFrame([(1, start), (2, start + "  \nz"), (3, start), (4, "short"), (5, None), (6, line + "\nand"), (7, start + " x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0), (5, 0, 0), (6, 1, 0), (6, None, 0), (None, 0, 0), (2, 7, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r["url"], r["bad"]) for r in url_filter.labelled_urls(pages, texts, labels).collect()} == {("http://a.b/1", True), ("http://a.b/2", True), ("http://a.b/5", False)}


def test_url_rule_of_six_tokens(spark, few_rows):
    """The only confident rule has six tokens: each URL with five of them is good."""
    six = list("uvwxyz")
    seen = [("http://q.q/" + "/".join(six), 0)] * 30 + [("http://q.q/" + "/".join(t for t in six if t != gone), 1) for gone in six for _ in range(20)]
    asked = [("http://q.q/k/" + "/".join(six), None), ("http://q.q/" + "/".join(six[:5]), None)]
    got = {r["page_id"]: r["mined"] for r in url_filter.judged(*url_tables(spark, seen + asked)).collect()}
    assert (got[len(seen)], got[len(seen) + 1]) == (True, False)


def test_url_rules_have_no_cap(spark, few_rows):
    """Thousands of redundant pairs of confidence 1.0 do not push out a rule of two tokens and one of three."""
    seen = [(f"http://casino.z/{' '.join(f'a{10 * i + k}' for k in range(6))}".replace(" ", "/"), 0) for i in range(150) for _ in range(4)]
    seen += [(f"http://casino.z/a{10 * i}/a{10 * i + 3}/c{i}/d{i}/e{i}/f{i}", 0) for i in range(150) for _ in range(4)]
    seen += [("http://m.q/red/blue", 0)] * 9 + [("http://m.q/red/blue", 1)] + [("http://m.q/red/x", 1)] * 9 + [("http://m.q/y/blue", 1)] * 9
    seen += [("http://m.q/k/l/m", 0)] * 9 + [("http://m.q/k/l/m", 1)] + [(f"http://m.q/{p}", 1) for p in ("k/l", "k/m", "l/m") for _ in range(9)]
    asked = [("http://new.q/red/blue", None), ("http://new.q/k/l/m", None), ("http://new.q/red/l", None), ("http://new.q/k/m", None)]
    got = {r["page_id"]: r["mined"] for r in url_filter.judged(*url_tables(spark, seen + asked)).collect()}
    assert [got[len(seen) + i] for i in range(4)] == [True, True, False, False] and len(got) == len(seen) + 4


def test_url_rules_of_long_paths(spark, few_rows):
    """Words after the sixth are learnt and block, alone and together; repeated long paths do not multiply the sets."""
    start = "a/b/c/d/e/f/g/h"
    seen = [(f"http://m.q/{start}/evil/{i}", 0) for i in range(20)] + [(f"http://m.q/{start}/fine/{i}", 1) for i in range(60)]
    seen += [(f"http://m.q/{start}/red/blue", 0)] * 9 + [(f"http://m.q/{start}/{x}", 1) for x in ("red/x", "y/blue") for _ in range(9)]
    slug = "/".join(f"s{i}" for i in range(60))
    seen += [(f"http://m.q/{slug}", 0)] * 10 + [(f"http://m.q/{slug}", 1)]
    asked = [f"http://n.q/{start}/evil/1", "http://n.q/1/2/3/4/5/6/7/evil", f"http://n.q/{start}/red/1/blue", f"http://n.q/{start}/red", "http://n.q/s59/x", f"http://n.q/{start}"]
    got = {r["page_id"]: r["mined"] for r in url_filter.judged(*url_tables(spark, seen + [(u, None) for u in asked])).collect()}
    assert [got[len(seen) + i] for i in range(6)] == [True, True, True, False, True, False]


def test_url_rules_against_brute_force(spark, few_rows):
    rnd = np.random.default_rng(17)
    rows = [(sorted(set(rnd.choice(list("abcdefgh"), rnd.integers(1, 7)).tolist())), int(rnd.random() < 0.4)) for _ in range(150)]
    rows = [(w, 0 if "a" in w and "b" in w and rnd.random() < 0.9 else 0 if "c" in w and "d" in w and "e" in w else q) for w, q in rows]
    rows = [([*w, "twin"] if "a" in w else w, q) for w, q in rows]
    sets = [({"h:q", *(f"p:{x}" for x in w)}, q) for w, q in rows]
    least, rules = max(url_filter.SUPPORT, url_filter.ROWS / len(sets)) * len(sets), []
    words = sorted(set().union(*(s for s, _ in sets)))
    for k in range(1, len(words) + 1):
        for own in itertools.combinations(words, k):
            marks = [q for s, q in sets if s >= set(own)]
            hits = marks.count(0)
            if hits >= least - 1e-6 and hits >= url_filter.CONFIDENCE * len(marks):
                rules.append(set(own))
    asked = [[*c] for k in (1, 2, 3, 4) for c in itertools.combinations([*"abcdefgh", "twin"], k)]
    urls = [("http://q/" + "/".join(w), q) for w, q in rows] + [("http://q/" + "/".join(w), None) for w in asked]
    got = {r["page_id"]: r["mined"] for r in url_filter.judged(*url_tables(spark, urls)).collect()}
    for i, own in enumerate([s for s, _ in sets] + [{"h:q", *(f"p:{x}" for x in w)} for w in asked]):
        assert got[i] == any(r <= own for r in rules), own
    assert rules and len(set(got.values())) == 2


def test_url_rules_pruned(spark):
    rnd = np.random.default_rng(16)
    sets = [s for n in range(1, 6) for s in itertools.combinations("abcdefg", n)]
    rules = [(list(s), float(rnd.choice([0.3, 0.8, 0.9, 1.0], p=[0.7, 0.1, 0.1, 0.1]))) for s in sets]
    want = {tuple(s) for s, c in rules if c >= 0.8 and not any(set(k) < set(s) and d >= c for k, d in rules)}
    got = [tuple(r["tokens"]) for r in url_filter.pruned(spark.createDataFrame(rules, "tokens array<string>, confidence double")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_quality(spark):
    rnd = np.random.default_rng(9)
    words = [f"word{i}" for i in range(300)]

    def good():
        return "\n".join(" ".join(rnd.choice(words, 12)).capitalize() + "." for _ in range(rnd.integers(1, 8)))

    def bad():
        w = str(rnd.choice(words))
        return "\n".join([" ".join([w] * 15), " ".join(x + "$$$" for x in rnd.choice(words, 9)), "A!! B!! C!!"])

    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, ""), (902, "word1 " * 20_000), (903, "\n" * 5000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in line_crf.quality_scores(docs(spark, rows), labels).collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [i for i in range(300) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.97
    none = line_crf.quality_scores(docs(spark, rows), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_marginals_match_enumeration():
    rnd = np.random.default_rng(1)
    logit, move = rnd.normal(size=5), rnd.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for y in itertools.product((0, 1), repeat=5):
        p = math.exp(sum(logit[i] * y[i] for i in range(5)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        good += p * np.array(y)
    assert np.allclose(line_crf.Chains(np.array([5])).marginals(logit, move), good / total)


def test_language_model(spark):
    rnd = np.random.default_rng(2)
    vocab = [[f"{side}{i}" for i in range(60)] for side in "ab"]
    rows = [(i, " ".join(rnd.choice(vocab[i % 2], rnd.integers(1, 60)))) for i in range(300)] + [(700, None), (701, ""), (702, "A0 " * 20_000), (703, "unseen words here")]
    cnt, toks = Counter(), {}
    for i, t in rows:
        toks[i] = [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), None]
        if zlib.crc32(str(i).encode()) % 10:
            cnt.update(toks[i])
    n, v = sum(cnt.values()), len(cnt)
    got = {r["doc_id"]: r for r in hmm.lm_scores(docs(spark, rows)).collect()}
    for i, w in toks.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in cnt for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((cnt[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6
        assert r["score"] < 0 and math.isfinite(r["score"])
    held = [i for i in range(300) if got[i]["held_out"]]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    assert hmm.lm_scores(docs(spark, [])).count() == 0


def test_forward_is_exact():
    rnd = np.random.default_rng(5)
    start, move, emit = rnd.dirichlet(np.ones(hmm.STATES)), rnd.dirichlet(np.ones(hmm.STATES), hmm.STATES), rnd.dirichlet(np.ones(hmm.ALL), hmm.STATES)
    model, seq = hmm.Model(start, move, emit), rnd.integers(0, hmm.ALL, 4)
    want = sum(start[s[0]] * emit[s[0], seq[0]] * math.prod(move[s[t - 1], s[t]] * emit[s[t], seq[t]] for t in range(1, 4)) for s in itertools.product(range(hmm.STATES), repeat=4))
    assert math.isclose(model.forward(seq.astype(np.int32), np.array([0]), np.array([4]))[0], math.log(want))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = np.random.default_rng(7)
    words = [f"word{i}" for i in range(900)]
    rows = [(i, "\n".join(" ".join(rnd.choice(words, 12)) + "." for _ in range(6))) for i in range(60)]
    item = " ".join(rnd.choice(words, 40))
    rows += [(100, rows[0][1]), (101, rows[1][1] + " end"), (102, rows[2][1] + "\n" + item), (103, rows[3][1] + " me@mail.example.com")]
    rows += [(200 + i, "\n".join([f"w{i} " * 15, "$$$ ### %%%", "A!! B!!"])) for i in range(20)]
    frames = {
        "documents": spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/s{k}")
        now = spark.read.parquet(f"{tmp_path}/s{k}")
        seen.append({r["doc_id"] for r in now.select("doc_id").distinct().collect()})
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen[0] == set(range(60)) | {100, 101, 102, 103}
    assert not {100, 101} & seen[1] and {0, 1} <= seen[1] and 102 not in seen[2] and seen[3] == seen[2] == seen[4]
    assert spark.read.parquet(f"{tmp_path}/s3").where("text like '%@%'").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == now.agg(F.sum("length")).first()[0]
