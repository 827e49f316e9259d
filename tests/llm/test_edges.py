"""Nulls, repeats, ties, empty tables and clashing column names in every operator and pipeline stage."""

import numpy as np
import pytest

from graphloom.llm import cover_topk, decontaminate, hmm, line_crf, ngram_join, packing, pii, stages, token_counts, url_filter

RND = np.random.default_rng(31)
WORDS = [f"w{i}" for i in range(500)]
TEXT = " ".join(RND.choice(WORDS, 80))
NEAR, OTHER = TEXT + " end", " ".join(RND.choice(WORDS, 70))
#: columns that operators use for themselves
SCHEMA = "doc_id long, text string, body string, base string, spans string, th long, n long, kept boolean, row string, its_id long, gone_id long, s_email string, n_chars long, quality string, h long, lines long, held string"
ROWS = [(5, TEXT), (9, NEAR), (None, TEXT + " fin"), (9, OTHER), (9, OTHER), (None, None), (7, None), (8, ""), (8, "")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "call me@x.org", "b", "s", 1, 2, False, "r", 3, 4, "e", 6, "q", 7, 8, "h") for i, t in rows], SCHEMA)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def test_components_of_rows(spark):
    got = ngram_join.component_table(table(spark, ROWS), 3, 9, 10).collect()
    want = [(5, 5), (9, 5), (None, 5), (9, 9), (9, 9), (None, None), (7, 7), (8, 8), (8, 8)]
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    assert ngram_join.component_table(table(spark, [])).count() == 0


def test_near_copies_keep_other_rows(spark):
    """Of each group the first row stays, of equal rows one; another text of an id that goes stays; empty texts stay."""
    out = stages.near_copies(spark, table(spark, ROWS), "")
    assert out.columns == table(spark, []).columns
    assert pairs(out) == sorted([(5, TEXT), (9, OTHER), (None, None), (7, None), (8, ""), (8, "")], key=repr)
    alone = [(1, TEXT), (2, NEAR), (2, OTHER), (None, NEAR + " x"), (None, NEAR + " x")]
    assert pairs(stages.near_copies(spark, table(spark, alone), "")) == sorted([(1, TEXT), (2, OTHER)], key=repr)
    assert stages.near_copies(spark, table(spark, []), "").count() == 0


def test_redaction_keeps_columns(spark):
    rows = [(1, "call me@x.org now"), (None, None), (2, ""), (2, "plain"), (2, "plain")]
    out = stages.redact(spark, table(spark, rows), "").collect()
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out), key=repr) == sorted([(1, "call [EMAIL] now", 16), (None, None, 6), (2, "", 6), (2, "plain", 6), (2, "plain", 6)], key=repr)
    assert {(r["body"], r["base"], r["spans"], r["row"], r["s_email"]) for r in out} == {("call me@x.org", "b", "s", "r", "e")}
    assert pii.pii_table(table(spark, [])).count() == 0 and pii.redacted(table(spark, [])).count() == 0


def test_secrets_are_found(spark):
    """Planted secrets of three forms; at least nine of ten are found, and clean texts stay as they are."""
    hexes = ["".join(RND.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    planted = [f"here token = \"{x}\" is" for x in hexes[:20]] + [f"so password={x[:18]} and" for x in hexes[20:40]] + ["key AKIA" + "".join(RND.choice(list("ABCDEFGHJKLMNPQRSTUV23456789"), 16)) + " of" for _ in range(20)]
    clean = [" ".join(RND.choice(WORDS, 30)) + f" part-number-{i}-of-the-long-list" for i in range(200)]
    rows = list(enumerate(planted + clean))
    got = {r["doc_id"]: r["n_spans"] for r in pii.pii_table(table(spark, rows)).collect()}
    again = {r["doc_id"]: r["n_spans"] for r in pii.pii_table(table(spark, rows).repartition(3)).collect()}
    assert got == again  # which candidates teach does not depend on the partitions
    assert sum(got[i] > 0 for i in range(60)) >= 54 and not any(got[i] for i in range(60, len(rows)))


def test_counts_and_packing_of_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(table(spark, rows)).collect()), key=repr) == [(1, 2), (1, 2), (None, 0), (None, 2)]
    assert token_counts.token_counts(table(spark, [])).count() == 0
    pieces = packing.packed(table(spark, rows)).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in pieces} == {(1, 3), (None, 1), (None, 3)} and sum(r["length"] for r in pieces) == 10


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 5.0]), (1, [2.0, 2.0]), (1, [2.0, 2.0]), (3, [1.0, 9.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], "vec_id long, embedding array<double>, dim int, leaf int, block int, x int")
    got = [(r["query_id"], r["vec_id"]) for r in cover_topk.top_k(vectors, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 3), (0, 1), (0, 1)]  # asked with the smallest vector, [0, 5]; its own rows are left out


def test_decontamination_of_rows(spark):
    item = " ".join(RND.choice(WORDS, 40))
    benchmark = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, item, "x"), (None, "other words of an item that no text has at all", "x")], "item_id long, text string, lcs_share string")
    docs = table(spark, [(1, OTHER + " " + item), (1, OTHER + " " + item), (None, item), (3, OTHER), (4, None)])
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_pairs(docs, benchmark).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (1, 2)] * 2 + [(None, 1), (None, 2)], key=repr)
    assert pairs(decontaminate.keep_clean(docs, benchmark)) == sorted([(3, OTHER), (4, None)], key=repr)
    assert decontaminate.leaked_pairs(table(spark, []), benchmark).count() == 0


@pytest.mark.parametrize("replaced", [0.1, 0.2, 0.3])
def test_recall_of_altered_passages(spark, replaced):
    rnd = np.random.default_rng(41)
    share = 1 / np.arange(1, 3001)
    share /= share.sum()
    draw = lambda n: [f"v{x}" for x in rnd.choice(3000, n, p=share)]
    items = [(i, " ".join(draw(40))) for i in range(60)]
    rows = []
    for i, t in items:
        own = [x if rnd.random() >= replaced else str(rnd.choice(draw(1))) for x in t.split()]
        rows += [(i, " ".join(draw(100) + own + draw(100))), (1000 + i, " ".join(draw(240)))]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_pairs(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len({(i, i) for i, _ in items} & got) >= 54 and not {d for d, _ in got if d >= 1000}


def test_urls_of_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "t", "h"), (1, "http://a.net/x", "t", "h"), (None, None, "t", "h")], "page_id long, url string, tokens string, host string")
    none = spark.createDataFrame([], "url string, bad boolean")
    assert sorted(((r["page_id"], r["host"], r["verdict"]) for r in url_filter.judged(pages, none).collect()), key=repr) == [(1, "a.net", "block"), (1, "a.net", "block"), (None, "", "allow")]


def test_quality_of_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, "Good words here. And more of them." if i % 2 else "## $$ ##") for i in range(40)] + [(None, None), (1, "## $$ ##"), (1, "## $$ ##")]
    got = line_crf.quality_scores(table(spark, rows), labels).collect()
    assert len(got) == 43 and all(0 <= r["score"] <= 1 for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    kept = pairs(line_crf.keep_good(table(spark, rows), labels))
    assert len(kept) < 43 and (3, "Good words here. And more of them.") in kept
    assert line_crf.quality_scores(table(spark, []), labels).count() == 0 and line_crf.keep_good(table(spark, []), labels).count() == 0


def test_language_model_of_rows(spark):
    rows = [(1, "a b a"), (1, "a b a"), (None, "a c"), (None, None)]
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in hmm.lm_scores(table(spark, rows)).collect()), key=repr)
    assert got == [(1, False, 4, 4, 8), (1, False, 4, 4, 8), (None, True, 1, 1, 8), (None, True, 3, 2, 8)]


def test_segments_carry_messages(monkeypatch):
    """Expected counts and likelihoods of sequences cut in segments equal those of whole sequences."""
    start, move, emit = RND.dirichlet(np.ones(hmm.STATES)), RND.dirichlet(np.ones(hmm.STATES), hmm.STATES), RND.dirichlet(np.ones(hmm.ALL), hmm.STATES)
    model, sizes = hmm.Model(start, move, emit), np.array([5, 1, 23, 8, 40, 3])
    flat, at = RND.integers(0, hmm.ALL, sizes.sum()).astype(np.int32), np.cumsum(sizes) - sizes
    whole, cut, like = hmm.blank(), hmm.blank(), model.forward(flat, at, sizes)
    model.expect(flat, sizes, whole)
    monkeypatch.setattr(hmm, "SEGMENT", 4)
    monkeypatch.setattr(hmm, "LONG", 6)
    model.expect(flat, sizes, cut)
    assert np.allclose(model.forward(flat, at, sizes), like) and np.isclose(whole["like"][0], like.sum())
    assert all(np.allclose(whole[k], cut[k]) for k in whole) and np.isclose(whole["move"].sum(), (sizes - 1).sum())


def test_merge_transducer():
    """Counts of every prefix equal a plain run of the merges."""
    merges = [["a", "b"], ["ab", "c"], ["b", "c"], ["a", "a"], ["aa", "aa"], ["c", "ab"], ["abc", "a"]]
    machine = token_counts.Merges({"merges": merges})

    def plain(word):
        parts = list(word)
        while True:
            ranks = [(merges.index([x, y]), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if [x, y] in merges]
            if not ranks:
                return len(parts)
            best = min(ranks)[0]
            i = min(i for r, i in ranks if r == best)
            parts[i : i + 2] = ["".join(merges[best])]

    for _ in range(400):
        word = "".join(RND.choice(list("abc"), RND.integers(1, 14)))
        raw = np.frombuffer(word.encode(), np.uint8)
        assert machine.counts(raw, np.array([0])).sum() == plain(word), word
