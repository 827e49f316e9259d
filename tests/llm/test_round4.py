"""Mixing, fill-in-middle and exponion clustering against brute force; their SQL is compared in test_sql_of_new_queries."""

import hashlib
import os
import random

import numpy as np
import pytest

from graphloom.llm import exponion, fim, mixing, queries

SF = "/root/testdata/sf0.001"
EXTRA = "size long, target double, row string, n long, output string, cluster int, vec string"


def extra(spark, rows, schema):
    """rows with further columns that the operators use for themselves."""
    return spark.createDataFrame([(*r, 1, 2.0, "r", 3, "o", 4, "v") for r in rows], f"{schema}, {EXTRA}")


# Mixing


def shared(sizes, weights, most):
    """Targets by sharing again and again, as stated."""
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        new = {s for s in open_ if share[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] for s in full} | share
        full |= new


def test_mixing(spark):
    rnd = random.Random(1)
    sizes = {"z": 40, "a": 3, None: 25, "é": 200, "B": 1}
    rows = [(i, " ".join("w" for _ in range(rnd.randrange(1, 30))), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(900, None, "a"), (901, "", "empty"), (None, "x y", "z"), (5, "x y", "z"), (5, "x y", "z")]
    got = mixing.mix_table(extra(spark, rows, "doc_id long, text string, source string")).collect()
    again = mixing.mix_table(extra(spark, rows, "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    per = {}
    for _, t, s in rows:
        per[s] = per.get(s, 0) + len((t or "").split())
    order = sorted(per, key=lambda s: (s is None, s or ""))
    want = shared(per, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    by = {}
    for (i, t, s) in rows:
        by.setdefault((i, len((t or "").split())), set()).add((per[s], round(want[s], 6)))
    assert all((r["source_size"], round(r["target"], 6)) in by[r["doc_id"], r["size"]] and r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3 for r in got)
    big = [r for r in got if r["source_size"] == per["é"]]
    assert abs(sum(r["taken"] for r in big) / want["é"] - 1) < 0.25
    assert mixing.mix_table(extra(spark, [], "doc_id long, text string, source string")).count() == 0


def test_mixed_repeats_documents(spark):
    """The text comes out as often as planned, with its columns; given weights hold, a source without one gives nothing."""
    df = extra(spark, [(i, "a b", "x" if i < 30 else "y" if i < 90 else "z") for i in range(120)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 3), ("y", 1)], "source string, weight long")
    plan = {r["row"]["doc_id"]: r["copies"] for r in mixing.planned(df, weights).collect()}
    out = mixing.mixed(df, weights=weights)
    assert out.columns == df.columns
    seen = [r["doc_id"] for r in out.collect()]
    assert all(seen.count(i) == n for i, n in plan.items()) and {plan[i] for i in range(30)} == {3} and not any(plan[i] for i in range(90, 120))


def test_mixing_beyond_broadcasts(spark, monkeypatch):
    df = extra(spark, [(i, "a b c", f"s{i % 7}" if i % 3 else "hot") for i in range(200)], "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix_table(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixing, "HOT", 5)  # hot sources are joined apart
    assert sorted(map(str, mixing.mix_table(df).collect())) == want


# Fill-in-middle


def units(text, unit):
    """Where each unit begins, by looking at every character."""
    blank = " \t\n\v\f\r"
    if unit == "char":
        return list(range(len(text)))
    if unit == "word":
        return [i for i in range(len(text)) if i == 0 or text[i] not in blank and text[i - 1] in blank]
    return [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle(spark, unit, monkeypatch):
    rnd = random.Random(2)
    texts = ["", None, "x", "é", "a<P>b", "<S>", "<M", "\n\n", " lead", "𝄞" * 700, "w " * 900] + ["".join(rnd.choices(["a", "é", "中", "𝄞", " ", "\n", "word", "<"], k=rnd.randrange(1, 900))) for _ in range(60)]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    got = fim.fill_in_middle(extra(spark, rows, "doc_id long, text string").coalesce(1), unit).collect()
    for (i, t), r in zip(rows, got, strict=True):
        t = t or ""
        at = [*units(t, unit), len(t)]
        n = len(at) - 1
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
        lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        p, m, s = t[: at[lo]], t[at[lo] : at[hi]], t[at[hi] :]
        want = t if form == "plain" else f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
        cut = (None, None) if form == "plain" else (lo, hi - lo)
        assert (r["doc_id"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) == (i, n, form, *cut, want)


def test_chunks_in_slabs(monkeypatch):
    monkeypatch.setattr(fim, "SLAB", 2)
    texts = [("é" * n + "x y\nz" * n).encode() for n in (0, 1, 150, 7, 400)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    edge = np.cumsum([0, *map(len, texts)])
    for unit in ("char", "word", "line"):
        c = fim.Chunks(raw, edge, unit)
        assert c.units().tolist() == [len(units(t.decode(), unit)) for t in texts]


def test_outputs_are_restored(spark):
    df = spark.createDataFrame([(i, f"some <text {i} <S is here" * (i % 4)) for i in range(40)] + [(99, None)], "doc_id long, text string")
    got = fim.fim_table(df).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    assert all(r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)
    assert len({r["form"] for r in got}) == 3 and fim.fim_table(df.limit(0)).count() == 0


# Clustering


def lloyd(vecs, start, rounds):
    c = [list(map(int, v)) for v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for v in vecs]
        for k in range(len(c)):
            mine = [v for v, o in zip(vecs, own, strict=True) if o == k]
            if mine:
                c[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [near(v) for v in vecs], c


def clusters(spark, rows, **options):
    return exponion.cluster_table(spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, vec string, cluster int"), **options)


def test_exponion_equals_lloyd(spark):
    rnd = np.random.default_rng(3)
    vecs = rnd.integers(-3, 4, (300, 3)).astype(float)  # a coarse grid: ties abound, and so do equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    ints = [[int(x) for x in v] for v in vecs]
    order = sorted(range(300), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:9]
    want, c = lloyd(ints, [ints[i] for i in order], 4)
    got = {r["vec_id"]: r for r in clusters(spark, rows, k=9, rounds=4, scale=1, dim=3).collect()}
    assert {i: (r["distance"], r["cluster"]) for i, r in got.items()} == dict(enumerate(want))
    assert {r["inertia"] for r in got.values()} == {sum(d for d, _ in want)}
    assert all(r["cluster_inertia"] == sum(d for d, k in want if k == r["cluster"]) and r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest() for r in got.values())


def test_bounds_prune(spark):
    rnd = np.random.default_rng(4)
    centre = rnd.normal(size=(30, 8)) * 10
    rows = [(i, (centre[i % 30] + rnd.normal(size=8) * 0.2).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    _, _, work = exponion.clustered(df, k=30, rounds=4, dim=8)
    assert work[0] == 3000 * 30 and sum(work[1:]) < 0.5 * len(work[1:]) * 3000 * 30


def test_vectors_that_take_no_part(spark):
    ok = [0.5] * 4
    rows = [(1, ok), (1, ok), (None, [1.0] * 4), (2, None), (3, [1.0, None, 1.0, 1.0]), (4, [1.0, float("nan"), 1.0, 1.0]), (5, [float("inf")] * 4), (6, [1.0] * 3), (7, []), (8, [3e38, -3e38, 0.0, 0.0])]
    got = clusters(spark, rows, k=40, dim=4).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == [(False, 1), (False, 1), (False, 8), (True, 0)]
    assert {r["inertia"] for r in got} == {0} and len({r["cluster"] for r in got if r["vec_id"] == 1}) == 1  # ties: the smaller number
    assert clusters(spark, [], k=3, dim=4).count() == 0 and clusters(spark, [(1, None)], k=3, dim=4).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op11_mixing", "op12_fill_in_middle", "op13_exponion"])
def test_sql_of_new_queries(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted(str([r[x] for x in cols]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())
