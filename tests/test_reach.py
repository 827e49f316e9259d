"""Reachability by bitmaps against breadth-first search in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, reach
from graphloom.operators.numbering import numbered


def brute(pairs):
    into = {}
    for a, b in pairs:
        into.setdefault(b, set()).add(a)
    hops = {}
    for o in into:
        front, seen, hop = {o}, {o}, 0
        while front:
            hop += 1
            front = {a for n in front for a in into.get(n, ())} - seen
            seen |= front
            hops |= {(o, n): hop for n in front}
    return into, hops


def counts(pairs):
    into, hops = brute(pairs)
    out = {}
    for o, near in into.items():
        n = sum(1 for a, _ in hops if a == o)
        others = len(near - {o})
        out[o] = (len(near), n - others)
    return out


def edges(spark, pairs, kind="string"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def shapes():
    rnd = random.Random(11)
    yield [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(130)]  # cycles, self-loops, repeats
    yield [(f"a{i:03}", f"a{i + 1:03}") for i in range(12)] + [("a003", "a009"), ("x", "y"), ("y", "x"), ("a005", "x")]
    yield [("hub", f"l{i}") for i in range(70)] + [(f"r{i}", "hub") for i in range(70)] + [("l0", "r0")]
    yield [("s", "s")]


@pytest.mark.parametrize("at", range(4))
def test_blast_counts(spark, at):
    pairs = list(shapes())[at]
    got = {r["origin"]: (r["direct"], r["transitive"]) for r in reach.blast_counts(edges(spark, pairs)).collect()}
    assert got == counts(pairs)


def test_blocks_of_bitmaps(spark, monkeypatch):
    """A block of one long: sets of more than 64 nodes travel in several blocks."""
    monkeypatch.setattr(reach, "BLOCK", 1)
    rnd = random.Random(12)
    pairs = [(a, b) for a, b in ((rnd.randrange(150), rnd.randrange(150)) for _ in range(170)) if a < b]
    df = edges(spark, pairs, "long")
    assert {r["origin"]: (r["direct"], r["transitive"]) for r in reach.blast_counts(df).collect()} == counts(pairs)
    assert {(r["origin"], r["node"]): r["hop"] for r in graph.closure(df).collect()} == brute(pairs)[1]


def test_components_of_cycles(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "f"), ("e", "g"), ("x", "y"), ("y", "z"), ("z", "x")]
    got = {r["node"]: r["comp"] for r in reach.cyclic_components(edges(spark, pairs)).collect()}
    assert got == {"a": "b", "b": "b", "c": "e", "d": "e", "e": "e", "x": "z", "y": "z", "z": "z"}


def test_paths_to_some_origins(spark):
    rnd = random.Random(13)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(90)]
    _, hops = brute(pairs)
    origins = [3, 8, 21, 99]
    got = {(r["origin"], r["node"]): r["path"] for r in graph.shortest_paths(edges(spark, pairs, "long"), spark.createDataFrame([(o,) for o in origins], "origin long")).collect()}
    known = hops | {(o, o): 0 for o in origins}

    def smallest(o, n):
        return [n] if n == o else [n, *smallest(o, min(b for a, b in pairs if a == n and known.get((o, b)) == known[o, n] - 1))]

    assert got == {(o, n): smallest(o, n) for o, n in hops if o in origins}


def test_empty(spark):
    e = edges(spark, [])
    assert reach.blast_counts(e).count() == 0 and reach.cyclic_components(e).count() == 0
    assert reach.reach_many(e, e.select(F.col("src").alias("origin"))).rows().count() == 0


def test_listed_cuts_hubs(spark):
    pairs = [("h", f"v{i:02}") for i in range(25)] + [("a", "v01"), ("a", "v01")]
    got = {(r["id"], r["part"]): (r["total"], r["values"]) for r in graph.listed(edges(spark, pairs), "src", "dst", 10).collect()}
    hub = [f"v{i:02}" for i in range(25)]
    assert got == {("h", 0): (25, hub[:10]), ("h", 1): (25, hub[10:20]), ("h", 2): (25, hub[20:]), ("a", 0): (2, ["v01", "v01"])}


def test_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in ["c", None, "a", "b"]], "v string")
    got = {r["v"]: r["n"] for r in numbered(rows, [F.col("v").asc_nulls_last()], "n").collect()}
    assert got == {"a": 0, "b": 1, "c": 2, None: 3}


def test_edges_are_worked_out_once(spark):
    """A search without a depth read its edges' sources anew in each round."""
    reads = spark.sparkContext.accumulator(0)
    pairs = [(i + 1, i) for i in range(8)]

    def counted(p):
        reads.add(1)
        return p

    lazy = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 2).map(counted), "src long, dst long")
    start = spark.createDataFrame([(0,)], "origin long")
    assert {r["node"]: r["hop"] for r in graph.reach(lazy, start, None).collect()} == {i: i for i in range(9)}
    assert reads.value == len(pairs)


def test_consecutive_lines(spark, tmp_path):
    """Parts on consecutive lines: over the ends of runs of line numbers, repeated lines, gaps and nulls."""
    from graphloom.plans.views import RUN, dep_edges

    rnd = random.Random(14)
    rows = [(o, n, rnd.choice([1, 2, 3, 4, None])) for o in range(3) for n in [0, 1, 1, 3, RUN - 1, RUN, RUN, RUN + 1, 2 * RUN - 1, 2 * RUN, -1, -RUN, None]]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want: dict = {}
    for o, n, a in rows:
        for o2, n2, b in rows:
            if o == o2 and None not in (n, n2, a, b) and n2 == n + 1 and a != b:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r["src"], r["dst"]): r["weight"] for r in dep_edges(spark, str(tmp_path)).collect()} == want


def test_searches_keep_new_bits_only(spark, monkeypatch):
    """All rounds' tables, with the bits had so far, stayed on disk; now each round's new bits do."""
    import os

    kept, store = [], reach.stored

    def noted(df):
        kept.append(store(df))
        return kept[-1]

    monkeypatch.setattr(reach, "stored", noted)
    pairs = [(i + 1, i) for i in range(6)]
    found = reach.reach_many(edges(spark, pairs, "long"), spark.createDataFrame([(0,), (3,)], "origin long"))
    assert {(r["origin"], r["node"]): r["hop"] for r in found.rows().collect()} == {(o, n): n - o for o in (0, 3) for n in range(o + 1, 7)}
    left = [k for k in kept if os.path.isdir(k.scratch_path.removeprefix("file:"))]
    assert len(left) == 1 + len(found.levels) == 7 and all("seen" not in k.columns for k in left)


def test_bits_are_expanded_by_many_tasks(spark):
    """A few bytes of bitmaps, which one task took, hold many rows."""
    pairs = [(a, b) for a in range(40) for b in range(40) if a != b]
    rows = graph.closure(edges(spark, pairs, "long"))
    assert rows.count() == 40 * 39 and rows.select(F.spark_partition_id()).distinct().count() > 1


def test_blast_counts_work_edges_out_once(spark):
    reads = spark.sparkContext.accumulator(0)
    pairs = [(1, 0), (2, 1), (0, 2), (3, 0)]

    def counted(p):
        reads.add(1)
        return p

    lazy = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 2).map(counted), "src long, dst long")
    assert {r["origin"]: (r["direct"], r["transitive"]) for r in reach.blast_counts(lazy).collect()} == counts(pairs)
    assert reads.value == len(pairs)


def islands_of(pairs, kind):
    """Several islands, among them one of a single edge, and self-loops and repeats."""
    name = (lambda i, n: f"é{i}-{n:03}") if kind == "string" else (lambda i, n: 1000 * i + n)
    return [(name(i, a), name(i, b)) for i in range(5) for a, b in (pairs[: 1 + 20 * i])] + [(name(9, 1), name(9, 2))] * 2


@pytest.mark.parametrize("kind, most, lump", [("long", 2_000_000, 4_000_000), ("long", 30, 7), ("string", 30, 4_000_000)])
def test_islands(spark, monkeypatch, kind, most, lump):
    """Pairs and paths of islands that a task holds and of larger ones, told apart from lumps that show parts of them."""
    from graphloom.operators import islands

    monkeypatch.setattr(islands, "MOST", most)
    monkeypatch.setattr(islands, "LUMP", lump)
    monkeypatch.setattr(islands, "CELLS", 500)
    rnd = random.Random(15)
    pairs = islands_of([(rnd.randrange(25), rnd.randrange(25)) for _ in range(90)], kind)
    _, hops = brute(pairs)
    df = edges(spark, pairs, kind)
    want = sorted((o, n, h) for (o, n), h in hops.items()) + [(a, a, 1) for a in sorted({a for a, b in pairs if a == b})]
    assert sorted((r["origin"], r["node"], r["hop"]) for r in graph.closure(df).collect()) == sorted(want)

    def smallest(o, n):
        return [n] if n == o else [n, *smallest(o, min(b for a, b in pairs if a == n and (0 if b == o else hops.get((o, b))) == hops[o, n] - 1))]

    origins = sorted({b for _, b in pairs})[::3]
    got = graph.shortest_paths(df, spark.createDataFrame([(o,) for o in origins], f"origin {kind}")).collect()
    assert sorted((r["origin"], r["node"], r["hop"], r["path"]) for r in got) == sorted((o, n, h, smallest(o, n)) for (o, n), h in hops.items() if o in origins)


@pytest.mark.parametrize("search", [graph.closure, graph.shortest_paths])
def test_islands_are_searched_without_a_round_of_joins(spark, monkeypatch, search):
    """Each round's bits were sent over every edge, and paths were stored for each hop: the disk of both grew with
    origins x edges, not with the edges."""

    def unwanted(*_):
        raise AssertionError("searched by joins")

    monkeypatch.setattr(graph, "reach_many", unwanted)
    monkeypatch.setattr(graph, "shortest_paths_to", unwanted)
    pairs = [(100 * i + n + 1, 100 * i + n) for i in range(3) for n in range(10)]
    assert {(r["origin"], r["node"]): r["hop"] for r in search(edges(spark, pairs, "long")).collect()} == brute(pairs)[1]
