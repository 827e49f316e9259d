"""The store written by differences against one that is rewritten at every sync."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import temporal
from graphloom.sources import store as module
from graphloom.sources.store import FILE_ATTRS, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def graph(spark, files, symbols=()):
    kinds = {f.name: f.dataType.simpleString() for f in schema.FILES}
    rows = spark.createDataFrame(sorted(files.items()), "path string, loc int").select("path", *[F.col("loc").cast(kinds[a]).alias(a) if a == "loc" else F.lit(None).cast(kinds[a]).alias(a) for a in FILE_ATTRS])
    edges = spark.createDataFrame([], "source_file_id long, target_file_id long, kind string, weight double")
    own = "file_id long, name string, kind string, line int, exported boolean, signature string, doc string, methods array<string>"
    return {"files": rows, "edges": edges, "symbols": spark.createDataFrame([(1, n, "function", line, True, None, None, []) for n, line in symbols], own)}


def facts(df):
    return {r["path"]: (r["loc"], r["active"], r["first_seen_commit"], r["last_seen_commit"]) for r in df.collect()}


def test_any_version_equals_the_full_rewrite(spark, store, monkeypatch):
    monkeypatch.setattr(module, "MOST_SEGMENTS", 3)  # so that differences are folded into new bases on the way
    rnd = random.Random(4)
    files, want, last = {f"f{i}": i for i in range(12)}, {}, None
    for turn in range(6):
        commit = f"c{turn}"
        for _ in range(2):
            p = f"f{rnd.randrange(15)}"
            files = {k: v for k, v in files.items() if k != p} if p in files and rnd.random() < 0.6 else files | {p: rnd.randrange(100)}
        version = store.sync(graph(spark, files), commit)
        old = last if last is not None else spark.createDataFrame([], schema.FILES).drop("id")
        full = temporal.upsert(old, graph(spark, files)["files"], ["path"], FILE_ATTRS, commit, F.current_timestamp())
        want[version] = facts(full)
        last = spark.createDataFrame(full.collect(), full.schema)
    assert {v: facts(store.read("files", v)) for v in want} == want
    assert {len(store.manifest(v)["tables"]["files"]) for v in want} > {1}
    store.vacuum()
    assert store.versions() == [max(want)] and facts(store.read("files")) == want[max(want)]


def test_one_change_writes_one_row(spark, store):
    files = {f"d/f{i}.py": 1 for i in range(10_000)}
    store.sync(graph(spark, files, [("a", 1), ("b", 2)]), "c1")
    v = store.sync(graph(spark, files | {"d/f77.py": 2}, [("a", 1), ("b", 3)]), "c2")
    tables = store.manifest(v)["tables"]
    assert [s["rows"] for s in tables["files"]] == [10_000, 1] and [s["rows"] for s in tables["symbols"]] == [2] and tables["edges"] == []
    seen = store.read("files").agg(F.count_if("active").alias("n"), F.min("last_seen_commit").alias("c")).first()
    assert (seen["n"], seen["c"]) == (10_000, "c2")  # what stays was seen by the last sync too
    assert {r["name"]: r["line"] for r in store.read("symbols").collect()} == {"a": 1, "b": 3}
    store.sync(graph(spark, files, [("a", 1)]), "c3")
    assert {r["name"]: (r["active"], r["last_seen_commit"]) for r in store.read("symbols").collect()} == {"a": (True, "c3"), "b": (False, "c2")}


def test_nothing_new_is_no_version(spark, store):
    rows = spark.createDataFrame([("k", "v")], schema.META)
    assert store.read("meta").count() == 0 and store.write({"meta": rows}) == 1 and store.write({"meta": rows}) == 1
