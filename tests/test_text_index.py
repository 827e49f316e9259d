"""The stored index after any sequence of syncs and updates against a scan of the documents."""

import random

import pytest

from graphloom.operators import search
from graphloom.sources.text_index import TextIndex

WORDS = ["store", "stock", "token", "tokens", "to", "verify", "user", "users", "cache"]


@pytest.fixture
def index(spark, tmp_path):
    return TextIndex(spark, f"file://{tmp_path}/words", buckets=4)


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "id long, text string")


def same(spark, index, docs, prefixes):
    want = {r["id"]: round(r["score"], 9) for r in search.bm25(frame(spark, docs), prefixes).collect()}
    return {r["id"]: round(r["score"], 9) for r in index.bm25(prefixes).collect()} == want


def test_edits(spark, index):
    rnd = random.Random(8)
    text = lambda: " ".join(rnd.choices(WORDS, k=rnd.randrange(0, 12)))
    docs = {i: text() for i in range(40)}
    index.sync(frame(spark, docs))
    assert same(spark, index, docs, ["sto", "token"])
    docs |= {3: text(), 50: text(), 51: ""}
    m = index.update(frame(spark, {i: docs[i] for i in (3, 50, 51)}))
    assert m["n"] == len(docs) and len(m["segments"]) == 2 and m["segments"][1]["postings"] < m["segments"][0]["postings"]
    assert same(spark, index, docs, ["sto", "token"]) and same(spark, index, docs, ["user"])
    del docs[3], docs[7]
    index.update(frame(spark, {}), spark.createDataFrame([(3,), (7,), (999,)], "id long"))
    assert same(spark, index, docs, ["sto", "t"])
    docs = {i: (text() if i % 2 else t) for i, t in docs.items() if i != 9} | {70: text()}
    m = index.sync(frame(spark, docs))
    assert m["n"] == len(docs) and same(spark, index, docs, ["sto", "token"])
    before = index.manifest()
    assert index.sync(frame(spark, docs)) == before  # nothing changed: nothing is written
    index.vacuum()
    assert same(spark, index, docs, ["cache", "ver"])


def test_reads_its_buckets_only(spark, index):
    index.sync(frame(spark, {i: " ".join(WORDS) for i in range(5)}))
    plan = index.postings(["tok"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "StringStartsWith(term,tok)" in plan


def test_empty(spark, index):
    assert index.fts("token", 5).count() == 0
    index.sync(frame(spark, {}))
    index.sync(frame(spark, {1: "verification of users"}))
    assert [r["id"] for r in index.fts("verificate", 5).collect()] == [1]  # shortened in a second pass
    index.sync(frame(spark, {}))
    assert index.manifest()["n"] == 0 and index.fts("users", 5).count() == 0


def test_a_text_is_split_once(spark, tmp_path):
    """a first sync splits each text once, and deals rows of lists, not occurrences."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def split(text):
        def words(t):
            seen.add(1)
            return t.split()

        return F.udf(words, "array<string>").asNondeterministic()(text)

    docs = {i: "store stock store" for i in range(30)}
    index = TextIndex(spark, f"file://{tmp_path}/words", buckets=4, split=split)
    m = index.sync(frame(spark, docs))
    assert seen.value == 30 and m["segments"][0]["postings"] == 60 and m["total"] == 90
    assert same(spark, index, docs, ["sto"])
    assert [r["tf"] for r in index.postings(["store"]).collect()] == [2] * 30
