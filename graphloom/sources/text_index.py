"""A stored inverted index: immutable segments of postings, bucketed by the first letters of a term.

A sync writes one segment with the postings of new and changed documents and the ids of those that it replaces or removes
(gone); older postings of such ids no longer count. Segments of like size are merged, so there are about as many as the
logarithm of the number of syncs. A row of postings holds a term and its documents among some, as lists of one length:
texts are split once, a batch of documents becomes a row for each of its terms, and only these rows are dealt to buckets.
Spark cuts large buckets and puts small ones together (a rebalancing exchange), so no range of terms is sampled. A manifest names the current segments and the totals; writing it makes a sync visible,
and readers of an older one are not disturbed until vacuum()."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.search import bm25_postings, query_words, truncations
from ..scratch import discard, stored

LISTS = "term string, id array<long>, tf array<int>, len array<int>"
POSTINGS = f"{LISTS}, bucket int"
DOCS = "id long, len int, terms int, hash long, part int"  #: terms: distinct ones
LEAD = 2  #: letters of a term that choose its bucket


def _each(lists: DataFrame) -> DataFrame:
    """A row for each document of a row of postings."""
    return lists.select("term", "bucket", "hi", F.inline(F.arrays_zip("id", F.col("tf").cast("array<long>").alias("tf"), "len"))).select("term", "id", "tf", "len", "bucket", "hi")


def _packed(batches):
    """Rows (lead, term, id, tf, len, doc) of each batch of documents (id, hash, old, t): one for each of its terms, and one with
    an empty lead and term for each document, whose doc is (hash, len, terms, old): old is the length it had, -1 if new."""
    kinds = [("lead", pa.string()), ("term", pa.string()), ("id", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32())), ("len", pa.list_(pa.int32())), ("doc", pa.list_(pa.int64()))]
    for b in batches:
        if not b.num_rows:
            continue
        t = b.column("t")
        ids, size = b.column("id").to_numpy(zero_copy_only=False), np.diff(t.offsets.to_numpy()).astype(np.int32)
        coded = t.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key, tf = np.unique(code * len(ids) + np.repeat(np.arange(len(ids)), size), return_counts=True)
        term, doc = np.divmod(key, len(ids))
        offsets = pa.array(np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term)).astype(np.int32))
        words = coded.dictionary
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ids[doc], tf.astype(np.int32), size[doc])]
        yield pa.RecordBatch.from_arrays([pc.utf8_slice_codeunits(words, 0, LEAD), words, *lists, pa.nulls(len(words), kinds[5][1])], schema=pa.schema(kinds))
        facts = np.stack([b.column("hash").to_numpy(zero_copy_only=False), size, np.bincount(doc, minlength=len(ids)), b.column("old").to_numpy(zero_copy_only=False)], 1).astype(np.int64)
        one = pa.array(np.arange(len(ids) + 1, dtype=np.int32))
        empty = pa.array([""] * len(ids))
        none = [pa.ListArray.from_arrays(one, pa.array(np.zeros(len(ids), kind))) for kind in (np.int32, np.int32)]
        yield pa.RecordBatch.from_arrays([empty, empty, pa.ListArray.from_arrays(one, pa.array(ids)), *none, pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(ids) + 1, 4, dtype=np.int32)), pa.array(facts.ravel()))], schema=pa.schema(kinds))


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, split=tokens):
        """split turns a text column into its terms; an index must always be opened with the same one. What the folder
        holds in an older layout is not read: such an index is empty until the next sync."""
        self.spark, self.folder, self.buckets, self.split = spark, f"{folder.rstrip('/')}/lists", buckets, split

    # The manifest

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        _, fs = self._files()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _current(self) -> tuple[int, dict]:
        _, fs = self._files()
        done = [int(n[2:]) for n in self._list("manifest") if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest/{n}/_SUCCESS"))]
        if not done:
            return 0, {"segments": [], "n": 0, "total": 0}
        return max(done), json.loads(self.spark.read.text(f"{self.folder}/manifest/v={max(done)}").first()[0])

    def manifest(self) -> dict:
        """segments (name, hi, postings), n (documents) and total (their terms)."""
        return self._current()[1]

    def _publish(self, version: int, m: dict) -> None:
        self.spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/v={version + 1}")

    # Reading

    def _union(self, segments: list[dict], table: str, schema: str) -> DataFrame:
        own = [self.spark.read.schema(schema).parquet(f"{self.folder}/segments/{s['name']}/{table}").withColumn("hi", F.lit(s["hi"])) for s in segments]
        return reduce(DataFrame.unionByName, own, self.spark.createDataFrame([], f"{schema}, hi int"))

    def _alive(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """rows (id, hi) that no later segment replaces."""
        if not any(s["gone"] for s in segments[1:]):
            return rows.drop("hi")
        later = self._union(segments[1:], "gone", "id long").groupBy("id").agg(F.max("hi").alias("_gone"))
        return rows.join(later, "id", "left").where(F.coalesce("_gone", F.lit(-1)) <= F.col("hi")).drop("_gone", "hi")

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(F.substring(term, 1, LEAD)), F.lit(self.buckets)).cast("int")

    def postings(self, prefixes: list[str]) -> DataFrame:
        """(term, id, tf, len) of the terms with any of the prefixes. Reads the buckets of the prefixes; a prefix shorter
        than LEAD letters can be in any bucket."""
        m = self.manifest()
        rows = self._union(m["segments"], "postings", POSTINGS)
        if all(len(p) >= LEAD for p in prefixes):
            leads = sorted({p[:LEAD] for p in prefixes})
            own = self.spark.range(1).select(*[self.bucket(F.lit(x)) for x in leads]).first()
            rows = rows.where(F.col("bucket").isin(*set(own)))
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("term").startswith(p) for p in prefixes]))
        return self._alive(_each(rows), m["segments"]).drop("bucket")

    def bm25(self, prefixes: list[str]) -> DataFrame:
        """(id, score) as search.bm25 gives it. A prefix's document frequency is of distinct documents over all its terms,
        so all of their postings are read; nothing else is."""
        m = self.manifest()
        sizes = self.spark.range(1).select(F.lit(m["n"]).cast("long").alias("n"), F.lit(m["total"] / max(1, m["n"])).alias("avg"))
        return bm25_postings(self.postings(prefixes), sizes, prefixes)

    def fts(self, query: str, k: int, words: list[str] | None = None) -> DataFrame:
        """(id, score): the k best, as search.fts gives them: truncated words if there is no match at all."""
        words = query_words(query) if words is None else words
        for tried in (words, truncations(words)):
            if tried and not (hits := self.bm25(tried)).isEmpty():
                return hits.orderBy(F.desc("score"), "id").limit(k)
        return self.spark.createDataFrame([], "id long, score double")

    # Writing

    def sync(self, docs: DataFrame) -> dict:
        """Makes the index hold exactly docs (id, text): what changed is found by comparing hashes of texts, and only that
        is tokenised and written. Null texts are empty; ids must be unique."""
        version, m = self._current()
        new = docs.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        new = new.withColumn("hash", F.xxhash64("text"))
        if not m["segments"]:
            return self._write(version, m, new.withColumn("len", F.lit(None).cast("int")), None)
        have = self._alive(self._union(m["segments"], "docs", DOCS), m["segments"]).select("id", "len", F.col("hash").alias("_had"))
        changed = new.join(have, "id", "left").where("_had is null or _had <> hash")
        return self._write(version, m, changed.select("id", "text", "hash", "len"), have.join(new, "id", "left_anti").select("id", "len"))

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> dict:
        """Puts documents (id, text) in, in place of those with their ids, and takes out removed ids. Of the documents
        that are there, only the parts of the given ids are read."""
        version, m = self._current()
        changed = stored(changed.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text")))
        ids = changed.select("id")
        if removed is not None:
            ids = ids.unionByName(removed.select(F.col("id").cast("long").alias("id")))
        parts = [r[0] for r in ids.select(self._part()).distinct().collect()]  # at most as many as there are buckets
        have = self._union(m["segments"], "docs", DOCS).where(F.col("part").isin(*parts) if parts else F.lit(False))
        have = self._alive(have.join(ids.distinct(), "id", "left_semi"), m["segments"]).select("id", "len")
        m = self._write(version, m, changed.join(have, "id", "left").select("id", "text", "hash", "len"), have.join(changed, "id", "left_anti"))
        discard(changed)
        return m

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("part")

    def _write(self, version: int, m: dict, changed: DataFrame, removed: DataFrame | None) -> dict:
        """A segment for changed (id, text, hash and len: that of the document it replaces, or null) and removed (id, len)."""
        hi = 1 + max((s["hi"] for s in m["segments"]), default=0)
        at = f"{self.folder}/segments/{version + 1}-{hi}"
        split = changed.select("id", "hash", F.coalesce("len", F.lit(-1)).cast("long").alias("old"), self.split("text").alias("t"))
        rows = split.mapInArrow(_packed, f"lead string, {LISTS}, doc array<long>")
        self._postings(at, rows.withColumn("bucket", F.when(F.col("doc").isNull(), self.bucket(F.col("lead"))).otherwise(-1)).drop("lead"))
        facts = [F.element_at("doc", i + 1).cast(kind).alias(name) for i, (name, kind) in enumerate({"hash": "long", "len": "int", "terms": "int", "_old": "int"}.items())]
        docs = self.spark.read.schema(f"{POSTINGS}, doc array<long>").parquet(f"{at}/postings").where("bucket = -1").select(F.element_at("id", 1).alias("id"), *facts)
        lost = None if removed is None else stored(removed)
        t = docs.agg(F.count("*"), F.sum("len"), F.count_if(F.col("_old") >= 0), F.sum(F.when(F.col("_old") >= 0, F.col("_old"))), F.sum("terms")).first()
        g = (0, 0) if lost is None else lost.agg(F.count("*"), F.sum("len")).first()
        if not t[0] and not g[0]:
            discard(lost)
            self._delete(f"segments/{version + 1}-{hi}")
            return m
        gone = docs.where("_old >= 0").select("id")
        self._facts(at, docs, gone if lost is None else gone.unionByName(lost.select("id")))
        discard(lost)
        self._delete(f"segments/{version + 1}-{hi}/postings/bucket=-1")  # docs has them now
        segment = {"name": f"{version + 1}-{hi}", "hi": hi, "postings": t[4] or 0, "gone": t[2] + g[0]}
        now = {"segments": [*m["segments"], segment], "n": m["n"] + t[0] - t[2] - g[0], "total": m["total"] + (t[1] or 0) - (t[3] or 0) - (g[1] or 0)}
        now = self._merged(version, now)
        self._publish(version, now)
        return now

    def _postings(self, at: str, rows: DataFrame) -> None:
        """Terms in order within a bucket's files."""
        ordered = rows.select("term", "id", "tf", "len", "doc", "bucket").hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")

    def _facts(self, at: str, docs: DataFrame, gone: DataFrame) -> None:
        docs.select("id", "len", "terms", "hash", self._part()).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{at}/docs")
        gone.select("id").distinct().write.mode("overwrite").parquet(f"{at}/gone")

    def _merged(self, version: int, m: dict) -> dict:
        """m with its last segments merged as long as one is not more than twice the next newer ones together."""
        segments, size, first = m["segments"], 0, len(m["segments"])
        while first and (not size or segments[first - 1]["postings"] <= 2 * size):
            first -= 1
            size += segments[first]["postings"]
        own = segments[first:]
        if len(own) < 2:
            return m
        hi = own[-1]["hi"]
        name = f"{version + 1}-{own[0]['hi']}-{hi}"
        at = f"{self.folder}/segments/{name}"
        post, docs = self._union(own, "postings", POSTINGS), self._alive(self._union(own, "docs", DOCS), own)
        if any(s["gone"] for s in own[1:]):  # else lists stay as they are
            post = self._alive(_each(post), own).select("term", *[F.array(F.col(c).cast(kind)).alias(c) for c, kind in (("id", "long"), ("tf", "int"), ("len", "int"))], "bucket")
            size = docs.agg(F.sum("terms")).first()[0] or 0
        self._postings(at, post.withColumn("doc", F.lit(None).cast("array<long>")))
        gone = self._union(own if first else [], "gone", "id long")
        self._facts(at, docs, gone)
        return {**m, "segments": [*segments[:first], {"name": name, "hi": hi, "postings": size, "gone": sum(s["gone"] for s in own) if first else 0}]}

    def _delete(self, name: str) -> None:
        path, fs = self._files()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, name), True)

    def vacuum(self) -> None:
        """Deletes segments and manifests that are not current; no reader may use them any more."""
        version, m = self._current()
        keep = {"segments": {s["name"] for s in m["segments"]}, "manifest": {f"v={version}"}}
        for folder, names in keep.items():
            for n in set(self._list(folder)) - names:
                self._delete(f"{folder}/{n}")
