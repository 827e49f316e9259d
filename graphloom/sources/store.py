"""The store: versioned Parquet tables that are written by differences.

A version is a folder v=N with the rows that are new or differ from the version before, table by table, and a manifest
that names each table's segments (a base, then differences) and the head. Writing the manifest makes the version current.
Of rows with one key the newest segment's counts. A table whose differences have grown is written whole again, as a new
base. Rows of the temporal tables that are active were seen by the last sync, so they are stored without last_seen_commit
and last_seen_at and filled from the head when read: a sync does not touch what stays as it is."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..operators import temporal
from ..scratch import discard, stored

TABLES = {"meta": schema.META, "commits": schema.COMMITS, "files": schema.FILES, "edges": schema.EDGES, "symbols": schema.SYMBOLS, "vectors": schema.VECTORS, "facts": schema.FACTS}
KEYS = {"meta": "key", "commits": "hash", "files": "id", "edges": "id", "symbols": "id", "vectors": "symbol_id", "facts": "path"}
TEMPORAL = ["files", "edges", "symbols"]
FILE_ATTRS = ["node_type", "language", "layer", "size", "loc", "node_group", "imports_count", "package", "content_hash", "blast_score", "direct_dependents", "transitive_dependents"]
MOST_SEGMENTS, SHARE = 8, 0.5  #: a table is written whole at so many segments, or when differences reach this share of the base
BROADCAST_ROWS = 250_000  #: keys that are broadcast at most (a few MB)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(self._path(f"{n}/MANIFEST/_SUCCESS")[0]))

    def manifest(self, version: int | None = None) -> dict:
        """version, head (commit and at, microseconds of its sync) and each table's segments (name, rows), base first."""
        if version is None:
            have = self.versions()
            if not have:
                return {"version": 0, "head": {"commit": None, "at": None}, "tables": {t: [] for t in TABLES}}
            version = have[-1]
        return json.loads(self.spark.read.text(f"{self.folder}/v={version}/MANIFEST").first()[0])

    # Reading

    def _segment(self, name: str, segment: dict) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{segment['name']}")

    def _rows(self, name: str, m: dict) -> DataFrame:
        """The table as stored: the base without the keys of later segments, and of these the newest row of each key. Keys
        are broadcast when the manifest counts few, so the base is not shuffled."""
        segments, key = m["tables"].get(name, []), KEYS[name]
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        base = self._segment(name, segments[0])
        if len(segments) == 1:
            return base
        later = reduce(DataFrame.unionByName, [self._segment(name, s).withColumn("_at", F.lit(i)) for i, s in enumerate(segments[1:])])
        newest = later.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at")))).where("_n = 1").drop("_at", "_n")
        keys = later.select(key).distinct()
        keys = F.broadcast(keys) if sum(s["rows"] for s in segments[1:]) <= BROADCAST_ROWS else keys
        return base.join(keys, key, "left_anti").select(*TABLES[name].names).unionByName(newest.select(*TABLES[name].names))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the current one if none is given."""
        m = self.manifest(version)
        rows = self._rows(name, m)
        if name not in TEMPORAL:
            return rows
        at = F.timestamp_micros(F.lit(m["head"]["at"]).cast("long"))
        fill = {"last_seen_commit": F.lit(m["head"]["commit"]).cast("string"), "last_seen_at": at}
        return rows.select(*[F.when(F.col("active"), fill[c]).otherwise(F.col(c)).alias(c) if c in fill else F.col(c) for c in rows.columns])

    # Writing

    def write(self, tables: dict[str, DataFrame], head: dict | None = None) -> int:
        """A new version in which the given rows are there, in place of those with their keys. Rows that are equal to what
        is there are not written; without any there is no new version, unless the head is new."""
        m = self.manifest()
        now = m["version"] + 1
        head = head or m["head"]
        segments, wrote = {t: m["tables"].get(t, []) for t in TABLES}, head != m["head"]
        for name, rows in tables.items():
            own = self._changed(name, rows, m)
            count = own.count()
            if count:
                segments[name] = self._put(name, own, count, m, now)
                wrote = True
            discard(own)
        if not wrote:
            return m["version"]
        text = json.dumps({"version": now, "head": head, "tables": segments})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/v={now}/MANIFEST")
        return now

    def _changed(self, name: str, rows: DataFrame, m: dict) -> DataFrame:
        """Rows, as stored, that are new or differ."""
        key, types = KEYS[name], TABLES[name]
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in types])
        if name in TEMPORAL:
            rows = rows.select(*[F.when(~F.col("active"), F.col(c)).alias(c) if c in ("last_seen_commit", "last_seen_at") else F.col(c) for c in rows.columns])
        old = self._rows(name, m).select(F.col(key), F.struct(*types.names).alias("_old"))
        return stored(rows.join(old, key, "left").where(F.col("_old").isNull() | ~F.struct(*types.names).eqNullSafe(F.col("_old"))).select(*types.names))

    def _put(self, name: str, rows: DataFrame, count: int, m: dict, version: int) -> list[dict]:
        segments, at = m["tables"].get(name, []), f"v={version}/{name}"
        differences = sum(s["rows"] for s in segments[1:]) + count
        if not segments or len(segments) < MOST_SEGMENTS and differences < SHARE * segments[0]["rows"]:
            rows.write.mode("overwrite").parquet(f"{self.folder}/{at}")
            return [*segments, {"name": at, "rows": count}]
        kept = self._rows(name, m).join(rows.select(KEYS[name]), KEYS[name], "left_anti").select(*rows.columns)
        kept.unionByName(rows).write.mode("overwrite").parquet(f"{self.folder}/{at}")
        return [{"name": at, "rows": self._segment(name, {"name": at}).count()}]

    def vacuum(self, keep: int = 1) -> None:
        """Deletes what none of the last `keep` versions needs; earlier versions can no longer be read."""
        have = self.versions()
        needed = {f"v={v}" for v in have[-keep:]} | {s["name"].split("/")[0] for v in have[-keep:] for t in self.manifest(v)["tables"].values() for s in t}
        held = {s["name"] for v in have[-keep:] for t in self.manifest(v)["tables"].values() for s in t}
        for v in have[:-keep]:
            gone = [f"v={v}"] if f"v={v}" not in needed else [f"v={v}/MANIFEST", *(f"v={v}/{t}" for t in TABLES if f"v={v}/{t}" not in held)]
            for name in gone:
                path, fs = self._path(name)
                fs.delete(path, True)

    def sync(self, graph: dict[str, DataFrame], commit: str) -> int:
        """Upserts an analysis (nodes, links, symbols, all with store column names) as of a commit."""
        at = self.spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
        now = F.timestamp_micros(F.lit(at))
        files = temporal.upsert(self.read("files").drop("id"), graph["files"].select("path", *FILE_ATTRS), ["path"], FILE_ATTRS, commit, now)
        files = files.withColumn("id", F.xxhash64("path"))
        edge_keys = ["source_file_id", "target_file_id", "kind"]
        edges = temporal.upsert(self.read("edges").drop("id"), graph["edges"].select(*edge_keys, "weight"), edge_keys, ["weight"], commit, now).withColumn("id", F.xxhash64(*edge_keys))
        attrs = ["kind", "line", "exported", "signature", "doc", "methods"]
        symbols = temporal.upsert(self.read("symbols").drop("id"), graph["symbols"].select("file_id", "name", *attrs), ["file_id", "name"], attrs, commit, now, keep_last=True)
        symbols = symbols.withColumn("id", F.xxhash64("file_id", "name"))
        meta = self.spark.createDataFrame([("last_indexed_commit", commit), ("schema_version", "3")], schema.META)
        return self.write({"files": files, "edges": edges, "symbols": symbols, "meta": meta}, {"commit": commit, "at": at})

    def status(self) -> DataFrame:
        f, e, s = (self.read(t).agg(F.count_if("active").alias(f"active_{t}"), F.count("*").alias(t)) for t in ("files", "edges", "symbols"))
        return f.crossJoin(e).crossJoin(s).crossJoin(self.read("vectors").agg(F.count("*").alias("vectors")))  # rows of totals
