"""Temporal operators: slowly changing relations in closed form, visibility as of a set of commits, and differences.

A snapshot log holds (seq, key...) for each analysed commit seq. A key's life is one interval: first is its first
commit, it is active when present in the last one, and otherwise it was found missing in the commit after its last
presence. Gaps are forgotten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(log: DataFrame, keys: Sequence[str], head: int | Column, attrs: Sequence[str] = ()) -> DataFrame:
    """keys, first, last, active, attrs (latest values). head: the last analysed seq, a number or a column of log."""
    top = F.lit(head) if isinstance(head, int) else F.max(head)
    life = log.groupBy(*keys).agg(F.min("seq").alias("first"), F.max("seq").alias("present"), top.alias("head"), *[F.max_by(a, "seq").alias(a) for a in attrs])
    active = F.col("present") == F.col("head")
    return life.select(*keys, "first", F.when(active, F.col("head")).otherwise(F.col("present") + 1).alias("last"), active.alias("active"), *attrs)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], attrs: Sequence[str], commit: str, now: Column, keep_last: bool = False) -> DataFrame:
    """One incremental sync: insert, refresh, or mark missing. keep_last: missing rows keep last_seen_commit (symbols)."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    there, was = F.col("n._new").isNotNull(), F.col("o.active").isNotNull()
    gone = ~there & F.col("o.active")
    attr = [F.when(there, F.col(f"n.{a}")).otherwise(F.col(f"o.{a}")).alias(a) for a in attrs]
    lost = F.when(gone & F.lit(not keep_last), F.lit(commit)).otherwise(F.col("o.last_seen_commit"))
    return o.join(n, list(keys), "full").select(
        *keys, *attr, there.alias("active"),
        F.when(was, F.col("o.first_seen_commit")).otherwise(F.lit(commit)).alias("first_seen_commit"),
        F.when(there, F.lit(commit)).otherwise(lost).alias("last_seen_commit"),
        F.when(was, F.col("o.first_seen_at")).otherwise(now).alias("first_seen_at"),
        F.when(there | gone, now).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
    )


def flagged(rows: DataFrame, reachable: DataFrame, first: str = "first_seen_commit", last: str = "last_seen_commit") -> DataFrame:
    """rows with _born and _gone: whether first and last are among the reachable commits (a column hash)."""
    a = reachable.select(F.col("hash").alias("_h1"), F.lit(True).alias("_b")).distinct()
    b = reachable.select(F.col("hash").alias("_h2"), F.lit(True).alias("_g")).distinct()
    out = rows.join(a, rows[first] == F.col("_h1"), "left").join(b, rows[last] == F.col("_h2"), "left")
    return out.select(*rows.columns, F.coalesce("_b", F.lit(False)).alias("_born"), F.coalesce("_g", F.lit(False)).alias("_gone"))


def visible(rows: DataFrame, reachable: DataFrame, first: str = "first_seen_commit", last: str = "last_seen_commit") -> DataFrame:
    """Files or edges alive as of the commits: born, and active or with a known removal that is not reachable."""
    f = flagged(rows, reachable, first, last)
    return f.where(F.col("_born") & (F.col("active") | (~F.col("active") & F.col(last).isNotNull() & ~F.col("_gone")))).select(*rows.columns)


def symbol_visible(rows: DataFrame, reachable: DataFrame, first: str = "first_seen_commit", last: str = "last_seen_commit", strict: bool = False) -> DataFrame:
    """Symbols hide when born later, or when inactive with a last commit that is not reachable; strict: the rule of files."""
    if strict:
        return visible(rows, reachable, first, last)
    f = flagged(rows, reachable, first, last)
    later = F.col(first).isNotNull() & ~F.col("_born")
    hidden = ~F.col("active") & F.col(last).isNotNull() & ~F.col("_gone")
    return f.where(~later & ~hidden).select(*rows.columns)


def changed_since(rows: DataFrame, reachable: DataFrame, first: str = "first_seen_commit", last: str = "last_seen_commit") -> DataFrame:
    """rows with change: added (active, born after the ref) or removed (inactive, removal known and after the ref)."""
    f = flagged(rows, reachable, first, last)
    added = F.col("active") & F.col(first).isNotNull() & ~F.col("_born")
    removed = ~F.col("active") & F.col(last).isNotNull() & ~F.col("_gone")
    return f.withColumn("change", F.when(added, "added").when(removed, "removed")).where("change is not null").select(*rows.columns, "change")


def backfill_suspect(rows: DataFrame, first: str = "first_seen_commit") -> DataFrame:
    """One row: whether all rows share at most one first commit, which says that history was never back-filled."""
    return rows.agg(F.count_distinct(first).alias("commits"), (F.count_distinct(first) <= 1).alias("warning"))


def tree_changes(log: DataFrame, key: str, value: str) -> DataFrame:
    """(seq, key, change) of each commit against the one before: added or modified."""
    w = Window.partitionBy(key).orderBy("seq")
    steps = log.withColumn("_seq", F.lag("seq").over(w)).withColumn("_value", F.lag(value).over(w))
    fresh = F.col("_seq").isNull() | (F.col("_seq") < F.col("seq") - 1)
    return steps.withColumn("change", F.when(fresh, "added").when(~F.col(value).eqNullSafe(F.col("_value")), "modified")).where("change is not null").select("seq", key, "change")


def first_links(trees: DataFrame, refs: DataFrame) -> DataFrame:
    """(source, target, first): the first commit in which a changed file's reference found its target.

    trees (seq, path, blob): every commit's files; refs (path, blob, ref, candidates): of each version of a file. A
    version is resolved in the trees of the commits that bring it, by the first candidate that is there."""
    brought = tree_changes(trees, "path", "blob").select("seq", "path").join(trees, ["seq", "path"])
    tried = brought.join(refs, ["path", "blob"]).select("seq", F.col("path").alias("source"), "ref", F.posexplode("candidates").alias("at", "path"))
    hit = tried.join(trees.select("seq", "path"), ["seq", "path"]).groupBy("seq", "source", "ref").agg(F.min_by("path", "at").alias("target"))
    return hit.where("source <> target").groupBy("source", "target").agg(F.min("seq").alias("first"))


def touched(edges: DataFrame, paths: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """edges with touched: whether an end is among the paths (a column path)."""
    a = paths.select(F.col("path").alias("_p1"), F.lit(True).alias("_a")).distinct()
    b = paths.select(F.col("path").alias("_p2"), F.lit(True).alias("_b")).distinct()
    out = edges.join(a, edges[src] == F.col("_p1"), "left").join(b, edges[dst] == F.col("_p2"), "left")
    return out.select(*edges.columns, (F.col("_a").isNotNull() | F.col("_b").isNotNull()).alias("touched"))


def backfilled(current: DataFrame, firsts: DataFrame, keys: Sequence[str], skeleton: dict[str, Column]) -> DataFrame:
    """current with first_seen_commit from history (keys, first); keys known only there become inactive skeleton rows."""
    f = firsts.select(*keys, F.col("first").alias("_first"))
    own = current.join(f, list(keys), "left").withColumn("first_seen_commit", F.coalesce("_first", "first_seen_commit")).select(*current.columns)
    missing = f.join(current.select(*keys), list(keys), "left_anti").withColumn("first_seen_commit", F.col("_first"))
    fill = [F.col(c) if c in (*keys, "first_seen_commit") else skeleton.get(c, F.lit(None)).cast(current.schema[c].dataType).alias(c) for c in current.columns]
    return own.unionByName(missing.select(*fill))
