"""Joins that resolve names: first match, longest prefix, suffix, routes and word containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(refs: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """refs (keys, candidates array of paths in order) with target: the first candidate that is a file (column path)."""
    tried = refs.select(*keys, F.posexplode("candidates").alias("_at", "path"))
    hit = tried.join(files.select("path").distinct(), "path").groupBy(*keys).agg(F.min_by("path", "_at").alias("target"))
    return refs.join(hit, keys, "left")


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """paths (path) with name: that of the longest directory (dir, name) above it.

    Every directory above a path is a key of an equi-join, so nothing is compared pair by pair."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keys = paths.select("path", F.explode(above).alias("dir"))
    best = keys.join(prefixes, "dir").groupBy("path").agg(F.max_by("name", F.struct(F.length("dir"), "name")).alias("name"))
    return paths.join(best, "path", "left")


def _tails(path: str) -> Column:
    """The last one, two, ... segments of a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, -i, i), "/"))


def suffix_match(refs: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """refs (keys, wanted) with target: the smallest file path that equals wanted or ends with /wanted."""
    ends = files.select("path", F.explode(_tails("path")).alias("wanted")).groupBy("wanted").agg(F.min("path").alias("target"))
    return refs.join(ends, "wanted", "left").select(*keys, "wanted", "target")


def route_match(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """calls (call_id, url) with route_id: equal paths first, else the first route with the same trailing segments.

    Of two such paths one is a tail of the other. The smallest route of every path, and of every tail of a path, is found
    first; calls then meet one row for each of their own tails, however many routes share a last segment."""
    whole = routes.groupBy("url").agg(F.min("route_id").alias("_id"))
    exact = calls.join(whole, "url").groupBy("call_id").agg(F.min("_id").alias("_exact"))
    other = routes.where("url <> '/'")
    tails = other.select("route_id", F.explode(_tails("url")).alias("url")).groupBy("url").agg(F.min("route_id").alias("_id"))
    longer = calls.join(tails, "url").select("call_id", "_id")
    shorter = calls.select("call_id", F.explode(_tails("url")).alias("url")).join(whole.where("url <> '/'"), "url").select("call_id", "_id")
    near = longer.unionByName(shorter).groupBy("call_id").agg(F.min("_id").alias("_near"))
    return calls.join(exact, "call_id", "left").join(near, "call_id", "left").select(*calls.columns, F.coalesce("_exact", "_near").alias("route_id"))


def word_usage(names: DataFrame, texts: DataFrame, pattern: str = r"\w+") -> DataFrame:
    """(name, id): texts (id, text) that hold a name as a whole word; tokens are joined, texts are not scanned per name."""
    words = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)))).alias("name"))
    return words.join(names.select("name").distinct(), "name")


def fuzzy_path(files: DataFrame, arg: str) -> DataFrame:
    """At most one file: the exact path, else the shortest that ends with the argument or is its end."""
    clean = arg.lstrip("./")
    p = F.col("path")
    fits = files.where((p == arg) | p.endswith(clean) | F.lit(clean).endswith(p))
    return fits.orderBy(F.desc(p == arg), F.length("path"), "path").limit(1)
