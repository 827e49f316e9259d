"""Source files to a dependency graph: nodes, links and symbols as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.risk import layer, link_kind
from ..functions.text import fold_path, normalize_url, parent
from ..operators.numbering import numbered
from ..operators.resolve import first_match, longest_prefix, route_match, suffix_match
from ..scratch import stored

FACT = "path string, what string, name string, line int, kind string, exported boolean, doc string, methods array<string>, candidates array<string>, external string, wanted string"
RULES = "1"  #: goes into the hash of a file's facts: to be raised when extraction changes


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .scan import FIELDS, scan

    kinds = {"line": pa.int32(), "exported": pa.bool_(), "methods": pa.list_(pa.string()), "candidates": pa.list_(pa.string())}
    fact = pa.struct([(f, kinds.get(f, pa.string())) for f in FIELDS])
    for b in batches:
        rows = [[{f: r.get(f) for f in FIELDS} for r in scan(p, t)] if p is not None and t is not None else [] for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("hash"), pa.array(rows, pa.list_(fact))], ["path", "hash", "rows"])


def file_facts(sources: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, hash, rows) of sources (path, content): of all, and of those that were parsed. A file whose path and content
    are among the known ones is not parsed again; files are parsed once and the rows are kept."""
    hashed = sources.select("path", "content", F.sha2(F.concat(F.lit(f"{RULES}:"), F.coalesce("content", F.lit(""))), 256).alias("hash"))
    if known is None:
        fresh = stored(hashed.select("path", "hash", "content").mapInArrow(_scan, f"path string, hash string, rows array<struct<{_fields()}>>"))
        return fresh, fresh
    have = known.select("path", "hash")
    fresh = stored(hashed.join(have, ["path", "hash"], "left_anti").select("path", "hash", "content").mapInArrow(_scan, f"path string, hash string, rows array<struct<{_fields()}>>"))
    return fresh.unionByName(known.join(hashed.select("path", "hash"), ["path", "hash"], "left_semi").select("path", "hash", "rows")), fresh


def _fields() -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in FACT.split(", "))


def facts(sources: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows of extract.scan for sources, and the rows of file_facts that are new."""
    every, fresh = file_facts(sources, known)
    return stored(every.select(F.explode("rows").alias("_r")).select("_r.*")), fresh


def _referring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .scan import scan

    schema = pa.schema([("path", pa.string()), ("blob", pa.string()), ("ref", pa.int32()), ("candidates", pa.list_(pa.string()))])
    for b in batches:
        rows = []
        for p, blob, t in zip(*(b.column(c).to_pylist() for c in ("path", "blob", "content")), strict=True):
            refs = [r["candidates"] for r in scan(p, t or "") if r["what"] == "ref" and r["candidates"]]
            rows += [{"path": p, "blob": blob, "ref": i, "candidates": c} for i, c in enumerate(refs)]
        yield pa.RecordBatch.from_pylist(rows, schema)


def references(versions: DataFrame) -> DataFrame:
    """(path, blob, ref, candidates) of file versions (path, blob, content): each reference's paths to try, in order."""
    return versions.select("path", "blob", "content").mapInArrow(_referring, "path string, blob string, ref int, candidates array<string>")


def symbol_table(found: DataFrame) -> DataFrame:
    return found.where("what = 'symbol'").select("path", "name", "line", "kind", "exported", "doc", "methods")


def node_table(found: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """id, type, language, loc, layer of the nodes inside; a Go package sums its files, other repeats take the last type."""
    n = found.where("what = 'node'").groupBy(F.col("name").alias("id")).agg(F.max_by("kind", "path").alias("type"), F.max_by("external", "path").alias("language"), F.sum("line").alias("loc"))
    return n.withColumn("layer", layer(F.col("type"), F.col("language")))


def _references(found: DataFrame, go_module: str | None, aliases: list[tuple[str, str]], psr4: list[tuple[str, str]]) -> DataFrame:
    refs = found.where("what = 'ref'").withColumn("_id", F.monotonically_increasing_id())
    tries = F.coalesce("candidates", F.array().cast("array<string>"))
    for alias, target in aliases:  # path aliases of a script configuration, in order
        if alias.endswith("/*"):
            base = F.concat(F.lit(target.removesuffix("*").lstrip("./")), F.expr(f"substring(wanted, {len(alias)})"))
            fits = F.col("wanted").startswith(alias[:-1])
        else:
            base, fits = F.lit(target.lstrip("./")), F.col("wanted") == alias
        from .rules import JS_INDEX, JS_ORDER

        more = F.array(*[F.concat(base, F.lit(e)) for e in [*JS_ORDER, ""]], *[F.concat(base, F.lit("/" + i)) for i in JS_INDEX])
        tries = F.when(fits & ~F.col("path").endswith(".go"), F.concat(tries, more)).otherwise(tries)
    if go_module:
        inside = F.col("path").endswith(".go") & ((F.col("wanted") == go_module) | F.col("wanted").startswith(go_module + "/"))
        local = F.when(F.col("wanted") == go_module, ".").otherwise(F.expr(f"substring(wanted, {len(go_module) + 2})"))
        tries = F.when(inside, F.array(local)).otherwise(tries)
        refs = refs.withColumn("external", F.when(inside, F.lit(None)).otherwise(F.col("external")))
    if psr4:  # the mapped files of a PHP class come before its namespace read as a path
        own = F.element_at("candidates", 1)
        mapped = [F.when(F.startswith(own, F.lit(f"{space}/" if space else "")), F.concat(F.lit(f"{folder}/" if folder else ""), F.substring(own, len(space) + 2 if space else 1, 1_000_000))) for space, folder in psr4]
        tries = F.when(F.col("wanted").endswith(".php"), F.concat(F.filter(F.array(*mapped), lambda x: x.isNotNull()), tries)).otherwise(tries)
    return refs.withColumn("candidates", tries)


def link_table(found: DataFrame, go_module: str | None = None, aliases: list[tuple[str, str]] = (), psr4: list[tuple[str, str]] = ()) -> DataFrame:
    """(source, target, kind, external, weight) after first-match, suffix, scope and name resolution."""
    nodes = found.where("what = 'node'")
    ids = nodes.select(F.col("name").alias("path")).distinct()
    refs = stored(_references(found, go_module, list(aliases), list(psr4)))
    hit = first_match(refs.select("_id", "candidates"), ids, ["_id"]).select("_id", F.col("target").alias("_t1"))
    tail = suffix_match(refs.where("wanted like '%.rb' or wanted like '%.php'").select("_id", "wanted"), ids, ["_id"]).select("_id", F.col("target").alias("_t2"))
    named = nodes.where("doc is not null").groupBy(F.col("doc").alias("wanted")).agg(F.max("name").alias("_t3"))
    fqn = refs.where("kind = 'fqn'").select("_id", "wanted").join(named, "wanted").select("_id", "_t3")
    done = refs.join(hit, "_id", "left").join(tail, "_id", "left").join(fqn, "_id", "left")
    target = F.coalesce("_t1", "_t2", "_t3", "external")
    inner = F.coalesce("_t1", "_t2", "_t3").isNull()
    plain = done.select(F.col("name").alias("source"), target.alias("target"), inner.alias("external")).where("target is not null and source is not null")
    defs = found.where("what = 'define'").groupBy("wanted", "kind", "name").agg(F.min("path").alias("_to"))
    scoped = found.where("what = 'refer'").join(defs, ["wanted", "kind", "name"]).select(F.col("path").alias("source"), F.col("_to").alias("target"), F.lit(False).alias("external"))
    every = plain.unionByName(scoped).where("source <> target or not external")
    return every.groupBy("source", "target", "external").agg(F.count("*").alias("weight"))


def api_links(found: DataFrame) -> DataFrame:
    """Calls of scripts matched to routes of services: kind api-call, weight 1, once for each pair of files."""
    mount = found.where("what = 'include'").groupBy(F.col("name").alias("_module")).agg(F.min("wanted").alias("_mount"))
    module = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    routes = found.where("what = 'route'").withColumn("_module", module).join(mount, "_module", "left")
    routes = routes.select("path", normalize_url(F.concat(F.coalesce("_mount", "wanted", F.lit("")), "name")).alias("url")).distinct()
    first = routes.groupBy("url").agg(F.min("path").alias("route_id"))
    calls = found.where("what = 'call'").select("path", normalize_url(F.regexp_replace("name", r"^https?://[^/]+", "")).alias("url")).distinct()
    matched = route_match(calls.select(F.struct("path", "url").alias("call_id"), "url"), first.select("route_id", "url"))
    return matched.where("route_id is not null").select(F.col("call_id.path").alias("source"), F.col("route_id").alias("target")).distinct().select("source", "target", F.lit("api-call").alias("kind"), F.lit(1).cast("long").alias("weight"))


def analyze(sources: DataFrame, packages: DataFrame | None = None, go_module: str | None = None, aliases: list[tuple[str, str]] = (), psr4: list[tuple[str, str]] = (), known: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, links and symbols of source files (path, content), and the facts of files that were parsed. packages: (dir,
    name) of a monorepo's workspaces; psr4: (namespace, folder) of PHP; known: facts of an earlier run."""
    found, fresh = facts(sources, known)
    inside, links = node_table(found), stored(link_table(found, go_module, aliases, psr4))
    outside = links.where("external").select(F.col("target").alias("id")).distinct().join(inside.select("id"), "id", "left_anti")
    hashes = sources.select(F.col("path").alias("id"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), F.length("content").cast("long").alias("size"))
    own = inside.join(hashes, "id", "left")
    extra = outside.select("id", F.lit("import").alias("type"), F.lit(None).cast("string").alias("language"), F.lit(0).cast("long").alias("loc"), F.lit("backend").alias("layer"), F.lit(None).cast("string").alias("content_hash"), F.lit(40).cast("long").alias("size"))
    nodes = own.unionByName(extra)
    if packages is not None:
        nodes = nodes.join(longest_prefix(nodes.select(F.col("id").alias("path")), packages).select(F.col("path").alias("id"), F.col("name").alias("package")), "id", "left")
    a, b = nodes.select(F.col("id").alias("source"), F.col("type").alias("_s")), nodes.select(F.col("id").alias("target"), F.col("type").alias("_t"))
    kinds = links.join(a, "source", "left").join(b, "target", "left").groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.first("_s").alias("_s"), F.first("_t").alias("_t"))
    linked = kinds.select("source", "target", link_kind(F.col("_s"), F.col("_t")).alias("kind"), "weight").unionByName(api_links(found))
    return {"nodes": nodes, "links": linked, "symbols": symbol_table(found), "facts": fresh}


def groups(nodes: DataFrame) -> DataFrame:
    """nodes with group: the number of the node's directory, directories counted in name order."""
    dirs = nodes.select(parent("id").alias("_dir")).distinct()
    own = numbered(dirs, [F.col("_dir")], "_n").select("_dir", F.col("_n").cast("int").alias("group"))
    return nodes.withColumn("_dir", parent("id")).join(own, "_dir", "left").drop("_dir")


__all__ = ["analyze", "api_links", "facts", "fold_path", "groups", "link_table", "node_table", "symbol_table"]
