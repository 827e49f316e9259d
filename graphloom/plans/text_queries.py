"""Catalogue: scalar functions, extraction and resolution over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import resolve
from .graph_queries import query
from .views import table


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash, length(text) - length(replace(text, chr(10), '')) + 1 AS loc FROM documents")
def content_hash_loc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash("text").alias("hash"), T.loc("text").alias("loc"))


@query("SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 80) AS first FROM documents")
def doc_first_line_trunc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_line("text").alias("first"))


@query("SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_ \\t\\n\\r\\f]', ' ', 'g'), '[ \\t\\n\\r\\f]+'), lambda w: length(w) >= 3), lambda w: substr(w, 1, 4)), ' ') AS stems FROM conversations")
def stems(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.query_stems("text"), " ").alias("stems"))


@query("SELECT page_id, regexp_extract(split_part(url, '://', 2), '^(@[^/]+/[^/]+|[^/]+)', 1) AS package, regexp_extract(split_part(split_part(url, '://', 2), '/', 1), '^[^.]*\\.?[^.]*') AS top2 FROM pages")
def package_names(spark, sf):
    rest = F.element_at(F.split("url", "://"), 2)
    return table(spark, sf, "pages").select("page_id", T.package_name(rest).alias("package"), T.top_components(F.substring_index(rest, "/", 1)).alias("top2"))


@query("WITH p AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/([0-9]+)', '/{id}', 'g'), '^[\\^$/\\s]+|[\\^$/\\s]+$', '', 'g')) AS u FROM pages) SELECT page_id, CASE WHEN u = '' THEN '/' ELSE replace(u, '{id}', '<p>') END AS route FROM p")
def url_normalize(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "/([0-9]+)", "/{id}")
    return table(spark, sf, "pages").select("page_id", T.normalize_url(path).alias("route"))


@query("WITH c AS (SELECT DISTINCT page_id AS call_id, lower(regexp_replace(split_part(split_part(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '?', 1), '#', 1), '/+$', '')) AS url FROM pages), r AS (SELECT min(call_id) AS route_id, regexp_extract(url, '[^/]*$') AS url FROM c GROUP BY 2), m AS (SELECT call_id, min(route_id) AS route_id FROM c JOIN r ON c.url = r.url OR ends_with(c.url, '/' || r.url) WHERE r.url <> '/' GROUP BY 1) SELECT call_id, url, route_id FROM c LEFT JOIN m USING (call_id)")
def route_match(spark, sf):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    clean = F.lower(F.regexp_replace(F.substring_index(F.substring_index(path, "?", 1), "#", 1), "/+$", ""))
    calls = table(spark, sf, "pages").select(F.col("page_id").alias("call_id"), clean.alias("url")).distinct()
    routes = calls.groupBy(F.regexp_extract("url", "[^/]*$", 0).alias("url")).agg(F.min("call_id").alias("route_id"))
    return resolve.route_match(calls, routes)


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS weight FROM l GROUP BY 1, 2")
def import_extract(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))).alias("target"))
    return rows.groupBy("page_id", "target").agg(F.count("*").alias("weight"))


@query("WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS ref FROM pages), f AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^./]*)', 1) AS path FROM pages UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*/([a-z]*)', 1) FROM pages) SELECT page_id, ref, CASE WHEN ref IN (SELECT path FROM f) THEN ref WHEN lower(ref) IN (SELECT path FROM f) THEN lower(ref) WHEN substr(ref, 1, 2) IN (SELECT path FROM f) THEN substr(ref, 1, 2) END AS target FROM l")
def import_resolve_first_match(spark, sf):
    pages = table(spark, sf, "pages")
    refs = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("ref")).distinct()
    files = pages.select(F.explode(F.array(F.regexp_extract("url", "^[a-z]+://([^./]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]*)", 1))).alias("path"))
    refs = refs.withColumn("candidates", F.array("ref", F.lower("ref"), F.substring("ref", 1, 2)))
    return resolve.first_match(refs, files, ["page_id", "ref"]).select("page_id", "ref", "target")


@query("WITH p AS (SELECT page_id, replace(split_part(url, '://', 2), '?', '/') AS path FROM pages), d AS (SELECT DISTINCT split_part(path, '/', 1) AS dir, 'host' AS name FROM p UNION SELECT DISTINCT split_part(path, '/', 1) || '/en', 'english' FROM p) SELECT page_id, path, arg_max(name, length(dir)) AS name FROM p LEFT JOIN d ON path = dir OR starts_with(path, dir || '/') GROUP BY 1, 2")
def path_prefix_package(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.replace(F.element_at(F.split("url", "://"), 2), F.lit("?"), F.lit("/")).alias("path"))
    host = F.substring_index("path", "/", 1)
    dirs = p.select(F.explode(F.array(F.struct(host.alias("dir"), F.lit("host").alias("name")), F.struct(F.concat(host, F.lit("/en")).alias("dir"), F.lit("english").alias("name")))).alias("x")).select("x.*").distinct()
    best = resolve.longest_prefix(p.select("path").distinct(), dirs)
    return p.join(best, "path").select("page_id", "path", "name")


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY 1) SELECT doc_id, (SELECT count(*) FROM d b WHERE b.first < a.first) AS node_group FROM documents JOIN d a USING (source)")
def dense_group_id(spark, sf):
    """Group numbers in first-seen order: directories are few, so their numbering is one small sort."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents").select("doc_id", "source")
    groups = d.groupBy("source").agg(F.min("doc_id").alias("first"))
    numbered = groups.select("source", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("node_group"))
    return d.join(numbered, "source").select("doc_id", "node_group")


@query("WITH n AS (SELECT html, page_id FROM pages) SELECT page_id, length(html) - length(replace(html, chr(10), '')) + 1 AS loc, len(regexp_extract_all(html, '<li>')) AS items FROM n")
def page_loc(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.loc("html").alias("loc"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"))


@query("SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.txt' AS path, source || '/' || lang AS folder, 'd' || doc_id AS stem, '.txt' AS suffix, source || '/x' AS folded FROM documents")
def path_functions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "source")
    return d.select("doc_id", "path", T.parent("path").alias("folder"), T.stem("path").alias("stem"), T.suffix("path").alias("suffix"), T.join_path(T.parent("path"), F.lit("./.././x")).alias("folded"))


@query("SELECT lang, source, count(*) AS docs, sum(n_chars)::BIGINT AS chars, grouping(lang, source)::INTEGER AS level FROM documents GROUP BY ROLLUP (lang, source)")
def platform_rollup(spark, sf):
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("int").alias("level"))


_PATHS = "paths AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.txt' AS path FROM documents)"


def _paths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))


@query(f"WITH {_PATHS}, r AS (SELECT doc_id, 'd' || (doc_id + 1) || '.txt' AS wanted FROM documents) SELECT r.doc_id, wanted, min(path) AS target FROM r LEFT JOIN paths p ON path = wanted OR ends_with(path, '/' || wanted) GROUP BY 1, 2")
def suffix_resolve(spark, sf):
    """Each document refers to the next one by file name alone."""
    p = _paths(spark, sf)
    refs = p.select("doc_id", F.concat(F.lit("d"), (F.col("doc_id") + 1).cast("string"), F.lit(".txt")).alias("wanted")).distinct()
    return resolve.suffix_match(refs, p, ["doc_id"])


@query(f"WITH {_PATHS} SELECT path FROM paths WHERE path = './d7.txt' OR ends_with(path, 'd7.txt') OR ends_with('d7.txt', path) ORDER BY path = './d7.txt' DESC, length(path), path LIMIT 1")
def fuzzy_path_lookup(spark, sf):
    return resolve.fuzzy_path(_paths(spark, sf).select("path"), "./d7.txt")
