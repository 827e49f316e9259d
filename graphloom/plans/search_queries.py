"""Catalogue: keyword, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import porter
from ..operators import search
from ..scratch import scratch_path
from ..sources.text_index import TextIndex
from .graph_queries import query
from .views import table

WORDS = ["stat", "onth"]
QUERY = "stat onth"

_TOK = "tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents)"


def _bm25(words: list[str], name: str = "bm") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{w}'))) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    idf = [f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)" for i in range(len(words))]
    score = " + ".join(f"{idf[i]} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(words)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"{_TOK}, f{name} AS (SELECT id, len(t) AS len, {tf} FROM tok), s{name} AS (SELECT count(*) AS n, avg(len) AS avg, {df} FROM f{name}), {name} AS (SELECT id, ({score})::DOUBLE AS score FROM f{name}, s{name} WHERE {some})"


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"WITH {_bm25(WORDS)} SELECT id, round(score, 6) AS score FROM bm")
def fts_bm25(spark, sf):
    return search.bm25(_docs(spark, sf), WORDS).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25(WORDS)} SELECT id, round(score, 6) AS score FROM bm")
def fts_postings(spark, sf):
    """The same ranking from an inverted index, as a stored index would serve it."""
    d = _docs(spark, sf)
    sizes = d.select(F.size(search.tokens("text")).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    return search.bm25_postings(search.postings(d), sizes, WORDS).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25(WORDS)} SELECT id, round(score, 6) AS score FROM bm")
def fts_stored_index(spark, sf):
    """The same from a stored index, written in two syncs: the English documents first, then all of them."""
    docs = _docs(spark, sf)
    index = TextIndex(spark, scratch_path(spark))
    index.sync(table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "text"))
    index.sync(docs)
    return index.bm25(WORDS).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25(WORDS)} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def fts_prefix_or(spark, sf):
    return search.fts(_docs(spark, sf), QUERY, 20).select("id", F.round("score", 6).alias("score"))


def _porter(stems: list[str]) -> str:
    """The ranking by stems in SQL: the same cascade in DuckDB's words, over distinct folded words."""
    accented, bare = porter.accents()
    some = "SELECT id, len(t) AS len, unnest(t) AS w FROM ptok"
    tf = ", ".join(f"count(*) FILTER (starts_with(s, '{w}')) AS tf{i}" for i, w in enumerate(stems))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(stems)))
    idf = [f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)" for i in range(len(stems))]
    score = " + ".join(f"{idf[i]} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(stems)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(stems)))
    return f"""ptok AS MATERIALIZED (SELECT doc_id AS id, list_filter(regexp_split_to_array(regexp_replace(translate(lower(text), '{accented}', '{bare}'), '\\p{{Mn}}+', '', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
pw AS MATERIALIZED (SELECT DISTINCT w FROM ({some})), ps AS MATERIALIZED (SELECT w, {porter.stem_sql(porter.DUCK, "w")} AS s FROM pw),
pf AS (SELECT id, len, {tf} FROM ({some}) JOIN ps USING (w) GROUP BY 1, 2), pn AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM ptok), pd AS (SELECT {df} FROM pf),
bm AS (SELECT id, ({score})::DOUBLE AS score FROM pf, pn, pd WHERE {hit})"""


@query(f"WITH {_porter(['licens', 'disgust'])} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def fts_porter(spark, sf):
    """Accents folded and words stemmed on both sides."""
    return search.fts(_docs(spark, sf), "licensed disgusting", 20, porter=True).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25(['then'])} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def fts_truncation_fallback(spark, sf):
    return search.fts(_docs(spark, sf), "thenq", 20).select("id", F.round("score", 6).alias("score"))


_DIST = "sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))"


@query(f"SELECT v.vec_id AS id, round({_DIST}, 6) AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DIST}, 1 LIMIT 20")
def knn_topk(spark, sf):
    q = table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    return search.knn(_vectors(spark, sf), q, 20).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_DIST} AS d FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM p) SELECT query_id, id, round(d, 6) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def knn_batch(spark, sf):
    q = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.knn_batch(_vectors(spark, sf), q, 10).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


_LISTS = f"""{_bm25(WORDS)},
sem AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank FROM (SELECT v.vec_id AS id, {_DIST} AS d FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY d, id LIMIT 20),
kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm ORDER BY score DESC, id LIMIT 20),
every AS (SELECT id, rank, 'semantic' AS signal FROM sem UNION ALL SELECT id, rank, 'fts' FROM kw),
fused AS (SELECT id, sum(1.0 / (60 + rank))::DOUBLE AS rrf, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM every GROUP BY 1)"""
_TOP = "top AS (SELECT * FROM fused ORDER BY rrf DESC, id LIMIT 30)"
_BOOST = "SELECT id, path, signals, round(rrf * (CASE WHEN contains(lower(path), 'stat') OR contains(lower(path), 'onth') THEN 1.5 ELSE 1.0 END) * (CASE WHEN exported THEN 1.2 ELSE 1.0 END), 6) AS score, rrf FROM top JOIN sym USING (id)"
_SYM = "sym AS (SELECT doc_id AS id, source || '/' || regexp_extract(lower(text), '^\\S+', 0) AS path, coalesce(quality, 1) = 1 AS exported, lang FROM documents LEFT JOIN labels USING (doc_id))"


def _symbols(spark, sf):
    quality = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.col("source"), F.lit("/"), F.regexp_extract(F.lower("text"), r"^\S+", 0)).alias("path"), "lang")
    return d.join(quality, "id", "left").select("id", "path", (F.coalesce("quality", F.lit(1)) == 1).alias("exported"), "lang")


def _lists(spark, sf):
    q = table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    sem = search.ranked(search.knn(_vectors(spark, sf), q, 20), "semantic", [F.col("distance"), F.col("id")])
    return [sem, search.ranked(search.fts(_docs(spark, sf), QUERY, 20), "fts", [F.desc("score"), F.col("id")])]


@query(f"WITH {_LISTS} SELECT id, round(rrf, 6) AS rrf, signals FROM fused")
def rrf_fuse(spark, sf):
    return search.rrf(_lists(spark, sf)).select("id", F.round("rrf", 6).alias("rrf"), "signals")


@query(f"WITH {_LISTS}, {_SYM}, {_TOP} SELECT id, path, signals, score FROM ({_BOOST}) ORDER BY score DESC, rrf DESC, id LIMIT 10")
def hybrid_boosted(spark, sf):
    q = table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    return search.hybrid(_docs(spark, sf), _vectors(spark, sf), q, _symbols(spark, sf), QUERY, 10).select("id", "path", "signals", "score")


@query(f"WITH {_LISTS}, {_SYM}, vis AS (SELECT * FROM fused WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en')), top AS (SELECT * FROM vis ORDER BY rrf DESC, id LIMIT 30) SELECT id, path, score FROM ({_BOOST}) ORDER BY score DESC, rrf DESC, id LIMIT 10")
def hybrid_as_of(spark, sf):
    q = table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    seen = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return search.hybrid(_docs(spark, sf), _vectors(spark, sf), q, _symbols(spark, sf), QUERY, 10, visible=seen).select("id", "path", "score")


@query(f"WITH {_LISTS}, d AS (SELECT source AS path FROM fused JOIN documents ON doc_id = id) SELECT path, count(*) AS hits FROM d GROUP BY 1")
def file_hits(spark, sf):
    src = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"))
    return search.file_hits(src.join(F.broadcast(search.rrf(_lists(spark, sf))), "id"))  # at most 40 rows


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def missing_embeddings(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").select("doc_id").join(v, "doc_id", "left_anti")


@query("WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS name FROM benchmark), t AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM documents), h AS (SELECT name, id FROM t JOIN w USING (name)) SELECT name, count(*) AS used FROM h GROUP BY 1")
def symbol_usage_word_boundary(spark, sf):
    from ..operators.resolve import word_usage

    names = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"), F.lit(1))).alias("name"))
    return word_usage(names, _docs(spark, sf), "[A-Za-z]+").groupBy("name").agg(F.count("*").alias("used"))
