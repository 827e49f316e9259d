"""Queries opN_<name> of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cover_topk, decontaminate, exponion, fim, hmm, licenses, line_crf, mixing, ngram_join, packing, pii, token_counts, url_filter
from .common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_table(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_table(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_table(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.labelled_urls(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.lm_scores(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"), cycle=(1, 2, 3), most=3)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_table(table(spark, sf_dir, "documents"))


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster_table(table(spark, sf_dir, "embeddings"), k=40, rounds=5, scale=256, dim=64)


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_token_counts, op3_cover_topk, op4_decontaminate, op5_packing, op6_licenses, op7_pii, op8_url_filter, op9_quality, op10_lm_scores, op11_mixing, op12_fill_in_middle, op13_exponion)}
#: DuckDB SQL where it can express an operator; the others are tested against brute force in tests/llm.
ORACLES = {
    "op3_cover_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 10""",
    "op6_licenses": licenses.oracle(),
    "op11_mixing": mixing.oracle(),
    "op12_fill_in_middle": fim.ORACLE,
    "op13_exponion": exponion.oracle(),
}
