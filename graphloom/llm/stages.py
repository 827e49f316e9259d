"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

docs has the columns doc_id and text, and any others, whatever their names; all stages but the last return the same
columns. Rows with null ids or texts, repeated rows and empty tables are allowed; each stage says what they become."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_crf, ngram_join, packing, pii
from .common import dropped, held, settle, stored, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier does not reject. Null and empty texts count as one empty line; rows are judged by
    their text alone, so repeated rows stay or go together; ids may be null."""
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8): that with the smallest doc_id, null last, then the
    smallest text hash.

    Rows are told apart by doc_id and text, so other texts of a repeated doc_id are rows of their own; of rows with
    equal doc_id and text one is kept. Null and empty texts belong to no group and stay. What goes is broadcast when
    counted to be few, so texts are not shuffled; else both sides are joined by id and text hash."""
    rows = stored(ngram_join.labelled(docs, width=5, num=8, den=10).select("doc_id", "th", "n", "kept"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = [F.col("row.doc_id").cast("long"), F.xxhash64("row.text")]

    def matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, key[0].eqNullSafe(F.col("its_id")) & (key[1] == F.col("its_hash")), how)

    names = [F.col("doc_id").alias("its_id"), F.col("th").alias("its_hash")]
    kept = matched(packed, held(stored(rows.where("not kept").select(*names).distinct())), "left_anti")
    twice = stored(rows.where("kept and n > 0").groupBy(*names).count().where("count > 1").drop("count"))
    if not twice.isEmpty():
        twice = held(twice)
        one = matched(kept, twice, "left_semi").groupBy(key[0].alias("its_id"), key[1].alias("its_hash")).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = matched(kept, twice, "left_anti").unionByName(one.select("row"))
    return kept.select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a benchmark passage. Null and empty texts hold none and stay; repeated rows stay or go together."""
    settle(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their texts replaced and n_chars, if there, renewed. Null texts stay null."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. Null and empty texts are the end token alone; repeated rows are packed each on
    their own; null ids stay null; other columns are left out."""
    settle(spark)
    return packing.packed(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontaminate", clean), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared scratch folder and read by the next, and what a
    stage had written there for itself is deleted. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        start = written()
        result = stage(spark, docs, sf_dir)
        stop = written()
        docs = stored(result)
        dropped(spark, start, stop)
    return docs
