"""Mixing sources to target weights.

Words are counted per source, which gives every source a repetition rate: its target over its size. A document is then
emitted floor(rate) times, and once more if a coin falls so; the coin's probability is the rate's fraction, and its side
comes from a hash of seed, id and text, so that reruns and tasks that run again agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import BROADCAST_ROWS, stored

WORD = r"[^\x20\x09-\x0D]+"
HOT = 1000  #: beyond broadcasts, a source with one document in HOT or more is joined apart; there are at most HOT of these


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(seed: str, doc_id: Column, text: Column) -> Column:
    """A number from 0 to 1 (exclusive) with 52 bits, from the MD5 of seed, id and the text's own MD5; null is empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cyclic_weights(sources: DataFrame, weights: list[int]) -> DataFrame:
    """(source, weight) for a table of distinct sources: the weights in turn, by code point, null last."""
    order = F.col("source").asc_nulls_last()
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    return numbered(sources.select("source"), [order], "turn").select("source", turn.cast("long").alias("weight"))


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, source_size, n_docs); sums are combined before the shuffle, so a source of any size is a row a task."""
    return docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"), F.count("*").alias("n_docs"))


def targets(sizes: DataFrame, weights: DataFrame, most: int) -> DataFrame:
    """sizes with weight and target. Sources share the sum of all sizes by weight; a target stops at `most` times its
    source's size, and the excess is shared again by weight until none is above. Sources without a weight get none.

    Each round finds the sources that the present level lifts to their stop; the driver sees three sums a round."""
    known = stored(sizes.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0, ["weight"]))
    stop = (F.col("source_size") * most).cast("decimal(38,0)")
    whole = int(known.agg(F.sum("source_size")).first()[0] or 0)
    full, level, share = F.lit(False), None, None
    while True:
        got = known.agg(F.sum(F.when(full, stop)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        now = (got["n"], whole - int(got["held"] or 0), int(got["weight"] or 0))
        if now == level:
            break
        level, (_, share, weight) = now, now
        full = stop * F.lit(weight).cast("decimal(38,0)") <= F.col("weight") * F.lit(share).cast("decimal(38,0)")
    target = F.when(full, stop.cast("double")).when(F.col("weight") == 0, 0.0).otherwise((F.col("weight") * F.lit(share).cast("decimal(38,0)")).cast("double") / F.lit(max(weight, 1)).cast("double"))
    return known.withColumn("target", target)


def planned(docs: DataFrame, weights: DataFrame | None = None, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """row (a document with all its columns), size, source_size, target and copies, for each row of docs.

    weights has a row (source, weight) for each source, whole numbers; without it the weights of cycle are dealt in
    turn. Null texts have size 0. Null is a source of its own. Rows that repeat both id and text share their coin;
    copies of a text under other ids do not. A source without words has target 0 and no copies. Columns of docs with
    any name are kept apart in row. An empty table gives an empty result."""
    sizes = stored(source_sizes(docs))
    if weights is None:
        weights = cyclic_weights(sizes, list(cycle))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = stored(targets(sizes, weights, most).select(F.col("source").alias("its_source"), "source_size", "target", rate.alias("rate"), "n_docs"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.source").eqNullSafe(F.col("its_source"))
    if known.count() <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(known), same)
    else:
        total = known.agg(F.sum("n_docs")).first()[0]
        hot = F.broadcast(known.where(F.col("n_docs") * HOT >= total))  # at most HOT rows
        met = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(known, same))
    extra = coin(seed, F.col("row.doc_id"), F.col("row.text")) < F.col("rate") - F.floor("rate")
    return met.select("row", words(F.col("row.text")).alias("size"), "source_size", "target", (F.floor("rate") + extra.cast("long")).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as planned() says, with the same columns."""
    return planned(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies) and copies, for each row of docs."""
    plan = planned(docs, **options)
    return plan.select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def oracle(most: int = 3, seed: str = "mix") -> str:
    """The query in SQL: a source is full if its stop is not above its share of what fuller ones leave."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY 1),
o AS (SELECT *, sum(source_size) OVER () AS whole, coalesce(sum({most} * source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
f AS (SELECT *, {most} * source_size * rest <= weight * (whole - held) AS is_full FROM o),
g AS (SELECT whole - coalesce(sum({most} * source_size) FILTER (is_full), 0) AS share, sum(weight) FILTER (NOT is_full) AS open FROM f GROUP BY whole),
t AS (SELECT source, source_size, CASE WHEN is_full THEN ({most} * source_size)::DOUBLE ELSE (weight * share)::DOUBLE / open::DOUBLE END AS target FROM f, g),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (SELECT doc_id, size, source_size, target, rate, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
n AS (SELECT *, floor(rate)::BIGINT + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM n"""
