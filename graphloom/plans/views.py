"""Views of the generic tables as a dependency graph, a commit history and a corpus, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import weighted


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


RUN = 64  #: line numbers of an order that meet in one group


def dep_edges(spark: SparkSession, sf: str) -> DataFrame:
    """src depends on dst: parts on consecutive lines of an order. Lines are dealt once, by order and run of line numbers;
    the first line of a run also goes to the run before, as a dst only."""
    line, run = F.col("l_linenumber"), F.floor(F.col("l_linenumber") / RUN)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").where("l_orderkey is not null and l_linenumber is not null")
    dealt = rows.withColumn("own", run).withColumn("run", F.explode(F.when(F.pmod(line, F.lit(RUN)) == 0, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))
    after = Window.partitionBy("l_orderkey", "run").orderBy("l_linenumber").rangeBetween(1, 1)
    pairs = dealt.withColumn("next", F.collect_list("l_partkey").over(after)).where("own = run").select(F.col("l_partkey").alias("src"), F.explode("next").alias("dst"))
    return weighted(pairs.where("src <> dst"))


def node_type():
    return F.expr("case when p_size <= 5 then 'import' when p_size <= 10 then 'service' when p_brand like '%1' then 'component' when p_brand like '%2' then 'route' when p_brand like '%3' then 'style' else 'module' end")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("path"), node_type().alias("node_type"), "p_brand", "p_size")


def latest(spark: SparkSession, sf: str) -> DataFrame:
    """(path): parts shipped on the last day, as the files that a change touches."""
    lines = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_partkey")
    last = lines.agg(F.max("day").alias("day"))
    return lines.join(F.broadcast(last), "day").select(F.col("l_partkey").alias("path")).distinct()  # one row


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, day, user_id, event_type, n): a commit for each day, numbered from 0."""
    e = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "user_id", "event_type").agg(F.count("*").alias("n"))
    seq = e.select("day").distinct().select("day", (F.row_number().over(Window.orderBy("day")) - 1).alias("seq"))
    return e.join(F.broadcast(seq), "day")  # a row for each day of the log, which the calendar bounds


def life(spark: SparkSession, sf: str) -> DataFrame:
    """Lives of (user_id, event_type) over the days, with commits named by their number."""
    from ..operators.temporal import history

    s = snapshots(spark, sf).withColumn("head", F.lit(None).cast("int"))
    head = snapshots(spark, sf).agg(F.max("seq").alias("_head"))
    s = s.drop("head").crossJoin(F.broadcast(head))  # one row
    return history(s, ["user_id", "event_type"], F.col("_head"), ["n"])


REF = 2  #: the reference commit of as-of queries: the third day


def reachable(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots(spark, sf).where(F.col("seq") <= REF).select(F.col("seq").alias("hash")).distinct()


DEP = """dep AS MATERIALIZED (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""
LATEST = """paths AS (SELECT DISTINCT l_partkey AS path FROM lineitem WHERE CAST(l_shipdate AS DATE) = (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem))"""
NODES = """nodes AS (SELECT p_partkey AS id, p_name AS path, CASE WHEN p_size <= 5 THEN 'import' WHEN p_size <= 10 THEN 'service' WHEN p_brand LIKE '%1' THEN 'component' WHEN p_brand LIKE '%2' THEN 'route' WHEN p_brand LIKE '%3' THEN 'style' ELSE 'module' END AS node_type, p_brand, p_size FROM part)"""
#: A pair is met once, at its shortest length.
CLOSURE = """clo(origin, node, hop) USING KEY (origin, node) AS (SELECT DISTINCT dst, src, 1 FROM dep WHERE dst IN (SELECT origin FROM origins) UNION SELECT DISTINCT w.origin, d.src, w.hop + 1 FROM clo w JOIN dep d ON d.dst = w.node WHERE d.src <> w.origin AND NOT EXISTS (SELECT 1 FROM recurring.clo r WHERE r.origin = w.origin AND r.node = d.src))"""
BLAST = """walk(origin, node) AS (SELECT dst, src FROM dep UNION SELECT w.origin, d.src FROM walk w JOIN dep d ON d.dst = w.node WHERE d.src <> w.origin),
cnt AS (SELECT origin, count(*) AS n FROM walk GROUP BY 1), dir AS (SELECT dst AS origin, count(*) AS direct FROM dep GROUP BY 1),
bl AS (SELECT origin, direct, n - direct AS transitive, round(direct + 0.5 * (n - direct), 2)::DOUBLE AS blast_score FROM cnt JOIN dir USING (origin))"""
SNAP = """snap AS (SELECT CAST(ts AS DATE) AS day, user_id, event_type, count(*) AS n, dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS seq FROM events GROUP BY 1, 2, 3)"""
LIFE = f"""{SNAP}, top AS (SELECT max(seq) AS head FROM snap),
life AS (SELECT user_id, event_type, min(seq) AS first, CASE WHEN max(seq) = head THEN head ELSE max(seq) + 1 END AS last, max(seq) = head AS active, arg_max(n, seq) AS n FROM snap, top GROUP BY 1, 2, head)"""
