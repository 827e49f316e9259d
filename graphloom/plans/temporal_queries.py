"""Catalogue: history, as-of and change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, temporal
from ..scratch import stored
from .graph_queries import query
from .views import DEP, LIFE, REF, SNAP, dep_edges, life, reachable, snapshots, table

_SEEN = f"CASE WHEN first <= {REF} THEN 1 ELSE 0 END"


@query(f"WITH {LIFE} SELECT user_id, event_type, first, last, active, n FROM life")
def scd_sync(spark, sf):
    return life(spark, sf)


@query(f"WITH {LIFE} SELECT user_id, event_type, last FROM life WHERE NOT active")
def soft_deleted(spark, sf):
    return life(spark, sf).where("not active").select("user_id", "event_type", "last")


@query(f"""WITH {SNAP}, t AS (SELECT seq, user_id, event_type, n, lag(seq) OVER w AS before, lag(n) OVER w AS had FROM snap WINDOW w AS (PARTITION BY user_id, event_type ORDER BY seq)),
c AS (SELECT * FROM t WHERE before IS NULL OR before < seq - 1 OR n <> had),
l AS (SELECT c.seq, c.user_id, c.event_type, CASE WHEN a.user_id IS NOT NULL THEN c.user_id + 1 WHEN b.user_id IS NOT NULL THEN c.user_id + 2 END AS other FROM c LEFT JOIN snap a ON a.seq = c.seq AND a.event_type = c.event_type AND a.user_id = c.user_id + 1 LEFT JOIN snap b ON b.seq = c.seq AND b.event_type = c.event_type AND b.user_id = c.user_id + 2)
SELECT user_id || '/' || event_type AS source, other || '/' || event_type AS target, min(seq)::INTEGER AS first FROM l WHERE other IS NOT NULL GROUP BY 1, 2""")
def edge_first_seen(spark, sf):
    """A user's events refer to the next user's of the same kind, or else to the one after: which commit first shows it."""
    s = snapshots(spark, sf)
    path = lambda d: F.concat((F.col("user_id") + d).cast("string"), F.lit("/"), F.col("event_type"))
    trees = s.select("seq", path(0).alias("path"), F.col("n").cast("string").alias("blob"))
    refs = s.select(path(0).alias("path"), F.col("n").cast("string").alias("blob"), F.lit(0).alias("ref"), F.array(path(1), path(2)).alias("candidates")).distinct()
    return temporal.first_links(trees, refs)


@query(f"WITH {LIFE} SELECT count(*) AS rows, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS inactive, count(DISTINCT event_type) AS kinds FROM life")
def status(spark, sf):
    return life(spark, sf).agg(F.count("*").alias("rows"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("inactive"), F.count_distinct("event_type").alias("kinds"))


@query(f"WITH {LIFE} SELECT user_id, event_type, first, last, active FROM life WHERE first <= {REF} AND (active OR last > {REF})")
def as_of_visible(spark, sf):
    return temporal.visible(life(spark, sf), reachable(spark, sf), "first", "last").drop("n")


@query(f"WITH {LIFE} SELECT user_id, event_type FROM life WHERE first <= {REF} AND NOT (NOT active AND last > {REF})")
def as_of_symbol_visible(spark, sf):
    return temporal.symbol_visible(life(spark, sf), reachable(spark, sf), "first", "last").select("user_id", "event_type")


@query(f"WITH {LIFE} SELECT user_id, event_type, first FROM life WHERE active AND first > {REF}")
def changed_since_added(spark, sf):
    return temporal.changed_since(life(spark, sf), reachable(spark, sf), "first", "last").where("change = 'added'").select("user_id", "event_type", "first")


@query(f"WITH {LIFE} SELECT user_id, event_type, last FROM life WHERE NOT active AND last > {REF}")
def changed_since_removed(spark, sf):
    return temporal.changed_since(life(spark, sf), reachable(spark, sf), "first", "last").where("change = 'removed'").select("user_id", "event_type", "last")


@query(f"WITH {LIFE} SELECT count(DISTINCT first) AS commits, count(DISTINCT first) <= 1 AS warning FROM life")
def backfill_warning(spark, sf):
    return temporal.backfill_suspect(life(spark, sf), "first")


@query(f"WITH {SNAP} SELECT user_id, event_type, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM snap GROUP BY 1, 2")
def backfill_first_seen(spark, sf):
    s = snapshots(spark, sf)
    return s.groupBy("user_id", "event_type").agg(F.min_by("day", "seq").cast("string").alias("first_day"), F.max_by("day", "seq").cast("string").alias("last_day"))


_STEPS = f"WITH {SNAP}, k AS (SELECT seq, user_id || ':' || event_type AS key, n, lag(seq) OVER w AS ps, lag(n) OVER w AS pn FROM snap WINDOW w AS (PARTITION BY user_id, event_type ORDER BY seq))"


@query(f"{_STEPS} SELECT seq, key, CASE WHEN ps IS NULL OR ps < seq - 1 THEN 'added' ELSE 'modified' END AS change FROM k WHERE ps IS NULL OR ps < seq - 1 OR n <> pn")
def tree_diff(spark, sf):
    s = snapshots(spark, sf).select("seq", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "n")
    return temporal.tree_changes(s, "key", "n")


@query(f"WITH RECURSIVE {DEP}, o AS (SELECT l_partkey AS part, min(CAST(o_orderdate AS DATE)) AS born FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1), vis AS (SELECT d.src, d.dst FROM dep d JOIN o a ON a.part = d.src JOIN o b ON b.part = d.dst WHERE a.born <= (SELECT quantile_disc(born, 0.5) FROM o) AND b.born <= (SELECT quantile_disc(born, 0.5) FROM o)), start AS (SELECT dst AS origin FROM vis GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), n(node, hop) AS (SELECT origin, 0 FROM start UNION SELECT v.src, n.hop + 1 FROM n JOIN vis v ON v.dst = n.node WHERE n.hop < 40) SELECT node, min(hop) AS hop FROM n GROUP BY 1")
def as_of_blast(spark, sf):
    """Impact on the graph of a past commit: files first ordered by the median day; only the origin's part is walked."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"))
    born = stored(rows.join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").groupBy("part").agg(F.min(F.to_date("o_orderdate")).alias("born")))
    ref = born.agg(F.expr("percentile_disc(0.5) within group (order by unix_date(born))").cast("int").alias("_ref"))
    alive = born.crossJoin(F.broadcast(ref)).where(F.expr("unix_date(born) <= _ref")).select(F.col("part").alias("id"))  # one row
    edges = stored(graph.valid_edges(dep_edges(spark, sf).select("src", "dst"), stored(alive)))
    start = edges.groupBy(F.col("dst").alias("origin")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "origin").limit(1).select("origin")
    return graph.reach(edges, stored(start), None, "dependents").select("node", "hop")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s) SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 1 HOUR) AS fires, count(*) AS events FROM g GROUP BY user_id, sid")
def debounce_sessions(spark, sf):
    """Events closer than an hour restart the timer; each session fires once, an hour after its last event."""
    from ..streaming.watch import debounced

    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    d = debounced(e, "1 hour")
    return d.select(F.col("key").alias("user_id"), F.unix_micros("started").alias("started"), F.unix_micros("fires").alias("fires"), "events")


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS previous, length(text) - coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 0) AS growth FROM conversations")
def turn_fold(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous"), (F.length("text") - F.coalesce(F.lag(F.length("text")).over(w), F.lit(0))).cast("long").alias("growth"))
