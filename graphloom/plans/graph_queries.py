"""Catalogue: graph, projection and aggregation queries over the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.risk import affected_pct, layer, link_kind, risk_label
from ..operators import graph
from ..operators.reach import blast_counts
from ..schema import NON_FILE_TYPES, SOURCE_TYPES
from ..scratch import stored
from .views import BLAST, CLOSURE, DEP, LATEST, NODES, dep_edges, latest, nodes, table

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


@query(f"WITH {DEP} SELECT src, dst, weight FROM dep")
def edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    return dep_edges(spark, sf)


@query(f"WITH {DEP}, p AS (SELECT dst AS id, src, count(*) OVER (PARTITION BY dst) AS direct, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1) // 1000 AS part FROM dep) SELECT id, part::BIGINT AS part, direct, string_agg(src::VARCHAR, ',' ORDER BY src) AS dependents FROM p GROUP BY 1, 2, 3")
def direct_dependents(spark, sf):
    return graph.listed(dep_edges(spark, sf), "dst", "src").select("id", "part", F.col("total").alias("direct"), F.array_join("values", ",").alias("dependents"))


@query(f"WITH {DEP}, o AS (SELECT id, part, string_agg(v::VARCHAR, ',' ORDER BY v) AS imports FROM (SELECT src AS id, dst AS v, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 1000 AS part FROM dep) GROUP BY 1, 2), i AS (SELECT id, part, string_agg(v::VARCHAR, ',' ORDER BY v) AS imported_by FROM (SELECT dst AS id, src AS v, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1) // 1000 AS part FROM dep) GROUP BY 1, 2) SELECT id, part::BIGINT AS part, imports, imported_by FROM o FULL JOIN i USING (id, part)")
def imports_imported_by(spark, sf):
    return graph.adjacency(dep_edges(spark, sf)).select("id", "part", F.array_join("imports", ",").alias("imports"), F.array_join("imported_by", ",").alias("imported_by"))


_EVERY_20 = "origins AS (SELECT DISTINCT dst AS origin FROM dep WHERE dst % 20 = 0)"


@query(f"WITH RECURSIVE {DEP}, {_EVERY_20}, {CLOSURE} SELECT origin, node, hop FROM clo")
def blast_closure(spark, sf):
    """Everything that depends on each part whose id is divisible by 20, in the graph of all parts."""
    edges = stored(dep_edges(spark, sf).select("src", "dst"))
    return graph.closure(edges, edges.where("dst % 20 = 0").select(F.col("dst").alias("origin")).distinct())


@query(f"WITH RECURSIVE {DEP}, {BLAST} SELECT * FROM bl")
def blast_score(spark, sf):
    return blast_counts(dep_edges(spark, sf))


def _scored(spark, sf):
    return blast_counts(dep_edges(spark, sf)).join(nodes(spark, sf).select(F.col("id").alias("origin"), "path", "node_type"), "origin")


@query(f"WITH RECURSIVE {DEP}, {BLAST}, {NODES} SELECT origin, path, node_type, blast_score FROM bl JOIN nodes ON id = origin WHERE blast_score >= 5.0 AND node_type NOT IN ('import', 'service', 'pipeline', 'database')")
def high_blast(spark, sf):
    return graph.high_blast(_scored(spark, sf), 5.0, NON_FILE_TYPES).select("origin", "path", "node_type", "blast_score")


@query(f"WITH RECURSIVE {DEP}, {BLAST} SELECT origin, blast_score FROM bl ORDER BY blast_score DESC, origin LIMIT 20")
def blast_top20(spark, sf):
    return blast_counts(dep_edges(spark, sf)).select("origin", "blast_score").orderBy(F.desc("blast_score"), "origin").limit(20)


@query(f"WITH RECURSIVE {DEP}, {BLAST}, {NODES}, t AS (SELECT count(*) AS total FROM nodes WHERE node_type <> 'import') SELECT origin, CASE WHEN total = 0 THEN 'UNKNOWN' WHEN blast_score >= 20 OR blast_score / total * 100 >= 30 THEN 'CRITICAL' WHEN blast_score >= 10 OR blast_score / total * 100 >= 15 THEN 'HIGH' WHEN blast_score >= 4 OR blast_score / total * 100 >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk, round((direct + transitive) * 100 / total::DOUBLE, 1) AS pct FROM bl, t")
def risk_labels(spark, sf):
    total = nodes(spark, sf).where("node_type <> 'import'").agg(F.count("*").alias("total"))
    scored = blast_counts(dep_edges(spark, sf)).crossJoin(F.broadcast(total))  # one row
    return scored.select("origin", risk_label(F.col("blast_score"), F.col("total")).alias("risk"), affected_pct("direct", "transitive", F.col("total").cast("double")).alias("pct"))


@query(f"WITH RECURSIVE {DEP}, {BLAST}, {LATEST} SELECT origin FROM bl WHERE floor(blast_score) >= 10 AND origin IN (SELECT path FROM paths)")
def staged_gate(spark, sf):
    """The pre-commit gate: staged files whose floored score reaches the threshold; the latest parts stand for staged."""
    staged = latest(spark, sf).withColumnRenamed("path", "origin")
    scored = blast_counts(dep_edges(spark, sf))
    return scored.where(F.floor("blast_score") >= 10).join(staged, "origin", "left_semi").select("origin")


def _centre(edges):
    return edges.groupBy(F.col("dst").alias("origin")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "origin").limit(1).select("origin")


_START = "start AS (SELECT dst AS origin FROM dep GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _around(moves: str, depth: int) -> str:
    return f"WITH RECURSIVE {DEP}, {_START}, moves AS ({moves}), n(node, hop) AS (SELECT origin, 0 FROM start UNION SELECT m.b, n.hop + 1 FROM n JOIN moves m ON m.a = n.node WHERE n.hop < {depth}) SELECT origin, node, min(hop) AS hop FROM n, start GROUP BY 1, 2"


_UP, _DOWN = "SELECT dst AS a, src AS b FROM dep", "SELECT src AS a, dst AS b FROM dep"


@query(_around(_UP, 2))
def neighborhood_dependents(spark, sf):
    edges = stored(dep_edges(spark, sf).select("src", "dst"))
    return graph.reach(edges, stored(_centre(edges)), 2, "dependents")


@query(_around(_DOWN, 2))
def neighborhood_dependencies(spark, sf):
    edges = stored(dep_edges(spark, sf).select("src", "dst"))
    return graph.reach(edges, stored(_centre(edges)), 2, "dependencies")


@query(_around(f"{_UP} UNION {_DOWN}", 2))
def neighborhood_both(spark, sf):
    edges = stored(dep_edges(spark, sf).select("src", "dst"))
    return graph.reach(edges, stored(_centre(edges)), 2, "both")


@query(f"WITH RECURSIVE {DEP}, {_START}, n(node, hop) AS (SELECT origin, 0 FROM start UNION SELECT d.src, n.hop + 1 FROM n JOIN dep d ON d.dst = n.node WHERE n.hop < 40) SELECT node, min(hop) AS hop FROM n GROUP BY 1")
def impact_of_one(spark, sf):
    """Single-origin closure: work in proportion to what the origin reaches."""
    edges = stored(dep_edges(spark, sf).select("src", "dst"))
    return graph.reach(edges, stored(_centre(edges)), None, "dependents").select("node", "hop")


@query(f"""WITH RECURSIVE {DEP}, {LATEST}, origins AS (SELECT path AS origin FROM paths), {CLOSURE}, known AS (SELECT * FROM clo UNION ALL SELECT origin, origin, 0 FROM origins),
nx AS MATERIALIZED (SELECT c.origin, c.node, c.hop, min(d.dst) AS next FROM clo c JOIN dep d ON d.src = c.node JOIN known k ON k.origin = c.origin AND k.node = d.dst AND k.hop = c.hop - 1 GROUP BY 1, 2, 3),
w(origin, node, hop, here, path) AS (SELECT origin, node, hop, next, node || '>' || next FROM nx UNION ALL SELECT w.origin, w.node, w.hop, nx.next, w.path || '>' || nx.next FROM w JOIN nx ON nx.origin = w.origin AND nx.node = w.here)
SELECT origin, node, hop, path FROM w WHERE here = origin""")
def shortest_dep_path(spark, sf):
    """How the latest parts' dependents come to depend on them: the smallest of the shortest paths of each pair."""
    starts = latest(spark, sf).withColumnRenamed("path", "origin")
    return graph.shortest_paths(dep_edges(spark, sf), starts).select("origin", "node", "hop", F.array_join("path", ">").alias("path"))


@query(f"WITH {DEP}, seeds AS (SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT dst FROM dep GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)), near AS (SELECT dst AS owner FROM dep WHERE src IN (SELECT id FROM seeds) UNION SELECT src FROM dep WHERE dst IN (SELECT id FROM seeds)) SELECT owner AS id FROM near WHERE owner NOT IN (SELECT id FROM seeds) ORDER BY 1 LIMIT 25")
def graph_expand(spark, sf):
    e = dep_edges(spark, sf)
    owners = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("owner"))
    seeds = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "id").limit(5).select("id")
    return graph.expand(e, owners, seeds, 25).select("id")


@query(f"WITH {DEP}, {NODES}, ok AS (SELECT id FROM nodes WHERE node_type <> 'import') SELECT src, dst, weight FROM dep WHERE src IN (SELECT id FROM ok) AND dst IN (SELECT id FROM ok)")
def edge_endpoint_validity(spark, sf):
    return graph.valid_edges(dep_edges(spark, sf), nodes(spark, sf).where("node_type <> 'import'"))


@query(f"WITH {DEP}, {NODES} SELECT d.src, d.dst, CASE WHEN a.node_type = 'style' OR b.node_type = 'style' THEN 'styles' WHEN a.node_type = 'service' OR b.node_type = 'service' THEN 'depends' WHEN a.node_type IN ('component', 'route') AND b.node_type IN ('component', 'route') THEN 'renders' ELSE 'imports' END AS kind FROM dep d LEFT JOIN nodes a ON a.id = d.src LEFT JOIN nodes b ON b.id = d.dst")
def link_kinds(spark, sf):
    n = nodes(spark, sf)
    a, b = n.select(F.col("id").alias("src"), F.col("node_type").alias("_s")), n.select(F.col("id").alias("dst"), F.col("node_type").alias("_t"))
    return dep_edges(spark, sf).join(a, "src", "left").join(b, "dst", "left").select("src", "dst", link_kind(F.col("_s"), F.col("_t")).alias("kind"))


@query(f"WITH {NODES} SELECT id, node_type, CASE WHEN node_type = 'service' THEN 'infrastructure' WHEN p_size % 3 = 0 THEN 'frontend' WHEN p_size % 3 = 1 THEN 'infrastructure' ELSE 'backend' END AS layer FROM nodes")
def assign_layer(spark, sf):
    language = F.expr("case p_size % 3 when 0 then 'typescript' when 1 then 'terraform' else 'python' end")
    return nodes(spark, sf).select("id", "node_type", layer(F.col("node_type"), language).alias("layer"))


@query(f"WITH {NODES} SELECT node_type, count(*) AS nodes, sum(p_size)::BIGINT AS loc FROM nodes WHERE coalesce(node_type, 'module') IN ('module', 'component', 'hook', 'store', 'route', 'config') GROUP BY 1")
def source_type_totals(spark, sf):
    return nodes(spark, sf).where(F.coalesce("node_type", F.lit("module")).isin(*SOURCE_TYPES)).groupBy("node_type").agg(F.count("*").alias("nodes"), F.sum("p_size").alias("loc"))


@query("SELECT p_partkey AS id, p_name AS name, p_brand AS kind, p_size AS line FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def symbol_lookup(spark, sf):
    p = table(spark, sf, "part")
    first = p.agg(F.min("p_name").alias("p_name"))
    return p.join(F.broadcast(first), "p_name").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.col("p_size").alias("line"))  # one name


@query("SELECT p_partkey AS id, p_name AS name, p_size AS line FROM part WHERE p_brand = 'Brand#11' AND p_retailprice > 950")
def exported_by_file(spark, sf):
    return table(spark, sf, "part").where("p_brand = 'Brand#11' and p_retailprice > 950").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("line"))


@query(f"WITH {DEP} SELECT f.p_partkey AS file_id, i.p_partkey AS importer_id, i.p_name AS importer FROM dep JOIN part f ON f.p_partkey = dst JOIN part i ON i.p_partkey = src WHERE f.p_brand = 'Brand#11'")
def importers(spark, sf):
    p = table(spark, sf, "part")
    f = p.where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("dst"))
    i = p.select(F.col("p_partkey").alias("src"), F.col("p_name").alias("importer"))
    return dep_edges(spark, sf).join(f, "dst").join(i, "src").select(F.col("dst").alias("file_id"), F.col("src").alias("importer_id"), "importer")


@query(f"WITH {DEP}, {LATEST} SELECT src, dst, weight, (src IN (SELECT path FROM paths) OR dst IN (SELECT path FROM paths)) AS touched FROM dep")
def touched_edges(spark, sf):
    from ..operators.temporal import touched

    return touched(dep_edges(spark, sf), latest(spark, sf))


@query(f"WITH {DEP}, {LATEST}, t AS (SELECT (src IN (SELECT path FROM paths) OR dst IN (SELECT path FROM paths)) AS touched FROM dep) SELECT count(*) FILTER (touched) AS shown, count(*) FILTER (NOT touched) AS suppressed FROM t")
def suppressed_count(spark, sf):
    return touched_edges(spark, sf).agg(F.count_if("touched").alias("shown"), F.count_if(~F.col("touched")).alias("suppressed"))
