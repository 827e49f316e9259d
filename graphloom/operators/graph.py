"""Graph operators over edges (src, dst): src depends on dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.risk import blast_score
from ..scratch import discard, stored
from . import islands
from .numbering import numbered
from .reach import reach_many, shortest_paths_to


def weighted(pairs: DataFrame, by: tuple[str, ...] = ("src", "dst"), weight: Column | None = None) -> DataFrame:
    """Weights of links summed over occurrences and analysers."""
    return pairs.groupBy(*by).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("weight"))


def valid_edges(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges both of whose ends are nodes."""
    n = nodes.select(F.col(key).alias("_n")).distinct()
    return edges.join(n, edges["src"] == n["_n"], "left_semi").join(n, edges["dst"] == n["_n"], "left_semi")


def listed(edges: DataFrame, key: str, value: str, most: int = 1000) -> DataFrame:
    """(id, part, total, values): each key's values in order, at most `most` in a row, so that no row grows with a hub.

    Rows are numbered over all keys at once by ranges, which cut a hub's rows too; values are not de-duplicated."""
    rows = numbered(edges.select(F.col(key).alias("id"), F.col(value).alias("value")), [F.col("id"), F.col("value")], "_at")
    first = rows.groupBy("id").agg(F.min("_at").alias("_first"), F.count("*").alias("total"))
    part = F.floor((F.col("_at") - F.col("_first")) / most).alias("part")
    return rows.join(first, "id").groupBy("id", "total", part).agg(F.sort_array(F.collect_list("value")).alias("values"))


def adjacency(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(id, part, imports, imported_by): both lists of a node, `most` entries of each in a row."""
    out = listed(edges, "src", "dst", most).select("id", "part", F.col("values").alias("imports"))
    into = listed(edges, "dst", "src", most).select("id", "part", F.col("values").alias("imported_by"))
    return out.join(into, ["id", "part"], "full")


def closure(edges: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """(origin, node, hop) for every node that reaches origin along edges; hop is the shortest length.

    origins (a column origin) are all nodes with a way in if not given; they are searched together, as bitmaps: inside
    islands that a task can hold by one task each, in larger ones by joins. A node is not its own dependent, except by a
    self-loop, which counts as a direct one."""
    starts = edges.select(F.col("dst").alias("origin")) if origins is None else origins
    loops = edges.where("src = dst").select(F.col("dst").alias("origin"), F.col("src").alias("node"), F.lit(1).alias("hop")).distinct()
    if origins is not None:
        loops = loops.join(origins.select("origin").distinct(), "origin", "left_semi")
    rows, left, others = islands.search(edges.where("src <> dst"), starts)
    if left is not None:
        rows = rows.unionByName(reach_many(left, others).rows())
    return rows.unionByName(loops)


def reach(edges: DataFrame, origins: DataFrame, depth: int | None = None, direction: str = "dependents") -> DataFrame:
    """(origin, node, hop) by breadth-first search from origins (a column origin), origin itself at hop 0.

    With a depth the plan is unrolled; without one the edges and each level are written out, until no node is new."""
    step = {"dependents": [("dst", "src")], "dependencies": [("src", "dst")], "both": [("dst", "src"), ("src", "dst")]}[direction]
    moves = None
    for a, b in step:
        m = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"))
        moves = m if moves is None else moves.unionByName(m)
    moves = stored(moves) if depth is None else moves.distinct()  # else each level would work the edges out anew
    seen = origins.select("origin", F.col("origin").alias("node"), F.lit(0).alias("hop")).distinct()
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        fresh = front.join(moves, front["node"] == moves["_from"]).select("origin", F.col("_to").alias("node")).distinct()
        front = fresh.join(seen, ["origin", "node"], "left_anti").withColumn("hop", F.lit(level))
        if depth is None:
            front = stored(front)
            if front.isEmpty():
                discard(front)
                break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """(origin, node, hop, path): the smallest of the shortest paths [node, ..., origin], by element; to all nodes if no
    origins are given."""
    starts = edges.select(F.col("dst").alias("origin")) if origins is None else origins
    rows, left, others = islands.search(edges.where("src <> dst"), starts, paths=True)
    return rows if left is None else rows.unionByName(shortest_paths_to(left, others))


def next_steps(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(node, next): for nodes (node, hop) reached from one origin the smallest next node on a shortest path to it."""
    here = reached.select(F.col("node").alias("src"), "hop")
    there = reached.select(F.col("node").alias("dst"), (F.col("hop") + 1).alias("hop"))
    return edges.select("src", "dst").join(here, "src").join(there, ["dst", "hop"]).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"))


def blast(reached: DataFrame) -> DataFrame:
    """origin, direct, transitive and score from (origin, node, hop)."""
    counts = reached.where("hop > 0").groupBy("origin").agg(F.count_if(F.col("hop") == 1).alias("direct"), F.count_if(F.col("hop") > 1).alias("transitive"))
    return counts.select("origin", "direct", "transitive", blast_score("direct", "transitive").alias("blast_score"))


def high_blast(scored: DataFrame, threshold: float, types: list[str]) -> DataFrame:
    return scored.where((F.col("blast_score") >= threshold) & ~F.col("node_type").isin(*types))


def expand(edges: DataFrame, owners: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """Items (id, owner) of the owners next to the seeds' owners, seeds left out, the `most` smallest ids."""
    start = owners.join(seeds, "id", "left_semi").select("owner").distinct()
    out = edges.join(start, edges["src"] == start["owner"], "left_semi").select(F.col("dst").alias("owner"))
    into = edges.join(start, edges["dst"] == start["owner"], "left_semi").select(F.col("src").alias("owner"))
    near = out.unionByName(into).distinct()
    return owners.join(near, "owner", "left_semi").join(seeds, "id", "left_anti").orderBy("id").limit(most)


def importers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, importer) over edges by file id."""
    a, b = files.select(F.col("id").alias("dst"), "path"), files.select(F.col("id").alias("src"), F.col("path").alias("importer"))
    return edges.join(a, "dst").join(b, "src").select("path", "importer")
