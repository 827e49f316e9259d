"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, dropped, held, stored, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _lowest(edges: DataFrame) -> DataFrame:
    """(w, m): the smallest neighbour of every node. It is written and, if few, broadcast: a node with very many edges
    then stays spread over the tasks that hold them, and beyond that both sides are plain tables whose hot keys can be split."""
    return held(stored(edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both)
    out = both.join(low, both.u == low.w).where("v > u").select(F.col("v").alias("u"), F.least("w", "m").alias("v"))
    return stored(out.where("u <> v").distinct())


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    joined = down.join(low, down.u == low.w)
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return stored(joined.select(F.explode(pairs).alias("p")).select("p.u", "p.v").where("u <> v").distinct())


def local(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, comps) of the edges u[i], v[i]: hooks every root to the smallest root beside it and halves the paths."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge; comp is the smallest node that it reaches.

    Up to BROADCAST_ROWS edges, by count, are solved in the driver (4 MB). Beyond that each round is written to the shared scratch folder, so lineage stays short and a lost executor
    costs one round; the rounds before it are deleted. Rounds grow with the logarithm of the component size. No edge:
    no row. Null ends and self-loops are ignored."""
    spark, start = edges.sparkSession, written()
    state = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    before = _state(state)
    if before[0] <= BROADCAST_ROWS:
        got = state.toArrow()
        node, comp = local(*(got.column(c).to_numpy() for c in ("u", "v")))
        out = stored(spark.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "comp": pa.array(comp, pa.int64())}), "node long, comp long"))
        dropped(spark, start, written() - 1)
        return out
    while before[0]:
        state, stop = _small(_large(state)), written() - 1
        after = _state(state)
        dropped(spark, start, stop)
        start = stop
        if after == before:
            break
        before = after
    leaves = state.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = stored(leaves.unionByName(leaves.select(F.col("comp").alias("node"), "comp")).distinct())
    dropped(spark, start, written() - 1)
    return out
