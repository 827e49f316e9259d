"""Exact top-k inner-product search with a cover tree over all vectors and one over the queries.

One tree serves both. Its shape comes from a bounded sample of vectors (about N / SHARE of them, at most CENTRES): a node of level l
covers its sample points within 2**l of its centre, and its children's centres lie more than 2**(l-1) apart. Every
vector then goes down to the nearest child until a leaf; leaves keep the exact radius and count of all their vectors,
and of their queries by themselves (the query tree), and inner nodes bound theirs by the triangle inequality. Leaves
are laid in blocks of bounded size in the tree's order, so a block is a part of the tree.

Queries first meet the block of their own leaf. That gives every leaf of the query tree its worst k-th score, and the
two trees are walked together from their roots: with centres q, c and radii r, s no score exceeds
q.c + |q| s + |c| r + r s, so a pair below the worst k-th score of all queries of its node is pruned with all beneath
it. Queries move only to blocks that keep a leaf, packed by leaf; vectors never move twice. In a block the leaves are
taken from the highest bound down, again pruned by each query's own k-th score. k candidates a query and block are ranked.

Scores are exact integers: float64 while all products stay below 2**53, Python integers beyond. Of equal vectors only
the smallest ids can count, so a batch sends no more of them. Where data do not prune (random directions in many
dimensions), every query meets every block, and work is queries x vectors; compared() reports the share.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, ship, stored
from .ngram_join import by_group

CENTRES, SHARE, BLOCK_NUMBERS, GROUP = 1024, 64, 1 << 22, 128
LIMIT = (1 << 63) - 1


class Tree:
    """Nodes in depth-first order: centre, parent (-1 for the root), stop (one past its last descendant), leaf number."""

    def __init__(self, sample: np.ndarray):
        self.centre, self.parent, self.stop, self.leaf = [], [], [], []
        self.leaves = 0
        far = np.sqrt(((sample - sample[0]) ** 2).sum(1).max(initial=0))
        self._add(sample, np.arange(len(sample)), -1, int(np.ceil(np.log2(far))) if far > 0 else None)
        self.centre = np.stack(self.centre)
        self.norm = np.sqrt((self.centre**2).sum(1))
        self.parent, self.stop, self.leaf = np.array(self.parent), np.array(self.stop), np.array(self.leaf)
        self.at = np.flatnonzero(self.leaf >= 0)  # node of each leaf
        self.children = [np.flatnonzero(self.parent == i) for i in range(len(self.parent))]
        self.step = np.sqrt(((self.centre - self.centre[np.maximum(self.parent, 0)]) ** 2).sum(1))

    def _add(self, x: np.ndarray, points: np.ndarray, parent: int, level: int | None) -> None:
        me = len(self.centre)
        self.centre.append(x[points[0]])
        self.parent.append(parent)
        self.stop.append(0)
        self.leaf.append(-1)
        groups = []
        while level is not None and len(groups) < 2 and level > -64:
            groups, rest = [], points
            while len(rest):
                near = ((x[rest] - x[rest[0]]) ** 2).sum(1) <= 4.0 ** (level - 1)
                groups.append(rest[near])
                rest = rest[~near]
            level -= 1
            if ((x[points] - x[points[0]]) ** 2).sum(1).max(initial=0) == 0:
                break
        if len(groups) < 2:
            self.leaf[me] = self.leaves
            self.leaves += 1
        else:
            for g in groups:
                self._add(x, g, me, level if len(g) > 1 else None)
        self.stop[me] = len(self.centre)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of every row and its distance to the leaf's centre."""
        node = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            kids = self.children[at]
            if not len(kids):
                node[rows] = at
                continue
            c = self.centre[kids]
            half = (c * c).sum(1) / 2
            for lo in range(0, len(rows), 4096):
                part = rows[lo : lo + 4096]
                best = np.argmax(x[part] @ c.T - half, axis=1)
                todo += [(int(kids[b]), part[best == b]) for b in np.unique(best)]
        return self.leaf[node], np.sqrt(((x - self.centre[node]) ** 2).sum(1))

    def spread(self, radius: np.ndarray) -> np.ndarray:
        """Radii of all nodes from those of the leaves; -1 where nothing is beneath."""
        out = np.full(len(self.parent), -1.0)
        out[self.at] = radius
        for i in range(len(out) - 1, 0, -1):
            if out[i] >= 0:
                p = self.parent[i]
                out[p] = max(out[p], out[i] + self.step[i])
        return out

    def survivors(self, radius: np.ndarray, q_radius: np.ndarray, worst: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Walks both trees from their roots: for each leaf with queries the leaves that a score may still come from."""
        r, s = self.spread(radius), self.spread(q_radius)
        low = np.full(len(r), np.inf)
        low[self.at] = worst
        for i in range(len(r) - 1, 0, -1):
            low[self.parent[i]] = min(low[self.parent[i]], low[i])
        todo = [(0, np.array([0]))]
        while todo:
            a, front = todo.pop()
            if s[a] < 0:
                continue
            front = front[r[front] >= 0]
            front = front[self.bound(self.centre[a], self.norm[a], s[a], front, r) >= low[a]]
            if not len(front):
                continue
            inner = front[self.leaf[front] < 0]
            down = np.concatenate([front[self.leaf[front] >= 0], *(self.children[i] for i in inner)])
            if self.leaf[a] < 0:
                todo += [(int(c), down) for c in self.children[a]]
            elif len(inner):
                todo.append((a, down))
            else:
                yield int(self.leaf[a]), self.leaf[front]

    def bound(self, q: np.ndarray, q_norm: float, s: float, nodes: np.ndarray, r: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            b = self.centre[nodes] @ q + q_norm * r[nodes] + self.norm[nodes] * s + r[nodes] * s
            b = b + np.abs(b) * 1e-9 + 1
        return np.where(np.isnan(b), np.inf, b)


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id. Scores are float64 or, if wide, objects."""

    def __init__(self, ids: np.ndarray, k: int, wide: bool):
        kind = object if wide else np.float64
        self.own, self.k = ids, k
        self.score = np.full((len(ids), k), -np.inf, kind)
        self.id = np.full((len(ids), k), LIMIT, np.int64)
        self.found = np.zeros(len(ids), np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        hopeful = np.flatnonzero((scores >= self.score[rows, -1][:, None]).any(1))
        for r, s in zip(rows[hopeful].tolist(), scores[hopeful], strict=True):
            ok = (s >= self.score[r, -1]) & (ids != self.own[r])
            if ok.any():
                a, b = np.concatenate([self.score[r][: self.found[r]], s[ok]]), np.concatenate([self.id[r][: self.found[r]], ids[ok]])
                order = sorted(range(len(a)), key=lambda i: (-a[i], b[i]))[: self.k] if a.dtype == object else np.lexsort((b, -a))[: self.k]
                self.found[r] = len(order)
                self.score[r, : len(order)], self.id[r, : len(order)] = a[order], b[order]


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as Python integers."""
    return np.array([[int(np.floor(Fraction(v) * 1024)) if abs(v) < 1e15 else int(v) * 1024 for v in row] for row in x.tolist()], object).reshape(x.shape)


def _shrunk(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k best of a query: of equal vectors the k + 1 smallest ids, k rows of each."""
    if len(ids) <= k:
        return np.arange(len(ids))
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)[1] if x.shape[1] else np.zeros(len(ids), np.int64)
    order = np.lexsort((ids, same))
    g, i = same[order], ids[order]
    new_g = np.append(True, g[1:] != g[:-1])
    new_i = new_g | np.append(True, i[1:] != i[:-1])
    nth_id = np.cumsum(new_i) - np.maximum.accumulate(np.where(new_g, np.cumsum(new_i), 0))
    pos = np.arange(len(i))
    nth_row = pos - np.maximum.accumulate(np.where(new_i, pos, 0))
    return np.sort(order[(nth_id <= k) & (nth_row < k)])


def _matrix(b: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    column = b.column("x")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, dim) if dim else np.zeros((b.num_rows, 0))


def _placed(trees: dict[int, Tree], k: int, asks: bool):
    """Rows with their leaf and their distance to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                x, ids = _matrix(part, dim), np.asarray(part.column("vec_id"))
                if not asks:
                    keep = _shrunk(ids, x, k)
                    part, x = part.take(pa.array(keep)), x[keep]
                with np.errstate(all="ignore"):
                    leaf, far = trees[dim].assign(np.floor(x * 1024.0)) if dim in trees else (np.zeros(len(x), np.int64), np.full(len(x), np.inf))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("dim"), pa.array(leaf), pa.array(far), part.column("x")], ["vec_id", "dim", "leaf", "far", "x"])

    return run


def _met(trees: dict[int, Tree], radii: dict[int, np.ndarray], k: int, share: bool = False):
    """Residents of a block first (role 0, by leaf), then queries in groups (role 1): their k best in this block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        key, held, home = None, [], None
        for b in batches:
            for t in by_group(iter([b]), ["dim", "block", "role"]):
                dim, now, role = t.column("dim")[0].as_py(), (t.column("dim")[0].as_py(), t.column("block")[0].as_py()), t.column("role")[0].as_py()
                if now != key:
                    key, held, home = now, [], None
                if role == 0:
                    held.append(t)
                    continue
                if not held:
                    continue
                if home is None:
                    whole = pa.concat_tables(held)
                    order = np.argsort(np.asarray(whole.column("leaf")), kind="stable")
                    whole = whole.take(pa.array(order))
                    leaf = np.asarray(whole.column("leaf"))
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)]])
                    home = (np.asarray(whole.column("vec_id")), _matrix(whole, dim), leaf[cut[:-1]], cut)
                t = t.take(pa.array(np.argsort(np.asarray(t.column("leaf")), kind="stable")))  # near queries share a group
                rows = _search(trees.get(dim), radii.get(dim), home, np.asarray(t.column("vec_id")), _matrix(t, dim), k)
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["query_id", "vec_id", "score", "compared"])

    return run


def _search(tree: Tree | None, radius: np.ndarray | None, home: tuple, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    ids, x, leaves, cut = home
    with np.errstate(all="ignore"):
        a, b = np.floor(q * 1024.0), np.floor(x * 1024.0)
        top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    wide = not top * top * max(1, a.shape[1]) < 2.0**53
    for lo in range(0, len(q_ids), GROUP):
        g, own = a[lo : lo + GROUP], q_ids[lo : lo + GROUP]
        best = Best(own, k, wide)
        if wide:
            g_exact, b_exact = _whole(q[lo : lo + GROUP]), _whole(x)
        n = np.zeros(len(own), np.int64)
        if tree is None:
            most = np.full((len(own), len(leaves)), np.inf)
        else:
            with np.errstate(all="ignore"):
                node = tree.at[leaves]
                most = g @ tree.centre[node].T + np.sqrt((g * g).sum(1))[:, None] * radius[leaves]
                most = np.where(np.isnan(most), np.inf, most + np.abs(most) * 1e-9 + 1)
        seeds = most.argmax(1)  # every query's most promising leaf comes first and gives its first k-th score
        todo = np.ones(most.shape, bool)
        order = [(int(j), seeds == j) for j in np.unique(seeds)] + [(int(j), None) for j in np.argsort(-most.max(0), kind="stable")]
        for j, only in order:
            ask = todo[:, j] & (only if only is not None else most[:, j] >= best.score[:, -1].astype(np.float64) if not wide else True)
            rows = np.flatnonzero(ask)
            todo[rows, j] = False
            if not len(rows):
                continue
            for at in range(int(cut[j]), int(cut[j + 1]), 4096):
                to = min(at + 4096, int(cut[j + 1]))
                scores = np.clip(g_exact[rows] @ b_exact[at:to].T, -LIMIT - 1, LIMIT) if wide else g[rows] @ b[at:to].T
                best.offer(rows, scores, ids[at:to])
                n[rows] += to - at
        for i, own_id in enumerate(own.tolist()):
            for c in range(int(best.found[i])):
                yield own_id, int(best.id[i, c]), int(best.score[i, c]), int(n[i]) if c == 0 else 0


def candidates(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """query_id, vec_id, score, compared: at least the k best of every query; compared adds up to the scored pairs."""
    spark = vectors.sparkSession
    ship(spark)
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    x = x.where("forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))").withColumn("dim", F.size("x")).select("vec_id", "dim", "x")
    sizes = {r["dim"]: r["count"] for r in x.groupBy("dim").count().orderBy(F.desc("count")).limit(64).collect()}  # other lengths have no tree
    trees = {}
    for dim, n in sizes.items():
        if dim and n > SHARE:
            some = x.where(F.col("dim") == dim).orderBy(F.xxhash64("x"), "vec_id").limit(min(CENTRES, -(-n // SHARE))).select("x").collect()
            with np.errstate(all="ignore"):
                sample = np.floor(np.array([r["x"] for r in some]) * 1024.0)
                if (sample * sample).sum(1).max() < 1e300:
                    trees[dim] = Tree(sample)
    schema = "vec_id long, dim int, leaf long, far double, x array<double>"
    data = stored(x.mapInArrow(_placed(trees, k, False), schema))
    asked = x.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "x")).alias("v")).select("vec_id", "v.dim", "v.x")
    asked = stored(asked.mapInArrow(_placed(trees, k, True), schema))
    cells = data.groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).where(F.col("dim").isin(*trees)) if trees else None
    radii, blocks, per = {}, {}, {}
    found = {d: [] for d in trees}
    for r in cells.collect() if trees else []:  # at most CENTRES rows for each of the trees
        found[r["dim"]].append((r["leaf"], r["n"], r["far"]))
    for dim, rows in found.items():
        room, radius = max(1, BLOCK_NUMBERS // max(1, dim)), np.full(trees[dim].leaves, -1.0)
        first, parts, block, filled = np.zeros(trees[dim].leaves, np.int64), np.ones(trees[dim].leaves, np.int64), 0, 0
        for leaf, n, far in sorted(rows):
            radius[leaf] = far * (1 + 1e-9) if np.isfinite(far) else np.inf
            if filled and filled + n > room:
                block, filled = block + 1, 0
            first[leaf], parts[leaf] = block, max(1, -(-n // room))
            filled += n
            if parts[leaf] > 1:
                block, filled = block + int(parts[leaf]), 0
        radii[dim], blocks[dim], per[dim] = radius, first, parts

    def block_of(rows: DataFrame) -> DataFrame:
        """Residents by block: a leaf's first block, and one of its parts by hash where it has several."""
        table = [(d, leaf, int(blocks[d][leaf]), int(per[d][leaf])) for d in trees for leaf in range(trees[d].leaves)]
        plan = F.broadcast(spark.createDataFrame(table, "dim int, leaf long, first long, parts long"))  # at most CENTRES rows a tree
        return rows.join(plan, ["dim", "leaf"], "left").withColumn("block", F.coalesce(F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")), F.lit(0).cast("long")))

    residents = block_of(data).select("dim", "block", F.lit(0).alias("role"), "leaf", "vec_id", "x")

    def meet(visits: DataFrame) -> DataFrame:
        both = residents.unionByName(visits.select("dim", "block", F.lit(1).alias("role"), "leaf", "vec_id", "x"))
        both = both.repartition("dim", "block").sortWithinPartitions("dim", "block", "role")
        return both.mapInArrow(_met(trees, radii, k), "query_id long, vec_id long, score long, compared long")

    def to_blocks(pairs: dict[tuple[int, int], list[int]]) -> DataFrame:
        rows = [(d, leaf, b) for (d, leaf), own in pairs.items() for b in own]
        return asked.join(F.broadcast(spark.createDataFrame(rows, "dim int, leaf long, block long")), ["dim", "leaf"])

    home = {(d, leaf): list(range(int(blocks[d][leaf]), int(blocks[d][leaf] + per[d][leaf]))) for d in trees for leaf in range(trees[d].leaves)}
    plain = asked.where(~F.col("dim").isin(*trees)).withColumn("block", F.lit(0).cast("long")) if trees else asked.withColumn("block", F.lit(0).cast("long"))
    visits = plain.select("dim", "leaf", "block", "vec_id", "x")
    if trees:
        visits = visits.unionByName(to_blocks(home).select(*visits.columns))
    done = stored(meet(visits))
    every_block = {d: int((blocks[d] + per[d]).max()) for d in trees}
    if all(n <= 1 for n in every_block.values()):
        return done
    kth = done.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s")).select(F.col("query_id").alias("vec_id"), F.when(F.size("s") >= k, F.element_at("s", k)).alias("kth"))
    worst = asked.join(kth, "vec_id", "left").groupBy("dim", "leaf").agg(F.max("far").alias("far"), F.min(F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf")))).alias("worst"))
    pairs: dict[tuple[int, int], list[int]] = {}
    q_radius, low = {d: np.full(t.leaves, -1.0) for d, t in trees.items()}, {d: np.full(t.leaves, np.inf) for d, t in trees.items()}
    for r in worst.where(F.col("dim").isin(*trees)).collect():  # a row for each leaf of a tree
        q_radius[r["dim"]][r["leaf"]], low[r["dim"]][r["leaf"]] = r["far"] * (1 + 1e-9), r["worst"]
    for d, tree in trees.items():
        for leaf, others in tree.survivors(radii[d], q_radius[d], low[d]):
            more = {b for o in others.tolist() for b in range(int(blocks[d][o]), int(blocks[d][o] + per[d][o]))} - set(home[d, leaf])
            if more:
                pairs.setdefault((d, leaf), []).extend(sorted(more))
    return done.unionByName(meet(to_blocks(pairs))) if pairs else done


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each vector whose vec_id is divisible by `every`, the k other
    vectors with the highest integer inner product of floor(1024 * x); ties go to the smaller vec_id.

    vectors: vec_id long, embedding array of numbers; other columns are ignored. Rows whose vec_id or embedding is
    null, or that hold a null or non-finite component, take no part. Vectors meet only those of their own length; empty
    vectors score 0. Rows that repeat a vec_id are candidates of their own for other ids; a repeated query is asked once,
    with the shortest and then smallest of its vectors. Scores that a long cannot hold are its ends. An empty table gives
    an empty result."""
    found = candidates(vectors, k, every)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def compared(vectors: DataFrame, k: int = 10, every: int = 100) -> float:
    """Share of the pairs of queries and vectors that were scored."""
    asked = vectors.where(F.col("vec_id") % every == 0).count()
    return (candidates(vectors, k, every).agg(F.sum("compared")).first()[0] or 0) / max(1, asked * vectors.count())
