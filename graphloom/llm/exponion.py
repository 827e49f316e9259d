"""Exact k-means of integer vectors by exponion search.

Every vector keeps an upper bound on the distance to its centroid and a lower bound on that to any other one. After
centroids have moved, the bounds are loosened by how far they moved. A vector is settled if its upper bound lies below
the lower one or below half the way to the nearest other centroid. Else its distance is computed, and if that does not
settle it, only centroids in a ball around its own one are looked at: within twice the upper bound plus the way to the
nearest other centroid, a prefix of its own one's list of centroids by distance. The ball is closed and comparisons that
settle a vector are strict, so that ties are seen and go to the smaller number. Squared distances are exact integers;
bounds are floating-point numbers rounded to the safe side.

Vectors live in blocks (a row for some thousand vectors with their bounds), rewritten once a round, so no round shuffles
them; what travels are sums per centroid and component, added up on the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, dropped, ship, stored, written

LIMIT = 1 << 27  #: components of greater size count as this, so that squared distances of 64 of them fit a long
BLOCK = 4096
UP, DOWN = 1 + 1e-6, 1 - 1e-6  #: slack of bounds, which are held in single precision
STATE = "n int, wide int, ids binary, known binary, vecs binary, own binary, upper binary, lower binary, scored long"
NAMES = [c.split()[0] for c in STATE.split(", ")]


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a double, cut at LIMIT."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(float(scale))).cast("double"), F.lit(float(-LIMIT))), F.lit(float(LIMIT))).cast("int"))


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, none null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & ~F.coalesce(bad, F.lit(True))


def starts(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed:id, in that order. Vectors with null ids come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("vec", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "vec").limit(k).collect()
    return np.array([r["vec"] for r in rows], np.int64)


def gaps(centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all centroids, exact."""
    return np.stack([((centroids - c) ** 2).sum(1) for c in centroids])


class Ball:
    """For every centroid the others by distance, itself first, and half the way to the nearest one."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        root = np.sqrt(gaps(centroids).astype(np.float64))
        np.fill_diagonal(root, -1.0)
        self.order = np.argsort(root, axis=1, kind="stable")
        self.far = np.take_along_axis(root, self.order, 1)
        self.far[:, 0] = 0.0
        self.near = self.far[:, 1] if len(centroids) > 1 else np.full(len(centroids), np.inf)

    def search(self, vecs: np.ndarray, own: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest centroid (ties: the smaller number), its squared distance, the squared distance of the second nearest
        one, each within the ball around the own one, how far the ball reached, and how many distances were computed."""
        best, first, second = own.copy(), np.full(len(vecs), np.iinfo(np.int64).max), np.full(len(vecs), np.iinfo(np.int64).max)
        scored = 0
        for a in np.unique(own).tolist():
            at = np.flatnonzero(own == a)
            # what lies beyond the ball is farther than both the own and its nearest neighbour
            reach = (2 * upper[at] + self.near[a]) * UP
            count = np.searchsorted(self.far[a], reach, side="right")
            by = np.argsort(-count, kind="stable")
            at, count = at[by], count[by]
            mine = vecs[at]
            for p in range(int(count[0])):
                m = int(np.searchsorted(-count, -p, side="left"))
                c = int(self.order[a, p])
                d = ((mine[:m] - self.centroids[c]) ** 2).sum(1)
                scored += m
                rows = at[:m]
                wins = (d < first[rows]) | ((d == first[rows]) & (c < best[rows]))
                second[rows] = np.where(wins, first[rows], np.minimum(second[rows], d))
                first[rows] = np.where(wins, d, first[rows])
                best[rows] = np.where(wins, c, best[rows])
        return best, first, second, scored

    def settle(self, vecs: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New own, upper and lower, and how many distances were computed."""
        own, upper, lower = own.copy(), upper.copy(), lower.copy()
        half = np.maximum(lower, self.near[own] * 0.5 * DOWN)
        rows = np.flatnonzero(upper >= half)
        scored = 0
        known = rows[np.isfinite(upper[rows])]
        if len(known):
            d = ((vecs[known] - self.centroids[own[known]]) ** 2).sum(1)
            scored += len(known)
            upper[known] = np.sqrt(d.astype(np.float64)) * UP
            rows = rows[upper[rows] >= half[rows]]
        if len(rows):
            best, first, second, seen = self.search(vecs[rows], own[rows], upper[rows])
            scored += seen
            own[rows], upper[rows] = best, np.sqrt(first.astype(np.float64)) * UP
            lower[rows] = np.sqrt(second.astype(np.float64)) * DOWN
        return own, upper, lower, scored


def moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and for each the farthest that another one moved."""
    step = np.sqrt(((new - old) ** 2).sum(1).astype(np.float64)) * UP
    if len(step) < 2:
        return step, np.zeros(len(step))
    first = int(np.argmax(step))
    rest = np.full(len(step), step[first])
    rest[first] = np.delete(step, first).max()
    return step, rest


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    for wide in (2, 4):
        if not x.size or (x.min() >= -(1 << (8 * wide - 1)) and x.max() < 1 << (8 * wide - 1)):
            break
    return wide, x.astype(f"<i{wide}").tobytes()


def _row(n: int, wide: int, ids: bytes, known: bytes, vecs: bytes, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, scored: int) -> tuple:
    return n, wide, ids, known, vecs, own.astype("<i4").tobytes(), upper.astype("<f4").tobytes(), lower.astype("<f4").tobytes(), scored


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.int64()]
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)


def blocks(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, vec) as rows of STATE without bounds: centroid 0, at most infinitely far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                n, ids = part.num_rows, part.column("vec_id")
                wide, vecs = _narrow(part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                key = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                known = (~ids.is_null().to_numpy(zero_copy_only=False)).tobytes()
                yield _batch([_row(n, wide, key, known, vecs, np.zeros(n), np.full(n, np.inf), np.zeros(n), 0)])

    return vectors.select("vec_id", "vec").mapInArrow(run, STATE)


def _opened(b: pa.RecordBatch, dim: int) -> Iterator[tuple]:
    """Of every block: its row, vectors, own, upper, lower."""
    for r in b.to_pylist():
        vecs = np.frombuffer(r["vecs"], f"<i{r['wide']}").reshape(-1, dim).astype(np.int64)
        yield r, vecs, np.frombuffer(r["own"], "<i4").astype(np.int64), np.frombuffer(r["upper"], "<f4").astype(np.float64), np.frombuffer(r["lower"], "<f4").astype(np.float64)


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """Blocks with every vector at its nearest centroid; before: the centroids of the last assignment."""
    dim = centroids.shape[1]
    step, rest = moved(before, centroids) if before is not None else (np.zeros(len(centroids)),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        ball = Ball(centroids)
        for b in batches:
            rows = []
            for r, vecs, own, upper, lower in _opened(b, dim):
                own, upper, lower, scored = ball.settle(vecs, own, (upper + step[own]) * UP, np.maximum(lower - rest[own], 0) * DOWN)
                # single precision must not tighten a bound
                rows.append(_row(r["n"], r["wide"], r["ids"], r["known"], r["vecs"], own, np.nextafter(upper.astype("<f4"), np.float32(np.inf)), np.nextafter(lower.astype("<f4"), np.float32(-np.inf)), scored))
            yield _batch(rows)

    return state.mapInArrow(run, STATE)


def sums(state: DataFrame, k: int, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Number and exact componentwise sums of every centroid's vectors: k * dim rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)  # below 2^63 up to 2^36 vectors a task
        for b in batches:
            for _, vecs, own, _, _ in _opened(b, dim):
                n += np.bincount(own, minlength=k)
                np.add.at(total, own, vecs)
        c = np.flatnonzero(n)
        flat = total[c].ravel()
        cols = [np.repeat(c, dim), np.tile(np.arange(dim), len(c)), np.repeat(n[c], dim), flat >> 32, flat & 0xFFFFFFFF]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["c", "i", "n", "high", "low"])

    rows = state.mapInArrow(run, "c long, i long, n long, high long, low long").groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r["c"], (r["n"], [0] * dim))[1][r["i"]] = (r["high"] << 32) + r["low"]
    return out


def clustered(rows: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, seed: str = "2") -> tuple[DataFrame, np.ndarray, list[int]]:
    """Blocks of STATE, the centroids, and how many distances each assignment computed.

    rows: vec_id and embedding. Vectors of another length, null, or with null or non-finite components take no part.
    Repeated ids are vectors of their own; a null id cannot start a centroid unless ids run out. With fewer vectors than
    k there are as many centroids as vectors. A centroid without vectors stays. Components beyond LIMIT count as LIMIT."""
    ship(rows.sparkSession)
    kept = rows.where(usable(F.col("embedding"), dim)).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("vec"))
    centroids, before, work = starts(kept, k, seed), None, []
    state = blocks(kept)
    if not len(centroids):
        return state, np.empty((0, dim), np.int64), work
    for turn in range(rounds + 1):
        mark = written()
        state = stored(assigned(state, centroids, before))
        if turn:
            dropped(rows.sparkSession, mark - 1, mark)  # the round before
        work.append(state.agg(F.sum("scored")).first()[0])
        before = centroids
        if turn < rounds:
            centroids = before.copy()
            for c, (n, total) in sums(state, len(centroids), dim).items():
                centroids[c] = [x // n for x in total]
    return state, before, work


def cluster_rows(state: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    """vec_id, cluster and squared distance of every vector in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        for b in batches:
            for r, vecs, own, _, _ in _opened(b, dim):
                ids = pa.array(np.frombuffer(r["ids"], "<i8"), mask=~np.frombuffer(r["known"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(((vecs - centroids[own]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_table(rows: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each vector that takes part."""
    state, centroids, _ = clustered(rows, k, rounds, scale, dim, seed)
    spark = rows.sparkSession
    found = cluster_rows(state, centroids, dim)
    names = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    shas = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    each = per.join(shas, "cluster").crossJoin(per.agg(F.sum("cluster_inertia").alias("inertia")))  # k rows by one
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, seed: str = "2") -> str:
    """The query in SQL: every distance in every round; doubles hold these integers exactly."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), e) - 1)::INTEGER AS c, e FROM (SELECT * FROM v ORDER BY sha256('{seed}:' || vec_id::VARCHAR), e LIMIT {k}))",
    ]
    for t in range(rounds + 1):
        parts.append(f"d{t} AS (SELECT v.r, c{t}.c, (list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, c{t}.e) + list_dot_product(c{t}.e, c{t}.e))::BIGINT AS d FROM v, c{t})")
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{t} GROUP BY 1)")
        if t < rounds:
            parts.append(f"u{t} AS (SELECT c, i, floor(sum(x) / count(*)) AS m FROM (SELECT a{t}.c, unnest(range(1, {dim + 1})) AS i, unnest(v.e) AS x FROM v JOIN a{t} USING (r)) GROUP BY 1, 2)")
            parts.append(f"n{t} AS (SELECT c, list(m ORDER BY i) AS e FROM u{t} GROUP BY 1)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(n{t}.e, c{t}.e) AS e FROM c{t} LEFT JOIN n{t} USING (c))")
    return f"""WITH {', '.join(parts)},
s AS (SELECT c, sha256(array_to_string(list_transform(e, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM c{rounds})
SELECT v.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN s ON s.c = a.c"""
