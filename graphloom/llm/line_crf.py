"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own shape and those of its two neighbours; transitions tie
neighbouring labels. Forward-backward marginals of "good", weighted by line length, average to the document's
score. The field is fitted on every line of every labelled row that may teach; all lines of a document carry its label.
The features of these lines are stored once, and each step of L-BFGS is a pass over them: partitions add up
log-likelihood and gradient, of which only sums reach the driver. The likelihood is concave, so steps go on until its
gradient is FLAT, after MOST_STEPS at the latest. Scoring covers every line.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_words, claim, hash_words, held, ship, stored

FLAT, MOST_STEPS, MEMORY, RIDGE = 2e-5, 300, 100, 1e-3
SLICE = 1_000_000  #: bytes of text whose features are held at a time
OWN = 14
WIDTH = 3 * OWN + 3


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for lo, hi in ranges:
        t[lo : hi + 1] = 1
    return t


UPPER, LOWER, DIGIT = _table((65, 90)), _table((97, 122)), _table((48, 57))
HIGH, BLANK, BAR = _table((128, 255)), _table((9, 13), (32, 32)), _table((124, 124))
STOP = _table((44, 44), (46, 46))
SYMBOL = 1 - np.maximum.reduce([UPPER, LOWER, DIGIT, HIGH, BLANK, BAR, STOP])


def own_features(lines: list[bytes], repeats: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Shape of each line; repeats: how often the line occurs in its document; text: the number of its document."""
    raw = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(size + 1) - size - 1
    share = np.maximum(size, 1)

    def part(t: np.ndarray) -> np.ndarray:
        return np.add.reduceat(t[raw], starts, dtype=np.int64) / share

    words = [x.split() for x in lines]
    n = np.fromiter(map(len, words), np.int64, len(lines))
    flat = hash_words(list(chain.from_iterable(words)))
    line = np.repeat(np.arange(len(lines)), n)
    of = text[line]  # words of other texts are no repeats
    twice = np.zeros(len(flat))
    twice[1:] = (flat[1:] == flat[:-1]) & (of[1:] == of[:-1])
    gap = np.zeros(len(flat))
    gap[2:] = (flat[2:] == flat[:-2]) & (of[2:] == of[:-2])
    count = np.maximum(n, 1)
    f = np.empty((len(lines), OWN))
    f[:, 0] = np.log1p(size) / 6
    f[:, 1], f[:, 2], f[:, 3] = part(UPPER), part(LOWER), part(DIGIT)
    f[:, 4], f[:, 5], f[:, 6], f[:, 7] = part(SYMBOL) * 3, part(BAR) * 3, part(STOP) * 3, part(HIGH)
    f[:, 8] = np.bincount(line, twice, len(lines)) / count
    f[:, 9] = np.bincount(line, gap, len(lines)) / count
    f[:, 10] = np.minimum(size / count, 30) / 10
    f[:, 11] = np.log1p(repeats - 1)
    f[:, 12] = np.fromiter((x[-1:] in (b".", b"!", b"?") for x in lines), float, len(lines))
    f[:, 13] = np.log1p(n) / 4
    return f


def shapes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines that hold words, lines for each text (at least one), and line lengths."""
    lines: list[bytes] = []
    count, repeats = [], []
    for t in texts:
        own = [x for x in t.split(b"\n") if x and not x.isspace()] or [b""]
        seen = Counter(own)
        repeats += [seen[x] for x in own]
        lines += own
        count.append(len(own))
    per = np.asarray(count, np.int64)
    return own_features(lines, np.asarray(repeats, float), np.repeat(np.arange(len(per)), per)), per, np.fromiter(map(len, lines), np.int64, len(lines)) + 1


def widened(f: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Own features of each line, those of its neighbours in the text, and marks of first and last lines."""
    start = np.zeros(len(f), bool)
    start[np.cumsum(per) - per] = True
    end = np.append(start[1:], True)
    x = np.zeros((len(f), WIDTH))
    x[:, :OWN] = f
    x[1:, OWN : 2 * OWN] = np.where(start[1:, None], 0, f[:-1])
    x[:-1, 2 * OWN : 3 * OWN] = np.where(end[:-1, None], 0, f[1:])
    x[:, -3], x[:, -2], x[:, -1] = start, end, 1
    return x


class Chains:
    """Chains of unequal length, laid end to end, walked in lockstep from the longest down."""

    def __init__(self, per: np.ndarray):
        self.order = np.argsort(-per, kind="stable")
        first = np.cumsum(per) - per
        self.first, self.per = first[self.order], per[self.order]
        self.live = np.searchsorted(-self.per, -np.arange(int(per.max()) if len(per) else 0), side="left")

    def marginals(self, logit: np.ndarray, move: np.ndarray, pairs: bool = False):
        """P(good) of every line; with pairs also the expected transitions, summed over chains by their weight, and the
        logarithm of every line's forward scale and emissions."""
        e = np.stack([np.exp(-np.logaddexp(0, logit)), np.exp(-np.logaddexp(0, -logit))], 1)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e))
        m = np.exp(move - move.max())
        for t, k in enumerate(self.live.tolist()):
            at = self.first[:k] + t
            a = e[at] if t == 0 else (alpha[at - 1] @ m) * e[at]
            c = a.sum(1)
            alpha[at], scale[at] = a / c[:, None], c
        for t in range(len(self.live) - 2, -1, -1):
            at = self.first[: self.live[t + 1]] + t
            b = (e[at + 1] * beta[at + 1]) @ m.T
            beta[at] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(1, keepdims=True)
        if not pairs:
            return p[:, 1]
        moves = np.zeros((2, 2))
        for t in range(1, len(self.live)):
            k = self.live[t]
            at = self.first[:k] + t
            x = alpha[at - 1][:, :, None] * m * (e[at] * beta[at])[:, None, :]
            x /= x.sum((1, 2), keepdims=True)
            moves += (x / self.per[:k, None, None]).sum(0)
        return p[:, 1], moves, np.log(scale), np.log(e)


class Field:
    def __init__(self, weights: np.ndarray, move: np.ndarray, center: np.ndarray, scale: np.ndarray):
        self.weights, self.move, self.center, self.scale = weights, move, center, scale

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        f, per, size = shapes(texts)
        x = widened(f, per)
        good = Chains(per).marginals(((x - self.center) / self.scale) @ self.weights, self.move)
        first = np.cumsum(per) - per
        return np.clip(np.add.reduceat(good * size, first) / np.add.reduceat(size, first), 0, 1)


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("words")
    for b in batches:
        texts = batch_words(b.column("text"))
        for lo, hi in _slices(texts):
            f, per, _ = shapes(texts[lo:hi])
            first = np.cumsum(per) - per
            blobs = [f[i : i + n].astype("<f4").tobytes() for i, n in zip(first.tolist(), per.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("h").slice(lo, hi - lo), b.column("quality").slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["h", "quality", "x"])


def _added(rows: DataFrame, own: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of own(features, lines for each text, labels), an array of size numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        total = np.zeros(size)
        for b in batches:
            blobs = b.column("x").to_pylist()
            per = np.fromiter(map(len, blobs), np.int64, len(blobs)) // (4 * OWN)
            f = np.frombuffer(b"".join(blobs), "<f4").reshape(-1, OWN).astype(float)
            if len(per):
                total += own(widened(f, per), per, b.column("quality").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    return sum((np.frombuffer(bytes(r["v"]), "<f8") for r in rows.mapInArrow(run, "v binary").collect()), np.zeros(size))


def _moments(x: np.ndarray, per: np.ndarray, label: np.ndarray) -> np.ndarray:
    stay = (per - 1) / per
    return np.concatenate([x.sum(0), (x * x).sum(0), [stay[label == 0].sum(), stay[label == 1].sum(), len(per)]])


def _likelihood(weights: np.ndarray, offset: float, move: np.ndarray):
    """Log-likelihood, its gradient by the weights and expected transitions; a text's lines weigh 1 together."""

    def own(x: np.ndarray, per: np.ndarray, label: np.ndarray) -> np.ndarray:
        p, moves, scale, e = Chains(per).marginals(x @ weights + offset, move, True)
        y, share = np.repeat(label, per), np.repeat(1 / per, per)
        like = ((np.where(y == 1, e[:, 1], e[:, 0]) - scale) * share).sum() + ((per - 1) / per * (move[label, label] - move.max())).sum()
        return np.concatenate([[like], x.T @ ((y - p) * share), moves.ravel()])

    return own


def ascended(value: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray) -> np.ndarray:
    """The maximum of a concave function, of which value gives height and gradient, by L-BFGS."""
    height, g = value(at)
    known: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MOST_STEPS):
        if np.abs(g).max() < FLAT:
            break
        d, back = g.copy(), []
        for s, y in reversed(known):
            back.append((s @ d) / (s @ y))
            d -= back[-1] * y
        if known:
            s, y = known[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(known, reversed(back), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        step = 1.0 if known else 1 / max(1.0, float(np.linalg.norm(g)))
        while (new := value(at + step * d))[0] < height + 1e-4 * step * (g @ d) and step > 1e-6:
            step /= 4
        if new[0] <= height:
            break
        s, y = step * d, g - new[1]
        if s @ y > 1e-12:
            known = [*known, (s, y)][-MEMORY:]
        at, (height, g) = at + s, new
    return at


def fitted(rows: DataFrame) -> Field:
    """The field of rows (quality, x): labels and own features of texts."""
    sums = _added(rows, _moments, 2 * WIDTH + 3)
    many = sums[-1]
    if not many:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(WIDTH), np.ones(WIDTH))
    lines = sums[WIDTH - 1]
    center = sums[:WIDTH] / lines
    scale = np.sqrt(np.maximum(sums[WIDTH : 2 * WIDTH] / lines - center * center, 0))
    scale[scale < 1e-6], center[-1], scale[-1] = 1, 0, 1
    seen = np.diag(sums[-3:-1])

    def value(at: np.ndarray) -> tuple[float, np.ndarray]:
        weights = at[:WIDTH] / scale
        got = _added(rows, _likelihood(weights, -float(center @ weights), at[WIDTH:].reshape(2, 2)), 1 + WIDTH + 4)
        by_weight = (got[1 : 1 + WIDTH] - center * got[WIDTH]) / scale
        return got[0] / many - RIDGE / 2 * float(at @ at), np.concatenate([by_weight, seen.ravel() - got[1 + WIDTH :]]) / many - RIDGE * at

    at = ascended(value, np.zeros(WIDTH + 4))
    return Field(at[:WIDTH], at[WIDTH:].reshape(2, 2), center, scale)


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Field:
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    one = held(stored(known.groupBy("doc_id").agg(F.min("quality").alias("quality"))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out()).join(one, "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", "quality")
    rows = texts.mapInArrow(_fit_rows, "h long, quality int, x binary").dropDuplicates(["h"])  # a repeated row teaches once
    return fitted(stored(rows.sortWithinPartitions("h").select("quality", "x")))


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size > SLICE or i == len(texts):
            yield lo, i
            lo, size = i, 0


def _all_scores(field: Field, column) -> np.ndarray:
    texts = batch_words(column)
    return np.concatenate([field.scores(texts[lo:hi]) for lo, hi in _slices(texts)] or [np.empty(0)])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5); a row for each row of docs.

    docs: doc_id long, text string; labels: doc_id, quality 0/1. Only labels whose crc32(doc_id as text) mod 3 is
    not 1 teach. Of several labels of a document the lowest counts; null or other labels are ignored; without any
    label every score is 0.5. Null texts are empty; an empty text is one empty line. Repeated rows, null ids
    (held_out false) and an empty table are kept as they are; other columns are ignored."""
    field = trained(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        for b in batches:
            s = _all_scores(field, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, whole, whose score is 0.5 or more. Null and empty texts are one empty line; null ids, repeated
    rows and columns of any name are kept as they are; an empty table gives an empty result."""
    field = trained(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        for b in batches:
            yield b.filter(pa.array(_all_scores(field, b.column("text")) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
