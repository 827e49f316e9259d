"""Benchmark decontamination by latent semantic retrieval.

Features are the benchmark's own words (all others share one silent feature); their document frequencies are
counted over every document. Passages, windows of WINDOW words every STEP words, get TF-IDF vectors. A randomised
SVD gives RANK latent directions: partitions multiply their passages with a random block, the products meet on the
executors, and POWER further rounds sharpen them. The SVD is fitted on what it indexes, all passages of all items of the
block; documents are the queries: every passage of every document is projected and compared with every
item. The cosine divides by the passage's whole TF-IDF norm, so it is about the square root of the share that the item
words have in that norm at most: passages clearly below COSINE by this bound are not projected. Those at COSINE or more are candidates.
RANK directions cannot hold many items whole. Items of which they lose some energy are also compared without the
projection, by exact cosines over an inverted index, and so are the windows of items longer than WINDOW + STEP words,
as a whole long item is far from each passage of its copy. A candidate's surroundings are verified by the longest
common subsequence (LCS) of words: a share of SURE of the item, or of LIKELY with the item's answer (its last
sentence) found too, is a leak. Items are taken in blocks of about BLOCK_BYTES of text, which bounds the vocabulary and so
every matrix that the driver and the workers hold (60,000 words x 200 directions at most); each block takes two passes over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_words, claim, ship
from .sums import PARTS, combined, pieces, summed

WINDOW, STEP, RANK, POWER = 32, 16, 192, 2
COSINE, SURE, LIKELY, ANSWER, SLACK = 0.35, 0.6, 0.5, 0.8, 0.7
FIT_WINDOW, BLOCK_BYTES, SHORT = 64, 1 << 20, 8
#: An item is held whole when the projection loses at most this share of its energy (float32 rounds below it).
LOST = 1e-5
CELLS = 4_000_000  #: numbers in one matrix or list of postings
#: A-Z to a-z; ASCII control characters and punctuation to blanks.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, with one machine-word operation for each word of b (bit-parallel)."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Index:
    """Items, vocabulary and weights; projection once the directions are known."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.words = [plain_words(t) for _, t in items]
        self.answers = []
        for (_, t), own in zip(items, self.words, strict=True):
            parts = [p for p in (plain_words(s) for s in re.split(rb"[.?!\n]+", t)) if len(p) >= 3]
            self.answers.append(parts[-1] if parts else own)
        self.vocab = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.idf = np.ones(len(self.vocab), np.float32)
        self.basis = np.zeros((len(self.vocab), 0), np.float32)

    def features(self, words: list[bytes]) -> np.ndarray:
        get, n = self.vocab.get, len(self.vocab)
        return np.fromiter((get(w, n) for w in words), np.int32, len(words))

    def weigh(self, df: np.ndarray, docs: int) -> None:
        self.idf = np.log((docs + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)

    def settle(self, basis: np.ndarray) -> None:
        """Rows of the projection are idf-weighted; one more row of zeros stands for all other words."""
        scaled = basis * self.idf[:, None]
        self.rows = np.concatenate([scaled, np.zeros((1, basis.shape[1]))]).astype(np.float32)
        self.mass = np.append(self.idf**2, 0).astype(np.float32)
        self.other = float(self.idf.max(initial=0)) ** 2  # a word that no item has is as telling as the rarest
        full = np.stack([self.rows[self.features(w)].sum(0) if w else self.rows[-1] for w in self.words])
        self.items = full / np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-9)
        lost = [i for i, (w, kept) in enumerate(zip(self.words, (full * full).sum(1).tolist(), strict=True)) if w and kept < (1 - LOST) * self.energy(w)]
        entries = [(i, 0, self.words[i]) for i in lost] + [e for i, w in enumerate(self.words) for e in _windows(i, w)]
        self.post(entries)

    def energy(self, words: list[bytes]) -> float:
        ids, n = np.unique(self.features(words), return_counts=True)
        return float(((n * self.idf[ids].astype(np.float64)) ** 2).sum())

    def post(self, entries: list[tuple[int, int, list[bytes]]]) -> None:
        """Entries are (item, first word, words); their unit vectors by entry and, inverted, by word."""
        self.entry_item = np.array([e[0] for e in entries], np.int64)
        self.entry_at = np.array([e[1] for e in entries], np.int64)
        ids, weights = [], []
        for _, _, w in entries:
            own, n = np.unique(self.features(w), return_counts=True)
            x = n * self.idf[own].astype(np.float64)
            ids.append(own)
            weights.append((x / np.linalg.norm(x)).astype(np.float32))
        self.entry_first = np.cumsum([0, *map(len, ids)])
        self.entry_word = np.concatenate(ids) if ids else np.empty(0, np.int32)
        self.entry_weight = np.concatenate(weights) if weights else np.empty(0, np.float32)
        order = np.argsort(self.entry_word, kind="stable")
        self.post_entry = np.repeat(np.arange(len(entries)), np.diff(self.entry_first))[order].astype(np.int32)
        self.post_weight = self.entry_weight[order]
        self.degree = np.bincount(self.entry_word, minlength=len(self.vocab) + 1)
        self.post_first = np.cumsum(self.degree) - self.degree

    def exact(self, feature: np.ndarray, first: np.ndarray, size: np.ndarray, norm: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passages, entries, cosines) of COSINE or more, without the projection. A passage's commonest words, as long
        as they cannot reach COSINE on their own, bring no entries, but count in the cosines."""
        n = len(self.vocab)
        work = np.add.reduceat(self.degree[feature], np.stack([first, np.minimum(first + size, len(feature) - 1)], 1).ravel())[::2] + size
        part = np.cumsum(work) // CELLS
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(first)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            of, at = _runs(first[lo:hi], size[lo:hi])
            f = feature[at].astype(np.int64)
            key, times = np.unique((of * n + f)[f < n], return_counts=True)
            if not len(key):
                continue
            p, w = key // n, key % n
            x = times * self.idf[w].astype(np.float64)
            limit = COSINE**2 * norm[lo:hi]
            order = np.lexsort((-self.degree[w], p))
            upto = np.cumsum((x * x)[order])
            before = np.concatenate([[0], upto])[np.searchsorted(p, np.arange(hi - lo))]
            chosen = order[upto - before[p[order]] >= 0.999 * limit[p[order]]]
            run, post = _runs(self.post_first[w[chosen]], self.degree[w[chosen]])
            pair = np.unique(p[chosen][run] * len(self.entry_item) + self.post_entry[post])
            step = CELLS // WINDOW
            for k in range(0, len(pair), step):
                q, e = np.divmod(pair[k : k + step], len(self.entry_item))
                run, place = _runs(self.entry_first[e], self.entry_first[e + 1] - self.entry_first[e])
                want = q[run] * n + self.entry_word[place]
                found = np.minimum(np.searchsorted(key, want), len(key) - 1)
                dot = np.bincount(run, np.where(key[found] == want, x[found] * self.entry_weight[place], 0), len(q))
                cos = dot / np.sqrt(np.maximum(norm[lo:hi][q], 1e-9))
                good = cos >= COSINE
                yield lo + q[good], e[good], cos[good]

    def blocks(self, feature: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of STEP-word blocks of every text in the flat features; blocks of each text."""
        per = np.maximum(1, -(-sizes // STEP))
        per[sizes == 0] = 0
        first = np.repeat(np.cumsum(sizes) - sizes, per)
        return first + STEP * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)), per

    def candidates(self, feature: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, first word of the passage, item, first word of the item's part, cosine)"""
        starts, per = self.blocks(feature, sizes)
        if not len(starts):
            return
        mass = np.add.reduceat(self.mass[feature], starts)
        text = np.repeat(np.arange(len(sizes)), per)
        same = np.append(text[1:] == text[:-1], False)
        whole = mass + np.where(same, np.append(mass[1:], 0), 0)
        known = np.add.reduceat((feature < len(self.vocab)).astype(np.int32), starts)
        long = np.minimum(starts + STEP, np.repeat(np.cumsum(sizes), per)) - starts
        strange = long - known
        norm = whole + self.other * (strange + np.where(same, np.append(strange[1:], 0), 0))
        keep = np.flatnonzero((whole > 0) & (whole >= SLACK * COSINE**2 * norm))
        if not len(keep):
            return
        wanted = np.zeros(len(starts) + 1, bool)
        wanted[keep] = True
        wanted[keep[same[keep]] + 1] = True
        chosen = np.flatnonzero(wanted)
        place = np.cumsum(wanted) - 1
        of = np.repeat(np.arange(len(starts)), long)
        words = np.flatnonzero(wanted[of] & (feature < len(self.vocab)))
        vectors = np.zeros((len(chosen), self.rows.shape[1]), np.float32)
        for lo in range(0, len(words), 65536):  # sums of the blocks' word vectors; blocks are runs in words
            w = words[lo : lo + 65536]
            at = place[of[w]]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
            vectors[at[cut]] += np.add.reduceat(self.rows[feature[w]], cut, axis=0)
        origin = np.cumsum(sizes) - sizes
        step = max(1, min(8192, CELLS // len(self.items)))
        for lo in range(0, len(keep), step):
            at = keep[lo : lo + step]
            v = vectors[place[at]] + np.where(same[at, None], vectors[np.minimum(place[at] + 1, len(chosen) - 1)], 0)
            cos = (v @ self.items.T) / np.sqrt(np.maximum(norm[at, None], 1e-9))
            w, i = np.nonzero(cos >= COSINE)
            for x, item in zip(w.tolist(), i.tolist(), strict=True):
                yield int(text[at[x]]), int(starts[at[x]] - origin[text[at[x]]]), item, 0, float(cos[x, item])
        if len(self.entry_item):
            size = long[keep] + np.where(same[keep], np.append(long[1:], 0)[keep], 0)
            for x, e, cos in self.exact(feature, starts[keep], size, norm[keep]):
                k = keep[x]
                yield from zip(text[k].tolist(), (starts[k] - origin[text[k]]).tolist(), self.entry_item[e].tolist(), self.entry_at[e].tolist(), cos.tolist(), strict=True)

    def verify(self, words: list[bytes], at: int, item: int) -> tuple[int, bool]:
        own = self.words[item]
        near = words[max(0, at - len(own)) : at + WINDOW + len(own)]
        n = lcs(own, near)
        if len(own) < SHORT or n >= SURE * len(own):
            return n, n == len(own) if len(own) < SHORT else True
        if n < LIKELY * len(own):
            return n, False
        answer = self.answers[item]
        return n, lcs(answer, near) >= ANSWER * len(answer)

    def leaks(self, texts: list[bytes]) -> Iterator[tuple[int, int, float, float]]:
        """(text, item, best cosine, LCS share) of the leaks, once for each text and item."""
        words = [plain_words(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        feature = np.concatenate([self.features(w) for w in words]) if words else np.empty(0, np.int32)
        best: dict[tuple[int, int], tuple[float, float]] = {}
        seen: set[tuple[int, int, int]] = set()  # where the item would start: parts of one copy are verified once
        for t, at, item, part, cos in self.candidates(feature, sizes):
            had = best.get((t, item))
            start = (t, item, (at - part) // STEP)
            if had and (had[1] == 1 or start in seen):
                best[t, item] = (max(cos, had[0]), had[1])
                continue
            if start in seen:
                continue
            seen.add(start)
            n, leak = self.verify(words[t], at, item)
            if leak:
                share = n / len(self.words[item])
                best[t, item] = (max(cos, had[0]), max(share, had[1])) if had else (cos, share)
        for (t, item), (cos, share) in sorted(best.items()):
            yield t, item, cos, share


def _windows(item: int, words: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Windows of WINDOW words every STEP words, and the last WINDOW words, of a long item."""
    if len(words) > WINDOW + STEP:
        last = len(words) - WINDOW
        for at in [*range(0, last, STEP), last]:
            yield item, at, words[at : at + WINDOW]


def _runs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run and position of every element of the runs."""
    of = np.repeat(np.arange(len(first)), size)
    return of, np.arange(len(of)) + np.repeat(first - (np.cumsum(size) - size), size)


def _parts(texts: list[bytes], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size > most or i == len(texts):
            yield lo, i
            lo, size = i, 0


def _total(df: DataFrame, run, size: int) -> np.ndarray:
    """Sums the arrays that run makes for each partition, in PARTS pieces on the executors."""
    return combined(summed(df.mapInArrow(run, "part int, v binary")), size)


def _frequencies(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        n = len(index.vocab)
        total = np.zeros(n + 1)
        for b in batches:
            for t in batch_words(b.column("text")):
                f = index.features(list(set(plain_words(t))))
                total[:n] += np.bincount(f, minlength=n + 1)[:n]
                total[n] += 1
        yield pieces(total)

    return run


def _products(index: Index, block: np.ndarray):
    """A^T (A block) over the passages of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        out = np.zeros(block.shape)
        weight = np.append(index.idf, 0).astype(np.float64)
        padded = np.concatenate([block, np.zeros((1, block.shape[1]))])
        for b in batches:
            for t in batch_words(b.column("text")):
                f = index.features(plain_words(t))
                for at in range(0, max(1, len(f) - FIT_WINDOW // 2), FIT_WINDOW // 2):
                    ids, n = np.unique(f[at : at + FIT_WINDOW], return_counts=True)
                    n = n * weight[ids]
                    norm = np.sqrt((n * n).sum())
                    if norm > 0:
                        n /= norm
                        y = n @ padded[ids]
                        real = ids < len(block)
                        out[ids[real]] += n[real, None] * y
        yield pieces(out)

    return run


def fitted(docs: DataFrame, index: Index) -> Index:
    n = len(index.vocab)
    counts = _total(docs.select("text"), _frequencies(index), n + 1)
    index.weigh(counts[:n], int(counts[n]))
    spark = docs.sparkSession
    rows = [(" ".join(w.decode(errors="replace") for w in ws),) for ws in index.words]
    passages = spark.createDataFrame(rows, "text string")
    rank = min(RANK, n)
    block = np.random.default_rng(11).standard_normal((n, min(n, rank + 8)))
    for _ in range(POWER):
        block = np.linalg.qr(_total(passages, _products(index, block), block.size).reshape(block.shape))[0]
    small = block.T @ _total(passages, _products(index, block), block.size).reshape(block.shape)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    index.settle(block @ vectors[:, np.argsort(-values)[:rank]])
    return index


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over blocks of about BLOCK_BYTES of item text."""
    ship(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)  # about BLOCK_BYTES by the hash
        rows = [(r["item_id"], r["text"].encode()) for r in own.collect()]
        rows = sorted(((i, t) for i, t in rows if plain_words(t)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield Index(rows)


PAIRS = "doc_id long, item_id long, cosine double, lcs_share double"


def leaked_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share of every leak of an item in a document; clean documents have no row.

    docs: doc_id long, text string; benchmark: item_id long, text string; other columns are ignored. Texts are
    compared as words without case and ASCII punctuation. Null and empty texts and items without words match
    nothing; items of fewer than SHORT words must occur whole. Rows that repeat an id are compared on their own.
    Empty tables give an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], PAIRS)
    for raw in _blocks(benchmark):
        index = fitted(docs, raw)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            claim("none")
            for b in batches:
                texts, rows = batch_words(b.column("text")), []
                for lo, hi in _parts(texts):
                    rows += [(lo + t, index.ids[i], c, s) for t, i, c, s in index.leaks(texts[lo:hi])]
                at, item, cos, share = zip(*rows, strict=True) if rows else ((), (), (), ())
                ids = b.column("doc_id").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), pa.array(cos, pa.float64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "cosine", "lcs_share"])

        out = out.unionByName(docs.mapInArrow(run, PAIRS))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, whole, without a leak. Null and empty texts have none; null ids, repeated rows and columns of
    any name are kept as they are; an empty table gives an empty result, an empty benchmark all rows."""
    for raw in _blocks(benchmark):
        index = fitted(docs, raw)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            claim("none")
            for b in batches:
                texts = batch_words(b.column("text"))
                clean = np.ones(len(texts), bool)
                for lo, hi in _parts(texts):
                    clean[[lo + t for t, *_ in index.leaks(texts[lo:hi])]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
