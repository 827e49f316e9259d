"""Language-model scoring with a hidden Markov model over words.

Symbols of the model are the HEAD most frequent training words, TAIL classes of all other words (by their last
two bytes) and one end symbol. Emission of a word of class g in state s is b_s(g) * (c + 0.1) / Z_g with its own
training count c, so probabilities of texts are proper over an open vocabulary.

Training, on all training documents throughout: words are counted exactly, and the head is taken from the counts, ties
by word. Then all texts are read once more, and their symbols are stored, two bytes a token; passes and scoring read these.
Of each slice of texts only the distinct words are looked up and hashed. States start from what stands near a symbol: the groups of its
neighbours within NEAR are counted over all tokens, symbols with like neighbours are gathered by k-means in the leading
directions of these counts, and each gathering starts a state, with moves as counted between gatherings. Then come Baum-Welch passes: partitions add up expected counts of
whole sequences, their sums meet in pieces on the executors, and the model is re-estimated, until the log-likelihood per
token improves by less than CONVERGED of itself. Sequences longer than SEGMENT run as segments side by side: messages across
their ends come forward through the first and backward through the last, and by products of transition matrices through
those between, so the counts are those of the whole sequence. Scoring: the scaled forward recursion over each whole text gives its exact likelihood. Nothing depends on
how documents lie in partitions, but for the order in which floating-point numbers are added.

Counts of all words: head counts are summed with the last Baum-Welch pass. Tail words are stored with the symbols and go,
as packed arrays of (hash, document, times), to hash buckets of about BUCKET_BYTES; a bucket holds all occurrences of its words, so it counts
them and sends each batch of documents its sum of log10(c + 0.1). Frequent words never travel, so no bucket is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_words, claim, dropped, ship, stored, written
from .ngram_join import by_group
from .sums import combined, pieces, summed

HEAD, TAIL, STATES = 8192, 16, 8
SEGMENT, LONG, CONVERGED, SMOOTH = 256, 512, 0.002, 0.02  #: LONG is SEGMENT at least
SLICE, BUCKET_BYTES, HELD_WORDS = 3_000_000, 8_000_000, 250_000
SCALED = 8  #: steps of a recursion between two scalings: an emission is above 1e-30, so nothing underflows
RUN = 65_536  #: symbols whose neighbours are counted at a time: small arrays are not mapped anew
NEAR, OWN, GROUPS, SHARE = 4, 48, 64, 0.8  #: a state starts with SHARE of its own symbols; the OWN most frequent words are groups of neighbours of their own, all others share the rest
ENTRY = np.dtype([("hash", "<u8"), ("doc", "<u4"), ("times", "<u4"), ("tail", "u1"), ("train", "u1")])
SUMS = np.dtype([("doc", "<u4"), ("known", "<u4"), ("logs", "<f8")])
CODED = "batch long, bucket int, ids array<long>, taught int, sizes binary, flat binary, blob binary"
META = np.dtype([("held", "u1"), ("tokens", "<i8"), ("known", "<i8"), ("logs", "<f8"), ("forward", "<f8"), ("tail", "<i4", (TAIL,))])


END = HEAD + TAIL
ALL = END + 1


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move = start.astype(np.float64), move.astype(np.float64)
        self.emit = np.ascontiguousarray(emit.T.astype(np.float64))  # symbol, state
        self.by_state = np.ascontiguousarray(emit.astype(np.float64))

    def _through(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment (of SEGMENT symbols) the product over its symbols of move * emission, scaled to sum 1, and the
        logarithm of the scale."""
        m = len(first)
        p, logs, back = np.repeat(np.eye(STATES)[:, :, None], m, 2), np.zeros(m), np.ascontiguousarray(self.move.T)  # state after, before, segment
        for t in range(SEGMENT if m else 0):
            p = (back @ p.reshape(STATES, -1)).reshape(STATES, STATES, m)
            p *= self.by_state.take(flat[first + t], 1)[:, None, :]
            if t % SCALED == SCALED - 1 or t + 1 == SEGMENT:
                c = p.sum((0, 1))
                p /= c
                logs += np.log(c)
        return p.transpose(2, 1, 0), logs

    def _opened(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The forward vectors at the end of segments (of SEGMENT symbols) that open a sequence, and their logarithms."""
        a, logs, back = None, np.zeros(len(first)), np.ascontiguousarray(self.move.T)
        for t in range(SEGMENT):
            a = (np.repeat(self.start[:, None], len(first), 1) if t == 0 else back @ a) * self.by_state.take(flat[first + t], 1)
            if t % SCALED == SCALED - 1 or t + 1 == SEGMENT:
                c = a.sum(0)
                a /= c
                logs += np.log(c)
        return a.T, logs

    def _closed(self, flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The backward vectors before segments that close a sequence, and their logarithms."""
        order = np.argsort(-n, kind="stable")
        last, n = (first + n - 1)[order], n[order]
        b, logs = np.ones((STATES, len(n))), np.zeros(len(n))
        for t, m in enumerate(np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist()):
            b[:, :m] = self.move @ (b[:, :m] * self.by_state.take(flat[last[:m] - t], 1))
            if t % SCALED == SCALED - 1:
                c = b[:, :m].sum(0)
                b[:, :m] /= c
                logs[:m] += np.log(c)
        c = b.sum(0)
        back, out = np.empty((len(n), STATES)), np.empty(len(n))
        back[order], out[order] = (b / c).T, logs + np.log(c)
        return back, out

    def forward(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural-log likelihood of every sequence: the scaled forward recursion, all sequences in lockstep; those of
        more than LONG symbols segment by segment: forward through the first, backward through the last, products of
        those between."""
        out = np.zeros(len(sizes))
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            first, n, rank, base = segments(starts[long], sizes[long])
            count = np.diff(np.append(base, len(n)))
            inner = np.flatnonzero((rank > 0) & (rank < np.repeat(count, count) - 1))
            place = np.zeros(len(n), np.int64)
            place[inner] = np.arange(len(inner))
            p, between = self._through(flat, first[inner])
            a, total = self._opened(flat, first[base])
            b, end = self._closed(flat, first[base + count - 1], n[base + count - 1])
            total += end + np.bincount(np.repeat(np.arange(len(long)), count)[inner], between, len(long))
            for r in range(1, int(count.max()) - 1):
                own = np.flatnonzero(count > r + 1)
                v = np.einsum("ds,dst->dt", a[own], p[place[base[own] + r]])
                c = v.sum(1)
                a[own] = v / c[:, None]
                total[own] += np.log(c)
            out[long] = total + np.log((a * b).sum(1))
        short = np.flatnonzero(sizes <= LONG)
        order = short[np.argsort(-sizes[short], kind="stable")]
        x, live, lo = timed(flat, starts[order], sizes[order])
        e, back = self.by_state.take(x, 1), np.ascontiguousarray(self.move.T)
        a, total = None, np.zeros(len(order))
        for t, m in enumerate(live):
            a = (np.repeat(self.start[:, None], m, 1) if t == 0 else back @ a[:, :m]) * e[:, lo[t] : lo[t] + m]
            stop = live[t + 1] if t + 1 < len(live) else 0
            if stop < m:
                total[stop:m] += np.log(a[:, stop:m].sum(0))
            if t % SCALED == SCALED - 1 and stop:
                c = a[:, :stop].sum(0)
                a = a[:, :stop] / c
                total[:stop] += np.log(c)
        out[order] = total
        return out

    def _messages(self, flat: np.ndarray, first: np.ndarray, n: np.ndarray, rank: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State distribution before each segment (of the ranks above 0) and backward vector after it."""
        before, after = np.zeros((len(n), STATES)), np.ones((len(n), STATES))
        count = np.diff(np.append(base, len(n)))
        opens, closes = base[count > 1], (base + count - 1)[count > 1]
        if not len(opens):
            return before, after
        inner = np.flatnonzero((rank > 0) & (rank < np.repeat(count, count) - 1))
        place = np.zeros(len(n), np.int64)
        place[inner] = np.arange(len(inner))
        p, _ = self._through(flat, first[inner])
        before[opens + 1], _ = self._opened(flat, first[opens])
        after[closes - 1], _ = self._closed(flat, first[closes], n[closes])
        most = int(count.max())
        for r in range(2, most):
            k = base[count > r] + r
            a = np.einsum("ds,dst->dt", before[k - 1], p[place[k - 1]])
            before[k] = a / a.sum(1, keepdims=True)
        for r in range(most - 3, -1, -1):
            k = base[count > r + 2] + r
            b = np.einsum("dst,dt->ds", p[place[k + 1]], after[k + 1])
            after[k] = b / b.sum(1, keepdims=True)
        return before, after

    def expect(self, flat: np.ndarray, sizes: np.ndarray, into: dict) -> None:
        """Adds the expected counts of whole sequences, laid end to end, to into."""
        first, n, rank, base = segments(np.cumsum(sizes) - sizes, sizes)
        if not len(n):
            return
        before, after = self._messages(flat, first, n, rank, base)
        order = np.argsort(-n, kind="stable")
        first, n, inner = first[order], n[order], rank[order] > 0
        before, beta = np.ascontiguousarray(before[order].T), np.ascontiguousarray(after[order].T)
        x, live, lo = timed(flat, first, n)
        e, back, inverse, like = self.by_state.take(x, 1), np.ascontiguousarray(self.move.T), {}, 0.0
        alpha, ends = np.empty_like(e), np.empty_like(beta)
        for t, m in enumerate(live):
            a = alpha[:, lo[t] : lo[t] + m]
            if t == 0:
                a[:] = np.where(inner, back @ before, self.start[:, None])
            else:
                np.matmul(back, alpha[:, lo[t - 1] : lo[t - 1] + m], out=a)
            a *= e[:, lo[t] : lo[t] + m]
            if t % SCALED == SCALED - 1:
                c = a.sum(0)
                like += np.log(c).sum()
                inverse[t] = 1 / c
                a *= inverse[t]
            stop = live[t + 1] if t + 1 < len(live) else 0
            ends[:, stop:m] = a[:, stop:]
        into["like"] += like + np.log(ends.sum(0)).sum()
        beta /= (ends * beta).sum(0)
        moves = np.zeros((STATES, STATES))
        for t in range(len(live) - 1, -1, -1):
            m = live[t]
            b, g = beta[:, :m], e[:, lo[t] : lo[t] + m]
            g *= b
            if t in inverse:
                g *= inverse[t]
            alpha[:, lo[t] : lo[t] + m] *= b
            if t:
                moves += alpha[:, lo[t - 1] : lo[t - 1] + m] @ g.T
                np.matmul(self.move, g, out=b)
            else:
                moves += before[:, inner] @ g[:, inner].T
        into["move"] += self.move * moves
        into["start"] += alpha[:, : live[0]][:, ~inner].sum(1)
        for s in range(STATES):
            into["emit"][s] += np.bincount(x, weights=alpha[s], minlength=ALL)
        into["seen"] += np.bincount(x, minlength=ALL)


def timed(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Symbols of runs, longest first, in order of their steps; how many runs a step has, and where its symbols begin."""
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    lo = np.cumsum(live) - live
    x = np.empty(int(live.sum()), np.int64)
    for t, (m, at) in enumerate(zip(live.tolist(), lo.tolist(), strict=True)):
        x[at : at + m] = flat[first[:m] + t]
    return x, live.tolist(), lo.tolist()


def segments(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First symbol, length and rank in its sequence of every segment; first segment of every sequence."""
    per = -(-sizes // SEGMENT)
    base = np.cumsum(per) - per
    rank = np.arange(per.sum()) - np.repeat(base, per)
    first = np.repeat(starts, per) + SEGMENT * rank
    return first, np.minimum(SEGMENT, np.repeat(starts + sizes, per) - first), rank, base


def blank() -> dict:
    return {"emit": np.zeros((STATES, ALL)), "move": np.zeros((STATES, STATES)), "start": np.zeros(STATES), "seen": np.zeros(ALL), "like": np.zeros(1)}


def estimate(x: dict) -> Model:
    prior = (x["seen"] + 0.1) / (x["seen"] + 0.1).sum()
    emit = x["emit"] + SMOOTH * STATES + prior * 50
    move, start = x["move"] + 1, x["start"] + 1
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _words(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-cased words of texts, laid end to end, and how many each text has."""
    raw = pa.array(texts, pa.binary())
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pa.StringArray.from_buffers(len(raw), *raw.buffers()[1:]))))
    words, sizes = lists.values.view(pa.binary()), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py():  # a text without words gives one empty word
        sizes[sizes == 1] = full.to_numpy(zero_copy_only=False)[lists.offsets.to_numpy()[:-1][sizes == 1]]
        words = words.filter(full)
    return words.dictionary_encode(), sizes


def _symbols(words: pa.Array, head: pa.Array) -> np.ndarray:
    """Symbols of distinct words: words outside the head get HEAD + their tail class, by their last two bytes."""
    found = pc.index_in(words, value_set=head).fill_null(-1).to_numpy()
    ends, text = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1], np.frombuffer(words.buffers()[2] or b"", np.uint8)
    last = ends[1:] - 1
    before = np.where(np.diff(ends) > 1, text[last - 1], 0).astype(np.int64)
    return np.where(found < 0, HEAD + (text[last] * 7 + before) % TAIL, found).astype(np.int32)


def _slices(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts in slices of most bytes or more; a rest of less goes with the slice before it."""
    lo = size = 0
    rest = sum(map(len, texts))
    for i, t in enumerate(texts, 1):
        size, rest = size + len(t), rest - len(t)
        if i == len(texts) or (size >= most and rest >= most):
            yield texts[lo:i]
            lo, size = i, 0


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c): every word of the partition, as often as HELD_WORDS distinct ones have come together."""
    claim("none")
    seen: pa.Table | None = None
    for b in batches:
        for part in _slices(batch_words(b.column("text")), SLICE):
            words, _ = _words(part)
            c = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            own = pa.table([words.dictionary, pa.array(c, pa.int64())], ["word", "c"])
            seen = own if seen is None else pa.concat_tables([seen, own]).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])
            if len(seen) > HELD_WORDS:
                yield from seen.to_batches()
                seen = None
    if seen is not None:
        yield from seen.to_batches()


def _coded(head: list[bytes], buckets: int):
    """Each slice of documents, those that teach first, as their symbols (end symbols included) laid end to end; and its
    tail words, packed for each bucket."""
    names = ["batch", "bucket", "ids", "taught", "sizes", "flat", "blob"]
    types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        top, number = pa.array(head, pa.binary()), TaskContext.get().partitionId() << 32
        for texts, held, ids in (x for b in batches for x in _sliced(b)):
            taught = int((held == 0).sum())
            words, sizes = _words(texts)
            doc, index = np.repeat(np.arange(len(texts)), sizes), words.indices.to_numpy().astype(np.int64)
            symbol = _symbols(words.dictionary, top)
            flat = np.full(len(doc) + len(texts), END, "<u2")
            flat[np.arange(len(doc)) + doc] = symbol[index]
            out = [(number, -1, ids, taught, (sizes + 1).astype("<i8").tobytes(), flat.tobytes(), None)]
            rare = np.flatnonzero(symbol >= HEAD)
            if len(rare):
                h = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.take(pa.array(rare)).to_pylist()), np.uint64, len(rare))
                to = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                rare, h, to = rare[order], h[order], to[order]
                place = np.full(len(symbol), -1)
                place[rare] = np.arange(len(rare))  # words of a bucket are neighbours, so their entries are too
                own = place[index]
                tail = own >= 0
                key, times = np.unique(own[tail] * len(texts) + doc[tail], return_counts=True)
                own, doc = np.divmod(key, len(texts))
                e, to = np.zeros(len(key), ENTRY), to[own]
                e["hash"], e["doc"], e["times"], e["tail"], e["train"] = h[own], doc, times, (symbol[rare] - HEAD)[own], doc < taught
                edge = np.flatnonzero(np.diff(to)) + 1
                out += [(number, int(to[lo]), None, None, None, None, e[lo:hi].tobytes()) for lo, hi in zip([0, *edge], [*edge, len(e)], strict=True)]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _groups() -> np.ndarray:
    """Group of every symbol as a neighbour; the last group is that of END and of no neighbour."""
    x = np.arange(ALL)
    g = np.where(x < OWN, x, OWN + (x * 2654435761 >> 16) % (GROUPS - OWN - 1))
    g[END] = GROUPS - 1
    return g


def _taught(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of the texts of each slice that teach, laid end to end, and their numbers of symbols."""
    for flat, sizes, taught in zip(b.column("flat"), b.column("sizes"), b.column("taught").to_pylist(), strict=True):
        n = np.frombuffer(sizes.as_buffer(), "<i8")[:taught]
        yield np.frombuffer(flat.as_buffer(), "<u2")[: n.sum()].astype(np.int32), n


def _laid(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of texts laid end to end, and which text each belongs to."""
    for flat, n in _taught(b):
        yield flat.astype(np.int64), np.repeat(np.arange(len(n)), n)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each symbol occurs, and how often it stands within NEAR of each group."""
    claim("none")
    group, total, seen = _groups(), np.zeros(ALL * GROUPS), np.zeros(ALL)
    for b in batches:
        for x, doc in _laid(b):
            g = group[x]
            seen += np.bincount(x, minlength=ALL)
            for lo in range(0, len(x), RUN):
                for o in range(1, min(NEAR, len(x) - 1 - lo) + 1):
                    one, other = slice(lo, min(lo + RUN, len(x) - o)), slice(lo + o, min(lo + RUN + o, len(x)))
                    same = doc[one] == doc[other]
                    for y, z in ((x[one], g[other]), (x[other], g[one])):
                        np.add.at(total, (y * GROUPS + z)[same], 1.0)
    if seen.any():
        yield pieces(np.concatenate([seen, total]))


def _label_moves(label: np.ndarray):
    """How often a symbol of one gathering follows one of another, and how often texts begin with each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        moves, starts = np.zeros(STATES * STATES), np.zeros(STATES)
        for b in batches:
            for x, doc in _laid(b):
                s, first = label[x], np.diff(doc, prepend=-1) != 0
                moves += np.bincount((s[:-1] * STATES + s[1:])[~first[1:]], minlength=STATES * STATES)
                starts += np.bincount(s[first], minlength=STATES)
        if starts.any():
            yield pieces(np.concatenate([moves, starts]))

    return run


def gathered(near: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """State of every symbol from what stands near it: k-means, every symbol with the weight of its occurrences."""
    x = np.sqrt(near / np.maximum(near.sum(1), 1)[:, None])
    weight = np.sqrt(seen)[:, None]
    x = x - (x * weight**2).sum(0) / max(1.0, seen.sum())
    _, _, directions = np.linalg.svd((x * weight).T @ (x * weight))
    x = x @ directions[:STATES].T
    centre = [x[int(np.argmax(seen))]]
    for _ in range(STATES - 1):  # each next centre has the most mass far from those before
        centre.append(x[int(np.argmax(seen * np.min([((x - c) ** 2).sum(1) for c in centre], 0)))])
    c = np.stack(centre)
    for _ in range(50):
        label = np.argmin([((x - v) ** 2).sum(1) for v in c], 0)
        new = np.stack([(x[label == s] * seen[label == s, None]).sum(0) / max(1.0, seen[label == s].sum()) if (label == s).any() else c[s] for s in range(STATES)])
        if np.allclose(new, c, atol=1e-12):
            break
        c = new
    return label


def first_model(coded: DataFrame) -> Model:
    """The model that Baum-Welch passes start from."""

    def total(run, size: int) -> np.ndarray:
        return combined(summed(coded.mapInArrow(run, "part int, v binary")), size)

    counts = total(_contexts, ALL + ALL * GROUPS)
    init = blank()
    init["seen"] = seen = counts[:ALL]
    label = gathered(counts[ALL:].reshape(ALL, GROUPS), seen)
    init["emit"] = np.where(label == np.arange(STATES)[:, None], SHARE, (1 - SHARE) / (STATES - 1)) * seen
    moves = total(_label_moves(label), STATES * STATES + STATES)
    init["move"], init["start"] = moves[: STATES * STATES].reshape(STATES, STATES), moves[STATES * STATES :]
    return estimate(init)


def _expected(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        into = blank()
        for b in batches:
            for flat, sizes in _taught(b):
                model.expect(flat, sizes, into)
        if into["seen"].any():  # a split of a file may hold no row
            yield pieces(np.concatenate([into[k].ravel() for k in into]))

    return run


def _split(flat: np.ndarray) -> dict:
    out, at = blank(), 0
    for k, v in out.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def _sliced(b: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray, list]]:
    """Rows of a batch in slices of about SLICE bytes of text, what a worker holds at a time; those that teach come first."""
    texts, held, ids = batch_words(b.column("text")), np.asarray(b.column("held").to_pylist(), np.uint8), b.column("doc_id").to_pylist()
    lo = 0
    for part in _slices(texts, SLICE):
        order = np.argsort(held[lo : lo + len(part)], kind="stable")
        yield [part[j] for j in order], held[lo + order], [ids[lo + j] for j in order]
        lo += len(part)


def _scored(model: Model, seen: np.ndarray):
    logs, known = np.log10(seen + 0.1), (seen > 0).astype(np.int64)
    tail = np.arange(HEAD, END)
    logs[tail], known[tail] = 0.0, 0  # the buckets count these

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        for b in batches:
            blobs = []
            for flat, sizes, taught in zip(b.column("flat"), b.column("sizes"), b.column("taught").to_pylist(), strict=True):
                flat, sizes = np.frombuffer(flat.as_buffer(), "<u2").astype(np.int32), np.frombuffer(sizes.as_buffer(), "<i8")
                n, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
                meta = np.zeros(n, META)
                meta["held"], meta["tokens"] = np.arange(n) >= taught, sizes
                meta["forward"] = model.forward(flat, np.cumsum(sizes) - sizes, sizes)
                meta["logs"], meta["known"] = np.bincount(doc, logs[flat], n), np.bincount(doc, known[flat], n)
                rare = (flat >= HEAD) & (flat < END)
                meta["tail"] = np.bincount(doc[rare] * TAIL + flat[rare] - HEAD, minlength=n * TAIL).reshape(-1, TAIL)
                blobs.append(meta.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("batch"), b.column("ids"), pa.array(blobs, pa.binary())], ["batch", "ids", "blob"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket: counts its words, then answers each batch of documents; batch -1 holds the bucket's totals."""
    claim("none")
    for t in by_group(batches, ["bucket"]):
        own = [np.frombuffer(x, ENTRY) for x in t.column("blob").to_pylist()]
        source = np.repeat(t.column("batch").to_numpy(), [len(x) for x in own])
        e = np.concatenate(own)
        word, first, inverse = np.unique(e["hash"], return_index=True, return_inverse=True)
        c = np.bincount(inverse, weights=e["times"].astype(np.float64) * e["train"], minlength=len(word))
        tail = e["tail"][first]
        totals = np.concatenate([np.bincount(tail, c, TAIL), np.bincount(tail[c > 0], minlength=TAIL)]).astype("<f8")
        value, sure = e["times"] * np.log10(c[inverse] + 0.1), e["times"] * (c[inverse] > 0)
        out = [(-1, totals.tobytes())]
        order = np.lexsort((e["doc"], source))
        key_b, key_d = source[order], e["doc"][order]
        new = np.concatenate([[True], (key_b[1:] != key_b[:-1]) | (key_d[1:] != key_d[:-1])])
        at = np.flatnonzero(new)
        s = np.zeros(len(at), SUMS)
        s["doc"], s["logs"], s["known"] = key_d[at], np.add.reduceat(value[order], at), np.add.reduceat(sure[order], at)
        of = key_b[at]
        edge = np.flatnonzero(of[1:] != of[:-1]) + 1
        out += [(int(of[lo]), s[lo:hi].tobytes()) for lo, hi in zip([0, *edge], [*edge, len(s)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["batch", "blob"])


def _finished(total: float, distinct: float, z: np.ndarray):
    base, zlog = np.log10(total + 0.1 * (distinct + 1)), np.log10(z)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["batch"]):
            ids, meta, sums = None, None, []
            for own, blob in zip(t.column("ids").to_pylist(), t.column("blob").to_pylist(), strict=True):
                if own is not None:
                    ids, meta = own, np.frombuffer(blob, META)
                else:
                    sums.append(np.frombuffer(blob, SUMS))
            s = np.concatenate(sums) if sums else np.empty(0, SUMS)
            tails = np.bincount(s["doc"], s["logs"], len(ids))
            known = meta["known"] + np.bincount(s["doc"], s["known"], len(ids)).astype(np.int64)
            score = meta["forward"] / np.log(10) + tails - meta["tail"] @ zlog
            cols = [pa.array(ids, pa.int64()), pa.array(meta["held"] == 1), pa.array(meta["tokens"].copy()), pa.array(known), pa.array(np.full(len(ids), int(total)))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(meta["logs"] + tails - meta["tokens"] * base), pa.array(score)], names)

    return run


def most_frequent(learn: DataFrame) -> tuple[list[bytes], int]:
    """The HEAD most frequent words, ties by word, and how many tokens are others. Counts are exact; a histogram of their
    logarithms, a few hundred rows, says below which count no word can be among them, so that few others are sorted."""
    words = stored(learn.mapInArrow(_word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    level = F.floor(F.log2("c") * 8).cast("int").alias("level")
    levels = words.groupBy(level).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()
    need, least = HEAD, 0
    for r in levels:
        need, least = need - r["n"], r["level"]
        if need <= 0:
            break
    rows = words.where(level >= least).orderBy(F.desc("c"), "word").limit(HEAD).collect()
    return [bytes(r["word"]) for r in rows], sum(r["c"] for r in levels) - sum(r["c"] for r in rows)


def coded(docs: DataFrame) -> tuple[list[bytes], DataFrame, int]:
    """Head words of the documents that teach (doc_id, text, held); the table of all documents' symbols and tail words;
    its number of buckets. Texts are read twice, to count words and to write this table."""
    begun = written()
    head, tails = most_frequent(docs.where("not held").select("text"))
    dropped(docs.sparkSession, begun, written())
    buckets = max(16, int(tails * 10 / 9 * ENTRY.itemsize) // BUCKET_BYTES)  # held-out documents' tail words included
    return head, stored(docs.mapInArrow(_coded(head, buckets), CODED)), buckets


def fitted(rows: DataFrame) -> tuple[Model, np.ndarray]:
    """Model and exact symbol counts of the documents that teach among coded ones."""
    rows = rows.where("bucket < 0").select("taught", "sizes", "flat")
    model = first_model(rows)
    last, size = None, sum(v.size for v in blank().values())
    while True:
        sums = _split(combined(summed(rows.mapInArrow(_expected(model), "part int, v binary")), size))
        model = estimate(sums)
        like = float(sums["like"][0]) / max(1.0, float(sums["seen"].sum()))
        if last is not None and not like - last > CONVERGED * abs(last):
            return model, sums["seen"]
        last = like


def train(learn: DataFrame) -> tuple[list[bytes], Model, np.ndarray]:
    """Head words, model and exact symbol counts of the training documents (a text column)."""
    begun = written()
    head, rows, _ = coded(learn.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("held")))
    model, seen = fitted(rows)
    dropped(learn.sparkSession, begun, written())
    return head, model, seen


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row of docs.

    Documents whose crc32(doc_id as text) mod 10 is 0 are held out (also those without an id) and teach nothing.
    Null and empty texts are the end token alone. Repeated rows count as often as they occur; other columns are
    ignored; an empty table gives an empty result."""
    ship(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held"))
    _, sent, buckets = coded(docs)
    mark = written()
    model, seen = fitted(sent)
    symbols = sent.where("bucket < 0").select("batch", "ids", "taught", "sizes", "flat")
    scored = stored(symbols.mapInArrow(_scored(model, seen), "batch long, ids array<long>, blob binary"))
    entries = sent.where("bucket >= 0").select("bucket", "batch", "blob").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = stored(entries.mapInArrow(_counted, "batch long, blob binary"))
    dropped(docs.sparkSession, mark - 1, mark)
    rows = answers.where("batch < 0").select("blob").collect()  # one short row for each bucket
    t = sum((np.frombuffer(bytes(r["blob"]), "<f8") for r in rows), np.zeros(2 * TAIL))
    own = np.delete(seen, np.arange(HEAD, END))
    total, distinct = own.sum() + t[:TAIL].sum(), (own > 0).sum() + t[TAIL:].sum()
    z = t[:TAIL] + 0.1 * (t[TAIL:] + 1)
    both = scored.unionByName(answers.where("batch >= 0").select("batch", F.lit(None).cast("array<long>").alias("ids"), "blob"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.repartition(buckets, "batch").sortWithinPartitions("batch").mapInArrow(_finished(total, distinct, z), schema)
