"""Harmonic packing of tokenised documents into sequences of a fixed capacity C.

Piece lengths fall into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k], and a sequence of
class k takes exactly k pieces. Every worker fills the sequences of each class by itself, with no shuffle.

Documents are cut so that pieces nearly fill their class: full pieces of C first, then the largest C // k that
fits, again and again, until the rest is short or already close to the top of its class. At the end of a
partition the classes' unfinished sequences (fewer than k pieces each) are laid end to end and cut at C; what
remains below C becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import _CLEAR, claim, ship

SHORT, CLOSE = 64, 0.985  #: rests below SHORT stay whole, as do rests that fill CLOSE of their class
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PART_WORDS = 400_000


#: What no word holds whose case and pieces need no Unicode tables; the pieces of other words, in lower case, and the
#: blanks between them.
ODD = re.compile(r"<\||[^\x20-\x7eÀ-ÖØ-öø-ÿ]")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]| |[^a-zß-öø-ÿ0-9 ]+")
STOP = b"\xff" * 4  #: stands for a blank among ids, whose upper bytes are 0
NEW_WORDS = 50_000


class WordIds(dict):
    """word (bytes between ASCII white space) -> its ids as little-endian uint32; at most `limit` words.

    White space always ends a token of this vocabulary, so a text's ids are those of its words in turn. Words that
    are new are cut into pieces, which repeat more often than words; new pieces are encoded together, and every
    piece ends with the one token that has the end-of-word mark."""

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {" ": STOP}

    def _whole(self, words: list[bytes]) -> dict[bytes, bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, got, strict=True)}

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for lo in range(0, len(pieces), 512):
            own = pieces[lo : lo + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            raw = ids.tobytes()
            out.update((p, raw[4 * a : 4 * z]) for p, a, z in zip(own, [0, *stops[:-1]], stops, strict=True))
        return out

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        text, at, odd, kept = b" ".join(words).decode(), 0, [], []
        while m := ODD.search(text, at):
            begin, end = max(at, text.rfind(" ", at, m.start()) + 1), text.find(" ", m.start())
            end = len(text) if end < 0 else end
            kept.append(text[at:begin])
            odd.append(text[begin:end].encode())
            at = end + 1
        kept.append(text[at:])
        simple = "".join(kept).rstrip(" ")
        pieces, known = PIECE.findall(simple.lower()), self.pieces
        fresh = self._encoded([p for p in set(pieces) if p not in known and p != " "])
        if len(known) + len(fresh) <= self.limit // 2:
            known.update(fresh)
            fresh = {}
        get = known.get
        ids = b"".join([fresh[p] if (x := get(p)) is None else x for p in pieces] if fresh else map(known.__getitem__, pieces))
        out = dict(zip(simple.encode().split(), ids.split(STOP) if pieces else [], strict=True))
        return out | (self._whole(odd) if odd else {})

    def texts(self, texts: list[bytes]) -> Iterator[bytes]:
        words, found, gaps = [], [], []
        for t in texts:
            ws = t.split()
            xs = list(map(self.get, ws))
            own, i = [], -1
            for _ in range(xs.count(None)):
                i = xs.index(None, i + 1)
                own.append(i)
            words.append([ws[i] for i in own])
            found.append(xs)
            gaps.append(own)
        missing, extra = list(set().union(*words)), {}
        for lo in range(0, len(missing), NEW_WORDS):
            extra |= self._new(missing[lo : lo + NEW_WORDS])
        room = self.limit - len(self)
        self.update(extra if room >= len(extra) else list(extra.items())[: max(0, room)])
        for xs, ws, own in zip(found, words, gaps, strict=True):
            for i, w in zip(own, ws, strict=True):
                xs[i] = extra[w]
            yield b"".join(xs)


def cuts(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        whole = capacity // rest
        if rest < SHORT or whole * rest >= CLOSE * capacity:
            out.append(rest)
            break
        size = capacity // (whole + 1)
        out.append(size)
        rest -= size
    return out


class Packer:
    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, raw, total in pieces:
            n = len(raw) // 4
            self.rows.append((doc, start, n, zlib.crc32(raw), total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc, raw: bytes) -> None:
        total = len(raw) // 4
        start = 0
        for n in cuts(total, self.capacity):
            k = self.capacity // n
            pieces = self.open.setdefault(k, [])
            pieces.append((doc, start, raw[4 * start : 4 * (start + n)], total))
            start += n
            if len(pieces) == k:
                self._emit(pieces)
                self.open[k] = []

    def finish(self) -> None:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) // 4 for p in rest)
        room = 0
        now: list[tuple] = []
        while rest:
            if not room:
                room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                left -= room
            doc, start, raw, total = rest.pop(0)
            n = min(room, len(raw) // 4)
            now.append((doc, start, raw[: 4 * n], total))
            if 4 * n < len(raw):
                rest.insert(0, (doc, start + n, raw[4 * n :], total))
            room -= n
            if not room:
                self._emit(now)
                now = []

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(COLUMNS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], COLUMNS)


_IDS: dict[str, WordIds] = {}
_CLEAR["packing"] = _IDS.clear


def packed(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer (no special tokens), then end_id; null or empty texts are end_id
    alone. Rows that repeat a doc_id are packed as documents of their own; a null doc_id stays null. Other columns
    are ignored. An empty table gives an empty result. sequence_id holds the partition in its upper bits: a task
    that runs again after a lost executor yields the same rows."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        if path not in _IDS:
            _IDS[path] = WordIds(path)
        words = _IDS[path]
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            step, lo = 0, 0
            for hi, t in enumerate(texts, 1):
                step += len(t)
                if step > 4 * PART_WORDS or hi == len(texts):
                    for doc, raw in zip(ids[lo:hi], words.texts(texts[lo:hi]), strict=True):
                        packer.add(doc, raw + end)
                    lo, step = hi, 0
            yield packer.take()
        packer.finish()
        yield packer.take()

    schema = ", ".join(f"{c} long" for c in COLUMNS)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
