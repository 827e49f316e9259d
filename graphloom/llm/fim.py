"""Fill-in-middle: documents cut in prefix, middle and suffix and put in another order.

Where a unit begins is told by adjacent bytes alone: a unit of `char` begins at every byte that does not continue a
character, one of `word` at a byte that is not blank after one that is, one of `line` after a line feed. So texts can be
cut into chunks of bytes anywhere, each overlapping the one before by a byte: all chunks count their boundaries at once,
prefix sums of the counts say which chunk holds a given rank, and only the chunks that own the two cuts of a document are
looked at again for the cuts' places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, ship

CHUNK = 256  #: bytes of a chunk
SLAB = 1 << 15  #: chunks that count at once (8 MB of bytes)
MARKS = (b"<P>", b"<S>", b"<M>")
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: (byte before, byte) -> whether a unit begins at the byte
BEGINS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "char": lambda before, at: (at & 0xC0) != 0x80,
    "word": lambda before, at: BLANK[before] & ~BLANK[at],
    "line": lambda before, at: before == 10,
}


class Chunks:
    """Chunks of the texts in raw (text i lies from edge[i] to edge[i + 1]); no chunk holds two texts."""

    def __init__(self, raw: np.ndarray, edge: np.ndarray, unit: str):
        self.raw, self.begins = raw, BEGINS[unit]
        size = np.diff(edge)
        self.first = np.concatenate([[0], np.cumsum(-(-size // CHUNK))])  # of each text
        n = int(self.first[-1])
        owner = np.repeat(np.arange(len(size)), np.diff(self.first))
        self.start = edge[owner] + (np.arange(n) - self.first[owner]) * CHUNK
        self.stop = np.minimum(self.start + CHUNK, edge[owner + 1])
        self.opens = np.zeros(n, bool)
        self.opens[self.first[:-1][size > 0]] = True
        self.upto = np.zeros(n + 1, np.int64)
        for lo in range(0, n, SLAB):
            hi = min(lo + SLAB, n)
            a, z = int(self.start[lo]), int(self.stop[hi - 1])
            flags = self._flags(a, z)
            flags[self.start[lo:hi][self.opens[lo:hi]] - a] = True  # a text begins with a unit whatever lies before
            self.upto[lo + 1 : hi + 1] = np.add.reduceat(flags, self.start[lo:hi] - a, dtype=np.int64)
        np.cumsum(self.upto, out=self.upto)

    def _flags(self, a: int, z: int) -> np.ndarray:
        """Whether a unit begins at each byte from a to z; the chunk's overlap is the byte before a."""
        at = self.raw[a:z]
        before = np.empty_like(at)
        before[1:] = at[:-1]
        before[:1] = self.raw[a - 1] if a else 10
        return self.begins(before, at)

    def units(self) -> np.ndarray:
        """Number of units of each text."""
        return self.upto[self.first[1:]] - self.upto[self.first[:-1]]

    def places(self, text: np.ndarray, rank: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where unit `rank` (from 0) of each text begins; end where it has no more units."""
        whole = self.upto[self.first[text]] + rank
        owner = np.searchsorted(self.upto, whole, side="right") - 1
        out = end.copy()
        for i in np.flatnonzero(rank < self.units()[text]).tolist():
            c = int(owner[i])
            flags = self._flags(int(self.start[c]), int(self.stop[c]))
            if self.opens[c]:
                flags[0] = True
            out[i] = self.start[c] + np.flatnonzero(flags)[whole[i] - self.upto[c]]
        return out


def draws(seed: str, doc_id) -> list[int]:
    """Four numbers below 2^32 from the SHA-256 of seed:id; a null id is empty."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transformed(ids: list, raw: np.ndarray, edge: np.ndarray, unit: str, seed: str, plain: int, spm: int) -> tuple[list, ...]:
    """Columns n, form, prefix, middle (units) and output (bytes) of the texts in raw."""
    chunks = Chunks(raw, edge, unit)
    n = chunks.units()
    rows = np.arange(len(ids))
    data = raw.tobytes()
    low, high, forms = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), []
    for i, doc in enumerate(ids):
        h = draws(seed, doc)
        cut = sorted((h[0] % (int(n[i]) + 1), h[1] % (int(n[i]) + 1)))
        low[i], high[i] = cut
        a, z = int(edge[i]), int(edge[i + 1])
        whole = a == z or h[2] % 100 >= plain or any(data.find(m, a, z) >= 0 for m in MARKS)
        forms.append("plain" if whole else "spm" if h[3] % 100 < spm else "psm")
    cut = np.flatnonzero([f != "plain" for f in forms])
    at, to = edge[:-1].copy(), edge[:-1].copy()
    at[cut], to[cut] = chunks.places(rows[cut], low[cut], edge[1:][cut]), chunks.places(rows[cut], high[cut], edge[1:][cut])
    p, s, m = MARKS
    out = []
    for f, a, x, y, z in zip(forms, edge[:-1].tolist(), at.tolist(), to.tolist(), edge[1:].tolist(), strict=True):
        prefix, middle, suffix = data[a:x], data[x:y], data[y:z]
        out.append(data[a:z] if f == "plain" else p + prefix + s + suffix + m + middle if f == "psm" else s + suffix + p + prefix + m + middle)
    kept = [f != "plain" for f in forms]
    prefix = [int(v) if k else None for v, k in zip(low, kept, strict=True)]
    middle = [int(b - a) if k else None for a, b, k in zip(low, high, kept, strict=True)]
    return n.tolist(), forms, prefix, middle, out


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: str = "1", plain: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_units, middle_units and output, a row for each row of docs.

    Of all texts, plain percent are cut (others stay whole), of these spm percent with the suffix first; which ones, and
    where, comes from a hash of seed and id. Null and empty texts and those that hold a mark stay whole. Rows that repeat
    an id are cut by the same numbers, null ids as the empty id. Other columns are left out. An empty table gives an
    empty result."""
    ship(docs.sparkSession)
    names = ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).fill_null(b"")
            edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            held = texts.buffers()[2]
            raw = np.frombuffer(held, np.uint8)[edge[0] : edge[-1]] if held else np.empty(0, np.uint8)
            n, form, prefix, middle, out = transformed(b.column("doc_id").to_pylist(), raw, edge - edge[0], unit, seed, plain, spm)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No mark can arise where two parts meet, as marks do not overlap."""
    part = F.split(output, "<P>|<S>|<M>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def fim_table(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text rebuilt from it."""
    return fill_in_middle(docs).select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS e FROM d),
f AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN n = 0 OR c >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substring(text, 1, lo) AS prefix, substring(text, lo + 1, hi - lo) AS middle, substring(text, hi + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
sha256(prefix || middle || suffix) AS restored_sha256 FROM p"""
