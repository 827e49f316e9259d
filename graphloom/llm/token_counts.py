"""Exact token counts by a compiled finite-state tokenizer.

Two deterministic transducers run one after the other. The first is the pre-tokenizer of the byte-level vocabulary: 8
states over 9 symbols (a character's class with one character of lookahead); each transition says whether a piece
begins at the character. Text is cut into chunks of equal length whatever its word borders. A chunk is a map from entry
state to exit state; these maps compose associatively, so a parallel prefix scan over them gives every chunk's entry
state, and all chunks then run in lockstep to mark where pieces begin.

The second compiles the merges: it reads the bytes of a piece, and every transition carries the number of tokens that it
emits (the count of the prefix read so far may also fall, by a negative number). A prefix has exactly one last token: the
one that fits the last token of the shorter prefix before it, where two tokens fit if no merge joins their ends before
each is complete. A state is what later bytes can still depend on: for every start of a possible further token its
place in the vocabulary's trie, the token before it and the count there. States and transitions are determinised when
first met and kept in a bounded hash table. At the first byte of a piece the state is START whatever came before, so
the map of a chunk that begins there is constant: all chunks run in lockstep and their counts add up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .common import _CLEAR, claim, ship

L, N, O, A2, A3, SP, WS, WW, END = range(9)
START, IN_L, IN_N, IN_O, SPACE, IN_W, ONE, TWO = range(8)
CHUNK, PART_CHARS = 256, 1_500_000
#: What may follow an apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")
BREAK = re.compile(r"[^\s](?=[ \t\n\r])")  #: a character before a blank


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """next state and piece-end flag for state * 9 + symbol."""
    to, cut = np.zeros((8, 9), np.uint8), np.ones((8, 9), np.uint8)
    for sym, state in ((L, IN_L), (N, IN_N), (O, IN_O)):
        to[:, sym] = state
        cut[[state, SPACE], sym] = 0
    to[TWO, L], to[ONE, L] = ONE, START
    cut[[ONE, TWO], L] = 0
    for sym, state in ((A2, ONE), (A3, TWO)):
        to[:, sym] = state
        to[[IN_O, SPACE], sym] = IN_O
        cut[[IN_O, SPACE], sym] = 0
    to[:, SP], to[:, WS], to[:, WW], to[:, END] = SPACE, START, IN_W, START
    cut[IN_W, WW] = 0
    return to.ravel(), cut.ravel()


NEXT, CUT = transducer()


class Merges:
    """Transducer over bytes for the merges of a tokenizers JSON file; states and transitions are made on demand."""

    def __init__(self, model: dict, limit: int = 600_000, size: int = 1 << 21):
        """limit: transitions and states that are held before a renewal; size: slots of the table, a power of two that
        leaves room for limit and one transition more for each chunk of a part."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        number = {c: i for i, c in enumerate(byte)}
        self.rank: dict[tuple[int, int], int] = {}
        left, right, self.born, spelled = [-1] * 256, [-1] * 256, [-1] * 256, list(byte)
        for r, (a, b) in enumerate(pairs):
            x, y = number[a], number[b]
            if a + b not in number:
                number[a + b] = len(left)
                left.append(x)
                right.append(y)
                self.born.append(r)
                spelled.append(a + b)
            self.rank.setdefault((x, y), r)
        self.left, self.right = left, right
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t, text in enumerate(spelled):
            node = 0
            for c in text:
                nxt = self.child[node].get(byte[c])
                if nxt is None:
                    nxt = self.child[node][byte[c]] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = t
        self.limit, self.size, self.shift = limit, size, np.uint64(64 - (size.bit_length() - 1))
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.fits.clear()
        self.states: dict[tuple, int] = {((0, -1, 0),): 0}
        self.known: list[tuple] = [((0, -1, 0),)]
        self.keys = np.full(self.size, -1, np.int64)
        self.to = np.zeros(self.size, np.int32)
        self.emits = np.zeros(self.size, np.int16)
        self.used = 0

    def _ends(self, token: int, side: list[int]) -> list[tuple[int, float]]:
        """Tokens along one end of a token's merge tree, each with the rank at which a merge uses it up."""
        out, end = [], float("inf")
        while token >= 0:
            out.append((token, end))
            end, token = self.born[token], side[token]
        return out

    def fit(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: no merge of an end of a with an end of b comes while both are there. Of two
        equal merges the one further left comes first."""
        got = self.fits.get((a, b))
        if got is None:
            ours = self._ends(b, self.left)
            got = not any(x_end > r and y_end >= r for x, x_end in self._ends(a, self.right) for y, y_end in ours if (r := self.rank.get((x, y))) is not None)
            self.fits[a, b] = got
        return got

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and emitted tokens."""
        open_, last, count = [], -1, 0
        for node, before, had in self.known[state]:
            nxt = self.child[node].get(byte)
            if nxt is None:
                continue
            t = self.token[nxt]
            if t >= 0 and (before < 0 or self.fit(before, t)):
                last, count = t, had + 1
            if self.child[nxt]:
                open_.append((nxt, before, had))
        entry = (*((n, b, h - count) for n, b, h in open_), (0, last, 0))
        to = self.states.get(entry)
        if to is None:
            to = self.states[entry] = len(self.known)
            self.known.append(entry)
        return to, count

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _learn(self, keys: np.ndarray) -> None:
        keys = np.unique(keys)
        made = [self.step(key >> 8, key & 255) for key in keys.tolist()]
        to, count = np.array(made, np.int64).T
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.to[at[won]], self.emits[at[won]] = keys[won], to[won], count[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & (self.size - 1)
        self.used += len(keys)

    def full(self) -> bool:
        return self.used > self.limit or len(self.known) > self.limit

    def renew(self, live: np.ndarray) -> np.ndarray:
        """Forgets all states and transitions but the states in live; returns their new numbers. A state is all that
        later bytes depend on, so counts stay the same."""
        old, place = np.unique(live, return_inverse=True)
        entries = [self.known[s] for s in old.tolist()]
        self.reset()
        new = []
        for e in entries:
            if e not in self.states:
                self.states[e] = len(self.known)
                self.known.append(e)
            new.append(self.states[e])
        return np.array(new, np.int32)[place.reshape(-1)] if new else live

    def move(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state.astype(np.int64) << 8 | byte
        at = self._slot(key)
        got = self.keys[at]
        off = np.flatnonzero(got != key)
        while len(off):
            new = off[got[off] < 0]
            if len(new):
                self._learn(key[new])
                at[new] = self._slot(key[new])
                off = np.union1d(new, np.setdiff1d(off, new, assume_unique=True))
                got[new] = self.keys[at[new]]
                off = off[got[off] != key[off]]
                if not len(off):
                    break
            at[off] = (at[off] + 1) & (self.size - 1)
            got[off] = self.keys[at[off]]
            off = off[got[off] != key[off]]
        return self.to[at], self.emits[at]

    def counts(self, raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Tokens that each byte emits; begin: where pieces begin, 0 first. The bytes run in lockstep as chunks of about
        CHUNK bytes, each from the begin of a piece. A step makes no more transitions than there are chunks; when more
        than `limit` are known, the chunks' states are carried into an empty table."""
        out = np.zeros(len(raw), np.int16)
        if self.full():
            self.reset()
        first = begin[np.unique(np.searchsorted(begin, np.arange(0, len(raw), CHUNK)).clip(max=len(begin) - 1))]
        size = np.diff(np.append(first, len(raw)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        fresh = np.zeros(len(raw), bool)
        fresh[begin] = True
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left").tolist()
        state = np.zeros(len(first), np.int32)
        for k, m in enumerate(live):
            if m < 8:  # what is left of a few long pieces
                self._singly(raw, fresh, first[:m] + k, first[:m] + size[:m], state[:m], out)
                break
            if self.full():
                state[:m] = self.renew(state[:m])
            at = first[:m] + k
            now = state[:m]
            now[fresh[at]] = 0
            state[:m], out[at] = self.move(now, raw[at])
        return out

    def _singly(self, raw, fresh, start, stop, state, out) -> None:
        rest = state.tolist()
        for lane, (a, z) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
            s, memo = rest[lane], {}
            for lo in range(a, z, CHUNK):  # bytes become numbers a chunk at a time, whatever a piece's length
                if self.full() or len(memo) > self.limit:
                    s, *rest[lane + 1 :] = self.renew(np.array([s, *rest[lane + 1 :]], np.int32)).tolist()
                    memo = {}
                hi = min(lo + CHUNK, z)
                for i, (byte, new) in enumerate(zip(raw[lo:hi].tolist(), fresh[lo:hi].tolist(), strict=True), lo):
                    key = (0 if new else s, byte)
                    got = memo.get(key)
                    if got is None:
                        got = memo[key] = self.step(*key)
                    s, out[i] = got


class Counter:
    """Tokens of texts by both transducers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str  # for the classes of characters
        self.classes = np.full(0x110000, 255, np.uint8)

    def _class(self, char: str) -> int:
        """Class of a character as the library's own pre-tokenizer treats it: which runs it joins."""
        for sym, probe in ((L, "a"), (N, "1"), (O, "!")):
            if len(self.split(probe + char)) == 1:
                return sym
        return WS

    def symbols(self, text: str, ends: np.ndarray) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cls = self.classes[codes]
        if (cls == 255).any():
            for c in np.unique(codes[cls == 255]).tolist():
                self.classes[c] = self._class(chr(c))
            cls = self.classes[codes]
        cls[ends] = END
        after = np.append(cls[1:], END)
        blank = cls == WS
        more = blank & ((after == WS) | (after == END))
        sym = cls.copy()
        sym[blank & (codes == 32)] = SP
        sym[more] = WW
        quote = np.flatnonzero((codes == 39) & (cls == O))
        for q in quote.tolist():  # apostrophes only
            if text[q + 1 : q + 2] in SHORT and text[q + 1 : q + 2]:
                sym[q] = A2
            elif text[q + 1 : q + 3] in LONG:
                sym[q] = A3
        return sym

    def ends(self, sym: np.ndarray) -> np.ndarray:
        """Positions where a piece begins."""
        n = len(sym)
        wide = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
        wide[:n] = sym
        grid = np.ascontiguousarray(wide.reshape(-1, CHUNK).T)  # step, chunk
        state = entry_states(grid)
        cuts = np.empty(grid.shape, np.uint8)
        for k in range(CHUNK):
            at = state * np.uint8(9) + grid[k]
            cuts[k] = CUT[at]
            state = NEXT[at]
        return np.flatnonzero(cuts.T.ravel()[:n])

    def segments(self, text: str) -> Iterator[tuple[str, int]]:
        """A text cut at special strings, and where it is longer than PART_CHARS before blanks that follow other
        characters: a piece begins there whatever lies around. A run without blanks stays whole, however long."""
        parts = [text]
        for s in self.special:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
        for n, p in enumerate(parts):
            lo = 0
            while len(p) - lo > PART_CHARS and (m := BREAK.search(p, lo + PART_CHARS // 2)):
                yield p[lo : m.start() + 1], 0
                lo = m.start() + 1
            yield p[lo:], int(n < len(parts) - 1)  # a special string inside a text is one token

    def count_all(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        held, owner, size = [], [], 0
        for i, t in enumerate(texts):
            for segment, special in self.segments(t):
                total[i] += special
                if held and size + len(segment) > PART_CHARS:
                    np.add.at(total, owner, self._counted(held))
                    held, owner, size = [], [], 0
                held.append(segment)
                owner.append(i)
                size += len(segment)
        if held:
            np.add.at(total, owner, self._counted(held))
        return total

    def _counted(self, segments: list[str]) -> np.ndarray:
        """Tokens of each segment."""
        text = "\n".join(segments) + "\n"
        border = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1) - 1
        begin = self.ends(self.symbols(text, border))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.cumsum(width) - width
        emitted = self.merges.counts(np.frombuffer(text.encode(), np.uint8), place[begin])
        emitted[place[border]] = 0
        return np.add.reduceat(emitted.astype(np.int64), np.concatenate([[0], place[border[:-1]] + 1]))


def entry_states(grid: np.ndarray) -> np.ndarray:
    """Entry state of every chunk (column): each chunk's state map, composed by a prefix scan.

    SP, WS and END send every state to one; a chunk with such a symbol has a constant map, which needs only
    the symbols after its last one."""
    steps, lanes = grid.shape
    fixed = (grid == SP) | (grid == WS) | (grid == END)
    last = steps - 1 - np.argmax(fixed[::-1], axis=0)
    constant = fixed.any(axis=0)
    maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    lane = np.flatnonzero(constant)
    at = last[lane]
    state = NEXT[grid[at, lane]]
    while len(lane):
        at = at + 1
        done = at == steps
        maps[lane[done]] = state[done, None]
        lane, at, state = lane[~done], at[~done], state[~done]
        state = NEXT[state * np.uint8(9) + grid[at, lane]]
    free = np.flatnonzero(~constant)
    if len(free):
        m = maps[free]
        for k in range(steps):
            m = NEXT[m * np.uint8(9) + grid[k, free][:, None]]
        maps[free] = m
        width = 1
        while width < lanes:  # Hillis-Steele: after it, maps[i] is the map of chunks 0..i
            maps[width:] = np.take_along_axis(maps[width:], maps[:-width], axis=1)
            width *= 2
    return np.concatenate([[np.uint8(START)], maps[:-1, START]])


_COUNTERS: dict[str, Counter] = {}
_CLEAR["tokens"] = _COUNTERS.clear


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), a row for each row of docs.

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids keep their rows; further
    columns are ignored; an empty table gives an empty result. The path names a byte-level vocabulary."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        c = counter(path)
        for b in batches:
            ids, column = b.column("doc_id"), b.column("text")
            texts = [t or "" for t in column.to_pylist()]
            size = [len(t.encode()) for t in texts]
            n = c.count_all(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
