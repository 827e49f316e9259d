"""N-gram Jaccard join by token-combination prefixes.

Each document is its set of distinct word shingles (64-bit hashes). Equal sets fold into one class.
For a class of n shingles and a similarity of num/den:

  o = ceil(n * num / den)      overlap that any similar set must reach
  k = min(o, 2 + o // 8)       overlap that similar sets must reach inside their samples
  sample                       the n - o + k smallest hashes (a prefix in hash order)
  prefix                       the n - o + 1 + M rarest shingles of the sample, by frequency then hash
  M                            number of frequent-token classes: a power of two near n / 32

Similar sets share at least k shingles of their samples and so at least 1 + M of their prefixes.
Rare shingles are indexed singly. Frequent ones fall into M classes by hash, and every pair of
one class is indexed as a combination: if two prefixes share no rare shingle, one of the M classes
holds two of the 1 + M shared ones. About four frequent shingles fall in a class, so the index
grows linearly with a document, and nothing similar is missed. M depends on n by bands; a document
near a band's edge is indexed in both.

Similar sets have similar sizes. Sizes fall into steps whose bounds are den / num apart, so those of similar sets are
equal or next to each other, and every signature is given with its set's step and with the next one: chance signatures
of sets of other sizes do not meet, which else would tie most of a large corpus into one unit.

Documents that share a signature form candidate units (connected components of a star for each
signature, never all pairs). Units are cut into blocks of bounded size; a block is verified exactly
in memory and emits only a spanning forest of its links. Members of larger units are kept as their symmetric
difference from the unit's first set, which is short for near copies; two sets differ by the symmetric difference
of their differences, so the check stays exact. Blocks of a unit are cut by size of set. Documents that a block leaves
outside their unit's largest component then visit those of the unit's other blocks that hold sets of similar sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_words, claim, dropped, hash_words, held, mixed, ship, stored, written
from .components import components

RARE = 12  #: shingles in at most so many samples are indexed singly
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 17  #: bounds of a verified block; units within them are one block
LARGE_SETS = 1024  #: sets in a block of a larger unit, whose members are kept as differences from its first set
BROADCAST_SHINGLES = 1 << 20  #: first sets of larger units with at most so many shingles (8 MB) are broadcast
TOUR = 64  #: in units of at most so many blocks a visitor sees all; in larger ones those with a common signature


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; the whole sequence where it has fewer words."""
    words = hash_words(text.lower().split())
    n = len(words)
    if not n:
        return words
    w = min(width, n)
    h = np.full(n - w + 1, w, np.uint64)
    for j in range(w):
        h = mixed(h + words[j : n - w + 1 + j])
    return np.unique(h)


class Rule:
    """Numbers of the prefix scheme for one similarity, num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n: int) -> int:
        return -(-n * self.num // self.den)

    def inner(self, n: int) -> int:
        o = self.overlap(n)
        return min(o, 2 + o // 8)

    def sample(self, n: int) -> int:
        return n - self.overlap(n) + self.inner(n)

    def step(self, n: int) -> int:
        """Steps of similar sizes differ by one at most (bounds are a little wider apart than den / num, for rounding)."""
        return int(math.log(n) / (math.log(self.den / self.num) * (1 + 1e-6))) if self.num < self.den else n

    def bands(self, n: int) -> list[int]:
        at = (n, n * self.den // self.num)
        return sorted({1 << max(0, (x // 32).bit_length() - 1) for x in at})


def _sets(width: int, rule: Rule, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        for b in batches:
            n, key, cls, toks = [], [], [], []
            for t in batch_words(b.column("text")):
                s = shingles(t, width)
                raw = s.tobytes()
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(raw))
                cls.append(np.int64(np.uint64(xxhash.xxh64_intdigest(raw)).view(np.int64)))
                toks.append((s if full else s[: rule.sample(len(s))] if len(s) > 1 else s[:0]).view(np.int64))
            sizes = np.fromiter(map(len, toks), np.int64, len(toks))
            flat = pa.array(np.concatenate(toks) if toks else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            if full:
                ok = pa.array(np.array(cls, np.int64) == b.column("cls").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cls", "unit", "large")), pa.array(n, pa.int64()), lists], ["cls", "unit", "large", "n", "toks"]).filter(ok)
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(cls, pa.int64()), lists], ["doc_id", "th", "n", "key", "cls", "toks"])

    return run


def _signatures(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, owner = [], []
            hits = b.column("hits")
            offs, flat = np.asarray(hits.offsets), hits.values
            dfs, tok = np.asarray(flat.field("df")), np.asarray(flat.field("tok"))
            for i, (c, n) in enumerate(zip(b.column("cls").to_pylist(), b.column("n").to_pylist(), strict=True)):
                d, t = dfs[offs[i] : offs[i + 1]], tok[offs[i] : offs[i + 1]].view(np.uint64)
                alone = rule.sample(n) - len(t)  # shingles of the sample that no other set has
                base, most = n - rule.overlap(n) + 1, rule.inner(n) - 1
                order = np.lexsort((t, d))
                d, t = d[order], t[order]
                bands = [min(m, most) for m in rule.bands(n)]
                got = [t[: max(0, base + max(bands) - alone)][d[: max(0, base + max(bands) - alone)] <= RARE]]
                for m in set(bands) - {0}:
                    f = t[: max(0, base + m - alone)]
                    f = np.sort(f[d[: len(f)] > RARE])
                    if len(f) < 2:
                        continue
                    group = f % np.uint64(m)
                    for g in np.unique(group):
                        x = f[group == g]
                        i1, i2 = np.triu_indices(len(x), 1)
                        got.append(mixed(mixed(x[i1] + np.uint64(m)) + x[i2]))
                s, step = np.concatenate(got), rule.step(n)
                s = np.concatenate([mixed(s + np.uint64(step)), mixed(s + np.uint64(step + 1))])
                sigs.append(s)
                owner.append(np.full(len(s), c, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owner))], ["sig", "cls"])

    return run


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches. A run is held whole; its size is bounded by the caller's blocks."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k)) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *change.tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[lo] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _similar(x: np.ndarray, n: int, sizes: np.ndarray, offs: np.ndarray, flat: np.ndarray, rule: Rule) -> np.ndarray:
    """Which sets are similar to x. x and flat (cut at offs) hold differences from one base set, which may be empty;
    n and sizes are the sizes of the sets themselves."""
    at = np.searchsorted(x, flat)
    at[at == len(x)] = 0
    same = np.concatenate([[0], np.cumsum(x[at] == flat)]) if len(x) else np.zeros(len(flat) + 1, np.int64)
    apart = len(x) + np.diff(offs) - 2 * (same[offs[1:]] - same[offs[:-1]])
    inter = (n + sizes - apart) // 2
    return rule.den * inter >= rule.num * (n + sizes - inter)


def _unpack(t: pa.Table):
    lists = t.column("toks").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    offs = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)[offs[0] : offs[-1]].view(np.uint64)
    return np.asarray(t.column("cls").combine_chunks()), np.asarray(t.column("n").combine_chunks()), flat, offs - offs[0]


def _forest(ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, offs: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links that span every component of the sets of a block: breadth-first, each set is expanded once."""
    left, out = np.ones(len(ids), bool), []
    for s in range(len(ids)):
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(left)
            rest = rest[(rule.den * sizes[rest] >= rule.num * sizes[i]) & (rule.den * sizes[i] >= rule.num * sizes[rest])]
            if not len(rest):
                continue
            part = np.concatenate([flat[offs[j] : offs[j + 1]] for j in rest])
            cut = np.concatenate([[0], np.cumsum(offs[rest + 1] - offs[rest])])
            for j in rest[_similar(flat[offs[i] : offs[i + 1]], int(sizes[i]), sizes[rest], cut, part, rule)]:
                left[j] = False
                queue.append(j)
                out.append((ids[i], ids[j]))
    return out


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of larger units as symmetric differences from their unit's first set (a column base)."""
    claim("none")
    for b in batches:
        out = [np.setxor1d(np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64), assume_unique=True) for x, y in zip(b.column("toks"), b.column("base"), strict=True)]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        flat = np.concatenate(out) if out else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("unit"), b.column("n"), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))], ["cls", "unit", "n", "toks"])


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["a", "b"])


def _verify(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        for t in by_group(batches, ["unit", "slice"]):
            if t.num_rows > 1:
                yield _links(_forest(*_unpack(t), rule))

    return run


def _visit(rule: Rule):
    """Residents of a block come first; visitors are streamed past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none")
        key, held, home = None, [], None
        for b in batches:
            role, pos = np.asarray(b.column("role")), 0
            for t in by_group(iter([b]), ["unit", "slice", "role"]):
                now, own = (t.column("unit")[0].as_py(), t.column("slice")[0].as_py()), role[pos]
                pos += t.num_rows
                if now != key:
                    key, held, home = now, [], None
                if own == 0:
                    held.append(t)
                    continue
                if home is None:
                    if not held:
                        continue
                    whole = pa.concat_tables(held)
                    whole = whole.sort_by("n")
                    home = (*_unpack(whole), np.asarray(whole.column("comp").combine_chunks()))
                ids, sizes, flat, offs, comp = home
                vid, vsizes, vflat, voffs = _unpack(t)
                out = []
                for i, c in enumerate(np.asarray(t.column("comp").combine_chunks())):
                    n = int(vsizes[i])
                    lo, hi = np.searchsorted(rule.den * sizes, rule.num * n), np.searchsorted(rule.num * sizes, rule.den * n, "right")
                    if lo == hi:
                        continue
                    own, part = offs[lo : hi + 1] - offs[lo], flat[offs[lo] : offs[hi]]
                    hit = lo + np.flatnonzero(_similar(vflat[voffs[i] : voffs[i + 1]], n, sizes[lo:hi], own, part, rule) & (comp[lo:hi] != c))
                    first = np.unique(comp[hit], return_index=True)[1]
                    out += [(vid[i], x) for x in ids[hit][first]]
                yield _links(out)

    return run


def _large_units(sets: DataFrame, sigs: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that span the components of units of more than one block."""
    base = sets.where("cls = unit").select("unit", F.col("toks").alias("base")).dropDuplicates(["unit"])
    if (base.agg(F.sum(F.size("base"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        base = F.broadcast(base)
    short = stored(sets.join(base, "unit").select("cls", "unit", "n", "toks", "base").mapInArrow(_differences, "cls long, unit long, n long, toks array<long>"))
    size = short.groupBy("unit").agg(F.count("*").alias("sets"), F.sum(F.size("toks")).alias("shingles"))
    slices = size.select("unit", F.greatest(F.ceil(F.col("sets") / LARGE_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("slices"))
    dealt = short.join(held(stored(slices)), "unit")
    # slice: which of unit's parts of equal sums of work, in the order of sizes, as running sums over a histogram of sizes show
    work = F.lit(BLOCK_SHINGLES // LARGE_SETS) + F.size("toks")
    sizes = stored(dealt.groupBy("unit", "slices", "n").agg(F.sum(work).alias("work")))
    along = Window.partitionBy("unit").orderBy("n")
    share = sizes.select("unit", "n", "slices", "work", F.sum("work").over(along).alias("upto"), F.sum("work").over(Window.partitionBy("unit")).alias("total"))
    share = held(stored(share.select("unit", "n", *[F.least(F.col("slices") - 1, F.floor((F.col("upto") - F.col("work") * x) * F.col("slices") / F.col("total"))).alias(c) for c, x in (("low", 1), ("high", 0))])))
    spread = F.pmod(F.xxhash64("cls"), F.col("high") - F.col("low") + 1)  # sets of one size may fill several parts
    dealt = dealt.join(share, ["unit", "n"]).withColumn("slice", F.col("low") + spread).drop("low", "high")
    cut, toks = dealt.drop("toks"), short.select("cls", "toks")
    blocks = dealt.repartition("unit", "slice").sortWithinPartitions("unit", "slice")
    links = stored(blocks.select("cls", "unit", "slice", "n", "toks").mapInArrow(_verify(rule), "a long, b long"))
    cut = cut.where("slices > 1")
    if cut.isEmpty():
        return links
    comps = components(links)
    cut = stored(cut.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "unit", "slice", "slices", "n", F.coalesce("comp", "cls").alias("comp")))
    largest = cut.groupBy("unit", "comp").count().groupBy("unit").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    minor = stored(cut.join(largest, "unit").where("comp <> main").drop("main"))
    cut = stored(cut.join(minor.select("unit").distinct(), "unit", "left_semi"))  # whole units need no visits
    ranges = held(stored(cut.groupBy("unit", F.col("slice").alias("to")).agg(F.min("n").alias("least"), F.max("n").alias("most"))))
    similar = (F.col("n") * rule.num <= F.col("most") * rule.den) & (F.col("least") * rule.num <= F.col("n") * rule.den)
    near = minor.where(F.col("slices") <= TOUR).join(ranges, "unit").where(similar).select(*minor.columns, "to")
    wide = cut.where(F.col("slices") > TOUR)
    seen = sigs.join(wide, "cls").select("sig", "unit", F.col("slice").alias("to")).distinct()
    far = minor.where(F.col("slices") > TOUR).join(sigs, "cls").join(seen, ["sig", "unit"]).select(*near.columns).distinct()
    trips = near.unionByName(far).where("slice <> to").select("cls", "unit", F.col("to").alias("slice"), "n", "comp")
    both = cut.select("cls", "unit", "slice", "n", "comp", F.lit(0).alias("role")).unionByName(trips.withColumn("role", F.lit(1)))
    rows = both.join(toks, "cls").repartition("unit", "slice").sortWithinPartitions("unit", "slice", "role")
    more = rows.select("cls", "unit", "slice", "role", "comp", "n", "toks").mapInArrow(_visit(rule), "a long, b long")
    return links.unionByName(more)


def labelled(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, th (xxhash64 of the text: with doc_id it names a row), n (set size), cls (hash of the set), rep and kept.

    rep is the first row of the document's component, struct<none, first_doc, first_th>: the smallest doc_id, a null
    one last, then the smallest th; null for empty sets. kept: whether the row is that first row, or its set is empty."""
    ship(docs.sparkSession)
    rule = Rule(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    spark, first_at = docs.sparkSession, written()
    every = stored(docs.mapInArrow(_sets(width, rule, False), "doc_id long, th long, n long, key binary, cls long, toks array<long>"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("first_doc"), F.col("th").alias("first_th"), "n", "cls", "toks")
    reps = stored(every.where("n > 0").groupBy("key").agg(F.min(own).alias("r")).select("key", "r.first_doc", "r.first_th", "r.n", "r.cls", "r.toks"))
    every = stored(every.drop("toks"))
    dropped(spark, first_at, first_at + 1)
    posts = reps.select("cls", "n", F.explode("toks").alias("tok"))
    df = posts.groupBy("tok").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    o = F.floor((F.col("n") * num + (den - 1)) / den)
    found = posts.join(df, "tok").groupBy("cls", "n").agg(F.collect_list(F.struct("df", "tok")).alias("hits"))
    found = found.where(F.size("hits") > F.least(o, 2 + F.floor(o / 8)) - 1 - F.greatest(F.lit(1), F.floor(F.col("n") * den / num / 32)))
    sigs = stored(found.mapInArrow(_signatures(rule), "sig long, cls long"))
    reps = stored(reps.drop("toks"))
    dropped(spark, first_at + 1, first_at + 2)
    lead = sigs.groupBy("sig").agg(F.min("cls").alias("lead"), F.max("cls").alias("top")).where("lead < top").select("sig", "lead")
    units = components(sigs.join(lead, "sig").select("cls", "lead"), "cls", "lead")
    members = stored(units.join(reps.select(F.col("cls").alias("node"), "first_doc", "first_th", "n"), "node").select(F.col("node").alias("cls"), F.col("comp").alias("unit"), "first_doc", "first_th", "n"))
    size = members.groupBy("unit").agg(((F.count("*") > BLOCK_SETS) | (F.sum("n") > BLOCK_SHINGLES)).alias("large"))
    placed = stored(members.join(size, "unit").drop("n"))
    want = held(placed)
    texts = docs.join(want, docs["doc_id"].eqNullSafe(want["first_doc"]) & (docs["th"] == want["first_th"])).select("cls", "unit", "large", "text")
    if not every.where("n > 0").groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["cls"])  # a row that is there more than once stands for its set once
    sets = stored(texts.mapInArrow(_sets(width, rule, True), "cls long, unit long, large boolean, n long, toks array<long>"))
    small = sets.where("not large").repartition("unit").sortWithinPartitions("unit")
    links = stored(small.select("cls", "unit", F.lit(0).cast("long").alias("slice"), "n", "toks").mapInArrow(_verify(rule), "a long, b long"))
    large = sets.where("large")
    if not large.isEmpty():
        more = _large_units(large, sigs, rule)
        links = stored(links.unionByName(more))
    comps = components(links)
    first = F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "first_th")
    named = comps.join(placed.select(F.col("cls").alias("node"), first.alias("own")), "node")
    low = named.groupBy("comp").agg(F.min("own").alias("low"))
    linked = named.join(low, "comp").select(F.col("node").alias("cls"), "low")
    classes = reps.select("key", "cls", first.alias("own")).join(linked, "cls", "left").select("key", F.coalesce("low", "own").alias("rep"))
    out = every.select("doc_id", "th", "n", "key", "cls").join(classes, "key", "left")
    is_first = F.col("doc_id").eqNullSafe(F.col("rep.first_doc")) & (F.col("th") == F.col("rep.first_th"))
    return out.select("doc_id", "th", "n", "cls", "rep", F.when(F.col("n") > 0, is_first).otherwise(F.lit(True)).alias("kept"))


def component_table(docs: DataFrame, width: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, class_id (hash of the set; null for an empty one), component_id; a row for each row of docs.

    docs: doc_id long, text string; other columns are ignored. Words are runs of bytes that are not ASCII white
    space, A-Z lower-cased; a text of fewer than `width` words is one shingle. Null or empty texts and texts
    without words have n_shingles 0 and link with nothing: component_id is their doc_id. Rows that repeat a
    doc_id are documents of their own with that id; a null doc_id counts as larger than any other, and a component of
    such rows alone has a null component_id. An empty table gives an empty result."""
    rows = labelled(docs, width, num, den)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("class_id"), F.when(F.col("n") > 0, F.col("rep.first_doc")).otherwise(F.col("doc_id")).alias("component_id"))
