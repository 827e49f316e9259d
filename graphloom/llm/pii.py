"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Generators with high recall propose spans that may overlap: the four base kinds and loose forms (long digit
groups, long mixed tokens with a digit, anything around an @). Boosted trees use format and context features, among
them a naming word just before the span and the prefixes of key issuers. They are fitted on the candidates of every
document, with weak labels (a validated base match, a naming word or an issuer's prefix). Features have fixed steps, so
candidates that agree in all of them are one row with their number as its weight. Half of the candidates, by hash,
teach the trees; each kind's threshold is calibrated on the other half, which the trees did not see. Base matches always stay; selected candidates of the loose kinds that no base span covers are added. The trees become SQL CASE expressions, so a document
is scored inside its own row: no shuffle, no Python.

Offsets: a regular expression's matches and the gaps between them (split by the same expression) lie end to end,
so running sums of their lengths are the positions, in code points.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Base forms, in the order in which they are listed. A leading look-behind after the first character replaces
#: restarts inside a run that has already failed, and possessive loops replace those that could only backtrack in vain.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "address": r"[^\s@\x22'<>(),;=]{1,80}+@[^\s@\x22'<>(),;=]++",
    "number": r"[0-9](?<![0-9][0-9])(?:[ ().-]{0,2}[0-9]){8,24}+",
    "secret": r"[A-Za-z0-9](?<![A-Za-z0-9+/_-][A-Za-z0-9])[A-Za-z0-9+/_-]{15,}+={0,2}+",
}
GUARD = {"email": "@", "address": "@", "phone": "+"}
NAMING = r"(?i)(?:token|key|secret|passw\w*|auth\w*|bearer|ssn|iban|account|mail|phone|tel)\W{0,6}$"
#: Prefixes of keys as their issuers give them.
ISSUED = r"^(?:AKIA|ASIA|AIza|gh[pousr]_|sk[-_]|xox[abprs]-|eyJ)"
TREES, DEPTH, PRECISION = 12, 3, 0.9
#: Shares are multiples of 1 / STEPS, counts end at MOST. Spark looks for splits in a part of the rows where there are more
#: than MAX_BINS ** 2 of them; a feature has fewer values than MAX_BINS, so every bound between two of them is a split.
STEPS, MOST, MAX_BINS = 64, 200, 1024


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    d = _digits(x)
    digit = f"int(substring({d}, -j, 1))"
    doubled = f"if(j % 2 = 1, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))"
    return f"aggregate(sequence(1, length({d})), 0, (t, j) -> t + {doubled}) % 10 = 0"


CHECK = {
    "email": "true",
    "ip": r"{x} rlike '^0*+(?:[0-9]{{1,2}}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?(?:\\.0*+(?:[0-9]{{1,2}}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?){{3}}$'",
    "card": "{luhn}",
    "phone": "length({digits}) between 9 and 15",
    "secret": "{x} rlike '[0-9]'",
}


def _check(kind: str, x: str) -> str:
    rule = CHECK.get(kind, "true")
    return rule.format(x=x, luhn=_luhn(x), digits=_digits(x))


def _spans(kind: str) -> Column:
    """array<struct<k, s, e, x>> from the match and gap columns of a kind."""
    m, g = f"m_{kind}", f"g_{kind}"
    piece, start = f"element_at({m}, i)", f"a.p + length(element_at({g}, i))"
    span = f"named_struct('k', '{kind}', 's', {start}, 'e', {start} + length({piece}), 'x', {piece})"
    none = "cast(array() as array<struct<k: string, s: int, e: int, x: string>>)"
    step = f"named_struct('p', {start} + length({piece}), 'o', if({_check(kind, piece)}, array_append(a.o, {span}), a.o))"
    return F.expr(f"case when size({m}) > 0 then aggregate(sequence(1, size({m})), named_struct('p', 0, 'o', {none}), (a, i) -> {step}).o else {none} end")


def with_spans(docs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """docs with a column s_<kind> of spans for each kind; docs must have a column body, the text without null."""
    own = docs.columns
    matched = docs.select("*", *[_matches(k, p).alias(f"m_{k}") for k, p in kinds.items()])
    gaps = matched.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("body", p, -1)).alias(f"g_{k}") for k, p in kinds.items()])
    return gaps.select(*own, *[_spans(k).alias(f"s_{k}") for k in kinds])


def _matches(kind: str, pattern: str) -> Column:
    found = F.regexp_extract_all("body", F.lit(pattern), F.lit(0))
    return F.when(F.contains("body", F.lit(GUARD[kind])), found).otherwise(F.array().cast("array<string>")) if kind in GUARD else found


def _features(c: str) -> dict[str, str]:
    """Format and context of a candidate struct; before: up to 16 characters before it."""
    x, n = f"{c}.x", f"length({c}.x)"

    def share(chars: str) -> str:
        return part(f"length(regexp_replace({x}, '[^{chars}]', ''))")

    def part(count: str) -> str:
        return f"round({STEPS} * {count} / {n}) / {STEPS}"

    def upto(count: str) -> str:
        return f"double(least({MOST}, {count}))"

    return {
        "length": upto(n), "digit": share("0-9"), "upper": share("A-Z"), "lower": share("a-z"), "hex": share("0-9a-f"),
        "marks": upto(f"length(regexp_replace({x}, '[A-Za-z0-9]', ''))"), "varied": part(f"size(array_distinct(split({x}, '')))"),
        "turns": upto(f"size(split({x}, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])'))"), "dots": upto(f"length({x}) - length(replace({x}, '.', ''))"),
        "quoted": f"double({c}.before rlike '[\"\\']$')", "assigned": f"double({c}.before rlike '[=:] ?[\"\\']?$')", "line_start": f"double({c}.before = '' or {c}.before rlike '\\n$')",
        "named": f"double({c}.named)", "issued": f"double({c}.issued)", "loose_kind": f"double(case {c}.k when 'address' then 0 when 'number' then 1 else 2 end)",
    }


def _candidates() -> Column:
    """Candidates of the loose kinds with their surroundings: array<struct<k, s, e, x, before, named, issued, covered>>."""
    base = " or ".join(f"exists(s_{k}, b -> b.s < c.e and c.s < b.e)" for k in BASE)
    before = "substring(body, greatest(1, c.s - 15), least(16, c.s))"
    named, issued = (p.replace("\\", "\\\\") for p in (NAMING, ISSUED))
    loose = ", ".join(f"s_{k}" for k in LOOSE)
    return F.expr(f"transform(concat({loose}), c -> named_struct('k', c.k, 's', c.s, 'e', c.e, 'x', c.x, 'before', {before}, 'named', {before} rlike '{named}', 'issued', c.x rlike '{issued}', 'covered', {base}))")


def _tree_sql(text: str, names: list[str]) -> str:
    """A tree's printed form as nested CASE expressions."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node(i: int) -> tuple[str, int]:
        if lines[i].startswith("Predict:"):
            return f"{round(float(lines[i].split(':')[1]), 9)!r}D", i + 1  # sums over tasks differ in their last digits
        feature, bound = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", lines[i]).groups()
        low, i = node(i + 1)
        high, i = node(i + 1)
        return f"case when {{{names[int(feature)]}}} <= {bound} then {low} else {high} end", i

    return node(0)[0]


class Selector:
    """Margin of the boosted trees as SQL and a threshold for each loose kind."""

    def __init__(self, margin: str, thresholds: dict[str, float]):
        self.margin, self.thresholds = margin, thresholds

    def choose(self, c: str) -> str:
        if not self.thresholds:
            return "false"
        rule = " ".join(f"when '{k}' then {v!r}" for k, v in self.thresholds.items())
        return f"({self.margin.format(**_features(c))}) >= case {c}.k {rule} else 1e9 end"


def fitted(docs: DataFrame) -> Selector:
    """Trees and thresholds from the candidates of every document (a column body).

    Which half a candidate belongs to follows from a hash. With too few candidates of one label there are no trees:
    kinds whose candidates are nearly all positive are selected."""
    rows = with_spans(docs, BASE | LOOSE).select(F.explode(_candidates()).alias("c"))
    names = list(_features("c"))
    weak = F.expr("double(c.covered or c.named or c.issued)").alias("label")
    half = F.pmod(F.xxhash64("c.k", "c.x", "c.before"), F.lit(2)).alias("half")
    flat = rows.select("c.k", weak, half, *[F.expr(v).alias(k) for k, v in _features("c").items()])
    flat = stored(flat.where("length is not null").groupBy("k", "label", "half", *names).agg(F.count("*").cast("double").alias("weight")))
    counts = {(r["half"], r["label"], r["k"]): r["n"] for r in flat.groupBy("half", "label", "k").agg(F.sum("weight").alias("n")).collect()}
    if any(sum(n for (h, v, _), n in counts.items() if (h, v) == (0, label)) < 5 for label in (0.0, 1.0)):
        good = {k: sum(n for (_, v, kind), n in counts.items() if (v, kind) == (1.0, k)) for k in LOOSE}
        total = {k: sum(n for (_, _, kind), n in counts.items() if kind == k) for k in LOOSE}
        return Selector("1D", {k: 0.5 for k in LOOSE if total[k] >= 5 and good[k] >= PRECISION * total[k]})
    data = VectorAssembler(inputCols=names, outputCol="features").transform(flat.where("half = 0"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3, maxBins=MAX_BINS, weightCol="weight").fit(data)
    margin = " + ".join(f"{w!r}D * ({_tree_sql(t.toDebugString, names)})" for t, w in zip(model.trees, model.treeWeights, strict=True))
    plain = {k: k for k in names}
    steps = flat.where("half = 1").select("k", "label", "weight", (F.floor(F.expr(margin.format(**plain)) * 20) / 20).alias("m"))
    seen = steps.groupBy("k", "m").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all")).collect()
    thresholds = {}
    for k in LOOSE:
        good = total = 0
        for r in sorted((r for r in seen if r["k"] == k), key=lambda r: -r["m"]):
            good, total = good + r["good"], total + r["all"]
            if r["m"] > 0 and good >= PRECISION * total:
                thresholds[k] = float(r["m"])
    return Selector(margin, thresholds)


def found(rows: DataFrame, text: Column) -> DataFrame:
    """rows with columns body (the text), base and spans: arrays of struct<k, s, e, x>, base kinds first, each kind by
    start. rows must not have columns of these names; callers keep theirs in a struct."""
    own = rows.columns
    whole = rows.withColumn("body", text)
    chosen = fitted(whole.select("body"))
    spread = with_spans(whole, BASE | LOOSE)
    spread = spread.select(*own, "body", F.concat(*[f"s_{k}" for k in BASE]).alias("base"), _candidates().alias("loose"))
    more = F.expr(f"transform(filter(loose, c -> not c.covered and {chosen.choose('c')}), c -> named_struct('k', c.k, 's', c.s, 'e', c.e, 'x', c.x))")
    return spread.select(*own, "body", "base", F.concat("base", more).alias("spans"))


def _joined(col: str) -> Column:
    return F.expr(f"concat_ws(',', transform({col}, c -> concat(c.k, ':', c.s, ':', c.e)))")


def pii_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans; a row for each row of docs.

    Null texts are empty: no spans, the SHA-256 of the empty string. Repeated rows and null ids are kept; other
    columns are ignored; an empty table gives an empty result."""
    rows = found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.coalesce("text", F.lit("")))
    counts = [F.expr(f"bigint(size(filter(base, c -> c.k = '{k}')))").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs, all columns, with every span of text replaced by its kind in brackets (and n_chars, if there, renewed).

    The row travels in one struct beside the working columns, so columns of any name are kept as they are. Null texts
    stay null, repeated rows and null ids stay, and an empty table gives an empty result."""
    own = docs.columns
    rows = found(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")), F.coalesce("row.text", F.lit("")))
    ordered = F.expr("array_sort(transform(spans, c -> named_struct('s', c.s, 'e', c.e, 'k', c.k)))")
    step = "named_struct('p', greatest(a.p, c.e), 'o', if(c.s >= a.p, array_append(array_append(a.o, substring(body, a.p + 1, c.s - a.p)), concat('[', upper(c.k), ']')), a.o))"
    marked = rows.withColumn("marked", F.when(F.size("spans") > 0, ordered)).withColumn("cut", F.expr(f"aggregate(marked, named_struct('p', 0, 'o', cast(array() as array<string>)), (a, c) -> {step})"))
    plain = marked.select("row", F.col("marked").isNotNull().alias("hit"), F.expr("if(marked is null, row.text, concat(array_join(cut.o, ''), substring(body, cut.p + 1)))").alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in own:
        new["n_chars"] = F.when(F.col("hit"), F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return plain.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in own])
