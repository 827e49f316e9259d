"""Porter's stemming algorithm (1980) and folding of accents as SQL expressions, the same text for Spark and for DuckDB but
for three functions: a cascade of CASE expressions, each step bound to a name by a lambda over an array of one word."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORD_SPLIT, col

#: The suffix tables of the published algorithm.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: Runs of consonants and of vowels: y is a vowel after a consonant, and a consonant else. A y that begins a word is held
#: as Y, which is in no vowel class.
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
HAS_VOWEL = f"^({CONSONANTS})?[aeiouy]"
SOME = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}"  #: a measure above 0
ONE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}({VOWELS})?$"
MORE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
SHORT = f"^{CONSONANTS}[aeiouy][b-df-hj-np-tvz0-9]$"  #: of words with measure 1; other letters have several bytes, each a consonant


class Dialect:
    def __init__(self, match: str, let: str, size: str):
        self.match, self._let, self.size = match, let, size

    def let(self, name: str, value: str, body: str) -> str:
        return self._let.format(value=value, name=name, body=body)

    def like(self, word: str, pattern: str) -> str:
        return f"{self.match}({word}, '{pattern}')"


SPARK = Dialect("regexp_like", "transform(array({value}), {name} -> {body})[0]", "octet_length")
DUCK = Dialect("regexp_matches", "list_transform([{value}], lambda {name}: {body})[1]", "strlen")


def _ends(w: str, *ends: str) -> str:
    return "(" + " OR ".join(f"right({w}, {len(e)}) = '{e}'" for e in ends) + ")"


def _cut(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _swap(d: Dialect, w: str, table: list[tuple[str, str]], pattern: str) -> str:
    """The longest suffix of the table that fits is replaced if what is before it matches."""
    out = "CASE"
    for old, new in sorted(table, key=lambda x: -len(x[0])):
        root = _cut(w, len(old))
        ok = d.like(root, pattern) + (f" AND {_ends(root, 's', 't')}" if old == "ion" else "")
        out += f" WHEN {_ends(w, old)} THEN CASE WHEN {ok} THEN {root} || '{new}' ELSE {w} END"
    return f"{out} ELSE {w} END"


@lru_cache
def stem_sql(d: Dialect, word: str) -> str:
    """SQL for the stem of a lower-case word; words of fewer than three bytes stay as they are."""
    like = d.like
    bare = "substring(w, 2)"
    double = f"right({bare}, 1) = left(right({bare}, 2), 1) AND length({bare}) > 1 AND right({bare}, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') AND right({bare}, 1) < '~' AND (right({bare}, 1) <> 'y' OR {like(bare, '[^aeiouy](yy)+$')})"
    steps = [
        "CASE WHEN left(w, 1) = 'y' THEN 'Y' || substring(w, 2) ELSE w END",
        f"CASE WHEN {_ends('w', 'sses', 'ies')} THEN {_cut('w', 2)} WHEN {_ends('w', 's')} AND NOT {_ends('w', 'ss')} THEN {_cut('w', 1)} ELSE w END",
        f"CASE WHEN {_ends('w', 'eed')} THEN CASE WHEN {like(_cut('w', 3), SOME)} THEN {_cut('w', 1)} ELSE w END WHEN {_ends('w', 'ed')} AND {like(_cut('w', 2), HAS_VOWEL)} THEN '+' || {_cut('w', 2)} WHEN {_ends('w', 'ing')} AND {like(_cut('w', 3), HAS_VOWEL)} THEN '+' || {_cut('w', 3)} ELSE w END",
        f"CASE WHEN left(w, 1) <> '+' THEN w WHEN {_ends('w', 'at', 'bl', 'iz')} THEN {bare} || 'e' WHEN {double} THEN {_cut(bare, 1)} WHEN {like(bare, ONE)} AND {like(bare, SHORT)} THEN {bare} || 'e' ELSE {bare} END",
        f"CASE WHEN {_ends('w', 'y')} AND {like(_cut('w', 1), HAS_VOWEL)} THEN {_cut('w', 1)} || 'i' ELSE w END",
        _swap(d, "w", STEP2, SOME),
        _swap(d, "w", STEP3, SOME),
        _swap(d, "w", [(x, "") for x in STEP4], MORE),
        f"CASE WHEN {_ends('w', 'e')} AND ({like(_cut('w', 1), MORE)} OR {like(_cut('w', 1), ONE)} AND NOT {like(_cut('w', 1), SHORT)}) THEN {_cut('w', 1)} ELSE w END",
        f"CASE WHEN {_ends('w', 'll')} AND {like(_cut('w', 1), MORE)} THEN {_cut('w', 1)} ELSE w END",
        "CASE WHEN left(w, 1) = 'Y' THEN 'y' || substring(w, 2) ELSE w END",
    ]
    out = "w0"
    for s in steps:
        out = d.let("w", out, s)
    return d.let("w0", word, f"CASE WHEN {d.size}(w0) < 3 THEN w0 ELSE {out} END")


@lru_cache
def accents() -> tuple[str, str]:
    """Lower-case letters and digits with an accent, and what they are without: by the Unicode decomposition."""
    pairs = [(c, "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) for c in map(chr, range(0x80, 0x2FFF)) if c.isalnum() and c == c.lower()]
    pairs = [(c, x) for c, x in pairs if len(x) == 1 and x != c]
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


def folded(text) -> Column:
    """Lower case without accents; a text of one-byte characters has none."""
    x = col(text)
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.regexp_replace(F.translate(F.lower(x), *accents()), r"\p{Mn}+", ""))


def folded_tokens(text) -> Column:
    """Words of a text, folded but not stemmed."""
    return F.filter(F.split(folded(text), WORD_SPLIT), lambda x: x != "")


def stemmed(text) -> Column:
    """Stems of the words of a text column."""
    return F.transform(folded_tokens(text), lambda w: _stem_of(w))


def _stem_of(w: Column) -> Column:
    """The cascade on a lambda's variable: bound by a named struct's field, as SQL text cannot hold the variable."""
    return F.element_at(F.call_function("transform", F.array(w), F.expr(f"x -> {stem_sql(SPARK, 'x')}")), 1)


def stem_column(word: str) -> Column:
    """The stem of a column of folded words."""
    return F.expr(stem_sql(SPARK, word))


def query_stems_of(df: DataFrame, words: list[str]) -> list[str]:
    """Stems of a query's words, in order, each once."""
    if not words:
        return []
    got = df.sparkSession.range(1).select(stemmed(F.lit(" ".join(words))).alias("s")).first()["s"]
    return list(dict.fromkeys(got))
