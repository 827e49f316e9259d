"""Scalar functions over text, paths and URLs, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SPLIT = r"[^\p{L}\p{N}]+"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def loc(content) -> Column:
    """Lines of code: line feeds and one."""
    return (F.length(col(content)) - F.length(F.replace(col(content), F.lit("\n"))) + 1).cast("long")


def content_hash(content) -> Column:
    return F.substring(F.sha2(col(content), 256), 1, 16)


def first_line(doc, most: int = 80) -> Column:
    return F.substring(F.substring_index(col(doc), "\n", 1), 1, most)


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(col(text)), WORD_SPLIT), lambda x: x != "")


def query_stems(query) -> Column:
    words = F.split(F.regexp_replace(F.lower(col(query)), r"[^\p{L}\p{N}_ \t\n\r\f]", " "), r"[ \t\n\r\f]+")
    return F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.substring(w, 1, 4))


def path_boost(path, stems, factor: float = 1.5) -> Column:
    low = F.lower(col(path))
    return F.when(F.exists(col(stems), lambda s: F.contains(low, s)), F.lit(factor)).otherwise(F.lit(1.0))


def parent(path) -> Column:
    """Directory of a path; empty at the top."""
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def basename(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def stem(path) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path) -> Column:
    return F.regexp_extract(basename(path), r".(\.[^.]*)$", 1)


def fold_path(path) -> Column:
    """Resolves . and .. segments; .. above the top stays."""
    none = F.array().cast("array<string>")

    def step(acc, part):
        up = (part == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")
        kept = F.concat(acc, F.array(part))
        return F.when((part == ".") | (part == ""), acc).when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(kept)

    return F.array_join(F.aggregate(F.split(col(path), "/"), none, step), "/")


def join_path(folder, rest) -> Column:
    f = col(folder)
    return fold_path(F.when(f == "", col(rest)).otherwise(F.concat_ws("/", f, col(rest))))


def package_name(specifier) -> Column:
    """@scope/name or the first segment."""
    return F.regexp_extract(col(specifier), r"^(@[^/]+/[^/]+|[^/]+)", 1)


def top_components(name, separator: str = ".", n: int = 2) -> Column:
    return F.substring_index(col(name), separator, n)


def normalize_url(url) -> Column:
    """Route pattern of a URL path: no query or fragment, parameters as <p>, no ^ $ /, lower case, / when empty."""
    steps = [(r"[?#].*$", ""), (r"\$\{[^}]*\}", "<p>"), (r"\{[^}]*\}", "<p>"), (r"<[^>]*>", "<p>"), (r":[A-Za-z_]\w*", "<p>"), (r"^[\^$/\s]+|[\^$/\s]+$", "")]
    out = F.lower(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col(url)))
    return F.when(out == "", F.lit("/")).otherwise(out)


def same_tail(a, b) -> Column:
    """Whether the last min(n, m) segments of two paths are equal."""
    x, y = F.split(col(a), "/"), F.split(col(b), "/")
    n = F.least(F.size(x), F.size(y))
    return F.slice(x, -n, n) == F.slice(y, -n, n)


def gitignore_regex(pattern: str) -> str:
    """Unanchored regular expression of an ignore line: ** any, * within a segment, ? one character."""
    out, i, special = "", 0, set(r"\.^$+{}[]()|")
    p = pattern.strip().rstrip("/")
    while i < len(p):
        if p.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += "[^/]*" if p[i] == "*" else "." if p[i] == "?" else "\\" + p[i] if p[i] in special else p[i]
        i += 1
    return out
