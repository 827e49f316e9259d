"""URL filters: explicit rules first, then association rules mined with Spark's FP-growth.

Transactions are the distinct tokens of labelled URLs (words of the host and of the path) with an item for the label. A
URL's label comes from what its page shows: labelled_urls() joins pages to labelled documents by title and first line.
Only tokens that a kept rule can have are mined, and tokens that all labelled URLs have together or not at all count as
one. Rules {tokens} => bad, of any number of tokens, are kept by confidence and support; a rule is dropped when a subset
of its tokens is at least as confident, which is found level by level: the best confidence below a set of tokens comes
from the sets with one token less. All others are kept, in a table with each rule's rarest token; the distinct token sets
of the URLs are joined with it and blocked when all tokens of a rule are there. All of it stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, stored

#: Fixed values: (host, path) => verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A rule needs a share SUPPORT of the labelled URLs and ROWS of them, all bad, and CONFIDENCE among all that it fits.
SUPPORT, ROWS, CONFIDENCE = 0.0005, 8, 0.8
TITLE = 60  #: pages cut longer titles after so many characters
BAD = "=bad"


def host_and_path() -> tuple[Column, Column]:
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens() -> Column:
    """Distinct host words (h:) and path words (p:) of columns host and path; numbers are one token."""
    host = F.transform(F.filter(F.split("host", r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.filter(F.split("path", r"[^\p{L}\p{N}]+"), lambda x: x != "")
    path = F.transform(words, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "^[0-9]+$", "#")))
    return F.array_distinct(F.concat(host, path))


def _explicit() -> tuple[Column, Column]:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(RULES, key=lambda r: len(r[0] + r[1])):  # the longest is applied last and wins
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def pruned(sets: DataFrame) -> DataFrame:
    """Of sets (tokens, sorted; confidence), which hold all parts of each, those of CONFIDENCE or more of which no proper
    part is at least as confident. A level is the sets of one size; it sees the level below only."""
    sets = stored(sets.select("tokens", "confidence", F.size("tokens").alias("n")))
    most = sets.agg(F.max("n")).first()[0] or 0
    level = sets.where("n = 1").select("tokens", "confidence", F.lit(-1.0).alias("best"))
    kept = [level]
    for n in range(2, most + 1):
        below = level.select(F.col("tokens").alias("part"), F.greatest("confidence", "best").alias("top"))
        parts = sets.where(F.col("n") == n).select("tokens", "confidence", F.explode(F.expr("transform(tokens, t -> array_remove(tokens, t))")).alias("part"))
        level = stored(parts.join(below, "part").groupBy("tokens", "confidence").agg(F.max("top").alias("best")))
        kept.append(level)
    return reduce(DataFrame.unionByName, kept).where((F.col("confidence") >= CONFIDENCE) & (F.col("best") < F.col("confidence"))).select("tokens", "confidence")


def labelled_urls(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages that show a labelled document: their title is the document's first line, whole or cut
    after TITLE characters; blanks at the ends do not count, runs of blanks are one.

    bad: at least half of the labelled documents with that line have quality 0. Null texts, empty lines and titles, null
    and other labels teach nothing; of several labels of a document the lowest counts. Lines meet as their hashes."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    blank = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    first = F.trim(F.substring(blank(F.substring_index("text", "\n", 1)), 1, TITLE))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), first.alias("line")).where("line <> ''").join(marks, "doc_id")
    known = held(stored(known.groupBy(F.md5("line").alias("line")).agg((F.avg("quality") <= 0.5).alias("bad"))))
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        title = F.replace(title, F.lit(code), F.lit(char))
    shown = pages.where("url is not null and html is not null").select("url", F.trim(F.substring(blank(title), 1, TITLE)).alias("line"))
    return shown.where("line <> ''").withColumn("line", F.md5("line")).join(known, "line").select("url", "bad")


def mined(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pruned rules (tokens, sorted; confidence) and the tokens that stand for others in them (token, name)."""
    rows = split(labelled.where("url is not null and bad is not null"), "bad").where("size(tokens) > 0")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"))
    spark = labelled.sparkSession
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "tokens array<string>, confidence double"), spark.createDataFrame([], "token string, name string")
    support = max(SUPPORT, ROWS / n)
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("hits"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    seen = seen.where(F.col("hits") >= F.ceil(F.lit(support * n * (1 - 1e-9))))  # no rule of the others has the support
    names = stored(seen.groupBy("n", "hits", "x", "y").agg(F.min("token").alias("name"), F.collect_list("token").alias("token")).select("name", "n", "hits", F.explode("token").alias("token")))
    sure = names.where("token = name and hits = n").select(F.array("name").alias("tokens"), F.lit(1.0).alias("confidence"))  # no larger rule with it is kept
    open_ = each.join(names.where("token = name and hits < n").select("token"), "token").groupBy("row", "bad").agg(F.collect_list("token").alias("tokens"))
    baskets = open_.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    m = baskets.count()
    if not m:
        return sure, names.select("token", "name")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * n * (1 - 1e-9) / m)).fit(baskets)
    frequent = stored(model.freqItemsets.select(F.sort_array(F.array_remove("items", BAD)).alias("tokens"), F.array_contains("items", BAD).alias("bad"), "freq"))
    rows = frequent.where("not bad").select("tokens", F.col("freq").alias("n"))
    sets = frequent.where("bad and size(tokens) > 0").select("tokens", F.col("freq").alias("hits")).join(rows, "tokens").select("tokens", (F.col("hits") / F.col("n")).alias("confidence"))
    return pruned(sets).unionByName(sure), names.select("token", "name")


def fitting(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The token sets whose names hold all of a rule; a rule is looked up by the name that the fewest sets have."""
    held = sets.select("tokens", "names", F.explode("names").alias("key"))
    common = held.groupBy("key").agg(F.count("*").alias("n"))
    keyed = rules.select(F.col("tokens").alias("rule"), F.explode("tokens").alias("key")).join(common, "key")
    keyed = keyed.groupBy("rule").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    return held.join(keyed, "key").where(F.size(F.array_except("rule", "names")) == 0).select("tokens").distinct()


def split(urls: DataFrame, *keep) -> DataFrame:
    """The columns to keep, with host, path and tokens of a column url."""
    host, path = host_and_path()
    rows = urls.select(*keep, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    return rows.select("*", tokens().alias("tokens"))


def judged(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (whether an association rule fits); a row for each row of pages.

    labelled: url string, bad boolean; every row counts, rows with a null teach nothing. A null URL or one without ://
    has an empty host and path, no rule and is allowed. Repeated rows and null ids are kept; other columns are ignored;
    without labels no rule is mined. An empty table gives an empty result."""
    rows = split(pages, F.col("page_id").cast("long").alias("page_id"))
    rules, names = mined(labelled)
    sets = rows.select("tokens").distinct()
    named = sets.select("tokens", F.explode("tokens").alias("token")).join(names, "token").groupBy("tokens").agg(F.collect_set("name").alias("names"))
    fits = held(stored(fitting(named, stored(rules)).withColumn("mined", F.lit(True))))  # if few, a common URL stays spread
    rows = rows.join(fits, "tokens", "left")
    rule, verdict = _explicit()
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), F.coalesce("mined", F.lit(False)).alias("mined"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")
