"""Licence scans by sentence-rule recognition, in DataFrame and SQL functions only.

A text is split into sentences at full stops, colons and blank lines (or lines of marks only), not at the ends of
wrapped lines. Each is normalised (A-Z lower-cased, runs of other characters to one blank, numbers to #) and looked up
among known licence sentences: as a whole, without its lead-in ("this project is"), or, for sentences of eight words
and more, anywhere inside it, as flattened texts put titles and names before them. One that is not known is split at its
line ends and looked up in parts. The identifiers, in order, are matched against the licence rules in order: a rule fits
where its identifiers come one after another, whatever is between them. Documents without a cue word hold no known
sentence and are not split. One row is one document's own work: no shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of well-known licences and notices.
SENTENCES = {
    "mit_notice": "released under the mit license",
    "mit_title": "the mit license mit",
    "mit_name": "mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache_notice": "licensed under the apache license version #",
    "apache_terms": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "gpl_notice": "this work is licensed under the gnu general public license version #",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl_short": "licensed under the gnu general public license version #",
    "lgpl_notice": "licensed under the gnu lesser general public license version #",
    "mpl_notice": "this source code form is subject to the terms of the mozilla public license v #",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "cc_by_nc": "licensed under cc by nc #",
    "cc_by_sa": "licensed under cc by sa #",
    "cc_by": "licensed under cc by #",
    "reserved": "all rights reserved copyright license",
}
#: Rules in order; the first that fits names the document's main licence.
RULES = [
    ("MIT", ["mit_title", "mit_grant", "mit_keep"]),
    ("MIT", ["mit_grant", "mit_keep"]),
    ("Apache-2.0", ["apache_notice", "apache_terms", "apache_copy"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_notice"]),
    ("MIT", ["mit_name"]),
    ("Apache-2.0", ["apache_notice"]),
    ("GPL", ["gpl_notice"]),
    ("GPL", ["gpl_short"]),
    ("GPL", ["gpl_terms"]),
    ("LGPL", ["lgpl_notice"]),
    ("MPL-2.0", ["mpl_notice"]),
    ("CC-BY-NC", ["cc_by_nc"]),
    ("CC-BY-SA", ["cc_by_sa"]),
    ("CC-BY", ["cc_by"]),
]
GNU = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
LATER = " either version # of the license or at your option any later version"
ENDORSE = "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
#: Further normalised sentences and the identifiers that they yield.
WHOLE = {
    "licensed under the mit license": "mit_notice",
    "distributed under the mit license": "mit_notice",
    "available under the mit license": "mit_notice",
    "licensed under the apache license version # the license": "apache_notice",
    "licensed under the apache license version # the license you may not use this file except in compliance with the license": "apache_notice,apache_terms",
    "released under the apache license version #": "apache_notice",
    "distributed under the apache license version #": "apache_notice",
    "licensed under the apache license #": "apache_notice",
    "released under the gnu general public license version #": "gpl_short",
    "licensed under the gnu general public license v #": "gpl_short",
    "licensed under the mozilla public license version #": "mpl_notice",
    "licensed under the mozilla public license v #": "mpl_notice",
    **{GNU.format(kind) + end: name for kind, name in (("", "gpl_terms"), ("lesser ", "lgpl_terms"), ("library ", "lgpl_terms"), ("affero ", "agpl_terms")) for end in ("", LATER, " version # of the license", " either version # of the license or any later version")},
    **{ENDORSE.format(who): "bsd_names" for who in ("the copyright holder", "the organization", "the author", "the project", "the university")},
}
WHOLE_RULES = [
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    *RULES,
    ("LGPL", ["lgpl_terms"]),
    ("AGPL", ["agpl_terms"]),
]
LEAD = "^(?:this|the|these|our|all)(?: [a-z0-9]+){0,4} (?:is|are)(?: free software| hereby| made)? "
CUES = ("license", "licensed", "permission", "redistribut", "copyright")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS, LINES = r"[.!?:]+[ \t\r\n]+|\n[^\p{L}\p{N}\n]*\n", r"\n+"
VERSION = "(^|[^a-z0-9])v[.] ?([0-9])"  #: the full stop of "v. 2.0" ends no sentence
OTHER, NUMBER = "[^a-z0-9]+", "[0-9]+(?: [0-9]+)*"
KNOWN = {v: k for k, v in SENTENCES.items()} | WHOLE
INSIDE = {s: k for s, k in KNOWN.items() if s.count(" ") >= 7}
SHORTEST = min(map(len, INSIDE))


def license_table(docs: DataFrame) -> DataFrame:
    """doc_id, license (first rule that fits, or null), licenses (all, in rule order, comma-joined), sentence_ids
    (comma-joined), n_known; a row for each row of docs.

    Null and empty texts have no licence. Repeated rows and null ids are kept; other columns are ignored; an empty
    table gives an empty result."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    cue = low.contains(CUES[0])
    for c in CUES[1:]:
        cue = cue | low.contains(c)
    known = F.from_json(F.lit(json.dumps(KNOWN)), "map<string, string>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(cue, F.split(F.regexp_replace(low, VERSION, "$1v $2"), ENDS, -1)).alias("sentences"))

    def named(s):
        plain = F.regexp_replace(F.trim(F.regexp_replace(s, OTHER, " ")), NUMBER, "#")

        def found(p):
            held = [F.when(F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.lit(f" {x} ")), F.lit(k)) for x, k in INSIDE.items()]
            return F.coalesce(F.element_at(known, p), F.element_at(known, F.regexp_replace(p, LEAD, "")), F.when(F.length(p) >= SHORTEST, F.coalesce(*held)))

        return F.element_at(F.transform(F.array(plain), found), 1)  # so that a sentence is normalised once

    def names(s):
        parts = F.filter(F.transform(F.split(s, LINES, -1), named), lambda x: x.isNotNull())
        return F.flatten(F.transform(F.array(named(s)), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(parts)))

    # an entry may yield several identifiers
    ids = F.flatten(F.transform(F.flatten(F.transform("sentences", names)), lambda x: F.split(x, ",")))
    rows = rows.select("doc_id", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    line = F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(","))
    fits = [F.when(line.like(_pattern(seq)), F.lit(n)) for n, seq in WHOLE_RULES]
    rows = rows.select("doc_id", "ids", F.array_distinct(F.filter(F.array(*fits), lambda x: x.isNotNull())).alias("all"))
    return rows.select("doc_id", F.when(F.size("all") > 0, F.element_at("all", 1)).alias("license"), F.array_join("all", ",").alias("licenses"), F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_known"))


def _pattern(seq: list[str]) -> str:
    return "%" + "%".join(f",{x}," for x in seq) + "%"


def oracle() -> str:
    """The same table in DuckDB's SQL."""

    def plain(s: str) -> str:
        return f"regexp_replace(trim(regexp_replace({s}, '{OTHER}', ' ', 'g')), '{NUMBER}', '#', 'g')"

    whole = " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in KNOWN.items())
    held = " ".join(f"WHEN contains(' ' || p || ' ', ' {s} ') THEN '{k}'" for s, k in INSIDE.items())
    name = f"coalesce(CASE p {whole} END, CASE regexp_replace(p, '{LEAD}', '') {whole} END, CASE {held} END)"
    cue = " OR ".join(f"contains(low, '{c}')" for c in CUES)
    fits = ", ".join(f"CASE WHEN line LIKE '{_pattern(seq)}' THEN '{n}' END" for n, seq in WHOLE_RULES)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
cut AS (SELECT r, string_split_regex(regexp_replace(low, '{VERSION}', '\1v \2', 'g'), '{ENDS}') AS ss FROM texts WHERE {cue}),
sentences AS (SELECT r, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM cut),
plains AS (SELECT r, i, s, {plain("s")} AS p FROM sentences),
firsts AS (SELECT r, i, s, {name} AS name FROM plains),
lines AS (SELECT r, i, generate_subscripts(ls, 1) AS j, unnest(ls) AS s FROM (SELECT r, i, string_split_regex(s, '{LINES}') AS ls FROM firsts WHERE name IS NULL)),
seconds AS (SELECT r, i, j, {name} AS name FROM (SELECT r, i, j, {plain("s")} AS p FROM lines)),
named AS (SELECT r, i, 0 AS j, name FROM firsts WHERE name IS NOT NULL UNION ALL SELECT r, i, j, name FROM seconds WHERE name IS NOT NULL),
joined AS (SELECT r, string_agg(name, ',' ORDER BY i, j) AS ids FROM named GROUP BY r),
wide AS (SELECT doc_id, coalesce(ids, '') AS ids, ',' || replace(coalesce(ids, ''), ',', ',,') || ',' AS line FROM texts LEFT JOIN joined USING (r)),
hit AS (SELECT doc_id, ids, list_filter([{fits}], lambda x: x IS NOT NULL) AS hits FROM wide),
fitting AS (SELECT doc_id, ids, [hits[i] FOR i IN range(1, len(hits) + 1) IF list_position(hits, hits[i]) = i] AS fit FROM hit)
SELECT doc_id, CASE WHEN len(fit) > 0 THEN fit[1] END AS license, array_to_string(fit, ',') AS licenses, ids AS sentence_ids, CASE WHEN ids = '' THEN 0 ELSE len(string_split(ids, ',')) END::BIGINT AS n_known FROM fitting"""
