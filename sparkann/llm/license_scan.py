"""Licence scans by sentence rules: known sentences become identifiers, and sequences of those are matched by rules.

DataFrame functions only, row by row: no shuffle, and nothing is gathered from other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of licence sentences, and the sentences, normalised as sentences() does.
SENTENCES: list[tuple[str, str]] = [
    ("MITref", "released under the mit license"),
    ("MITref", "licensed under the mit license"),
    ("MITref", "this project is licensed under the mit license"),
    ("MITref", "spdx license identifier mit"),
    ("MITgrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MITnotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITasis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("MITliability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("ISCgrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISCasis", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("BSDpre", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDsource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDbinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSDendorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDasis", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("ApacheRef", "licensed under the apache license version 2 0"),
    ("ApacheRef", "spdx license identifier apache 2 0"),
    ("ApacheLic", "licensed under the apache license version 2 0 the license"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheGet", "you may obtain a copy of the license at"),
    ("ApacheGet", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheLimit", "see the license for the specific language governing permissions and limitations under the license"),
    ("GPL3ref", "this work is licensed under the gnu general public license version 3"),
    ("GPL3ref", "licensed under the gnu general public license version 3"),
    ("GPL3ref", "spdx license identifier gpl 3 0 only"),
    ("GPLfree", "this program is free software"),
    ("GPL3orLater", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL2orLater", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPL3free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL2free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPLhope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("GPLimplied", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLsee", "see the gnu general public license for more details"),
    ("GPLcopy", "you should have received a copy of the gnu general public license along with this program"),
    ("MPL2subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("CCBYref", "licensed under cc by 4 0"),
    ("CCBYref", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CCBYSAref", "licensed under cc by sa 4 0"),
    ("CCBYNCref", "licensed under cc by nc 4 0"),
    ("PublicDomain", "this is free and unencumbered software released into the public domain"),
    ("AllRights", "all rights reserved"),
]

# Licences with their sequences of identifiers, in the order in which they are tried, and what they are.
RULES: list[tuple[str, list[str], str]] = [
    ("MIT", ["MITgrant", "MITnotice", "MITasis", "MITliability"], "permissive"),
    ("MIT", ["MITgrant", "MITnotice", "MITasis"], "permissive"),
    ("BSD-3-Clause", ["BSDpre", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis"], "permissive"),
    ("BSD-2-Clause", ["BSDpre", "BSDsource", "BSDbinary", "BSDasis"], "permissive"),
    ("ISC", ["ISCgrant", "ISCasis"], "permissive"),
    ("Apache-2.0", ["ApacheLic", "ApacheUse", "ApacheGet", "ApacheAsIs", "ApacheLimit"], "permissive"),
    ("Apache-2.0", ["ApacheLic", "ApacheUse"], "permissive"),
    ("GPL-3.0-or-later", ["GPLfree", "GPL3orLater", "GPLhope", "GPLimplied", "GPLsee", "GPLcopy"], "copyleft"),
    ("GPL-3.0-or-later", ["GPLfree", "GPL3orLater"], "copyleft"),
    ("GPL-3.0-or-later", ["GPL3free"], "copyleft"),
    ("GPL-2.0-or-later", ["GPL2free"], "copyleft"),
    ("GPL-2.0-or-later", ["GPLfree", "GPL2orLater", "GPLhope", "GPLimplied", "GPLsee", "GPLcopy"], "copyleft"),
    ("GPL-2.0-or-later", ["GPLfree", "GPL2orLater"], "copyleft"),
    ("MIT", ["MITref"], "permissive"),
    ("Apache-2.0", ["ApacheRef"], "permissive"),
    ("Apache-2.0", ["ApacheLic"], "permissive"),
    ("GPL-3.0", ["GPL3ref"], "copyleft"),
    ("MPL-2.0", ["MPL2subject"], "copyleft"),
    ("CC-BY-4.0", ["CCBYref"], "permissive"),
    ("CC-BY-SA-4.0", ["CCBYSAref"], "copyleft"),
    ("CC-BY-NC-4.0", ["CCBYNCref"], "restricted"),
    ("Unlicense", ["PublicDomain"], "permissive"),
    ("All-Rights-Reserved", ["Copyright", "AllRights"], "restricted"),
    ("All-Rights-Reserved", ["AllRights"], "restricted"),
]

# What every known sentence holds some of; a text without any of them needs no splitting. Single words, as lines may wrap between two.
HINTS = "(?i)licen[sc]e|copyright|permission|warrant|redistribut|reserved|software"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Leaders of comment lines; lines that end with an SPDX tag; line ends within a sentence, which a lower-case letter
#: follows, or capitals between capitals; a version's "v."; sentence ends.
LEADER = "(^|\\n)[\\x09 ]*(#+|//+|/?\\*+|;+|--+|>+)"
TAG = "(SPDX-License-Identifier:[^\\n]*)(\\n|\\z)"
CAPS = "([A-Z0-9][,)]?)[\\x09\\x0B-\\x0D ]*\\n[\\x09\\x0B-\\x0D ]*([A-Z][A-Z])"
WRAP = "([^.!?;\\x09-\\x0D ])[\\x09\\x0B-\\x0D ]*\\n[\\x09\\x0B-\\x0D ]*([a-z])"
VERSION = "([Vv])\\.[ ]?([0-9])"
STEPS = ((LEADER, "$1"), (TAG, "$1.\n"), (WRAP, "$1 $2"), (CAPS, "$1 $2"), (VERSION, "$1 $2"))
END = "[.!?;]+([\\x09-\\x0D ]+|\\z)|\\n+"


def sentences(text: Column) -> Column:
    """The normalised sentences of a text in order: A-Z lower-cased, all but a-z and 0-9 made one space, none empty."""
    flat = text
    for pattern, by in STEPS:
        flat = F.regexp_replace(flat, pattern, by)
    parts = F.split(F.translate(flat, _UPPER, _LOWER), END, -1)
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (long), sequence, licenses, rest, category: one row for each row of docs.

    sequence has the identifiers of known sentences in text order, as <A><B>. Rules are tried in order; a rule matches
    where its identifiers stand next to each other, and uses them up. licenses are the matched ones, in rule order, each once, joined by
    commas; rest is what no rule used. category is the strictest of the matched licences (restricted, copyleft,
    permissive), 'unclear' if only rest is left, 'none' for no known sentence. Null and empty texts have none; an id may be null
    or repeated; columns beside the two named are not read.
    """
    known = F.create_map(*[F.lit(x) for name, s in SENTENCES for x in (s, name)])
    name = lambda s: F.when(s.startswith("copyright "), F.lit("Copyright")).otherwise(F.element_at(known, s))
    ids = F.filter(F.transform(sentences(F.col("text")), name), lambda x: x.isNotNull())
    seen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = seen.select("doc_id", F.when(F.col("text").rlike(HINTS), ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    seen = seen.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("sequence"))

    rules = F.array(*[F.struct(F.lit(who).alias("who"), F.lit("".join(f"<{x}>" for x in seq)).alias("seq")) for who, seq, _ in RULES])
    start = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["seq"])
        found = F.when(hit, F.array_union(state["found"], F.array(rule["who"]))).otherwise(state["found"])
        return F.struct(F.replace(state["rest"], rule["seq"], F.lit("|")).alias("rest"), found.alias("found"))

    matched = F.when(F.col("n_sentences") > 0, F.aggregate(rules, start, apply)).otherwise(start)
    out = seen.select("doc_id", "n_sentences", "sequence", matched.alias("m"))
    of = lambda kind: F.arrays_overlap(F.col("m.found"), F.array(*[F.lit(x) for x in sorted({w for w, _, k in RULES if k == kind})]))
    category = F.when(F.col("n_sentences") == 0, "none").when(of("restricted"), "restricted").when(of("copyleft"), "copyleft").when(of("permissive"), "permissive").otherwise("unclear")
    return out.select("doc_id", "n_sentences", "sequence", F.array_join("m.found", ",").alias("licenses"), F.replace("m.rest", F.lit("|"), F.lit("")).alias("rest"), category.alias("category"))


def scan_sql(table: str = "documents") -> str:
    """DuckDB SQL for scan(): the same rules, without the hint test."""
    back = lambda p: p.replace("$", "\\")
    flat = "coalesce(text, '')"
    for pattern, by in STEPS:
        flat = f"regexp_replace({flat}, '{pattern}', '{back(by)}', 'g')"
    parts = f"regexp_split_to_array(translate({flat}, '{_UPPER}', '{_LOWER}'), '{END}')"
    known = "MAP {" + ", ".join(f"'{s}': '{name}'" for name, s in SENTENCES) + "}"
    q = f"SELECT doc_id, list_filter(list_transform({parts}, lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS ss FROM {table}"
    q = f"SELECT doc_id, list_filter(list_transform(ss, lambda s: CASE WHEN starts_with(s, 'copyright ') THEN 'Copyright' ELSE {known}[s] END), lambda x: x IS NOT NULL) AS ids FROM ({q})"
    q = f"SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(list_aggregate(list_transform(ids, lambda x: '<' || x || '>'), 'string_agg', ''), '') AS sequence FROM ({q})"
    q = f"SELECT *, sequence AS rest0 FROM ({q})"
    for k, (_, seq, _) in enumerate(RULES):
        has = "".join(f"<{x}>" for x in seq)
        q = f"SELECT *, contains(rest{k}, '{has}') AS hit{k}, replace(rest{k}, '{has}', '|') AS rest{k + 1} FROM ({q})"
    # A licence stands where its first matching rule stands.
    hits = ", ".join(f"CASE WHEN hit{k}" + "".join(f" AND NOT hit{j}" for j in range(k) if RULES[j][0] == who) + f" THEN '{who}' END" for k, (who, _, _) in enumerate(RULES))
    kind = lambda x: "(" + " OR ".join(f"hit{k}" for k, r in enumerate(RULES) if r[2] == x) + ")"
    return (
        f"SELECT doc_id, n_sentences, sequence, array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ',') AS licenses, replace(rest{len(RULES)}, '|', '') AS rest, "
        f"CASE WHEN n_sentences = 0 THEN 'none' WHEN {kind('restricted')} THEN 'restricted' WHEN {kind('copyleft')} THEN 'copyleft' WHEN {kind('permissive')} THEN 'permissive' ELSE 'unclear' END AS category FROM ({q})"
    )
