"""Licence recognition by sentence rules: known sentences become identifiers, identifier sequences match rules.

Only built-in functions: no shuffle, no Python. A text is cut into sentences after . ! ? ; or : and white
space, at empty lines, and before a line that starts like a licence sentence, so that wrapped licence
texts stay whole. A sentence is normalised (lower case, comment marks and quotes dropped, other
characters than letters, digits and . + - made spaces, spaces joined, final full stop dropped) and takes
the identifier of the first pattern that it contains. Rules are ordered sequences of identifiers; each
is looked for in the sequence that earlier rules have left, where "," ends every identifier.

Null and empty texts have no sentences and no licences. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentence identifiers and what a normalised sentence of each contains.
SENTENCES = [
    ("SPDX", r"\bspdx-license-identifier ([a-z0-9.+-]+( (or|and|with) [a-z0-9.+-]+)*)"),
    ("Apache2", r"\blicensed under the apache license version 2\.0\b"),
    ("ApacheUse", r"\byou may not use this file except in compliance with the license\b"),
    ("ApacheCopy", r"\byou may obtain a copy of the license at\b"),
    ("ApacheAsIs", r"\bunless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis\b"),
    ("MITShort", r"\b(released|licensed|distributed|available) under (the )?(terms of the )?mit licen[cs]e\b"),
    ("MITGrant", r"\bpermission is hereby granted free of charge to any person obtaining a copy of this software\b"),
    ("MITNotice", r"\bthe above copyright notice and this permission notice shall be included in all copies\b"),
    ("AsIs", r"\b(the|this) software is provided (by .* )?as is\b"),
    ("ISCGrant", r"\bpermission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted\b"),
    ("BSDGrant", r"\bredistribution and use in source and binary forms with or without modification are permitted\b"),
    ("BSDSource", r"\bredistributions of source code must retain the above copyright notice\b"),
    ("BSDBinary", r"\bredistributions in binary form must reproduce the above copyright notice\b"),
    ("BSDEndorse", r"\bmay be used to endorse or promote products derived from this software\b"),
    ("BSDShort", r"\bunder (the |a )?(new |modified |3-clause |2-clause |simplified )?bsd( 3-clause| 2-clause)?(-style)? licen[cs]e\b"),
    ("AGPL3Plus", r"\bgnu affero general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version\b"),
    ("LGPL3Plus", r"\bgnu lesser general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version\b"),
    ("LGPL21Plus", r"\bgnu lesser general public license as published by the free software foundation either version 2\.1 of the license or (at your option )?any later version\b"),
    ("GPL3Plus", r"\bgnu general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version\b"),
    ("GPL2Plus", r"\bgnu general public license as published by the free software foundation either version 2 of the license or (at your option )?any later version\b"),
    ("AGPL3", r"\bgnu affero general public license(.* version)? 3\b"),
    ("LGPL3", r"\bgnu lesser general public license(.* version)? 3\b"),
    ("LGPL21", r"\bgnu lesser general public license(.* version)? 2\.1\b"),
    ("GPL3", r"\bgnu general public license(.* version)? 3\b"),
    ("GPL2", r"\bgnu general public license(.* version)? 2\b"),
    ("GPLRedist", r"\bit under the terms of the gnu general public license as published by the free software foundation\b"),
    ("LGPLRedist", r"\bit under the terms of the gnu lesser general public license as published by the free software foundation\b"),
    ("AGPLRedist", r"\bit under the terms of the gnu affero general public license as published by the free software foundation\b"),
    ("Either21", r"^either version 2\.1 of the license or (at your option )?any later version\b"),
    ("Either2", r"^either version 2 of the license or (at your option )?any later version\b"),
    ("Either3", r"^either version 3 of the license or (at your option )?any later version\b"),
    ("GPLCopy", r"\byou should have received a copy of the gnu (affero |lesser )?general public license\b"),
    ("OrLater", r"^(or )?(at your option )?any later version\b"),
    ("GPLHope", r"\bdistributed in the hope that it will be useful but without any warranty\b"),
    ("GPLImplied", r"^without even the implied warranty of merchantability\b"),
    ("GPLWarranty", r"\bwithout any warranty without even the implied warranty of merchantability\b"),
    ("MPL2", r"\bmozilla public license( version)? 2\.0\b"),
    ("MPLCopy", r"\bif a copy of the mpl was not distributed with this file you can obtain one at\b"),
    ("EPL2", r"\beclipse public license(( -)? version| -)? ?v?2\.0\b"),
    ("Boost", r"\bboost software license( -)?( version)? 1\.0\b"),
    ("ZlibGrant", r"\bpermission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely\b"),
    ("ZlibAsIs", r"\b(the|this) software is provided as-is\b"),
    ("ISCShort", r"\bunder (the )?(terms of the )?isc licen[cs]e\b"),
    ("Artistic2", r"\bartistic license( version)? 2\.0\b"),
    ("ApacheShort", r"\bunder (the )?(terms of the )?apache( software)? licen[cs]e,?( version)? 2\.0\b"),
    ("CCBYNCND", r"\b(cc by-nc-nd|creative commons attribution-noncommercial-noderivatives)( license)?( version)? ?[0-9]?"),
    ("CCBYND", r"\b(cc by-nd|creative commons attribution-noderivatives)( license)?( version)? ?[0-9]?"),
    ("CCBYNCSA", r"\b(cc by-nc-sa|creative commons attribution-noncommercial-sharealike)( license)?( version)? ?[0-9]?"),
    ("CCBYNC", r"\b(cc by-nc|creative commons attribution-noncommercial)( license)?( version)? ?[0-9]?"),
    ("CCBYSA", r"\b(cc by-sa|creative commons attribution-sharealike)( license)?( version)? ?[0-9]?"),
    ("CCBY", r"\b(cc by|creative commons attribution)( license)?( version)? ?[0-9]?"),
    ("CC0", r"\b(cc0|public domain dedication)\b"),
    ("Unlicense", r"\bthis is free and unencumbered software released into the public domain\b"),
    ("PublicDomain", r"\b(released|placed|dedicated) (in|into|to) the public domain\b"),
    ("AllRights", r"\ball rights reserved\b"),
]
# Rules in the order in which they are tried, longest first within a family.
RULES = [
    ("Apache-2.0", "Apache2,ApacheUse,ApacheCopy,ApacheAsIs,"),
    ("Apache-2.0", "Apache2,ApacheUse,ApacheCopy,"),
    ("Apache-2.0", "Apache2,"),
    ("MIT", "MITGrant,MITNotice,AsIs,"),
    ("MIT", "MITGrant,MITNotice,"),
    ("MIT", "MITShort,"),
    ("ISC", "ISCGrant,AsIs,"),
    ("ISC", "ISCGrant,"),
    ("BSD-3-Clause", "BSDGrant,BSDSource,BSDBinary,BSDEndorse,AsIs,"),
    ("BSD-3-Clause", "BSDGrant,BSDSource,BSDBinary,BSDEndorse,"),
    ("BSD-2-Clause", "BSDGrant,BSDSource,BSDBinary,AsIs,"),
    ("BSD-2-Clause", "BSDGrant,BSDSource,BSDBinary,"),
    ("BSD", "BSDShort,"),
    ("AGPL-3.0-or-later", "AGPL3Plus,GPLHope,GPLImplied,GPLCopy,"),
    ("AGPL-3.0-or-later", "AGPL3Plus,"),
    ("LGPL-3.0-or-later", "LGPL3Plus,GPLHope,GPLImplied,GPLCopy,"),
    ("LGPL-3.0-or-later", "LGPL3Plus,"),
    ("LGPL-2.1-or-later", "LGPL21Plus,GPLHope,GPLImplied,GPLCopy,"),
    ("LGPL-2.1-or-later", "LGPL21Plus,"),
    ("GPL-3.0-or-later", "GPL3Plus,GPLHope,GPLImplied,GPLCopy,"),
    ("GPL-3.0-or-later", "GPL3Plus,"),
    ("GPL-2.0-or-later", "GPL2Plus,GPLHope,GPLImplied,GPLCopy,"),
    ("GPL-2.0-or-later", "GPL2Plus,"),
    ("AGPL-3.0-or-later", "AGPLRedist,Either3,GPLHope,GPLImplied,GPLCopy,"),
    ("AGPL-3.0-or-later", "AGPLRedist,Either3,"),
    ("LGPL-3.0-or-later", "LGPLRedist,Either3,GPLHope,GPLImplied,GPLCopy,"),
    ("LGPL-3.0-or-later", "LGPLRedist,Either3,"),
    ("LGPL-2.1-or-later", "LGPLRedist,Either21,GPLHope,GPLImplied,GPLCopy,"),
    ("LGPL-2.1-or-later", "LGPLRedist,Either21,"),
    ("GPL-3.0-or-later", "GPLRedist,Either3,GPLHope,GPLImplied,GPLCopy,"),
    ("GPL-3.0-or-later", "GPLRedist,Either3,"),
    ("GPL-2.0-or-later", "GPLRedist,Either2,GPLHope,GPLImplied,GPLCopy,"),
    ("GPL-2.0-or-later", "GPLRedist,Either2,"),
    ("AGPL-3.0", "AGPL3,"),
    ("LGPL-3.0", "LGPL3,"),
    ("LGPL-2.1", "LGPL21,"),
    ("GPL-3.0-or-later", "GPL3,OrLater,GPLWarranty,"),
    ("GPL-3.0-or-later", "GPL3,OrLater,"),
    ("GPL-3.0", "GPL3,GPLWarranty,"),
    ("GPL-3.0", "GPL3,GPLHope,GPLImplied,GPLCopy,"),
    ("GPL-3.0", "GPL3,"),
    ("GPL-2.0-or-later", "GPL2,OrLater,"),
    ("GPL-2.0", "GPL2,GPLHope,GPLImplied,GPLCopy,"),
    ("GPL-2.0", "GPL2,"),
    ("AGPL", "AGPLRedist,"),
    ("LGPL", "LGPLRedist,"),
    ("GPL", "GPLRedist,"),
    ("MPL-2.0", "MPL2,MPLCopy,"),
    ("MPL-2.0", "MPL2,"),
    ("EPL-2.0", "EPL2,"),
    ("BSL-1.0", "Boost,"),
    ("Zlib", "ZlibAsIs,ZlibGrant,"),
    ("Zlib", "ZlibGrant,"),
    ("ISC", "ISCShort,"),
    ("Artistic-2.0", "Artistic2,"),
    ("Apache-2.0", "ApacheShort,"),
    ("CC-BY-NC-ND", "CCBYNCND,"),
    ("CC-BY-ND", "CCBYND,"),
    ("CC-BY-NC-SA", "CCBYNCSA,"),
    ("CC-BY-NC", "CCBYNC,"),
    ("CC-BY-SA", "CCBYSA,"),
    ("CC-BY", "CCBY,"),
    ("CC0-1.0", "CC0,"),
    ("Unlicense", "Unlicense,"),
    ("Public-Domain", "PublicDomain,"),
]
#: Every match of a sentence pattern holds one of these words. They have no blank, so they stand in the lower-case text as they
#: do in its normalised sentences, however it is wrapped or cut; a text or sentence without any holds no known sentence.
HINT = r"licen[cs]e|permission|redistribution|provided|later|warranty|endorse|creative|cc[^a-z0-9.+-]|cc0|dedication|domain|unencumbered|reserved|obtain"
_OPENING = r"(?i)\n[ \t]*([/*#;-]*[ \t]*(?:spdx-license-identifier|licen[cs]ed under|released under|distributed under|this work is licen[cs]ed|this (?:program|software|library|file|project) is|copyright|permission|redistribution|unless required|you may|creative commons))"


#: Rewriting before the cut, in order; \\1 and \\2 are groups. Comment marks at line starts go, an SPDX tag keeps its line to
#: itself, "v. 2" isn't the end of a sentence, and \u0001 stands where sentences end.
_STEPS = (
    (r"\r\n?", "\n"),
    (r"(^|\n)[ \t]*(?:--+|//+|/?\*+/?|#+|;+|%+|>+|!+)[ \t]*", r"\1"),
    (r"(?i)(spdx-license-identifier):[ \t]*([^\n]*)", "\u0001" + r"\1 \2" + "\u0001"),
    (r"(?i)\bv(?:ersion|\.)?[ \t\n]*([0-9])", r"version \1"),
    (r"\n[ \t]*\n", "\u0001"),
    (_OPENING, "\u0001" + r"\1"),
    (r"([.!?;:])[ \t\n]+", r"\1" + "\u0001"),
)


def sentences(text: Column) -> Column:
    """Normalised sentences in order."""
    cut = text
    for pattern, by in _STEPS:
        cut = F.regexp_replace(cut, pattern, by.replace("\\", "$"))
    clean = F.regexp_replace(F.translate(F.lower(cut), "\"'", "  "), r"[^\x01a-z0-9.+-]+", " ")
    clean = F.regexp_replace(clean, r" *[.]?\x01[ .]*", "\u0001")
    return F.filter(F.transform(F.split(clean, "\u0001"), lambda s: F.regexp_replace(F.trim(s), r"[.]$", "")), lambda s: s != "")


def identifiers(found: Column) -> Column:
    """The identifier of each sentence that has one; SPDX ones carry the tag as SPDX:tag."""

    def known(s: Column) -> Column:
        out = F.when(s.rlike(SENTENCES[0][1]), F.concat(F.lit("SPDX:"), F.regexp_extract(s, SENTENCES[0][1], 1)))
        for name, pattern in SENTENCES[1:]:
            out = out.when(s.rlike(pattern), F.lit(name))
        return out

    # None but a sentence with one of these words can match; the test spares the others thirty patterns.
    return F.filter(F.transform(F.filter(found, lambda s: s.rlike(HINT)), known), lambda x: x.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, unmatched), a row for each row of docs.

    n_sentences counts recognised sentences, sentence_ids joins their identifiers by commas in order,
    licenses joins the distinct licences in the order of the rules (SPDX tags first, as they stand in the
    text, in lower case), unmatched counts the identifiers that no rule used.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    df = docs.select(F.col(id_col).alias("doc_id"), F.when(F.lower(text).rlike(HINT), identifiers(sentences(text))).otherwise(none).alias("ids"))
    df = df.withColumn("tags", F.transform(F.filter("ids", lambda x: x.startswith("SPDX:")), lambda x: F.substring(x, F.lit(6), F.char_length(x))))
    left = F.array_join(F.transform(F.filter("ids", lambda x: ~x.startswith("SPDX:")), lambda x: F.concat(x, F.lit(","))), "")
    # Rules in order, each on what earlier ones have left: an accumulator of (sequence, licences).
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ids).alias("ids")) for name, ids in RULES])
    start = F.struct(F.concat(F.lit(","), left).alias("rest"), none.alias("got"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.instr(acc["rest"], rule["ids"]) > 0
        return F.struct(F.when(hit, F.replace(acc["rest"], rule["ids"], F.lit(","))).otherwise(acc["rest"]).alias("rest"), F.when(hit, F.concat(acc["got"], F.array(rule["name"]))).otherwise(acc["got"]).alias("got"))

    df = df.withColumn("matched", F.when(F.size("ids") > 0, F.aggregate(rules, start, step)))
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.concat("tags", F.coalesce(F.col("matched.got"), none))), ",").alias("licenses"),
        F.coalesce(F.regexp_count(F.regexp_replace("matched.rest", "^,", ""), F.lit(",")), F.lit(0)).cast("long").alias("unmatched"),
    )


def oracle() -> str:
    """The same in DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    case = f"WHEN regexp_matches(s, {q(SENTENCES[0][1])}) THEN 'SPDX:' || regexp_extract(s, {q(SENTENCES[0][1])}, 1) " + " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN {q(n)}" for n, p in SENTENCES[1:])
    steps = ["SELECT doc_id, ids, tags, ',' || array_to_string([x || ',' FOR x IN ids IF NOT starts_with(x, 'SPDX:')], '') AS rest, []::VARCHAR[] AS got FROM i"]
    ctes = []
    for k, (name, ids) in enumerate(RULES):
        source = f"r{k - 1}" if k else f"({steps[0]})"
        ctes.append(f"r{k} AS (SELECT doc_id, ids, tags, CASE WHEN contains(rest, {q(',' + ids)}) THEN replace(rest, {q(',' + ids)}, ',') ELSE rest END AS rest, CASE WHEN contains(rest, {q(',' + ids)}) THEN list_append(got, {q(name)}) ELSE got END AS got FROM {source})")
    cut = "coalesce(text, '')"
    for pattern, by in _STEPS:
        cut = f"regexp_replace({cut}, {q(pattern)}, {q(by)}, 'g')"
    clean = f"regexp_replace(regexp_replace(translate(lower({cut}), '\"''', '  '), '[^\\x01a-z0-9.+-]+', ' ', 'g'), ' *[.]?\\x01[ .]*', chr(1), 'g')"
    return f"""
WITH s AS (SELECT doc_id, [regexp_replace(trim(x), '[.]$', '') FOR x IN string_split({clean}, chr(1))] AS found FROM documents),
i0 AS (SELECT doc_id, [CASE {case} END FOR s IN found] AS ids FROM s),
i1 AS (SELECT doc_id, [x FOR x IN ids IF x IS NOT NULL] AS ids FROM i0),
i AS (SELECT doc_id, ids, [substring(x, 6) FOR x IN ids IF starts_with(x, 'SPDX:')] AS tags FROM i1),
{", ".join(ctes)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string([x FOR x, k IN list_concat(tags, got) IF list_position(list_concat(tags, got), x) = k], ',') AS licenses,
  (length(rest) - length(replace(rest, ',', '')) - 1)::BIGINT AS unmatched
FROM r{len(RULES) - 1}"""
