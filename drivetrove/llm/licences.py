"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, each is normalised and looked up among known licence sentences, and the sequence of
identifiers is matched against ordered rules; what a rule takes, later rules don't see. All of it happens inside the row,
so there is no shuffle. Texts without any clue word skip the cutting; every known sentence holds a clue word, so nothing
is missed by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import only

# Sentences of public licence texts and usual notices, as they read after normalisation.
SENTENCES = {
    "apache_notice": ["licensed under the apache license version 2.0", "this work is licensed under the apache license version 2.0",
                      "released under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache_use": ["you may not use this file except in compliance with the license"],
    "apache_obtain": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http"],
    "apache_asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit_notice": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license"],
    "mit_title": ["mit license", "the mit license", "the mit license mit"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_keep": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit_asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit_liable": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc_asis": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd_notice": ["released under the bsd license", "licensed under the bsd license"],
    "gpl3_notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2_notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "gpl_free": ["this program is free software"],
    "gpl3_later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2_later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl_merchant": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl_details": ["see the gnu general public license for more details"],
    "mpl2_terms": ["this source code form is subject to the terms of the mozilla public license v. 2.0"],
    "cc_by": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "released under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc_by_sa": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0", "released under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc_by_nc": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "released under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc_by_nd": ["licensed under cc by nd 4.0", "this work is licensed under cc by nd 4.0", "released under cc by nd 4.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["copyright all rights reserved", "all rights reserved copyright"],
}
# The rules, tried in this order; `?` marks a sentence that may be missing.
RULES = [
    ("MIT", ["mit_title?", "mit_grant", "mit_keep", "mit_asis?", "mit_liable?"]),
    ("ISC", ["isc_grant", "isc_asis?"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache_notice", "apache_use?", "apache_obtain?", "apache_asis?"]),
    ("GPL-3.0-or-later", ["gpl_free?", "gpl3_later", "gpl_hope?", "gpl_merchant?", "gpl_details?"]),
    ("GPL-2.0-or-later", ["gpl_free?", "gpl2_later", "gpl_hope?", "gpl_merchant?", "gpl_details?"]),
    ("GPL-3.0-only", ["gpl3_notice"]),
    ("GPL-2.0-only", ["gpl2_notice"]),
    ("MIT", ["mit_notice"]),
    ("BSD", ["bsd_notice"]),
    ("MPL-2.0", ["mpl2_terms"]),
    ("CC-BY-NC-4.0", ["cc_by_nc"]),
    ("CC-BY-SA-4.0", ["cc_by_sa"]),
    ("CC-BY-ND-4.0", ["cc_by_nd"]),
    ("CC-BY-4.0", ["cc_by"]),
    ("Unlicense", ["unlicense"]),
    ("all-rights-reserved", ["reserved"]),
]
CLUES = ["licen", "permission", "warrant", "copyright", "redistribut", "released", "software"]  # single words, so that line breaks do not hide them
OPENERS = ["licensed under", "released under", "this work is licensed", "this program is free", "this source code form"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Applied in turn to the lower-cased text; ``\x1e`` ends a sentence.
CUTS = [(r"[.!?;:]+([ \t\r\n]+|\z)", "\x1e"), (r"\r?\n[ \t]*\r?\n", "\x1e"), (r"\n([^a-z\x1e]*)(" + "|".join(OPENERS) + ")", "\x1e$2")]
NOISE = r"[^a-z0-9.]+"

assert all(any(c in s for c in CLUES) for v in SENTENCES.values() for s in v)


def pattern(rule: list[str]) -> str:
    return "".join(f"(<{x[:-1]}>)?" if x.endswith("?") else f"<{x}>" for x in rule)


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    lower = F.translate(text, UPPER, LOWER)
    cut = lower
    for what, by in CUTS:
        cut = F.regexp_replace(cut, F.lit(what), F.lit(by))
    sentences = F.transform(F.split(cut, "\x1e"), lambda s: F.trim(F.regexp_replace(s, F.lit(NOISE), F.lit(" "))))
    known = F.filter(sentences, lambda s: s.isin([s for v in SENTENCES.values() for s in v]))

    def name(sentence: Column) -> Column:
        out = F.when(F.lit(False), "")
        for key, values in SENTENCES.items():
            out = out.when(sentence.isin(values), key)
        return out

    clue = F.lit(False)
    for word in CLUES:
        clue = clue | lower.contains(word)
    return F.when(clue, F.transform(known, name)).otherwise(F.array().cast("array<string>"))


def licences(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_known (known licence sentences), licences (names in text order,
    comma-joined, repeats kept), unmatched (identifiers that no rule took, comma-joined).

    NULL or empty text: 0 and empty strings. Repeated rows are judged alike, ids may be NULL, empty input gives no rows.
    """
    base = only(docs, doc_id="long", text="string")
    found = base.select("doc_id", identifiers(F.coalesce("text", F.lit(""))).alias("ids"))
    line = F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    for name, rule in RULES:
        line = F.regexp_replace(line, F.lit(pattern(rule)), F.lit(f"={name};"))
    left = F.regexp_replace(line, F.lit("=[^;]*;"), F.lit(""))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_known"),
                        F.concat_ws(",", F.regexp_extract_all(line, F.lit("=([^;]*);"), 1)).alias("licences"),
                        F.concat_ws(",", F.regexp_extract_all(left, F.lit("<([^>]*)>"), 1)).alias("unmatched"))


def duckdb_sql() -> str:
    """The same in DuckDB SQL over the view ``documents``."""
    cut = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    for what, by in CUTS:
        by = by.replace("$2", "\\2").replace("\x1e", "' || chr(30) || '")
        what = what.replace("\x1e", "\\x1E")
        cut = f"regexp_replace({cut}, '{what}', '{by}', 'g')"
    pairs = [(s, k) for k, v in SENTENCES.items() for s in v]
    case = "CASE " + " ".join(f"WHEN s = '{s}' THEN '{k}'" for s, k in pairs) + " END"
    line = "line"
    for name, rule in RULES:
        line = f"regexp_replace({line}, '{pattern(rule)}', '={name};', 'g')"
    return rf"""
WITH a AS (SELECT doc_id, list_filter(list_transform(list_transform(string_split({cut}, chr(30)), lambda x: trim(regexp_replace(x, '{NOISE}', ' ', 'g'))), lambda s: {case}), lambda x: x IS NOT NULL) AS ids FROM documents),
b AS (SELECT doc_id, len(ids) AS n, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS line FROM a),
c AS (SELECT doc_id, n, {line} AS line FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS n_known, coalesce(array_to_string(regexp_extract_all(line, '=([^;]*);', 1), ','), '') AS licences,
       coalesce(array_to_string(regexp_extract_all(regexp_replace(line, '=[^;]*;', '', 'g'), '<([^>]*)>', 1), ','), '') AS unmatched FROM c"""
