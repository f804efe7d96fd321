"""Licence scan by sentence rules: known licence sentences become identifiers, and rules are ordered runs of identifiers.

A text is cut into sentences at punctuation followed by white space and at empty lines. Comment marks (ASCII punctuation)
at the start of a line after a cut go with it, and a line of nothing else is empty. A sentence that spans lines is tried
whole and line by line. A known sentence has no cut inside. Sentences are normalised (letters and digits, lower case, single
spaces) and looked up. Wrapped sentences are not found in comments whose mark is itself a cut (`; `) or a word (`dnl`, `REM`).
A rule matches where its identifiers follow one another in the text's sequence of identifiers, whatever unknown
sentences stand between. Everything is one projection per row: no shuffle, no limit on texts or sentences.

Defined results: null and empty texts have no sentences and no licences; a repeated sentence counts each time in
`sentence_ids` and its licence once in `licences`; rows are independent, so repeated or null ids are kept. Only the id and
text columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# white space, and the ASCII punctuation of which comment marks are made; they go with the line end before them
_MARKS = " \\t\\r\\f!-/:-@\\[-`{-~"
_CUT = f"([.!?:;])(?:[ \\t\\r\\f]*\\n[{_MARKS}\\n]*|[ \\t\\r\\f]+)|\\n[{_MARKS}]*\\n[{_MARKS}\\n]*"


# Standard notices of further licences, as published. Their sentences are cut below by the rule for all texts.
NOTICES = {
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
}

# Sentences of public licences and notices in normal form.
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.project": "this project is licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache2.licensed": "licensed under the apache license version 2 0",
    "apache2.header": "licensed under the apache license version 2 0 the license",
    "apache2.comply": "you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2.obtain": "you may obtain a copy of the license at",
    "apache2.url": "http www apache org licenses license 2 0",
    "apache2.urls": "https www apache org licenses license 2 0",
    "apache2.asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2.see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl3.licensed": "licensed under the gnu general public license version 3",
    "gpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.free": "this program is free software",
    "gpl3.later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl.implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.see": "see the gnu general public license for more details",
    "gpl.received": "you should have received a copy of the gnu general public license along with this program",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd.asis-holder": "this software is provided by the copyright holder and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "ccbync4.licensed": "licensed under cc by nc 4 0",
    "ccby4.licensed": "licensed under cc by 4 0",
    "ccbysa4.licensed": "licensed under cc by sa 4 0",
    "ccby4.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0.waived": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "reserved": "all rights reserved",
}

# Rule name, licence, ordered sentence identifiers.
RULES = (
    ("mit-released", "MIT", ("mit.released",)),
    ("mit-licensed", "MIT", ("mit.licensed",)),
    ("mit-project", "MIT", ("mit.project",)),
    ("mit-text", "MIT", ("mit.grant", "mit.notice", "mit.warranty", "mit.liability")),
    ("apache-2.0-licensed", "Apache-2.0", ("apache2.licensed",)),
    ("apache-2.0-header", "Apache-2.0", ("apache2.header", "apache2.comply", "apache2.copy", "apache2.asis", "apache2.see")),
    ("apache-2.0-header-lines", "Apache-2.0", ("apache2.header", "apache2.comply", "apache2.obtain", "apache2.url", "apache2.asis", "apache2.see")),
    ("apache-2.0-header-https", "Apache-2.0", ("apache2.header", "apache2.comply", "apache2.obtain", "apache2.urls", "apache2.asis", "apache2.see")),
    ("gpl-3.0-work", "GPL-3.0-only", ("gpl3.work",)),
    ("gpl-3.0-licensed", "GPL-3.0-only", ("gpl3.licensed",)),
    ("gpl-3.0-header", "GPL-3.0-or-later", ("gpl3.free", "gpl.hope", "gpl.implied", "gpl.see", "gpl.received")),
    ("gpl-3.0-header-cut", "GPL-3.0-or-later", ("gpl.free", "gpl3.later", "gpl.hope", "gpl.implied", "gpl.see", "gpl.received")),
    ("bsd-3-clause-text", "BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.names")),
    # the three conditions alone also begin the BSD-3 text, so a BSD-2 rule goes on to what follows them there
    ("bsd-2-clause-text", "BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.asis")),
    ("bsd-2-clause-text-holder", "BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.asis-holder")),
    ("bsd-2-clause-reserved", "BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "reserved")),
    ("cc-by-nc-4.0-licensed", "CC-BY-NC-4.0", ("ccbync4.licensed",)),
    ("cc-by-4.0-licensed", "CC-BY-4.0", ("ccby4.licensed",)),
    ("cc-by-4.0-work", "CC-BY-4.0", ("ccby4.work",)),
    ("cc-by-sa-4.0-licensed", "CC-BY-SA-4.0", ("ccbysa4.licensed",)),
    ("cc0-waiver", "CC0-1.0", ("cc0.waived",)),
    ("all-rights-reserved", "proprietary-notice", ("reserved",)),
)

def cut(text: str) -> list[str]:
    """The normal forms of an ASCII text's sentences, by the rule of sentences()."""
    pattern = re.compile(_CUT.replace("\\\\", "\\"))
    whole = pattern.sub(lambda m: (m.group(1) or "") + "\x01", text).split("\x01")
    return [n for n in (re.sub("[^A-Za-z0-9]+", " ", w).strip().lower() for w in whole) if n]


def _with_notices(known: dict[str, str], rules: tuple) -> tuple[dict[str, str], tuple]:
    by_text = {v: k for k, v in known.items()}
    more = []
    for licence, text in NOTICES.items():
        name = licence.lower() + "-notice"
        ids = [by_text.setdefault(x, f"{name}.{i}") for i, x in enumerate(cut(text))]
        more.append((name, licence, tuple(ids)))
    return {k: v for v, k in by_text.items()}, (*rules, *more)


SENTENCES, RULES = _with_notices(SENTENCES, RULES)


def sentences(text: Column) -> Column:
    """Candidate sentences in order: each sentence, and the lines of one that spans lines."""
    whole = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _CUT, "$1\u0001"), "\u0001")
    return F.flatten(F.transform(whole, lambda s: F.when(F.contains(s, F.lit("\n")), F.concat(F.array(s), F.split(s, "\n"))).otherwise(F.array(s))))


def normal_form(sentence: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(sentence, "[^\\p{L}\\p{N}]+", " ")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, matched_rules and licences (comma-joined; the last two sorted)."""
    if any("," in i or i not in known for _, _, r in rules for i in r):
        raise ValueError("a rule names an unknown sentence, or an identifier has a comma")
    by_text = {v: k for k, v in known.items()}
    lookup = F.create_map(*[F.lit(x) for kv in by_text.items() for x in kv])
    normal = F.transform("sentence", normal_form)
    ids = F.transform(F.filter(normal, lambda s: s.isin(*by_text)), lambda s: F.element_at(lookup, s))
    out = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), sentences(F.col(text_col).cast("string")).alias("sentence"))
        .select("doc_id", F.size(F.filter(normal, lambda s: s != "")).cast("long").alias("n_sentences"), ids.alias("ids"))
        .withColumn("bounded", F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")))
    )
    # identifiers are written with a comma on both sides; a rule's are joined the same way
    hits = F.array_compact(F.array(*[F.when(F.contains(F.col("bounded"), F.lit("," + ",,".join(r) + ",")), F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("licence"))) for name, licence, r in rules]))
    return out.withColumn("hits", hits).select(
        "doc_id",
        "n_sentences",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.transform("hits", lambda h: h["rule"])), ",").alias("matched_rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["licence"]))), ",").alias("licences"),
    )


def oracle() -> str:
    """The same scan as DuckDB SQL."""
    known = ", ".join(f"('{v}', '{k}')" for k, v in SENTENCES.items())
    rules = ", ".join(f"('{n}', '{lic}', '{',' + ',,'.join(r) + ','}')" for n, lic, r in RULES)
    cut = _CUT.replace("\\\\", "\\")
    assert re.compile(cut)
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
rules(name, licence, seq) AS (VALUES {rules}),
s AS (
  SELECT doc_id, list_transform(flatten(list_transform(
    string_split(regexp_replace(coalesce(text, ''), '{cut}', '\\1' || chr(1), 'g'), chr(1)),
    lambda x: CASE WHEN contains(x, chr(10)) THEN list_concat([x], string_split(x, chr(10))) ELSE [x] END)),
    lambda x: trim(lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))) AS w
  FROM documents),
e AS (SELECT doc_id, i, w[i] AS sentence FROM s, unnest(range(1, len(w) + 1)) AS t(i)),
k AS (SELECT doc_id, string_agg(id, ',' ORDER BY i) AS ids, ',' || string_agg(id, ',,' ORDER BY i) || ',' AS bounded FROM e JOIN known USING (sentence) GROUP BY doc_id),
m AS (
  SELECT doc_id, string_agg(name, ',' ORDER BY name) AS matched_rules, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
  FROM k JOIN rules ON contains(bounded, seq) GROUP BY doc_id)
SELECT s.doc_id, CAST(len(list_filter(w, lambda x: x <> '')) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids,
       coalesce(matched_rules, '') AS matched_rules, coalesce(licences, '') AS licences
FROM s LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""
