"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, normalised (A-Z lower-cased, every run of other
characters than a-z and 0-9 one space).  Known licence sentences become their identifiers,
in order: whole sentences, and also sentences that are wrapped over several lines (comment
marks are blanks) or joined by semicolons, as long as no . ! ? or empty line stands in them; a licence is recognised when the identifiers of one
of its rules occur in that order, other identifiers may stand between.  One projection per
document: no shuffle, no join, no Python; the tables below are literals of the plan.

Defined results: null or empty texts have no sentences and no licence; a sentence counts as
often as it stands; repeated rows give repeated rows; other columns are kept out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences (identifier, sentence) and rules (licence, identifiers in order).
SENTENCES = [
    (1, "Licensed under the Apache License, Version 2.0"),
    (2, "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    (3, "you may not use this file except in compliance with the License"),
    (4, "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    (5, "Released under the MIT License"),
    (6, "Licensed under the MIT License"),
    (7, "This project is licensed under the MIT License"),
    (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    (9, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    (10, "This work is licensed under the GNU General Public License, version 3"),
    (11, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    (12, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    (13, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    (14, "You should have received a copy of the GNU General Public License along with this program"),
    (15, "You should have received a copy of the GNU Lesser General Public License along with this library"),
    (16, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    (17, "Licensed under CC BY-NC 4.0"),
    (18, "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (19, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    (20, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (21, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (22, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    (23, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    (24, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (25, "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    (26, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    (27, "This is free and unencumbered software released into the public domain"),
    (28, "SPDX-License-Identifier: Apache-2.0"),
    (29, "SPDX-License-Identifier: MIT"),
    (30, "SPDX-License-Identifier: GPL-3.0-or-later"),
    (31, "SPDX-License-Identifier: BSD-3-Clause"),
    (32, "Licensed under CC BY 4.0"),
    (33, "Licensed under CC BY-SA 4.0"),
    (34, "All rights reserved"),
]
RULES = [
    ("Apache-2.0", [1]), ("Apache-2.0", [2, 3]), ("Apache-2.0", [28]),
    ("BSD-2-Clause", [21, 22, 23]), ("BSD-3-Clause", [21, 22, 23, 24]), ("BSD-3-Clause", [31]),
    ("CC-BY-4.0", [18]), ("CC-BY-4.0", [32]), ("CC-BY-NC-4.0", [17]), ("CC-BY-NC-4.0", [20]),
    ("CC-BY-SA-4.0", [19]), ("CC-BY-SA-4.0", [33]),
    ("GPL-2.0-or-later", [12, 16]), ("GPL-3.0", [10]), ("GPL-3.0-or-later", [11, 16]), ("GPL-3.0-or-later", [30]),
    ("ISC", [26]), ("LGPL-2.1-or-later", [13]),
    ("MIT", [5]), ("MIT", [6]), ("MIT", [7]), ("MIT", [8, 9]), ("MIT", [29]), ("MPL-2.0", [25]), ("Unlicense", [27]),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A sentence ends at a line's end, and at . ! ? before a blank or the end; \x01 marks the cut.
_END = r"[.!?]+([ \t]+|$)|[\r\n]+"
_OTHER = "[^a-z0-9\x01]+"
_EDGE = " ?\x01[ \x01]*"
# For known sentences: \x01 an end that none spans, \x02 a line break and \x03 a semicolon, which they may span or end at.
_HARD = r"[.!?]+([ \t\r\n]+|$)|(?>\r\n|\r|\n)([^a-z0-9\r\n\x01]*+(?>\r\n|\r|\n))+"
_OTHER_MARKED = "[^a-z0-9\x01\x02\x03]+"
_JOIN = "[ \x02\x03]+"


def sentence_parts(text: str) -> list[str]:
    """Python twin of the normalisation, for the tables above (a known notice may hold several sentences)."""
    t = re.sub(_END, "\x01", text.translate(str.maketrans(_UPPER, _LOWER)))
    return [x for x in re.sub(_EDGE, "\x01", re.sub(_OTHER, " ", t)).strip(" \x01").split("\x01") if x]


def known_sentences(sentences=SENTENCES) -> dict[str, int]:
    out: dict[str, int] = {}
    for number, text in sentences:
        parts = sentence_parts(text)
        if len(parts) != 1:
            raise ValueError(f"not one sentence: {text}")
        out[parts[0]] = number
    return out


def rule_patterns(rules=RULES) -> list[tuple[str, str]]:
    """Pattern over ``,id,id,`` for each rule: its identifiers in order, others between."""
    return [(name, "," + ",([0-9]+,)*".join(map(str, ids)) + ",") for name, ids in rules]


def sentence_pattern() -> str:
    """Pattern over a marked text: one known sentence (group 1) between two marks, the longest first."""
    known = sorted(known_sentences(), key=lambda x: (-len(x), x))
    return "[\x01-\x03] ?(" + "|".join(_JOIN.join(x.split(" ")) for x in known) + ")(?= ?[\x01-\x03])"


def marked(text: Column) -> Column:
    """Normalised text with its cuts as marks, between two marks."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + "\x02\x03;", _LOWER + "  \x03")
    t = F.translate(F.regexp_replace(t, _HARD, "\x01"), "\r\n", "\x02\x02")
    return F.concat(F.lit("\x01"), F.regexp_replace(t, _OTHER_MARKED, " "), F.lit("\x01"))


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, _END, "\x01"), _OTHER, " "), _EDGE, "\x01")
    return F.filter(F.split(F.trim(t, F.lit(" \x01")), "\x01"), lambda x: x != "")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses): identifiers in order, recognised licences sorted by name."""
    table = known_sentences()
    known = F.create_map(*[x for s, i in table.items() for x in (F.lit(s), F.lit(i))])
    text = F.col(text_col)
    hits = F.regexp_extract_all(marked(text), F.lit(sentence_pattern()), F.lit(1))
    ids = F.transform(hits, lambda x: known[F.regexp_replace(x, _JOIN, " ")])
    found = docs.select(F.col(id_col).alias("doc_id"), F.size(sentences(text)).cast("long").alias("n_sentences"), ids.alias("sentence_ids"))
    line = F.concat(F.lit(","), F.array_join(F.col("sentence_ids").cast("array<string>"), ","), F.lit(","))
    hits = [F.when(line.rlike(pattern), F.lit(name)) for name, pattern in rule_patterns()]
    return found.select("doc_id", "n_sentences", "sentence_ids", F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))).alias("licenses"))


def duckdb_sql() -> str:
    """The same in DuckDB SQL, for notices that stand in one line each without clauses of their own behind a semicolon."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sent = ", ".join(f"({quoted(s)}, {i})" for s, i in known_sentences().items())
    rules = ", ".join(f"({quoted(n)}, {quoted(p)})" for n, p in rule_patterns())
    return f"""
WITH known(s, i) AS (VALUES {sent}), rules(name, p) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(
  translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.!?]+([ \\t]+|$)|[\\r\\n]+', chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g'),
  ' ?\\x01[ \\x01]*', chr(1), 'g'), ' ' || chr(1)), chr(1)), lambda x: x <> '') AS s FROM documents),
u AS (SELECT r, unnest(s) AS s, unnest(range(len(s))) AS k FROM d),
ids AS (SELECT r, string_agg(i::VARCHAR, ',' ORDER BY k) AS ids FROM u JOIN known USING (s) GROUP BY r),
lic AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS l FROM ids JOIN rules ON regexp_matches(',' || ids || ',', p) GROUP BY r)
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(l, '') AS licenses
FROM d LEFT JOIN ids USING (r) LEFT JOIN lic USING (r)
"""
