"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (A-Z lowered, everything but a-z and 0-9 to one space) and looked up
among known licence sentences; a sentence over several lines is looked up joined, as are runs of lines within longer text,
else line by line. The sequence of identifiers found is matched against ordered rules: a rule that occurs in it names a licence and
consumes its identifiers, so an earlier, longer rule wins over a later one. No shuffle: a row is scanned on its own.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import table

# Sentences of public licences and notices, by identifier.
SENTENCES: dict[str, list[str]] = {
    "apache2_grant": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");",
                      "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "apache2_use": ["you may not use this file except in compliance with the License"],
    "apache2_copy": ["You may obtain a copy of the License at",
                     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                     "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2_asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache2_see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit_name": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License"],
    "mit_grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit_asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit_liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd_name": ["Licensed under the BSD 3-Clause License", "BSD 3-Clause License"],
    "bsd2_name": ["Licensed under the BSD 2-Clause License", "BSD 2-Clause License"],
    "gpl3_name": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3",
                  "Licensed under the GNU General Public License v3.0"],
    "gpl2_name": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"],
    "gpl_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2_free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl_details": ["See the GNU General Public License for more details"],
    "lgpl3_name": ["This work is licensed under the GNU Lesser General Public License, version 3", "Licensed under the GNU Lesser General Public License, version 3"],
    "agpl3_name": ["This work is licensed under the GNU Affero General Public License, version 3", "Licensed under the GNU Affero General Public License, version 3"],
    "mpl2_name": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc_name": ["Licensed under the ISC License", "ISC License"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "ccby4": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "ccbysa4": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "ccbync4": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["Licensed under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0"],
    "reserved": ["All rights reserved"],
    "bsd_asis": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "bsd_liability": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"],
    "lgpl21_free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3_free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl3_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "zlib_asis": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "epl2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
}

# Identifiers of the public licence list that stand alone in a "SPDX-License-Identifier:" line.
LISTED = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
          "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
          "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
SENTENCES |= {"listed_" + re.sub("[^a-z0-9]", "_", x.lower()): [f"SPDX-License-Identifier: {x}"] for x in LISTED}

# Ordered rules: identifiers in a row -> licence. Earlier rules consume their identifiers first.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2_grant", "apache2_use", "apache2_copy", "apache2_asis", "apache2_see"]),
    ("Apache-2.0", ["apache2_grant", "apache2_copy", "apache2_asis", "apache2_see"]),
    ("MIT", ["mit_name", "mit_grant", "mit_notice", "mit_asis", "mit_liability"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_asis", "mit_liability"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_asis"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_details"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_details"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("Apache-2.0", ["apache2_grant"]),
    ("MIT", ["mit_name"]),
    ("MIT", ["mit_grant"]),
    ("BSD-3-Clause", ["bsd_name"]),
    ("BSD-2-Clause", ["bsd2_name"]),
    ("GPL-3.0", ["gpl3_name"]),
    ("GPL-2.0", ["gpl2_name"]),
    ("LGPL-3.0", ["lgpl3_name"]),
    ("AGPL-3.0", ["agpl3_name"]),
    ("MPL-2.0", ["mpl2_name"]),
    ("ISC", ["isc_name", "isc_grant"]),
    ("ISC", ["isc_grant"]),
    ("ISC", ["isc_name"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-SA-4.0", ["ccbysa4"]),
    ("CC-BY-NC-4.0", ["ccbync4"]),
    ("CC-BY-4.0", ["ccby4"]),
    ("CC0-1.0", ["cc0"]),
    ("LGPL-2.1-or-later", ["lgpl21_free"]),
    ("LGPL-3.0-or-later", ["lgpl3_free"]),
    ("AGPL-3.0-or-later", ["agpl3_free"]),
    ("Zlib", ["zlib_asis", "zlib_grant"]),
    ("Zlib", ["zlib_grant"]),
    ("EPL-2.0", ["epl2"]),
    *((x, ["listed_" + re.sub("[^a-z0-9]", "_", x.lower())]) for x in LISTED),
]

# The endorsement sentence with any holder's name (which may hold full stops) is brought to the known one.
_GAP = r"[^a-z0-9]+"
_HOLDER = _GAP.join(["neither", "the", "names?", "of"]) + r"[\s\S]{1,300}?" + _GAP.join(["nor", "the", "names", "of", f"(?:(?:its|their|any|the|other){_GAP})*contributors"])
_ANY_HOLDER = "neither the name of the copyright holder nor the names of its contributors"

BREAK = "\x01"  # stands for a sentence end
_ENDS = r"[.!?]+[ \t\r\n\f\x0B]"
_BLANK = r"\n[ \t\r]*\n"
_OTHER = r"[^a-z0-9\n\x01]+"


def normal(sentence: str) -> str:
    """A sentence as it is looked up."""
    lowered = sentence.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"[.!?]+$", "", lowered)).strip()


def known_sentences() -> dict[str, str]:
    return {normal(s): name for name, group in SENTENCES.items() for s in group}


def _runs() -> str:
    """Pattern of runs of whole lines that make a known sentence, the longest first; lines without a letter or digit do not matter."""
    longest = sorted(known_sentences(), key=lambda s: (-len(s), s))
    return rf"(?<![^\n{BREAK}])( *(?:" + "|".join(s.replace(" ", r"[ \n]+") for s in longest) + rf") *)(?![^\n{BREAK}])"


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in sorted(d.items()) for x in kv))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_sentences`` and ``n_known`` (long), ``sentence_ids``, ``licences`` (distinct, in rule order), ``unmatched`` (identifiers no
    rule consumed) and ``n_unknown_mentions`` (sentences with "license" or "licence" that are not known).

    NULL and empty texts give 0 and empty arrays. Rows are independent, so repeated rows repeat. ``ValueError`` if a result column is
    there already. A wrapped sentence may stand among other lines (a copyright line, comment marks), but begins and ends with a line or
    sentence."""
    names = ["n_sentences", "n_known", "sentence_ids", "licences", "unmatched", "n_unknown_mentions"]
    if clash := {*names, "__units", "__ids", "__state"} & set(df.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    known = _literal_map(known_sentences())
    t = F.translate(F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(" ")), string.ascii_uppercase, string.ascii_lowercase)
    t = F.when(F.contains(t, F.lit("neither")), F.regexp_replace(t, F.lit(_HOLDER), F.lit(_ANY_HOLDER))).otherwise(t)
    t = F.regexp_replace(t, F.lit(_ENDS), F.lit(BREAK))
    t = F.regexp_replace(t, F.lit(_BLANK), F.lit(BREAK))
    t = F.regexp_replace(t, F.lit(_OTHER), F.lit(" "))
    t = F.regexp_replace(t, F.lit(_runs()), F.lit(f"{BREAK}$1{BREAK}"))

    def units(s: Column) -> Column:
        whole = F.trim(F.regexp_replace(s, F.lit("[ \n]+"), F.lit(" ")))
        lines = F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(known[whole].isNotNull(), F.array(whole)).otherwise(lines)

    rules = F.array(*(F.struct(F.lit("".join(f"<{i}>" for i in ids)).alias("pattern"), F.lit(name).alias("name")) for name, ids in RULES))
    out = df.withColumn("__units", F.flatten(F.transform(F.split(t, BREAK), units)))
    out = out.withColumn("__ids", F.filter(F.transform("__units", lambda u: known[u]), lambda x: x.isNotNull()))
    start = F.struct(F.concat(F.lit(""), F.array_join(F.transform("__ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")).alias("left"),
                     F.array().cast("array<string>").alias("found"))
    fold = F.aggregate(rules, start, lambda s, r: F.when(
        F.contains(s["left"], r["pattern"]),
        F.struct(F.replace(s["left"], r["pattern"], F.lit("|")).alias("left"), F.array_union(s["found"], F.array(r["name"])).alias("found"))
    ).otherwise(s))
    out = out.withColumn("__state", F.when(F.size("__ids") > 0, fold).otherwise(start))
    mention = lambda u: known[u].isNull() & (F.contains(u, F.lit("license")) | F.contains(u, F.lit("licence")))
    return out.select(*df.columns, F.size("__units").cast("long").alias("n_sentences"), F.size("__ids").cast("long").alias("n_known"),
                      F.col("__ids").alias("sentence_ids"), F.col("__state.found").alias("licences"),
                      F.regexp_extract_all("__state.left", F.lit("<([a-z0-9_]+)>"), F.lit(1)).alias("unmatched"),
                      F.size(F.filter("__units", mention)).cast("long").alias("n_unknown_mentions"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_known", F.array_join("sentence_ids", ",").alias("sentence_ids"),
                      F.array_join("licences", ",").alias("licences"), F.array_join("unmatched", ",").alias("unmatched"),
                      "n_unknown_mentions")


def oracle() -> str:
    """The same rows by DuckDB: sentences and lines unnested, known sentences joined, one step per rule."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in sorted(known_sentences().items()))
    steps, last = [], "r0"
    for k, (name, ids) in enumerate(RULES, 1):
        p = "".join(f"<{i}>" for i in ids)
        steps.append(f"r{k} AS (SELECT doc_id, CASE WHEN contains(lft, '{p}') AND NOT list_contains(found, '{name}') "
                     f"THEN list_append(found, '{name}') ELSE found END AS found, replace(lft, '{p}', '|') AS lft FROM {last})")
        last = f"r{k}"
    return f"""
WITH known(s, id) AS (VALUES {values}),
t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        translate(coalesce(text, '') || ' ', '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
        '{_HOLDER}', '{_ANY_HOLDER}', 'g'), '{_ENDS}', chr(1), 'g'), '{_BLANK}', chr(1), 'g'), '{_OTHER}', ' ', 'g'), chr(1)) AS ss FROM documents),
s AS (SELECT doc_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM t),
w AS (SELECT doc_id, i, s, trim(regexp_replace(s, '[ \\n]+', ' ', 'g')) AS whole FROM s),
k AS (SELECT w.*, known.id FROM w LEFT JOIN known ON known.s = w.whole),
l AS (SELECT doc_id, i, generate_subscripts(string_split(s, chr(10)), 1) AS j, trim(unnest(string_split(s, chr(10)))) AS u FROM k WHERE id IS NULL),
u AS (SELECT doc_id, i, 0 AS j, whole AS u, id FROM k WHERE id IS NOT NULL
      UNION ALL SELECT doc_id, i, j, u, id FROM l LEFT JOIN known ON known.s = l.u WHERE u <> ''),
a AS (SELECT doc_id, count(*) AS n_sentences, count(id) AS n_known,
             coalesce(string_agg(id, ',' ORDER BY i, j) FILTER (WHERE id IS NOT NULL), '') AS sentence_ids,
             coalesce(string_agg('<' || id || '>', '' ORDER BY i, j) FILTER (WHERE id IS NOT NULL), '') AS lft,
             count(*) FILTER (WHERE id IS NULL AND (contains(u, 'license') OR contains(u, 'licence'))) AS n_unknown_mentions
      FROM u GROUP BY doc_id),
r0 AS (SELECT doc_id, CAST([] AS VARCHAR[]) AS found, lft FROM a),
{", ".join(steps)}
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_known, 0) AS n_known, coalesce(sentence_ids, '') AS sentence_ids,
       coalesce(array_to_string(found, ','), '') AS licences,
       coalesce(array_to_string(regexp_extract_all({last}.lft, '<([a-z0-9_]+)>', 1), ','), '') AS unmatched,
       coalesce(n_unknown_mentions, 0) AS n_unknown_mentions
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN {last} ON {last}.doc_id = d.doc_id
"""


OP1_SQL = oracle()
