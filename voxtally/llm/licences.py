"""Licence scans by canonical digest lookup.

A text is reduced to a canonical form, in which case, punctuation, copyright lines and
equivalent spellings no longer matter, and the digest of the whole form is joined with the
digests of known licences. Each line is made canonical once; the whole form is its lines
joined. Known texts are also looked up inside longer ones, as runs of lines: where a line
has the digest of a known text's first line, the digest of as many lines as that text has
is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spellings that licence texts use one for the other; the second one is kept.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("while", "whilst"),
    ("wilful", "willful"),
    ("http://", "https://"),
    ("&", " and "),
]

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

BSD_3 = BSD_2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

# Licence identifiers and whole texts or notices that stand for them.
KNOWN = [
    ("MIT", MIT),
    ("MIT", "The MIT License\n" + MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("0BSD", ZERO_BSD),
    ("0BSD", "Zero-Clause BSD\n" + ZERO_BSD),
    ("BSD-2-Clause", BSD_2 + BSD_DISCLAIMER),
    ("BSD-3-Clause", BSD_3 + BSD_DISCLAIMER),
    ("Unlicense", UNLICENSE),
    ("Zlib", ZLIB),
    ("BSL-1.0", BOOST),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]

COPYRIGHT_LINE = r"(?dm)^[ \t/*#;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, one spelling, words with single spaces between."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, without the empty ones; joined by spaces they are the whole form."""
    return F.filter(F.transform(F.split(text, "\n"), canonical), lambda line: line != "")


def known_digests(df: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, first, n, licence) of the known texts, whose number is fixed: the digests of the whole and of
    the first line, the number of lines, one row a digest."""
    entries = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(text).alias("text")) for name, text in (KNOWN if known is None else known)])
    rows = df.sparkSession.range(1).select(F.inline(entries)).select(canonical_lines(F.col("text")).alias("lines"), "licence").where(F.size("lines") > 0)
    rows = rows.select(F.sha2(F.array_join("lines", " "), 256).alias("digest"), F.sha2(F.col("lines")[0], 256).alias("first"), F.size("lines").alias("n"), "licence")
    # one form may be cut into lines in several ways, each a run of its own
    return rows.withColumn("licence", F.min("licence").over(Window.partitionBy("digest"))).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, digest, licence, n_licence_lines, line_licences) of every row.

    `digest` is the sha-256 of the canonical whole text, `licence` what it stands for, or
    null. `n_licence_lines` counts the lines at which a known text begins that is a whole
    line or a run of whole lines, and `line_licences` lists, in order and once each, their
    licences, separated by commas; it is empty where there is none. Lines that are empty in
    canonical form do not count. A null text is empty, and an empty form is no licence. No
    row meets another, so repeated rows repeat.
    """
    entries = known_digests(docs, known).orderBy("digest", "first").collect()  # a row a known text
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), canonical_lines(text).alias("__lines"))
    rows = rows.select("__id", "__lines", F.sha2(F.array_join("__lines", " "), 256).alias("digest"))
    begins: dict[str, list[Column]] = {}
    for e in entries:
        begins.setdefault(e["first"], []).append(F.struct(F.lit(e["n"]).alias("n"), F.lit(e["digest"]).alias("digest"), F.lit(e["licence"]).alias("licence")))
    if not begins:
        return rows.select(F.col("__id").alias(id_col), "digest", F.lit(None).cast("string").alias("licence"), F.lit(0).cast("long").alias("n_licence_lines"), F.lit("").alias("line_licences"))
    runs = F.create_map(*[c for first, found in begins.items() for c in (F.lit(first), F.array(*found))])
    at = F.filter(F.transform("__lines", lambda line, k: F.struct(k.alias("k"), F.sha2(line, 256).alias("first"))), lambda p: F.array_contains(F.array(*map(F.lit, begins)), p["first"]))
    rows = rows.withColumn("__at", at)
    same = lambda p, e: F.sha2(F.array_join(F.slice("__lines", p["k"] + 1, e["n"]), " "), 256) == e["digest"]
    hits = F.transform("__at", lambda p: F.transform(F.filter(F.element_at(runs, p["first"]), lambda e: same(p, e)), lambda e: e["licence"]))
    rows = rows.withColumn("__hits", F.filter(hits, lambda h: F.size(h) > 0))
    whole = docs.sparkSession.createDataFrame(sorted({(e["digest"], e["licence"]) for e in entries}), "digest string, licence string")
    rows = rows.join(F.broadcast(whole), "digest", "left")  # as many rows as there are known texts
    names = F.array_join(F.array_sort(F.array_distinct(F.flatten("__hits"))), ",")
    return rows.select(F.col("__id").alias(id_col), "digest", "licence", F.size("__hits").cast("long").alias("n_licence_lines"), names.alias("line_licences"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """`canonical` in SQL."""
    out = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE.replace('(?dm)', '(?m)'))}, '', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return f"trim(regexp_replace({out}, {_quoted(NOT_WORD)}, ' ', 'g'), ' ')"


def scan_sql(known: list[tuple[str, str]] | None = None) -> str:
    """`scan` of `documents` (doc_id, text) in SQL."""
    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in known or KNOWN)
    lines = lambda table: f"SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda line: {canonical_sql('line')}), lambda line: line <> '') AS lines FROM {table}"
    return f"""
    WITH given AS ({lines(f"(VALUES {values}) v(licence, text)")}),
    known AS (SELECT DISTINCT array_to_string(lines, ' ') AS form, len(lines) AS n, min(licence) OVER (PARTITION BY array_to_string(lines, ' ')) AS licence FROM given WHERE len(lines) > 0),
    texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
    cut AS ({lines("texts")}),
    places AS (SELECT text, lines, unnest(range(1, len(lines) + 1)) AS place FROM cut),
    hits AS (SELECT p.text, p.place, k.licence FROM places p JOIN known k ON starts_with(k.form, p.lines[p.place]) AND array_to_string(list_slice(p.lines, p.place, p.place + k.n - 1), ' ') = k.form),
    found AS (SELECT text, count(DISTINCT place) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM hits GROUP BY text)
    SELECT d.doc_id, sha256(array_to_string(c.lines, ' ')) AS digest, k.licence, coalesce(f.n, 0)::BIGINT AS n_licence_lines, coalesce(f.names, '') AS line_licences
    FROM documents d JOIN cut c ON c.text = coalesce(d.text, '') LEFT JOIN (SELECT DISTINCT form, licence FROM known) k ON k.form = array_to_string(c.lines, ' ') LEFT JOIN found f ON f.text = c.text
    """
