"""License scans by canonical digest lookup, in DataFrame functions alone.

A text is brought to a canonical form: A-Z lower-cased, punctuation and white
space to plain gaps, copyright lines dropped, equivalent spellings made one.
The digest of the whole canonical text is hash-joined to those of known
licences; each line is looked up likewise, which finds one-line notices in
texts that are not licences. Only forms between the shortest and the longest
known one are digested, as no other can be equal.

The known texts are a parameter: a small table of (license_id, text). It is
joined by hash; Spark broadcasts it where its size is under the session's
bound and shuffles both sides beyond it.

Defined results: a null or empty text matches nothing; equal texts match
equally, repeated rows each by itself; ids that share a digest are all
reported, in order; an empty table gives no rows; further columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import with_row_ids

#: Characters that are gaps, besides the newline. ASCII other than letters and digits, typographic quotes, dashes and spaces.
GAPS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{AB}\x{BB}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}]+"
#: Equivalent spellings of single words.
WORDS = {
    "acknowledgement": "acknowledgment",
    "authorisation": "authorization",
    "centre": "center",
    "favour": "favor",
    "fulfil": "fulfill",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "merchantibility": "merchantability",
    "organisation": "organization",
    "owner": "holder",
    "recognise": "recognize",
    "sublicence": "sublicense",
    "utilise": "utilize",
    "while": "whilst",
    "wilful": "willful",
}
#: Equivalent spellings of several words.
PHRASES = {
    "copy right": "copyright",
    "c copyright": "copyright",
    "free of charge": "without charge",
    "non commercial": "noncommercial",
    "non infringement": "noninfringement",
    "per cent": "percent",
    "sub license": "sublicense",
    "the mit license": "mit license",
}
#: A line of canonical words that only names the holder.
COPYRIGHT_LINE = r"^(portions  )?(copyright|c|©)( +(c|©|copyright))* +([0-9]{4}|year|yyyy)( .*)?$|^all  rights  reserved$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{keep}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
#: Known licences and one-line notices of them.
KNOWN = [
    ("0BSD", _ISC.format(keep="")),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", f"{_BSD}\n\n{_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD}\n\n{_BSD3}\n\n{_DISCLAIMER}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003\n\n{_BOOST}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", _ISC.format(keep=", provided that the above copyright notice and this permission notice appear in all copies")),
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT-0", _MIT.split(", subject to")[0] + ".\n\n" + _MIT.split("\n\n")[2]),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <http://unlicense.org/>"),
    ("WTFPL", _WTFPL),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n\n{_ZLIB}"),
]


def _spelt(text: Column, pairs: dict[str, str]) -> Column:
    """The pairs replaced in a text whose words stand between double spaces."""
    for a, b in pairs.items():
        text = F.replace(text, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return text


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line: words between double spaces; copyright lines are empty."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = F.replace(F.regexp_replace(low, GAPS, "  "), F.lit("\n"), F.lit("  \n  "))
    low = _spelt(F.concat(F.lit("  "), low, F.lit("  ")), WORDS)
    return F.transform(F.split(low, "\n"), lambda l: F.trim(l))


def whole_form(lines: Column) -> Column:
    """The canonical form of a whole text from those of its lines."""
    kept = F.filter(lines, lambda l: (l != "") & ~l.rlike(COPYRIGHT_LINE))
    return F.trim(_spelt(F.concat(F.lit("  "), F.array_join(kept, "  "), F.lit("  ")), PHRASES))


def known_digests(known: DataFrame) -> DataFrame:
    """digest, license_id, n_chars of the known licences' canonical forms."""
    form = whole_form(canonical_lines(F.col("text")))
    return known.select("license_id", form.alias("form")).where("form <> ''").select(F.sha2("form", 256).alias("digest"), "license_id", F.length("form").alias("n_chars")).distinct()


def builtin_licenses(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in KNOWN])
    return spark.range(1).select(F.inline(rows))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document license_id (of the whole text, else null), notice_ids (of its lines, comma-joined) and n_notices."""
    known = known_digests(builtin_licenses(docs.sparkSession) if known is None else known)
    bounds = known.agg(F.coalesce(F.min("n_chars"), F.lit(1)), F.coalesce(F.max("n_chars"), F.lit(0))).first()
    rows = with_row_ids(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "row")
    forms = rows.where("text is not null").select("row", canonical_lines(F.col("text")).alias("lines"))
    units = forms.select("row", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), whole_form(F.col("lines")).alias("form"))), F.transform("lines", lambda l: F.struct(F.lit(False).alias("whole"), l.alias("form"))))).alias("u"))
    one_line = F.trim(_spelt(F.concat(F.lit("  "), F.col("u.form"), F.lit("  ")), PHRASES))
    units = units.select("row", "u.whole", F.when(F.col("u.whole"), F.col("u.form")).otherwise(one_line).alias("form"))
    units = units.where(F.length("form").between(*bounds))
    hits = units.select("row", "whole", F.sha2("form", 256).alias("digest")).join(known.select("digest", "license_id"), "digest")
    joined = F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",")
    whole = F.array_join(F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("license_id")))), ",")
    found = hits.groupBy("row").agg(F.nullif(whole, F.lit("")).alias("license_id"), joined.alias("notice_ids"), F.count_if(~F.col("whole")).alias("n_notices"))
    out = rows.select("row", "doc_id").join(found, "row", "left")
    return out.select("doc_id", "license_id", F.coalesce("notice_ids", F.lit("")).alias("notice_ids"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

def _duck(sql: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        sql = f"replace({sql}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return sql


def _duck_lines(text: str) -> str:
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    low = f"replace(regexp_replace({low}, '{GAPS}', '  ', 'g'), chr(10), '  ' || chr(10) || '  ')"
    low = _duck(f"('  ' || {low} || '  ')", WORDS)
    return f"list_transform(string_split({low}, chr(10)), lambda l: trim(l, ' '))"


def _duck_whole(lines: str) -> str:
    kept = f"list_filter({lines}, lambda l: l <> '' AND NOT regexp_matches(l, '{COPYRIGHT_LINE}'))"
    return "trim(" + _duck(f"('  ' || coalesce(array_to_string({kept}, '  '), '') || '  ')", PHRASES) + ", ' ')"


_VALUES = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in KNOWN)
OP1_SQL = f"""
WITH known AS (SELECT DISTINCT license_id, {_duck_whole('lines')} AS form FROM (SELECT license_id, {_duck_lines('text')} AS lines FROM (VALUES {_VALUES}) AS k(license_id, text))),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
f AS (SELECT rid, {_duck_lines('text')} AS lines FROM d WHERE text IS NOT NULL),
u AS (
  SELECT rid, true AS whole, {_duck_whole('lines')} AS form FROM f
  UNION ALL
  SELECT rid, false AS whole, trim({_duck("('  ' || l || '  ')", PHRASES)}, ' ') AS form FROM (SELECT rid, unnest(lines) AS l FROM f)
),
h AS (SELECT rid, whole, license_id FROM u JOIN known ON sha256(u.form) = sha256(known.form) WHERE known.form <> ''),
g AS (
  SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (whole) AS license_id,
         string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (NOT whole) AS notice_ids, count(*) FILTER (NOT whole) AS n_notices
  FROM h GROUP BY rid
)
SELECT doc_id, license_id, coalesce(notice_ids, '') AS notice_ids, coalesce(n_notices, 0)::BIGINT AS n_notices FROM d LEFT JOIN g USING (rid)
"""
