"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: ASCII lower case, copyright lines dropped, equivalent
spellings made one, everything but letters and digits to single spaces. Its SHA-256 is
joined with the digests of known licence texts: short ones stand here as texts, long ones
(GPL, LGPL, GFDL, MPL, Apache, CC0 and Artistic) as digests. A document is looked up as a whole, and each
of its lines as a text of its own, for one-line notices.

No step of the canonical form makes the words of ``GATE`` out of others, and every known text
holds one of them, so only texts and lines in which one is written can match; the others are
not brought to the canonical form. The known texts are a fixed list, so their digests are
broadcast.

Rows: null and empty texts match nothing. Each row gets one row; repeated rows the same. A
line that occurs twice counts twice. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The steps of the canonical form, in order: pattern, replacement.
STEPS = [
    (r"(^|\n)[^a-z0-9\n(\x{a9}]*(copyright[ \t]*(\(c\)|\x{a9}|[0-9][0-9][0-9][0-9]|:|by )|\(c\)[ \t]*[0-9]|\x{a9})[^\n]*", "\n"),
    (r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|$)", "\n"),
    (r"sub-licen[cs]", "sublicens"),
    (r"licenc", "licens"),
    (r"non-commercial", "noncommercial"),
    (r"acknowledgement", "acknowledgment"),
    (r"copyright owner", "copyright holder"),
    (r"https://", "http://"),
    (r"merchantibility", "merchantability"),
    (r"whilst", "while"),
    (r"([aiy])s(e|ed|es|ing|ation)\b", "$1z$2"),
    (r"our(s|ed|able)?\b", "or$1"),
    (r"[^a-z0-9\x{c0}-\x{24f}\x{370}-\x{ffff}]+|[\x{2010}-\x{2027}]+", " "),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPOKEN = "[Ll][Ii][Cc][Ee][Nn][CcSs]"
GATE = SPOKEN + "|[Pp][Ee][Rr][Mm][Ii][Ss][Ss][Ii][Oo][Nn]|[Rr][Ee][Dd][Ii][Ss][Tt][Rr][Ii][Bb][Uu][Tt][Ii][Oo][Nn]|[Cc][Cc][^A-Za-z0-9]"

# Licence texts, without their copyright lines.
_MIT = """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD_HEAD = """BSD {n}-Clause License
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# SHA-256 of the canonical form of whole licences as the Debian system ships them, with their appendix and up to the end of the terms.
_WHOLE = [
    ("Apache-2.0", "38b4f9647e85da8492a80164379dfb4140e26fc86c1001fc24aff6164d8cb434"),  # all of it
    ("Apache-2.0", "3a8eaafbf1bd56a141366df75bb24d6db4ebce0d4bc60c0cc6228fa293768193"),  # the terms
    ("Artistic-1.0-Perl", "b35b3a55b33e50ea032c5cae7b428d53b2588c179f6cba5b23a3716a2d16a9e9"),  # all of it
    ("CC0-1.0", "9303391beca4f50b22fa1630aa4dde35a61a27d85fd3f7a1dbdaa90ecf2a99c5"),  # all of it
    ("GFDL-1.2-only", "0d4cb8e678e5cc3adfeac0c42f161148f2173880508b22c7a0c0b0e5a48ef854"),  # all of it
    ("GFDL-1.3-only", "3afd4ddc612c5d6abb6b2a5b5f6ed6ec50380adc6e531e08e66c009ec0543f5e"),  # all of it
    ("GPL-1.0-only", "e6b357d3e19321092bbc5c5eec7716aafe4c74d25e98bca18993ec5a059ca7be"),  # all of it
    ("GPL-1.0-only", "d5d5da8ab09fd76407a956bcbd899eb97e25cf60f0fb78d646d8ff5fea9800e8"),  # the terms
    ("GPL-2.0-only", "7242b68d22d0701341ad42a61b1a6e6b3159bb2eeb7dcb421ba11eca11c2f306"),  # all of it
    ("GPL-2.0-only", "7f9458729426472e65fe54dd6ed2abe0b52e0fcd22d0bd6301ee84f6de55daaa"),  # the terms
    ("GPL-3.0-only", "36c9e1c63a43213b79fba75db98f73bded24734c08eb90796e4d5017939290d7"),  # all of it
    ("GPL-3.0-only", "01ff1655f3b0da4cf9ecf80450594b00384ea0964a4f55a6495456315cb244c9"),  # the terms
    ("LGPL-2.0-only", "f2b46405d156c8415318fd57535b39480a815ce00171a9687674e792c3e8ed58"),  # all of it
    ("LGPL-2.0-only", "11220407548c05a77c143850d38ffeb7dfe2eddecacd803f08b9ddb3a906aa29"),  # the terms
    ("LGPL-2.1-only", "1ccdd5558b7faa521ebfe6d2ec6f4f57df021d22a8317e92c439b4da97c0dbc9"),  # all of it
    ("LGPL-2.1-only", "9b6298da8abf724a24c8ca9afabaad6896743a5f954c5c42adbbb6165d8db807"),  # the terms
    ("LGPL-3.0-only", "808f6ed393224ac45cdbee273016b327ee86fe236e6c558b07444fcaa7ccdacd"),  # all of it
    ("MPL-1.1", "e024c1cdd64a7abd2d0c6ef6d0178f85e2288adee9dc57b20e5cae0cdb57f57e"),  # all of it
    ("MPL-2.0", "2a967c8923849baf4c0e5bffee8fd140f8c13ee083e85e6e3b0a292f3416bffc"),  # all of it
]
_NAMES = {
    "MIT": ["MIT License", "MIT licence terms"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "Unlicense": ["Unlicense"],
}
_PHRASES = ["Licensed under the {}", "Licensed under {}", "Released under the {}", "This work is licensed under the {}", "This work is licensed under {}", "This software is licensed under the {}", "License: {}", "SPDX-License-Identifier: {id}"]


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of those that say licence, as the SQL has them: full texts with their heading, and one-line notices by rule."""
    full = [("MIT", _MIT), ("ISC", _ISC), ("Apache-2.0", _APACHE), ("BSD-2-Clause", _BSD_HEAD.format(n=2) + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD.format(n=3) + _BSD_THIRD + _BSD_TAIL)]
    out = dict.fromkeys(full)
    for spdx, names in _NAMES.items():
        for name in names:
            for phrase in _PHRASES:
                text = phrase.format(name, id=spdx)
                if "licen" in text.lower():
                    out[spdx, text] = None
    return list(out)


def further_texts() -> list[tuple[str, str]]:
    """(licence, text) beyond the SQL's: full texts without their heading, as usually shipped, and notices that don't say licence."""
    headed = [(spdx, text) for spdx, text in known_texts() if "\n" in text and spdx != "Apache-2.0"]
    bare = [(spdx, text.split("\n", 1)[1]) for spdx, text in headed]
    said = dict.fromkeys((spdx, phrase.format(name, id=spdx)) for spdx, names in _NAMES.items() for name in names for phrase in _PHRASES)
    return bare + [row for row in said if "licen" not in row[1].lower()]


def canonical(text: str | Column) -> Column:
    """The canonical form; null stays null."""
    c = F.translate(F.col(text) if isinstance(text, str) else text, UPPER, LOWER)
    for pattern, put in STEPS:
        c = F.regexp_replace(c, pattern, put)
    return F.trim(c)


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, licence) of the known texts; a fixed, small table."""
    known = spark.createDataFrame(known_texts() + further_texts(), "licence string, text string")
    made = known.select(F.sha2(canonical("text"), 256).alias("digest"), "licence")
    return made.unionByName(spark.createDataFrame(_WHOLE, "licence string, digest string")).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licence, n_notices, notices) for each row: the licence that is the whole text, and how many lines are notices and of which licences, sorted."""
    known = F.broadcast(known_digests(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    spoken = F.coalesce(F.col("text").rlike(GATE), F.lit(False))
    whole = rows.withColumn("digest", F.when(spoken, F.sha2(canonical("text"), 256))).join(known, "digest", "left").select("doc_id", "tie", "licence")
    lines = rows.where(spoken).select("doc_id", "tie", F.posexplode(F.split("text", "\n")).alias("line", "said")).where(F.col("said").rlike(GATE))
    hits = lines.withColumn("digest", F.sha2(canonical("said"), 256)).join(known, "digest").select("doc_id", "tie", "line", "licence")
    notices = hits.groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).agg(F.count_distinct("line").alias("n_notices"), F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"))
    return whole.join(notices, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")), "left").select("doc_id", "licence", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def oracle() -> str:
    """The same in DuckDB's SQL, over the table documents with one row for each doc_id."""
    def form(text: str) -> str:
        c = f"translate({text}, '{UPPER}', '{LOWER}')"
        for pattern, put in STEPS:
            c = f"regexp_replace({c}, '{pattern}', '{put.replace('$', chr(92)).replace(chr(10), chr(10))}', 'g')"
        return f"trim({c}, ' ')"

    known = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in known_texts())
    return f"""
        WITH known AS (SELECT sha256({form('text')}) AS digest, min(licence) AS licence FROM (VALUES {known}) AS k(licence, text) GROUP BY 1),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said FROM documents WHERE text IS NOT NULL),
        notices AS (
            SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
            FROM (SELECT doc_id, sha256({form('said')}) AS digest FROM lines WHERE regexp_matches(said, '{SPOKEN}')) JOIN known USING (digest) GROUP BY doc_id),
        whole AS (SELECT doc_id, sha256({form('text')}) AS digest FROM documents WHERE regexp_matches(text, '{SPOKEN}'))
        SELECT d.doc_id, k.licence, CAST(coalesce(n.n_notices, 0) AS BIGINT) AS n_notices, coalesce(n.notices, '') AS notices
        FROM documents d LEFT JOIN whole w USING (doc_id) LEFT JOIN known k USING (digest) LEFT JOIN notices n ON n.doc_id = d.doc_id"""
