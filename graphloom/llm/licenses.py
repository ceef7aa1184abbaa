"""Licence scan by canonical digest, in DataFrame operations only.

A text is brought to canonical form: A-Z lower-cased, copyright lines and "all
rights reserved" left out, equivalent spellings made equal, list marks and
punctuation dropped, white space joined.  The SHA-256 of the whole canonical
text is then looked up among the digests of known licences by an equi-join on
the digest.  Known texts are canonicalised by the same expressions.

Null text is an empty text, whose canonical form is empty and matches nothing;
rows are matched one by one, so repeated rows each get their result; an empty
table gives no rows; extra columns are ignored.  Several known names for one
digest give the first by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spellings that count as equal (the first is rewritten to the second), as whole words.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("centre", "center"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), 
    ("modelling", "modeling"), ("noninfringement", "non infringement"), ("organisation", "organization"), ("organisations", "organizations"),
    ("owner", "holder"), ("owners", "holders"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NOTICES = ", provided that the above copyright notice and this permission notice appear in all copies."
#: Short lines by which a work states its licence.
_LINES = [
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-line", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT-line", "This work is licensed under the MIT License."),
    ("Apache-2.0-line", "This work is licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]
#: Public licence texts by name: the driver's only table, a fixed size.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("ISC", _GRANT + _NOTICES + "\n" + _AS_IS), ("ISC", "ISC License\n" + _GRANT + _NOTICES + "\n" + _AS_IS), ("0BSD", _GRANT + ".\n" + _AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_3 + _BSD_END),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB), ("Unlicense", _UNLICENSE), ("Apache-2.0-notice", _APACHE_NOTICE), ("GPL-3.0-notice", _GPL3_NOTICE), *_LINES,
]
#: Digests of the canonical form of full licence texts too long to be kept here, as common Linux distributions ship them.
DIGESTS = [
    ("Apache-2.0", "891ad20525c3a554dbb65f7eb384309a037aa98e2781df4382d37fe88dc6649e"),
    ("Artistic-1.0-Perl", "0ce87c1a2f9de8bd07685d372028374149e71fffb4eab93598a4cdc00ed86780"),
    ("BSD-3-Clause", "9c1c378ce1582c9d25bc92becd747b6da87ac08b3c361d95767aea7fe7e34905"),
    ("CC0-1.0", "fafce6fc44c0b5fb558759a634ac05dd1bd01738d447fafab429e615ba9ab314"),
    ("GFDL-1.2", "df9bdcc01c31ba20a61601f24885116a984c60ca77f8d85540578c462c7494c4"),
    ("GFDL-1.3", "328a22db4a7c832f61a545235737f809247d30348a04e32738e655d8fc690cc0"),
    ("GPL-1.0", "8006d6938e45108c7c95d49b6d84aa0a345eedc8566395dd2bc121b8e6ba4ae9"),
    ("GPL-2.0", "5ca608bb2eb79eb10b1a80b55bb0a99df497ce228143b9d233b5df274e85643a"),
    ("GPL-3.0", "574558f81ddacaf4aaa6dc5f7c3c6e0ce6c10c21a8b943ec8a6315fda3f388c1"),
    ("LGPL-2.0", "ec44c766883b869bef6a328cf51aafbe256ee10744ba67af3472eda9d0446def"),
    ("LGPL-2.1", "5ef8b7ba71d31fa31954beed6b9d500255758be9aaae1903502fe0f4c080e8d9"),
    ("LGPL-3.0", "828c3944cde1fc14c68737c9be14d8d0f4f13ab980f8a72364a0e64f72965525"),
    ("MPL-1.1", "2f106f77ca079c28bc8d7cd424e925bdf4dffac85431d5daada97d4ce783fd9b"),
    ("MPL-2.0", "7e20688289808cf47ec16a442bbbc044a092b494f6ce8d1d5b5a4eb933c9cb91"),
]
#: Steps in order: pattern and replacement, in a common subset of Java's and RE2's syntax (lines are separated by \n).
STEPS = [
    (r"[\r\x0B\x0C]", "\n"),
    (r"(^|\n)[^a-z0-9\n]*(copyright|copr|\(c\)|©)[ \t]*(\(c\)|©)?[ \t,:]*[0-9<\[{][^\n]*", "\n"),
    (r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|$)", "\n"),
    (r"(^|\n)[ \t]*([0-9]{1,2}[.)]|\([0-9a-z]\)|[*#/;-]+)[ \t]", "\n"),
    (r"https?://", " "),
    (r"[^a-z0-9\x80-\x{10FFFF}]+", " "),
]


def canonical(text: Column) -> Column:
    """Canonical form of a text."""
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    out = F.concat(F.lit(" "), F.replace(F.trim(out), F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest, license_id`` of the given texts; without any, of ``KNOWN`` and ``DIGESTS``."""
    rows = spark.createDataFrame(known if known is not None else KNOWN, "license_id string, text string")
    rows = rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id")
    if known is None:
        rows = rows.unionByName(spark.createDataFrame(DIGESTS, "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, canonical_chars, digest, license_id`` (null: not a known licence) per row of ``docs``."""
    known = known if known is not None else F.broadcast(known_digests(docs.sparkSession))  # a fixed number of rows
    rows = docs.select("doc_id", canonical(F.col("text")).alias("c"))
    rows = rows.select("doc_id", F.length("c").cast("long").alias("canonical_chars"), F.sha2("c", 256).alias("digest"))
    return rows.join(known, "digest", "left").select("doc_id", "canonical_chars", "digest", "license_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents`` against the known digests."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(c: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}')"
    for pattern, to in STEPS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {'chr(10)' if to == chr(10) else quoted(to)}, 'g')"
    out = f"' ' || replace(trim({out}), ' ', '  ') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def oracle() -> str:
    """SQL for :func:`op8_licenses`."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    digests = ", ".join(f"('{n}', '{d}')" for n, d in DIGESTS)
    return f"""
WITH k AS (SELECT digest, min(n) AS license_id FROM (SELECT n, sha256({_sql_canonical("t")}) AS digest FROM (VALUES {values}) v(n, t) UNION ALL FROM (VALUES {digests}) w(n, digest)) GROUP BY digest),
d AS (SELECT doc_id, {_sql_canonical("text")} AS c FROM documents)
SELECT doc_id, CAST(length(c) AS BIGINT) AS canonical_chars, sha256(c) AS digest, license_id
FROM d LEFT JOIN k ON k.digest = sha256(d.c)
"""
