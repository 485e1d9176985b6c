"""License scans: digests of canonical texts, joined to digests of known licences.

A text is canonical after: lower case; lines of copyright notices removed; typographic quotes and
dashes to plain ones and equivalent spellings to one of them (licence/license, and so on); everything
but letters and digits to one space; ends trimmed. The SHA-256 of the whole canonical text is the key of
a hash join with the digests of the known licences, whose texts pass through the same expressions.

Defined cases: a null text has a null digest and no licence; a text with nothing left (empty, blank,
or copyright lines only) has the digest of the empty text and no licence; repeated rows each get a row; a
known text listed twice gives its first identifier; other columns are not read. Known licences are a
list in the program, hence bounded, and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Equivalent spellings, each replaced by the second.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"),
    ("organisation", "organization"), ("authoris", "authoriz"), ("modificatons", "modifications"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("fulfil ", "fulfill "), ("whilst", "while"), ("https://", "http://"), ("merchantibility", "merchantability"),
)

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: (identifier, text): published licence texts and notices; placeholders of names stand in copyright lines.
KNOWN = (
    ("MIT", f"""MIT License

Copyright (c) <year> <holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_WARRANTY}"""),
    ("ISC", f"ISC License\n\nCopyright (c) <year> <holders>\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"Copyright (c) <year> <holders>\n\n{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"Copyright (c) <year> <holders>\n\n{_BSD_GRANT}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"""Copyright (c) <year> <holders>

{_BSD_GRANT}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.

{_BSD_WARRANTY}"""),
    ("Zlib", """Copyright (c) <year> <holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0-notice", """Copyright <year> <holders>

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("MIT-line", "Released under the MIT License."),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    low = F.translate(F.lower(text), "‘’“”–—\r", "''\"\"--\n")
    signs = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))
    body = F.when(signs, F.regexp_replace(low, COPYRIGHT_LINE, "")).otherwise(low)
    for old, new in SPELLINGS:
        body = F.replace(body, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(body, NOT_WORD, " "))


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(doc_id, digest, license_id) of each row of ``docs``; license_id is null for unknown texts."""
    listed = docs.sparkSession.createDataFrame([(i, name, text) for i, (name, text) in enumerate(known)], "i int, license_id string, text string")
    digests = (
        listed.select("i", "license_id", canonical(F.col("text")).alias("body")).filter("body <> ''")
        .groupBy(F.sha2("body", 256).alias("digest")).agg(F.min_by("license_id", "i").alias("license_id"))
    )
    return docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(F.broadcast(digests), "digest", "left").select(
        "doc_id", "digest", "license_id"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    def body(text: str) -> str:
        x = f"translate(lower({text}), '‘’“”–—' || chr(13), '''''\"\"--' || chr(10))"
        x = f"regexp_replace({x}, '{COPYRIGHT_LINE}', '', 'g')"
        for old, new in SPELLINGS:
            x = f"replace({x}, '{old}', '{new}')"
        return f"trim(regexp_replace({x}, '{NOT_WORD}', ' ', 'g'))"

    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(KNOWN))
    return f"""
WITH k AS (SELECT sha256({body("t")}) AS digest, arg_min(name, i) AS license_id FROM (VALUES {rows}) v(i, name, t) GROUP BY 1),
d AS (SELECT doc_id, sha256({body("text")}) AS digest FROM documents)
SELECT d.doc_id, d.digest, k.license_id FROM d LEFT JOIN k ON d.digest = k.digest
"""


ORACLE = _oracle()
