"""Licence scans by canonical digests, in DataFrame functions only.

A text's canonical form has lower case, no copyright statements, single spaces in place of punctuation and white space,
and one spelling of words that are spelled in several ways, so that it doesn't depend on where lines are wrapped. Its
SHA-256 is joined with those of known licences, for the whole text and for each of its lines (licence notices). Whole
texts are known with their usual titles, too, and stay the same with or without "All rights reserved".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded

#: Equivalent spellings, as patterns over canonical words with a space on either side of the text.
SPELLINGS = (
    ("licenc", "licens"),
    (" sub licens", " sublicens"),
    ("organis", "organiz"),
    ("favour", "favor"),
    ("merchantib", "merchantab"),
    (" non infring", " noninfring"),
    (" copyright owner", " copyright holder"),
    (" version ([0-9]+) 0 ", " version $1 "),
    (" http ", " https "),
)
#: A copyright statement: its mark, then all up to the end of the sentence or line (initials and a last name or two don't
#: end it), and what is reserved.
_HOLDER = r"([^.]|\.\S|\.\s[a-z]\.)*(\.\s[\p{L}\-]+(\s[\p{L}\-]+)?\.?$|\.)?(\s*all rights reserved\.?)?"
COPYRIGHT = rf"(copyright|copr\.)[\s:]*(\(c\)|©|by\s|[0-9]{{4}}){_HOLDER}|(\(c\)|©)\s*[0-9]{{4}}{_HOLDER}"
NOT_WORD = r"[^\p{L}\p{N}]+"
RESERVED = " all rights reserved "

# Notices and texts of well-known licences.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("proprietary", "All rights reserved."),
)
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _WARRANTY),
    ("BSD-2-Clause", f"{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_END}"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
)


TITLES = (
    ("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", "MIT License (MIT)"),
    ("ISC", "ISC License"), ("ISC", "The ISC License"), ("ISC", "ISC License (ISC)"),
    ("0BSD", "BSD Zero Clause License"), ("0BSD", "Zero-Clause BSD"), ("0BSD", "BSD Zero Clause License (0BSD)"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "The BSD 2-Clause License"), ("BSD-2-Clause", "The 2-Clause BSD License"), ("BSD-2-Clause", 'BSD 2-Clause "Simplified" License'),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "The BSD 3-Clause License"), ("BSD-3-Clause", "The 3-Clause BSD License"), ("BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License'), ("BSD-3-Clause", "New BSD License"),
    ("Zlib", "zlib License"), ("Zlib", "The zlib License"), ("Zlib", "The zlib/libpng License"),
)
# SHA-256 of the canonical forms of the published texts of longer licences; where they close with an
# appendix on how to apply them, without it, too.
DIGESTS = (
    ("Apache-2.0", "337aee8aba879d475290ad185e43647b60b046ead00fa763cad169870c3d867c"),
    ("Apache-2.0", "2085e42348507256aee3446873d5bfb774067d1d568904f2f32a3b17fd5e3d17"),
    ("Apache-2.0", "af568c7aa0507af9bde105737e2f94c3daaa50dea825ab5c1c90b1c063c0d366"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "e80b630fa4f92f7da9cffbd75699f62bfac51ce5b33da44e74b5acc53e5187f6"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "ada43b21b16dd64b4b8f1d9c2ab43ff16f75a8f0f835fc2f37a0c7e65f28d243"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "a6a3c847015e8505b1d152c1bcdf4b64e2b7d5c41edd6775fe18475b27ae8387"),
    ("GPL-3.0", "5f9a16d8d81dfc9674a4e4f9408fb8caac3d60626eaf090bb0c40c0f9cd0eb14"),
    ("GPL-3.0", "caf91755cf33283be25f1e05efbd2839d225ef7def53695a510aed6dfdd1550c"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "63f16a6808ef8dfa21c2ea61b3f84e9b02208b9032233b9104d82a29a42afdb6"),
    ("MPL-1.1", "efd1698a29a8fd2900c263ae8b3e2b7d1bfadda6212b956a536738d269759ef0"),
    ("MPL-2.0", "dc5278fbd20b39f80b1a20daf322b30a8cb6f835444e214939160b1d530d2d96"),
)


def _words(text: Column) -> Column:
    """Canonical words of a text without copyright statements, with a space on either side."""
    out = F.concat(F.lit(" "), F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), NOT_WORD, " "), F.lit(" "))
    out = F.regexp_replace(out, " +", " ")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return out


def _lines(text: Column) -> Column:
    """Lower-case lines without copyright statements."""
    return F.transform(F.split(F.lower(text), "\n", -1), lambda x: F.regexp_replace(x, COPYRIGHT, " "))


def _whole(lines: Column) -> Column:
    words = _words(F.array_join(lines, " "))
    return F.trim(F.when(words == RESERVED, words).otherwise(F.replace(words, F.lit(RESERVED), F.lit(" "))))


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = (), digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(digest, license) of known licences: the texts of this module, ``texts`` besides them, and ``digests``.

    Of texts with one canonical form the least licence name stays.
    """
    rows = spark.createDataFrame([*_texts(), *texts], "license string, text string")
    rows = rows.select(F.sha2(_whole(_lines(F.col("text"))), 256).alias("digest"), "license").union(spark.createDataFrame(list(digests), "license string, digest string").select("digest", "license"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def _texts() -> list[tuple[str, str]]:
    return [*TEXTS, *NOTICES, *((name, f"{title}\n{dict(TEXTS)[name]}") for name, title in TITLES)]


def scanned(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id_col, digest of the whole text, its licence (null if unknown) and the licences that its lines name.

    ``notices`` is sorted, without repeats, and empty if there are none. A text without words (null ones too) has the
    digest of the empty text and no licence. Repeated rows each have a row; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), _lines(F.coalesce(text_col, F.lit(""))).alias("lines"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), _whole(F.col("lines")).alias("form")))
    forms = F.array_distinct(F.filter(F.transform("lines", lambda x: F.trim(_words(x))), lambda x: x != ""))
    each = F.transform(forms, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("form")))
    parts = rows.select("id", "row", F.explode(F.concat(whole, each)).alias("part")).select("id", "row", "part.whole", F.sha2("part.form", 256).alias("digest"))
    found = parts.join(bounded(licences, licences.count()), "digest", "left").where("whole or license is not null")
    is_whole = F.col("whole")
    out = found.groupBy("id", "row").agg(
        F.max(F.when(is_whole, F.col("digest"))).alias("digest"),
        F.max(F.when(is_whole, F.col("license"))).alias("license"),
        F.array_join(F.sort_array(F.collect_set(F.when(~is_whole, F.col("license")))), ",").alias("notices"),
    )
    return out.drop("row").withColumnRenamed("id", id_col)


def oracle() -> str:
    """The same over documents in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lines = f"list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda x: regexp_replace(x, {quote(COPYRIGHT)}, ' ', 'g'))"

    def words(x: str) -> str:
        out = f"regexp_replace(concat(' ', regexp_replace(replace({x}, '&', ' and '), {quote(NOT_WORD)}, ' ', 'g'), ' '), ' +', ' ', 'g')"
        for pattern, to in SPELLINGS:
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(to.replace('$1', chr(92) + '1'))}, 'g')"
        return out

    whole = f"sha256(trim(CASE WHEN w = '{RESERVED}' THEN w ELSE replace(w, '{RESERVED}', ' ') END))"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in _texts())
    digests = ", ".join(f"({quote(name)}, {quote(digest)})" for name, digest in DIGESTS)
    return f"""WITH k AS (SELECT digest, min(license) AS license FROM (
  SELECT {whole} AS digest, license FROM (SELECT license, {words(f"array_to_string({lines}, ' ')")} AS w FROM (VALUES {values}) v(license, text))
  UNION ALL SELECT digest, license FROM (VALUES {digests}) v(license, digest)) GROUP BY 1),
d AS (SELECT doc_id, {lines} AS lines FROM documents),
w AS (SELECT doc_id, {whole} AS digest FROM (SELECT doc_id, {words("array_to_string(lines, ' ')")} AS w FROM d)),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, sha256(trim({words("x")})) AS digest FROM (SELECT doc_id, unnest(lines) AS x FROM d)) JOIN k USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license, coalesce(n.notices, '') AS notices FROM w LEFT JOIN k USING (digest) LEFT JOIN n ON n.doc_id = w.doc_id"""
