"""Licence scan by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright and title
lines, and spellings that the licences' publishers hold equivalent), and the digest of
the whole form is joined to those of known licences. Each line is looked up
as a text of its own, too, for one-line notices.

DataFrame functions only. Add licences as more rows of :func:`known_licences`'
form; see ``extra`` in :func:`scan_licences`.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linededup import let

# --- Fixed values: public licence texts and usual notices, in plain words ---
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: Long texts, each in a file of its own, and where the terms of some end; what follows there is how to apply them.
FILES = (
    ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"),
    ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD-3-Clause", "BSD"),
)
TERMS_END = "END OF TERMS AND CONDITIONS"


def long_texts() -> list[tuple[str, str]]:
    """Names and texts of ``FILES``; terms alone, with and without the line that ends them, are texts as well."""
    out = []
    for name, file in FILES:
        text = (files(__package__) / "licence_texts" / f"{file}.txt").read_text(encoding="utf-8")
        terms, end, _ = text.partition(TERMS_END)
        out += [(name, text)] + ([(name, terms + end), (name, terms)] if end else [])
    return out


LICENCES = (
    ("MIT", MIT), ("ISC", ISC), ("0BSD", ZERO_BSD), ("BSD-2-Clause", BSD_2), ("BSD-3-Clause", BSD_3), ("Zlib", ZLIB),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    *long_texts(),
)
#: Spellings held equivalent, after lower-casing: pattern, replacement.
SPELLINGS = (("licence", "license"), ("acknowledgement", "acknowledgment"), ("non-infringement", "noninfringement"), ("https://", "http://"), ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"), ("per cent", "percent"))
# --- end of the fixed values ---

#: Titles above licence texts, in lower case.
TITLES = (
    "(?:mit|expat|x11|mit/x11|isc)(?: licen[cs]e)?(?: \\((?:mit|expat|x11|isc)\\))?",
    "(?:zlib|zlib/libpng|libpng/zlib)(?: licen[cs]e)?(?: \\(zlib\\))?",
    "(?:bsd zero[- ]clause|zero[- ]clause bsd|0bsd|bsd[- ]0[- ]clause|0[- ]clause bsd)(?: licen[cs]e)?(?: \\(0bsd\\))?",
    "[\"'(]*(?:(?:new|modified|revised|simplified|freebsd|two|three|[23])[\"')]*[- ]+)?(?:clause[- ]+)?bsd(?:[- ]+(?:two|three|[23])[- ]clause)?(?: [\"'(]+(?:new|modified|revised|simplified|freebsd|or)(?:[\"' ]|or|new|revised|modified)*[\"')]+)?(?: licen[cs]e)?(?: \\([^()]*\\))?",
)
#: A line, in lower case, that is no part of the terms: who holds the copyright, that rights are reserved, or a title.
COPYRIGHT_LINE = (
    "^[^\\p{L}\\p{N}(©]*(?:(?:portions\\s+)?copyright[\\s:,]+(?:\\(c\\)|©|&copy;|[0-9]|[\\[<{]|.*\\b(?:19|20)[0-9]{2}\\b)|(?:portions\\s+)?copyright©|spdx-filecopyrighttext:|(?:\\(c\\)|©)\\s*(?:copyright|[0-9])"
    "|all rights reserved\\.?[^\\p{L}\\p{N}]*$|(?:the )?(?:" + "|".join(TITLES) + ")[^\\p{L}\\p{N}]*$)"
)


#: What numbers or letters an item of a list, at the start of its line; bullets are no letters and go anyway.
MARKER = "^[^\\p{L}\\p{N}]*(?:[0-9]{1,2}|[ivx]{1,4}|[a-z])[.)]\\s+"
#: The line before an item: without a letter or digit, or ended by a mark or a conjunction. So the end of a wrapped sentence (of section 2.) is no marker.
BEFORE = "(?:^|[.:;]|(?:^|[^\\p{L}])(?:and|or))[^\\p{L}\\p{N}]*$"


def canonical_line(line: Column) -> Column:
    """Lower case, equivalent spellings; anything but letters and digits becomes one space. Empty for a copyright or title line."""

    def spelled(low: Column) -> Column:
        out = low
        for a, b in SPELLINGS:
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(low.rlike(COPYRIGHT_LINE), "").otherwise(F.btrim(F.regexp_replace(out, "[^\\p{L}\\p{N}]+", " ")))

    return let(F.lower(line), spelled)


def canonical_lines(text: Column) -> Column:
    """The canonical forms of the lines of a text, without what numbers items and without empty ones; joined by spaces they are that of the text."""

    def formed(lines: Column) -> Column:
        def item(line: Column, i: Column) -> Column:
            low = F.lower(line)
            first = low.rlike(MARKER) & ((i == 0) | F.lower(F.get(lines, i - 1)).rlike(BEFORE))
            return canonical_line(F.when(first, F.regexp_replace(low, MARKER, "")).otherwise(line))

        return F.transform(lines, item)

    return F.filter(let(F.split(F.coalesce(text, F.lit("")), "\n", -1), formed), lambda x: x != "")


def whole_digest(lines: Column) -> Column:
    """MD5 of the canonical form of a text; null where it is empty."""
    return F.when(F.size(lines) > 0, F.md5(F.array_join(lines, " ").cast("binary")))


def known_licences(spark: SparkSession, extra: tuple = ()) -> DataFrame:
    """``licence_id`` and ``licence_digest``; the first of several names of one digest in the order of names."""
    rows = spark.createDataFrame([*LICENCES, *extra], "licence_id string, text string")
    return rows.select("licence_id", whole_digest(canonical_lines(F.col("text"))).alias("licence_digest")).groupBy("licence_digest").agg(F.min("licence_id").alias("licence_id"))


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple = ()) -> DataFrame:
    """One row for each document: the key, text_digest, licence_id and line_licences.

    ``licence_id`` names the licence that the entire text is, else null;
    ``line_licences`` lists, sorted and joined by commas, those that entire
    lines are (empty if none). Null and empty texts, and those of punctuation,
    copyright lines and titles only, have a null digest. Rows of equal key are rows of their own; other columns are
    ignored; an empty table gives an empty table. The known digests are a
    fixed list, so they are broadcast; texts aren't shuffled.
    """
    known = known_licences(docs.sparkSession, extra)
    rows = docs.select(F.col(key).alias("_key"), canonical_lines(F.col(text)).alias("_lines"))
    rows = rows.select("_key", whole_digest(F.col("_lines")).alias("text_digest"), F.transform("_lines", lambda x: F.md5(x.cast("binary"))).alias("_digests"))
    listed = F.broadcast(known.agg(F.collect_list("licence_digest").alias("_known"), F.collect_list("licence_id").alias("_names")))  # one row of fixed size
    rows = rows.crossJoin(listed)
    found = F.array_sort(F.array_distinct(F.transform(F.array_intersect("_digests", "_known"), lambda d: F.get("_names", F.array_position("_known", d).cast("int") - 1))))
    whole = F.broadcast(known)
    return rows.join(whole, F.col("text_digest") == F.col("licence_digest"), "left").select(F.col("_key").alias(key), "text_digest", "licence_id", F.array_join(found, ",").alias("line_licences"))
