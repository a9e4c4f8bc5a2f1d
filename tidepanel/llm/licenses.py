"""Operator 2: licence scan by canonical digest.

A text is brought to one form: letters in lower case, copyright lines gone, punctuation and
spaces one space, equivalent spellings one word.  The digest of the whole form is looked up
among the digests of known licence texts, by a hash join.  The same is done for each line,
or each stretch between blank lines, where licences stand as notices of their own.  One pass
cleans a text for all units.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, each to the first.
SPELLINGS = {
    "license": ("licence",),
    "sublicense": ("sub license",),
    "copyright holder": ("copyright owner",),
    "noncommercial": ("non commercial",),
    "noninfringement": ("non infringement",),
    "organization": ("organisation",),
    "acknowledgment": ("acknowledgement",),
    "merchantability": ("merchantibility",),
}

#: Lines that go: a copyright sign or word with a year, a sign or a colon beside it; reserved rights.
COPYRIGHT = (
    r"(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©|:)|copyright[^\n]*(\(c\)|©|[0-9]{4}|yyyy)"
    r"|(\(c\)|©)[^\n]*([0-9]{4}|yyyy)|all rights reserved)[^\n]*"
)
#: A text without any of these has no such line.
COPYRIGHT_HINTS = ("copyright", "(c)", "©", "all rights reserved")
#: All but a-z, 0-9 and the line end; the ranges spelled out run ten times faster than their negation.
MARKS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x{10ffff}]+"
#: Known tables of at most so many digests are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000

BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

# The titles that full texts are found under, besides none.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "Unlicense": ("The Unlicense",),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "Zlib": ("zlib License", "The zlib/libpng License"),
}

# Known texts by SPDX name.  Several texts may have one name.
KNOWN = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "BSD-2-Clause": (BSD_HEAD + " " + BSD_TAIL,),
    "BSD-3-Clause": (BSD_HEAD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_TAIL,),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
}
KNOWN |= {name: (*KNOWN[name], *(f"{title} {KNOWN[name][0]}" for title in titles)) for name, titles in TITLES.items()}

# SHA-256 of the canonical forms of long texts, as their publishers word them (Apache-2.0 with and
# without its appendix).  ``digest`` of such a text gives the value; a user's own texts go into a table ``known``.
DIGESTS = {
    "Apache-2.0": (
        "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
        "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",
        "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f",
    ),
    "CC0-1.0": ("cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",),
    "Artistic-1.0-Perl": ("e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",),
    "GFDL-1.2": ("1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f",),
    "GFDL-1.3": ("7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7",),
    "GPL-1.0": ("8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",),
    "GPL-2.0": ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",),
    "GPL-3.0": ("a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",),
    "LGPL-2.0": ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",),
    "LGPL-2.1": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",),
    "MPL-2.0": ("6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",),
}


def _any(x: Column, words: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words))


def _spelled(x: Column, phrases_only: bool = False) -> Column:
    """Equal spellings made one; texts without any are told by searches, which cost less than replacements."""
    pairs = [(other, to) for to, spellings in SPELLINGS.items() for other in spellings if " " in other or not phrases_only]
    made = reduce(lambda y, pair: F.replace(y, F.lit(pair[0]), F.lit(pair[1])), pairs, x)
    return F.when(_any(x, [other for other, _ in pairs]), made).otherwise(x)


def _plain(low: Column) -> Column:
    """Lower-case text without copyright lines and marks, its line ends kept."""
    x = F.when(_any(low, COPYRIGHT_HINTS), F.regexp_replace(low, COPYRIGHT, "$1")).otherwise(low)
    return F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), MARKS, " ")


def _trimmed(clean: Column) -> Column:
    return F.transform(F.split(clean, "\n"), lambda x: F.trim(x))


def one_line(clean: Column) -> Column:
    """The one form of cleaned lines; spellings that go over a line end meet here."""
    lines = F.filter(_trimmed(clean), lambda x: x != "")
    return _spelled(F.array_join(lines, " "), phrases_only=True)


def canonical(text: Column) -> Column:
    """The one form of a text; null gives null."""
    return one_line(_spelled(_plain(F.lower(text))))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: dict[str, tuple[str, ...]] = KNOWN, digests: dict[str, tuple[str, ...]] = DIGESTS) -> DataFrame:
    """``license, digest`` of known texts and digests (small: as many rows as those)."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    made = spark.createDataFrame(rows, "license string, text string").select("license", digest(F.col("text")).alias("digest"))
    given = [(name, x) for name, values in digests.items() for x in values]
    return made.union(spark.createDataFrame(given, "license string, digest string")).distinct()


UNITS = ("text", "line", "block")


def _units(clean: Column, kinds: tuple[str, ...]) -> Column:
    """``kind, unit, c`` of each unit of a cleaned text."""
    numbered = lambda kind, parts: F.transform(parts, lambda c, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("unit"), c.alias("c")))
    made = []
    if "text" in kinds:
        made.append(F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("unit"), one_line(clean).alias("c"))))
    if "line" in kinds:
        made.append(numbered("line", _trimmed(clean)))
    if "block" in kinds:
        made.append(numbered("block", F.transform(F.split(clean, "\n ?\n"), one_line)))
    return F.filter(F.concat(*made), lambda u: u["c"] != "")


def license_scan(docs: DataFrame, known: DataFrame | None = None, kinds: tuple[str, ...] = ("text",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches: ``doc_id, kind, unit, license``.

    ``kinds`` are the units looked up: the text as a whole (unit 0), each line, each block between lines
    without letters and digits; lines and blocks are numbered from 1.  Every unit of every text is looked up entirely.
    A digest under several names gives a row for each.  Null and empty texts or units match nothing; repeated rows
    match each; extra columns are ignored; an empty table of texts or of known digests gives an empty one.
    ``known(license, digest)`` is broadcast while it has at most BROADCAST_ROWS rows, beyond that both sides are shuffled.
    """
    small = known is None or known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = known_digests(docs.sparkSession) if known is None else known.select("license", "digest").distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("x"))
    for step in (_plain, _spelled):  # a projection each, as every step uses the one before many times
        rows = rows.select("doc_id", step(F.col("x")).alias("x"))
    rows = rows.select("doc_id", F.explode(_units(F.col("x"), kinds)).alias("u"))
    found = rows.select("doc_id", "u.kind", "u.unit", F.sha2("u.c", 256).alias("digest"))
    return found.join(F.broadcast(known) if small else known, "digest").select("doc_id", "kind", "unit", "license")
