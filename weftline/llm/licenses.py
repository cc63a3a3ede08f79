"""Licence scans by canonical digests, by built-in functions only.

A text is made canonical: A-Z lowered, copyright lines dropped, punctuation and
white space to single spaces, equivalent spellings to one. The MD5 of the whole
canonical text is looked up among the digests of known licences, and that of
each of its lines among those of known notices.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pairs of equivalent spellings, as parts of words, on canonical text.
SPELLINGS = [
    ("licenc", "licens"), ("sub licens", "sublicens"), ("organis", "organiz"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("realis", "realiz"), ("initialis", "initializ"),
    ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"), ("labour", "labor"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("programme", "program"), ("copyright owner", "copyright holder"),
    ("non infring", "noninfring"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("whilst", "while"), ("https", "http"),
]
# Whole texts of short public licences, without their copyright lines.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
}
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("BSD 2-Clause", "BSD 3-Clause").replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
)
# Digests of the canonical texts of longer public licences.
DIGESTS = {
    "Apache-2.0": "11126b2fe3260ba89f3cc1853190e911",
    "GPL-1.0": "5a1f95d7ed8778ac3dd2424a133f539c",
    "GPL-2.0": "bc956f44d1c84837504c207f245fa68b",
    "GPL-3.0": "973bd6aa012124b0398a2ebfb853eea4",
    "LGPL-2.0": "6885b1a1b528de907e6c89bd80a1ea4f",
    "LGPL-2.1": "79aa7998cfa6069eae71d7bea9b32641",
    "LGPL-3.0": "b31b7335bc37919e8cdd79154e04d88d",
    "MPL-1.1": "078227c099e8c4e4b330b65d75e8c99e",
    "MPL-2.0": "0e97aa3fde78079502ca22eb7780393e",
    "CC0-1.0": "93a180096f6cfcf2c0dd24f75c2eec48",
    "GFDL-1.2": "8f625fa772c7639bde126ed5179e5c01",
    "GFDL-1.3": "a323536f60c497c29d1e7e67b38b1faf",
    "Artistic-1.0": "01297679267ad921516667ccd889865e",
}
# One-line notices by which a text says under what it stands.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC0 1.0.": "CC0-1.0",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "Licensed under the Mozilla Public License, version 2.0.": "MPL-2.0",
    "All rights reserved.": "all-rights-reserved",
}
_COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright|©|\(c\))[^a-z0-9\n]*(\(c\)[^a-z0-9\n]*)?([0-9]{4}|<year>|yyyy|by )[^\n]*"
# Copyright lines without a year too, and the lines after them that reserve all rights. What goes on like a licence's sentence is none.
_SENTENCE = r"[^a-z0-9\n]*(notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interests?|infringements?|disclaimers?|claims?|acts?|treat(y|ies)|protection|status|permission|and|or|in|is|are|on|to|for|of|as|by law)(?![a-z0-9])"
_HEADER = rf"(^|\n)[^a-z0-9\n]*((portions[ \t]+)?(copyright(?![a-z])|©)(?!{_SENTENCE})|\(c\)[^a-z0-9\n]*([0-9]{{4}}|<year>|yyyy|by ))[^\n]*(\n[^a-z0-9]*all rights reserved[^a-z0-9\n]*(?=\n|$))*"
_PUNCTUATION = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F‘’“”«»–—…© ]+"


def canonical(text: Column, dropped: str = _COPYRIGHT) -> Column:
    """The canonical form without the lines ``dropped``, lines still apart."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(F.regexp_replace(out, dropped, "\n"), _PUNCTUATION, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _whole(canon: Column) -> Column:
    return F.trim(F.regexp_replace(canon, "[ \\n]+", " "))


def canonical_text(text: str) -> str:
    """The same in Python, for the table of known digests."""
    out = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    out = re.sub(_PUNCTUATION, " ", re.sub(_COPYRIGHT, "\n", out))
    for old, new in SPELLINGS:
        out = out.replace(old, new)
    return re.sub("[ \n]+", " ", out).strip(" ")


def _digest(text: str) -> str:
    return hashlib.md5(canonical_text(text).encode()).hexdigest()


def known_licenses(extra: dict[str, str] | None = None) -> dict[str, str]:
    """Digest -> licence of whole texts; ``extra``: further licence -> text."""
    out = {d: k for k, d in DIGESTS.items()}
    for k, t in (TEXTS | (extra or {})).items():
        out[_digest(t)] = k
        title, _, body = t.partition("\n\n")
        if body and len(title) < 60:  # the text without its title line
            out[_digest(body)] = k
    return out


def known_notices() -> dict[str, str]:
    return {_digest(t): k for t, k in NOTICES.items()}


def _table(spark: SparkSession, known: dict[str, str], key: str, value: str) -> DataFrame:
    return spark.createDataFrame(sorted(known.items()), f"{key} string, {value} string")


def license_scan(docs: DataFrame, extra: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, canonical_digest, license_id, n_notices, notice_licenses) per row.

    license_id: the known licence that the whole text is, or null. If the text is
    none as it is, copyright lines without a year and lines after copyright lines
    that reserve all rights are left out too; canonical_digest is that of the
    form that is known. n_notices:
    lines that are a known notice; notice_licenses: their licences, distinct,
    sorted, joined by commas, '' if none. A null or empty text has the digest of
    the empty text and no licence. Repeated rows each give a row, null ids stay
    null, other columns are not read, an empty table gives an empty result.

    Both tables of digests are constants of this module (and ``extra``), so
    they are broadcast. A line can be a notice only if it is no longer than the
    longest canonical notice, so only such lines are digested.
    """
    spark = docs.sparkSession
    licenses, notices = known_licenses(extra), known_notices()
    longest = max(len(canonical_text(t)) for t in NOTICES)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = text.rlike("(?i)copyright") | text.contains("©") | text.contains("(c)") | text.contains("(C)")
    bare = F.when(marked, F.md5(_whole(canonical(text, _HEADER))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical(text).alias("canon"), bare.alias("bare"))
    lines = F.filter(F.transform(F.split("canon", "\n"), lambda x: F.trim(x)), lambda x: (F.char_length(x) > 0) & (F.char_length(x) <= longest))
    digest = F.md5(_whole(F.col("canon")))
    digest = F.when(F.col("bare").isin(*licenses) & ~digest.isin(*licenses), F.col("bare")).otherwise(digest)
    rows = rows.select("doc_id", digest.alias("canonical_digest"), F.transform(lines, lambda x: F.md5(x)).alias("digests"))
    rows = rows.join(F.broadcast(_table(spark, licenses, "canonical_digest", "license_id")), "canonical_digest", "left")
    names = F.create_map(*(F.lit(x) for pair in sorted(notices.items()) for x in pair))
    hits = F.array_compact(F.transform(F.filter("digests", lambda d: d.isin(*notices)), lambda d: names[d]))
    rows = rows.withColumn("hits", hits)
    return rows.select("doc_id", "canonical_digest", "license_id", F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notice_licenses"))
