"""Licence scans: whole texts whose canonical form has a known digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents, text_or_empty

#: Up to so many known texts the table is broadcast (digests of 32 bytes); beyond, Spark joins by digest.
BROADCAST_KNOWN = 100_000

# Spellings that count as equal, word by word in canonical form (no punctuation, blanks single).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("artefacts", "artifacts"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"),
    ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("sublicence", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]
# Notices and texts of known licences.
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
KNOWN = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": _BSD_2 + "\n" + _AS_IS,
    "BSD-3-Clause": _BSD_2 + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

""" + _AS_IS,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}


# Title lines that may stand before a licence's text, in canonical form.
TITLES = {
    "MIT": ["mit license", "the mit license", "the mit license mit", "expat license"], "ISC": ["isc license", "the isc license"], "0BSD": ["bsd zero clause license", "zero clause bsd"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license", "the 2 clause bsd license"], "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "the 3 clause bsd license"],
    "Zlib": ["zlib license", "the zlib license"], "BSL-1.0": ["boost software license version 1 0 august 17th 2003"], "Unlicense": ["the unlicense"],
}
# SHA-256 of the canonical form of texts too long to stand here.
KNOWN_DIGESTS = {
    "Apache-2.0": "f92c423b6d6da66caa78abd6f49f73f5bc8715dca82e1a73f62d1e6eec41986c",
    "Apache-2.0 / without appendix": "09ad3868555dada25cbf24199409a8c1e39fe8ef08d164adc6e98c1d02767793",
    "Apache-2.0 / without appendix, short links": "0c625737207ff21211498d94941901de5bca68c965547007c169a1e718b97f16",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "BSD-3-Clause / Regents": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f",
    "GFDL-1.3": "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
}

# Fixed value: how a line begins that only says whose the copyright is, also behind comment marks.
COPYRIGHT_LINE = r"\n[ \t#*/;%\-]*(?:(?:portions[ \t]+)?copyright[ \t]*(?:\(c\)|©|[0-9\[<{]|by[ \t])|\(c\)|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """Lower case; lines that begin with a copyright mark go; punctuation and white space become single blanks; words of equal spelling are made equal."""
    text = F.regexp_replace(F.concat(F.lit("\n"), F.lower(text)), COPYRIGHT_LINE, "")
    # two blanks between words, so that each word has its own while words are replaced
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licences(spark: SparkSession, texts: dict[str, str] = KNOWN, titles: dict[str, list[str]] = TITLES, digests: dict[str, str] = KNOWN_DIGESTS) -> DataFrame:
    """licence, licence_digest: of the texts, of the texts after each of their titles, and the given ones (a name may have " / variant" behind it)."""
    rows = [(name, text) for name, text in sorted(texts.items())] + [(name, f"{title}\n{texts[name]}") for name in sorted(titles) if name in texts for title in titles[name]]
    made = spark.createDataFrame(rows, "licence string, text string").select("licence", canonical(F.col("text")).alias("text")).filter("text <> ''").select("licence", F.sha2("text", 256).alias("licence_digest"))
    return made.union(spark.createDataFrame([(name.split(" / ")[0], x) for name, x in sorted(digests.items())], "licence string, licence_digest string"))


def scan(docs: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per row of docs: its keys, licence_digest, licence (null if the text is no known licence).

    Whole texts are compared in canonical form, by SHA-256. known: licence, licence_digest; of licences with one
    digest the first name counts. Each row has at most one match, so a licence that a third of all documents are
    costs a lookup per row and no shuffle while known is small (its rows are counted). Null text: the digest of the
    empty text, no licence. Null keys and repeated rows stay as they are. Empty tables: no rows, or no matches.
    """
    known = known.groupBy("licence_digest").agg(F.min("licence").alias("licence"))
    rows = docs.select(*keys, digest(text_or_empty(text_col)).alias("licence_digest"))
    known = F.broadcast(known) if known.count() <= BROADCAST_KNOWN else known
    return rows.join(known, "licence_digest", "left").select(*keys, "licence_digest", "licence")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (from 0), text of each line of the documents that has a letter or digit. Null text: no lines."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "text"))
    return each.filter(F.col("text").rlike(r"[\p{L}\p{N}]"))


def op6_licence_digests(spark, sf_dir):
    return scan(read_documents(spark, sf_dir), known_licences(spark))


def licence_lines(spark, sf_dir):
    """Lines of documents that are a known licence or notice, whole."""
    return scan(lines(read_documents(spark, sf_dir)), known_licences(spark), ("doc_id", "line")).filter("licence is not null")


def _sql_canonical(x: str) -> str:
    quoted = COPYRIGHT_LINE.replace("'", "''")
    x = rf"regexp_replace(chr(10) || lower({x}), '{quoted}', '', 'g')"
    x = rf"(' ' || trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '  ', 'g')) || ' ')"
    for a, b in SPELLINGS:
        x = f"replace({x}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    return f"trim(replace({x}, '  ', ' '))"


def _sql_known() -> str:
    rows = sorted(KNOWN.items()) + [(k, f"{t}\n{KNOWN[k]}") for k in sorted(TITLES) for t in TITLES[k]]
    texts = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in rows)
    given = "".join(f" UNION ALL SELECT '{v}', '{k.split(' / ')[0]}'" for k, v in sorted(KNOWN_DIGESTS.items()))
    return f"known AS (SELECT d, min(licence) AS licence FROM (SELECT sha256({_sql_canonical('t')}) AS d, n AS licence FROM (VALUES {texts}) AS k(n, t){given}) GROUP BY 1)"


def sql() -> str:
    return f"""
WITH {_sql_known()}, docs AS (SELECT doc_id, sha256({_sql_canonical("coalesce(text, '')")}) AS licence_digest FROM documents)
SELECT doc_id, licence_digest, licence FROM docs LEFT JOIN known ON d = licence_digest
"""


def lines_sql() -> str:
    return rf"""
WITH {_sql_known()}, l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
each AS (SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS line, unnest(parts) AS text FROM l),
docs AS (SELECT doc_id, line, sha256({_sql_canonical("text")}) AS licence_digest FROM each WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]'))
SELECT doc_id, line, licence_digest, licence FROM docs JOIN known ON d = licence_digest
"""
