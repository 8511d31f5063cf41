"""Licence scans by canonical digests.

A text's canonical form has lower case, no copyright lines, one spelling where several are equivalent, and single spaces
for punctuation and white space. Its SHA-256 is joined with the digests of known licence texts and notices; the same is
done for every line, since a notice is mostly one line among others.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fenced
from .linededup import hash128, lines_of

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Known texts and notices by SPDX identifier: fixed values.
KNOWN = {
    "MIT": [
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, '
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "SPDX-License-Identifier: ISC",
    ],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License " + _BSD_HEAD + _BSD_TAIL, "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        head + _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL
        for head in ("", "BSD 3-Clause License ")
    ]
    + ["SPDX-License-Identifier: BSD-3-Clause"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
}
#: Spellings taken as the same word: fixed values.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize",
    "centre": "center", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "honour": "honor", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©(]*(?:copyright\b(?!\s+(?:notice|holder|owner|law))|©|\(c\)|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    words = F.btrim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))
    # One pass over the words, each looked up; only where a text has any of the spellings.
    spelling = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.element_at(spelling, w), w)), " ")
    return F.when(words.rlike(rf"\b(?:{'|'.join(EQUIVALENT)})\b"), spelled).otherwise(words)


#: Two words and what is between them.
TWO_WORDS = r"[\p{L}\p{N}]+[^\p{L}\p{N}]+[\p{L}\p{N}]+"


def head(line: Column) -> Column:
    """The first two words of a line's canonical form (empty for a line of fewer): a line that is no known text mostly shows so here already."""
    return canonical(F.regexp_extract(F.lower(line), TWO_WORDS, 0))


#: Whole texts in licenses_data: file name to SPDX identifier.
FILES = {
    "Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-only", "GFDL-1.3": "GFDL-1.3-only", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only",
    "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
#: Usual titles of the texts in KNOWN that begin with one.
TITLES = {"MIT": ("MIT License ", "The MIT License ", "The MIT License (MIT) "), "ISC": ("ISC License ", "The ISC License ")}
#: What follows a licence's text as advice on its use.
APPENDIX = r"(?mi)^ *(?:appendix:|addendum:|how to apply these terms).*"


def known_texts() -> list[tuple[str, str]]:
    """(license, text): KNOWN and the files, each with and without its titles, the files also without the advice after them."""
    found = [(name, t) for name, some in KNOWN.items() for t in some]
    for name, titles in TITLES.items():
        bare = KNOWN[name][0].removeprefix(titles[0])
        found += [(name, title + bare) for title in ("", *titles[1:])]
    for file, name in FILES.items():
        text = (Path(__file__).parent / "licenses_data" / file).read_text(encoding="utf-8").strip("\n")
        terms = text[: m.start()] if (m := re.search(APPENDIX, text)) else text
        for whole in {text, terms, re.sub(r"END OF TERMS AND CONDITIONS\s*\Z", "", terms)}:
            parts = re.split(r"\n\s*\n", whole)
            found += [(name, "\n\n".join(parts[k:])) for k in range(3 if file == "CC0-1.0" else 2)]
    return found


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(digest, license, head): one row per digest of the known texts and of those in `more` (license, text), the least license of each."""
    texts = spark.createDataFrame(known_texts(), "license string, text string")
    if more is not None:
        texts = texts.unionByName(more.select("license", "text"))
    forms = texts.filter("text is not null").select(canonical(F.col("text")).alias("form"), "license")
    first_two = F.concat_ws(" ", F.slice(F.split("form", " "), 1, 2))
    return forms.select(F.sha2("form", 256).alias("digest"), "license", F.when(F.contains("form", F.lit(" ")), first_two).otherwise("").alias("head")).groupBy("digest", "head").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, text: str = "text", more: DataFrame | None = None) -> DataFrame:
    """docs, without the text, with digest, license (of the whole text, or null) and line_licenses (sorted, by commas).

    `more`, a table (license, text) of any size, adds to the known texts. A null text has null digest; texts without
    letters or digits match nothing; an empty table gives an empty one. Columns of docs named as the new ones are
    replaced. Lines are matched by the hash of the text they stand in, so that copies fold together and ids need not be
    present or unique.
    """
    inner, back = fenced(docs, ["digest", "license", "line_licenses", text], _text=F.col(text), **dict(zip(("_t1", "_t2"), hash128(F.col(text)), strict=True)))
    known = known_digests(docs.sparkSession, more).filter(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256))
    known = F.broadcast(known) if more is None else known
    lines = (
        inner.select("_t1", "_t2", F.explode(F.array_distinct(lines_of(F.col("_text")))).alias("_line"))
        .filter(F.length("_line") > 0)
        .withColumn("head", head(F.col("_line")))
        .join(F.broadcast(known.select("head").distinct()) if more is None else known.select("head").distinct(), "head", "left_semi")
        .select("_t1", "_t2", F.sha2(canonical(F.col("_line")), 256).alias("digest"))
        .join(known, "digest")
        .groupBy("_t1", "_t2")
        .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"))
    )
    slim = inner.withColumn("digest", F.sha2(canonical(F.col("_text")), 256)).drop("_text")
    met = slim.join(known.select("digest", "license"), "digest", "left").join(lines, ["_t1", "_t2"], "left")
    return back(met, "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))
