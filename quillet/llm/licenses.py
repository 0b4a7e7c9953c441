"""Licence scan by canonical digests: whole texts, normalised, looked up among the digests of known licences."""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of public licences and notices, in their published wording.
LICENSES = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """BSD Zero Clause License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License

Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "All rights reserved": "All rights reserved.",
}

# The longer ones, each in a file of its own, named by its SPDX identifier (BSD-3-Clause-UC: the University's wording).
LICENSES |= {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}

# Words that count as others, after normalisation to single-spaced lower-case words.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "authorisation": "authorization",
    "organisation": "organization", "merchantibility": "merchantability", "whilst": "while", "favour": "favor",
}
SPLIT_WORD = ("non infringement", "noninfringement")
#: Titles that may head a text without changing which licence it is.
TITLES = "(the )?(mit|isc|zlib|bsd zero clause) license"
#: A line that states a copyright: a sign or a year follows the word, so lines that merely begin with it stay.
COPYRIGHT_LINE = r"[ \t>*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9<\[])|\(c\)[ \t]*[0-9<\[]|©)[^\n]*"
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(text: Column) -> Column:
    """Normal form of a whole text; null gives null.

    A-Z in lower case; lines that state a copyright dropped; every run of other characters than ASCII letters,
    digits and non-ASCII ones is one space; a licence title at the start dropped; spellings unified.
    """
    low = F.translate(text, *_LETTERS)
    low = F.regexp_replace(low, rf"(^|\n){COPYRIGHT_LINE}", "\n")
    words = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    words = F.replace(words, F.lit(SPLIT_WORD[0]), F.lit(SPLIT_WORD[1]))

    def spelled(w: Column) -> Column:
        out = F.when(w == "", w)
        for one, other in SPELLINGS.items():
            out = out.when(w == one, other)
        return out.otherwise(w)

    words = F.array_join(F.transform(F.split(words, " "), spelled), " ")
    return F.regexp_replace(words, rf"^{TITLES} (permission|this software)", r"$3")


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license): one row per known licence; a fixed table of some dozen rows."""
    rows = spark.createDataFrame(list(LICENSES.items()), "license string, body string")
    return rows.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: id_col, digest (sha256 of the canonical text), license (null: no known licence).

    known: (digest, license), by default the fixed table; an own one may be of any size, Spark chooses the join.
    Null texts have a null digest and no licence, empty ones the digest of the empty text. Repeated rows stay; two
    known licences with one digest count as the first by name. No rows give no rows; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    table = F.broadcast(known_digests(docs.sparkSession)) if known is None else known.groupBy("digest").agg(F.min("license").alias("license"))
    return own.join(table, "digest", "left").select(F.col("id").alias(id_col), "digest", "license")
