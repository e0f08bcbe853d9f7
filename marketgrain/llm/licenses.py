"""License scans by canonical digests: normalise a text, hash it, and look the hash up among known licenses.

Normalised are: case, lines that are copyright notices, punctuation, white space, and equivalent spellings. The whole
text of a document is looked up, and each of its lines, so that a one-line notice is found inside other text.

Rows are written with a number and their normalised text; lines are exploded, digested and joined with the known digests,
and only rows with a known line come back to be joined by their number.

Nulls and edges: a null or blank text has a null digest and no license; known texts that are blank are left out; of known
texts with the same digest the least license_id counts; repeated rows give repeated results; texts of any length are
digested whole; further columns are carried along whatever their names, except those named as the results; without known
texts nothing is found.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.llm.shared import written

#: Known texts up to this number are broadcast; beyond it digests are joined by shuffles.
BROADCAST_TEXTS = 100_000
#: Results by line of up to so many rows are broadcast; beyond it they are joined by row numbers.
BROADCAST_ROWS = 200_000

#: Spellings taken as the same, after the published license-matching guidelines.
EQUIVALENT = {
    "licence": "license",
    "sub license": "sublicense",
    "non commercial": "noncommercial",
    "acknowledgement": "acknowledgment",
    "copyright holder": "copyright owner",
    "per cent": "percent",
    "merchantibility": "merchantability",
    "whilst": "while",
    "fulfil ": "fulfill ",
    "favour": "favor",
    "organisation": "organization",
    "authorise": "authorize",
}
COPYRIGHT_LINES = r"(?m)^[ \t*#/;-]*(copyright\b|\(c\)|©|all rights reserved\b)[^\n]*$"

#: Public license texts and notices, by SPDX identifier.
KNOWN = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-notice": "Released under the MIT License.",
}


#: Title lines that stand before texts which have none of their own.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: Where the terms end and an appendix begins that copies often leave out.
APPENDIX = r"(?is)(?<=END OF TERMS AND CONDITIONS)\s.*$"
#: Names that one-line notices call a license by; notices of MIT keep the identifier that KNOWN gives them.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "MIT-notice": ["MIT License", "MIT license (MIT)"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPLv2", "GPLv2"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPLv3", "GPLv3"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU LGPLv2.1", "LGPLv2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU LGPLv3", "LGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}
#: Wordings of one-line notices.
WORDINGS = [f"{what}{verb} under {the}{{}}" for what in ("", "This work is ", "This project is ", "This software is ", "This file is ", "This program is ") for verb in ("licensed", "released", "distributed") for the in ("", "the ", "the terms of the ")]


def _texts() -> list[tuple[str, str]]:
    """KNOWN, and whole texts with and without title, wrapped or not and without appendix, and notices in many wordings."""
    whole = whole_texts()
    whole += [(n, re.sub(APPENDIX, "", t)) for n, t in whole]
    whole += [(n, re.sub(r"(?<!\n)\n(?!\n)", " ", t)) for n, t in whole]
    whole += [(n, f"{title}\n\n{t}") for n, t in whole for title in TITLES.get(n, [])]
    notices = [(n, wording.format(name)) for n, names in NAMES.items() for name in names for wording in WORDINGS]
    tags = [(n, f"SPDX-License-Identifier: {n.removesuffix('-notice')}") for n in NAMES]
    return sorted({*KNOWN.items(), *whole, *notices, *tags})


def whole_texts() -> list[tuple[str, str]]:
    """The whole license texts: license_id, text."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))] + [(n, KNOWN[n]) for n in ("MIT", "ISC")]


def copies_of_texts(docs: DataFrame, every: int = 20) -> DataFrame:
    """doc_id (below 0), text: for one in ``every`` documents a license file as people keep it, which one by its doc_id."""
    texts = F.array(*[F.lit(t) for _, t in whole_texts()])
    n = F.col("doc_id") / every
    text = F.get(texts, F.pmod(n.cast("long"), F.size(texts)).cast("int"))
    shouted = F.when(F.col("doc_id") % 3 == 0, F.upper(text)).otherwise(text)
    spelt = F.when(F.col("doc_id") % 7 == 0, F.replace(shouted, F.lit("license"), F.lit("licence"))).otherwise(shouted)
    wrapped = F.when(F.col("doc_id") % 11 == 0, F.regexp_replace(spelt, ",", " ,")).otherwise(spelt)
    owner = F.concat(F.lit("Copyright (c) 2024 Author "), F.col("doc_id").cast("string"), F.lit("\nAll rights reserved.\n\n"))
    return docs.where(F.col("doc_id") % every == 0).select((-1 - F.col("doc_id")).alias("doc_id"), F.concat(owner, wrapped).alias("text"))


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id, text."""
    return spark.createDataFrame(_texts(), "license_id string, text string")


def normalised(text: Column) -> Column:
    """The text in canonical form, its lines still apart."""
    text = F.regexp_replace(F.lower(text), COPYRIGHT_LINES, "")
    text = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " "), F.lit(" "))
    for spelt, as_ in EQUIVALENT.items():
        text = F.replace(text, F.lit(spelt), F.lit(as_))
    return text


def digest(text: Column) -> Column:
    """The SHA-256 of a normalised text with single spaces; null if nothing is left of it."""
    one = F.trim(F.regexp_replace(text, r"[ \n]+", " "))
    return F.when(one != "", F.sha2(one, 256))


def license_scan(docs: DataFrame, known: DataFrame, text_column: str = "text", broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """Add text_sha256 and license of the whole text, n_license_lines, and line_licenses (sorted, distinct)."""
    kept = [c for c in docs.columns if c not in ("text_sha256", "license", "n_license_lines", "line_licenses")]
    digests = known.select(digest(normalised(F.col("text"))).alias("text_sha256"), "license_id").where("text_sha256 is not null")
    digests = written(digests.groupBy("text_sha256").agg(F.min("license_id").alias("license")), "licenses")
    small = F.broadcast if digests.count() <= broadcast_texts else (lambda df: df)
    # the document's own columns are one field, so none of theirs and ours can clash
    rows = docs.select(F.struct(*[F.col(c) for c in kept]).alias("page"), F.monotonically_increasing_id().alias("row"), normalised(F.col(text_column)).alias("normal"))
    rows = written(rows, "normalised")
    lines = rows.select("row", F.explode(F.split("normal", "\n")).alias("line")).select("row", digest(F.col("line")).alias("text_sha256")).where("text_sha256 is not null")
    by_row = lines.join(small(digests), "text_sha256").groupBy("row").agg(F.count("*").alias("n_license_lines"), F.array_sort(F.collect_set("license")).alias("line_licenses"))
    by_row = written(by_row, "license-lines")
    few = F.broadcast if by_row.count() <= BROADCAST_ROWS else (lambda df: df)
    scanned = rows.withColumn("text_sha256", digest(F.col("normal"))).drop("normal").join(small(digests), "text_sha256", "left").join(few(by_row), "row", "left")
    return scanned.select(
        *[F.col("page")[c].alias(c) for c in kept],
        "text_sha256",
        "license",
        F.coalesce("n_license_lines", F.lit(0).cast("long")).alias("n_license_lines"),
        F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"),
    )
