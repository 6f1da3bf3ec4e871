"""Licence scan: canonical digest lookup of entire texts (DataFrame functions only)."""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short licence notices, each a whole text, and below them standard headers and full texts. A caller passes its own table for more.
KNOWN = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["Licensed under the GNU General Public License v3.0.", "Released under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["All rights reserved.", "Proprietary and confidential."],
}

#: Headers of source files, paragraph by paragraph.
HEADERS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
}

#: Full texts beside this module. `LEADS`: the paragraph by which one is told when it stands inside a longer document.
FULL = ("MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0")
LEADS = {"MIT": "Permission is hereby granted, free of charge"}


def _full_texts() -> None:
    """Adds to KNOWN each full text with and without its title, as it is wrapped and with a line a paragraph, and the headers."""
    for name in FULL:
        text = pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()
        paragraphs = [re.sub(r"\s*\n\s*", " ", x.strip()) for x in re.split(r"\n\s*\n", text)]
        texts = [text, "\n\n".join(paragraphs)]
        if "END OF TERMS AND CONDITIONS" in text:
            texts += [x.split("END OF TERMS AND CONDITIONS")[0] + end for x in texts for end in ("END OF TERMS AND CONDITIONS", "")]
        else:
            texts += [x.split("\n", 1)[1] for x in texts]
        KNOWN[name] = KNOWN[name] + texts + [x for x in paragraphs if name in LEADS and x.startswith(LEADS[name])]
    for name, parts in HEADERS.items():
        link = [" ".join(parts), " ".join(parts).replace("https:", "http:")] if name == "GPL-3.0" else [" ".join(parts)]
        KNOWN[name] = KNOWN[name] + link + [parts[0], " ".join(parts[:2])]


_full_texts()

#: Spellings that licence texts use for one another.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "authorise": "authorize", "catalogue": "catalog", "centre": "center",
    "copy right": "copyright", "emphasise": "emphasize", "favour": "favor", "fulfil": "fulfill", "initialise": "initialize",
    "judgement": "judgment", "labour": "labor", "licence": "license", "maximise": "maximize", "modelled": "modeled",
    "noncommercial": "non commercial", "organisation": "organization", "owner": "holder", "per cent": "percent", "practise": "practice",
    "realise": "realize", "recognise": "recognize", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while",
}

COPYRIGHT_LINE = r"(?m)^[^\S\n]*(copyright|\(c\)|\xa9)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, every run of other than a-z, 0-9 and letters beyond ASCII one space, one spelling.

    Null stays null; a text of nothing else becomes the empty string.
    """
    t = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), COPYRIGHT_LINE, "")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        t = F.replace(t, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(t)


#: Marks at the start of a line that make it a comment.
COMMENT = r"(?m)^[^\S\n]*(?:#+|//+|/?\*+/?|--+|;+|%+|<!--)[^\S\n]*"


def paragraphs(text: Column) -> Column:
    """The runs of non-blank lines of two lines or more, without comment marks; none where that is the whole text."""
    parts = F.split(text, r"\n[^\S\n]*(?=\n)")
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.when(F.size(parts) > 1, F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("\n"))), lambda p: F.regexp_replace(p, COMMENT, ""))).otherwise(F.array().cast("array<string>"))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """license, digest of each known text; texts alike after normalising count once, under the first name."""
    rows = [(name, text) for name, texts in (known or KNOWN).items() for text in texts]
    t = spark.createDataFrame(rows, "license string, known string")
    return t.groupBy(digest(F.col("known")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, n_notices, licenses, whole_license: which documents, paragraphs and lines are, entire, a known licence.

    The whole text, each of its lines and each run of two or more non-blank lines are entire texts: each is normalised, digested and joined by
    digest to the known ones. The known side is broadcast only while it has at most `broadcast_rows` rows.
    `licenses`: distinct names, sorted, comma-joined, empty where none; `n_notices`: lines and
    paragraphs that are known; `whole_license`: the name if the whole text is one, else null. Null or empty text: none.
    Repeated rows give a row each; ties and clashing columns do not matter.
    """
    known = known if known is not None else known_licenses(docs.sparkSession)
    n = known.count()
    k = known.select(F.col("digest").alias("_digest"), F.col("license").alias("_license"))
    k = F.broadcast(k) if n <= broadcast_rows else k
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    lines = F.transform(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: F.struct(x.alias("t"), F.lit(False).alias("whole")))
    runs = F.transform(paragraphs(F.coalesce("_text", F.lit(""))), lambda x: F.struct(x.alias("t"), F.lit(False).alias("whole")))
    units = F.array_append(F.concat(lines, runs), F.struct(F.coalesce("_text", F.lit("")).alias("t"), F.lit(True).alias("whole")))
    u = d.select("doc_id", "_row", F.explode(units).alias("u")).select("doc_id", "_row", "u.whole", digest(F.col("u.t")).alias("_digest"))
    hit = u.join(k, "_digest", "left")
    line = F.when(~F.col("whole"), F.col("_license"))
    return hit.groupBy("doc_id", "_row").agg(
        F.count(line).alias("n_notices"),
        F.concat_ws(",", F.array_sort(F.collect_set("_license"))).alias("licenses"),
        F.max(F.when(F.col("whole"), F.col("_license"))).alias("whole_license"),
    ).drop("_row")
