"""Licence scans by canonical digests, in DataFrame functions.

A text is brought into a canonical form in which copies of a licence agree
however they are set: lower case, no punctuation, no copyright lines, one
spelling. The digest of the form is joined with those of known licences. Looked
up are each document as a whole, each of its paragraphs and each of its lines,
so that a licence text is found on its own or inside a longer document.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import KEY, row_key, written

# Notices and texts of public licences, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
]

_NO_HOLDER = (
    "notices?|holders?|owners?|owned|laws?|licen[sc]es?|licensed|statements?|permissions?|interests?|treaty|treaties|disclaimer|lines?|acts?"
    "|on|of|in|is|it|to|and|or|for|as|also|means|that|which|are|if|with|under|like|protection|rights?|claims?|infringement|ownership|information"
)
COPYRIGHT = (
    rf"^[^a-z0-9]*(?:all rights reserved.*|©.*|copyright(?![a-z])(?![^a-z0-9©]*(?:{_NO_HOLDER})(?![a-z])).*"
    r"|\(c\)(?=[^a-z0-9]*copyright|.*(?:19|20)[0-9]{2}).*)"
)
"""A lower-cased line that only says whose the work is: with a year, a sign or a holder, and no sentence of a licence
that is wrapped there."""
SQL_COPYRIGHT = r"^[^a-z0-9]*(copyright|©|\(c\)|all rights reserved).*"
"""The wider pattern of ``scan_sql``, which also takes such sentences away."""
# Spellings that mean the same, after punctuation has become spaces.
SPELLINGS = [
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("non commercial", "noncommercial"),
    ("(?:^| )https? ", " http "),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("acknowledgement", "acknowledgment"),
    ("version ([0-9])", "v $1"),
]


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; empty if nothing in it counts."""
    form = F.regexp_replace(F.lower(line), COPYRIGHT, "")
    form = F.regexp_replace(form, r"&", " and ")
    form = F.regexp_replace(form, r"[^a-z0-9\u0080-￿]+", " ")
    for pattern, one in SPELLINGS:
        form = F.regexp_replace(form, pattern, one)
    return F.trim(F.regexp_replace(form, " +", " "))


def canonical_lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n", -1), canonical_line)


def digest(form: Column) -> Column:
    return F.sha2(form, 256)


def whole_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the files in ``license_texts``, which are named by the licence."""
    folder = files("spanloom.llm") / "license_texts"
    return [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name)]


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest) of licence texts; of NOTICES and the whole texts in ``license_texts`` if none are given."""
    rows = spark.createDataFrame([*NOTICES, *whole_texts()] if texts is None else texts, "license_id string, text string")
    form = F.array_join(F.filter(canonical_lines(F.col("text")), lambda x: x != ""), " ")
    return rows.select("license_id", digest(form).alias("digest")).distinct()


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, whole_license, licenses array<string>, n_found) for every row.

    ``whole_license`` names the licence the whole text is (the first by name if
    several have that digest; null if none), ``licenses`` all that the text, a
    paragraph or a line is, sorted; ``n_found`` counts the places. Null, empty
    and blank texts are none. Rows that agree in doc_id and text are treated
    alike. Other columns are ignored.
    """
    forms = docs.select(*row_key(), canonical_lines(F.col("text")).alias("lines"))
    some = F.filter("lines", lambda x: x != "")
    whole = F.array_join(some, " ")
    # Paragraphs lie between lines that are empty in the canonical form.
    paragraphs = F.transform(F.split(F.array_join("lines", "\n"), "\n\n+"), lambda x: F.trim(F.translate(x, "\n", " ")))
    one = lambda kind, forms: F.transform(forms, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("form")))
    units = F.concat(one("whole", F.array(whole)), one("paragraph", F.array_distinct(paragraphs)), one("line", some))
    units = forms.select(*KEY, F.explode(units).alias("unit")).where("unit.form <> ''")
    digests = units.select(*KEY, "unit.kind", digest(F.col("unit.form")).alias("digest"))
    found = digests.join(known, "digest").groupBy(*KEY)
    found = found.agg(
        F.min(F.when(F.col("kind") == "whole", F.col("license_id"))).alias("whole_license"),
        F.array_sort(F.collect_set("license_id")).alias("licenses"),
        F.count("*").alias("n_found"),
    )
    found = written(found, "licenses")
    return docs.select("doc_id", *row_key()).join(found, KEY, "left").select(
        "doc_id",
        "whole_license",
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"),
    )


def scan_sql() -> str:
    """The same for the built-in licences as DuckDB SQL."""

    def canonical(x: str) -> str:
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        form = f"regexp_replace(lower({x}), {quote(SQL_COPYRIGHT)}, '')"
        form = f"replace({form}, '&', ' and ')"
        form = f"regexp_replace({form}, '[^a-z0-9\\x{{80}}-\\x{{FFFF}}]+', ' ', 'g')"
        for pattern, one in SPELLINGS:
            form = f"regexp_replace({form}, {quote(pattern)}, {quote(one.replace('$1', chr(92) + '1'))}, 'g')"
        return f"trim(regexp_replace({form}, ' +', ' ', 'g'))"

    values = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in NOTICES)
    lines = f"list_transform(string_split_regex(text, '\\r?\\n'), lambda x: {canonical('x')})"
    whole = "array_to_string(list_filter(lines, lambda x: x <> ''), ' ')"
    return f"""
        WITH known AS (
            SELECT DISTINCT license_id, {whole} AS form
            FROM (SELECT license_id, {lines} AS lines FROM (VALUES {values}) AS k(license_id, text))
        ),
        forms AS (SELECT doc_id, {lines} AS lines FROM documents),
        units AS (
            SELECT doc_id, 'whole' AS kind, {whole} AS form FROM forms
            UNION ALL SELECT doc_id, 'line', unnest(lines) FROM forms
            UNION ALL SELECT doc_id, 'paragraph', unnest(list_distinct(list_transform(
                string_split_regex(array_to_string(lines, chr(10)), '\\n\\n+'),
                lambda x: trim(replace(x, chr(10), ' '))))) FROM forms
        ),
        found AS (
            SELECT doc_id, min(license_id) FILTER (kind = 'whole') AS whole_license,
                   string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses, count(*) AS n_found
            FROM units JOIN known USING (form) WHERE form <> '' GROUP BY doc_id
        )
        SELECT doc_id, whole_license, coalesce(licenses, '') AS licenses, coalesce(n_found, 0) AS n_found
        FROM documents LEFT JOIN found USING (doc_id)
    """
