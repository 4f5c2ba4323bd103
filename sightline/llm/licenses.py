"""License scans by sentence rules.

Texts are cut into sentences, normalised and looked up among known licence sentences;
the identifiers found, in order, are matched against ordered rules, each a sequence of
identifiers.  Families of licences that differ in name and version alone come from rules.
The tables are small and fixed; everything runs within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache2-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc0-short": "This work is dedicated to the public domain under CC0 1.0.",
    "reserved": "All rights reserved.",
    "apache2-name": "Apache License",
    "apache2-date": "Version 2.0, January 2004",
    "apache2-heading": "Apache License Version 2.0, January 2004",
    "mpl2-heading": "Mozilla Public License Version 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl1-heading": "Eclipse Public License - v 1.0",
    "epl2-heading": "Eclipse Public License - v 2.0",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsl-heading": "Boost Software License - Version 1.0 - August 17th, 2003",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "artistic2-heading": "The Artistic License 2.0",
    "openssl-heading": "OpenSSL License",
}

#: The GNU family. (identifier, licence, what it covers, name, version, notice's mark, heading's date).
GNU = [
    ("gpl2", "GPL-2.0", "program", "General Public License", "2", ";", "June 1991"),
    ("gpl3", "GPL-3.0", "program", "General Public License", "3", ":", "29 June 2007"),
    ("lgpl21", "LGPL-2.1", "library", "Lesser General Public License", "2.1", ";", "February 1999"),
    ("lgpl3", "LGPL-3.0", "library", "Lesser General Public License", "3", ":", "29 June 2007"),
    ("agpl3", "AGPL-3.0", "program", "Affero General Public License", "3", ":", "19 November 2007"),
]
#: The Creative Commons family. (identifier, name, category).
COMMONS = [
    ("BY", "Attribution", "permissive"),
    ("BY-SA", "Attribution-ShareAlike", "copyleft"),
    ("BY-NC", "Attribution-NonCommercial", "noncommercial"),
    ("BY-ND", "Attribution-NoDerivatives", "restricted"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "noncommercial"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "noncommercial"),
]
COMMONS_VERSIONS = {"2.0": "Generic", "3.0": "Unported", "4.0": "International"}


def family_sentences() -> dict[str, str]:
    """The sentences of the GNU and Creative Commons families."""
    out = {}
    for key, _, thing, name, version, mark, date in GNU:
        free = "free software: you" if mark == ":" else "free software; you"
        join = "," if mark == ":" else ";"
        out[f"{key}-later"] = f"This {thing} is {free} can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{join} either version {version} of the License, or (at your option) any later version."
        out[f"{key}-name"] = f"GNU {name}"
        out[f"{key}-date"] = f"Version {version}, {date}"
        out[f"{key}-heading"] = f"GNU {name} Version {version}, {date}"
    for kind, name, _ in COMMONS:
        for version, scope in COMMONS_VERSIONS.items():
            key = f"cc-{kind.lower()}-{version}"
            out[f"{key}-short"] = f"Licensed under CC {kind} {version}."
            out[f"{key}-work"] = f"This work is licensed under a Creative Commons {name} {version} {scope} License."
            out[f"{key}-heading"] = f"Creative Commons {name} {version} {scope}"
    return out


def family_rules() -> list[tuple[str, str, list[str]]]:
    out = []
    for key, licence, *_ in GNU:
        out += [(f"{licence}-or-later", "copyleft", [f"{key}-later"]), (licence, "copyleft", [f"{key}-heading"]), (licence, "copyleft", [f"{key}-name", f"{key}-date"])]
    for kind, _, category in COMMONS:
        for version in COMMONS_VERSIONS:
            out += [(f"CC-{kind}-{version}", category, [f"cc-{kind.lower()}-{version}-{form}"]) for form in ("short", "work", "heading")]
    return out


SENTENCES |= family_sentences()

#: Rules in order: (licence, category, sentences that follow one another among those known).
RULES = [
    ("Apache-2.0", "permissive", ["apache2-notice", "apache2-obtain", "apache2-asis", "apache2-see"]),
    ("Apache-2.0", "permissive", ["apache2-notice"]),
    ("Apache-2.0", "permissive", ["apache2-short"]),
    ("Apache-2.0", "permissive", ["apache2-heading"]),
    ("Apache-2.0", "permissive", ["apache2-name", "apache2-date"]),
    ("MIT", "permissive", ["mit-grant", "mit-keep", "mit-asis"]),
    ("MIT", "permissive", ["mit-grant", "mit-keep"]),
    ("MIT", "permissive", ["mit-released"]),
    ("MIT", "permissive", ["mit-licensed"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("BSD-4-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]),
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-only", "copyleft", ["gpl3-short"]),
    ("MPL-2.0", "copyleft", ["mpl2-notice"]),
    ("MPL-2.0", "copyleft", ["mpl2-heading"]),
    ("EPL-1.0", "copyleft", ["epl1-heading"]),
    ("EPL-2.0", "copyleft", ["epl2-heading"]),
    ("EPL-2.0", "copyleft", ["epl2-notice"]),
    ("Unlicense", "public-domain", ["unlicense"]),
    ("BSL-1.0", "permissive", ["bsl-heading"]),
    ("Zlib", "permissive", ["zlib-asis"]),
    ("Zlib", "permissive", ["zlib-grant"]),
    ("Artistic-2.0", "permissive", ["artistic2-heading"]),
    ("OpenSSL", "permissive", ["openssl-heading"]),
    ("CC0-1.0", "public-domain", ["cc0-short"]),
    ("LicenseRef-Proprietary", "proprietary", ["reserved"]),
]

RULES += family_rules()

#: A sentence ends at .!?:; before white space, at lines without letter or digit, and (cut by lines) at every line end.
SENTENCE_END = "(?<=[.!?:;])[ \t\n\x0b\f\r]+|\n[\x02-/:-@\\[-`{-\x7f]*\n"
LINE_END = "(?<=[.!?:;])[ \t\n\x0b\f\r]+|\n"


def normalise(sentence: str) -> str:
    """The plain statement of :func:`_normal`: lower-case runs of a-z and 0-9, joined by single spaces."""
    import re

    return " ".join(re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)))


def _normal(sentence: Column) -> Column:
    lower = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def known_sentences(text: Column, end: str, table: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order; a sentence cut at ``;`` or ``:`` is known as a whole.

    Licence sentences hold such cuts themselves, so the table maps each sentence's
    pieces to numbered identifiers, which are put together again by the rules.
    """
    lookup = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    return F.filter(F.transform(F.split(text, end), lambda s: F.try_element_at(lookup, _normal(s))), lambda x: x.isNotNull())


def sentence_table(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised piece to identifier; a sentence of several pieces has identifiers with /0, /1, ..."""
    import re

    table = {}
    for name, sentence in sentences.items():
        parts = [normalise(x) for x in re.split(SENTENCE_END, sentence) if normalise(x)]
        for i, part in enumerate(parts):
            table.setdefault(part, name if len(parts) == 1 else f"{name}/{i}")
    return table


def _pattern(rule: list[str], sentences: dict[str, str], table: dict[str, str]) -> str:
    import re

    ids = []
    for name in rule:
        ids += [table[normalise(x)] for x in re.split(SENTENCE_END, sentences[name]) if normalise(x)]
    return "," + ",".join(ids) + ","


def patterns(sentences: dict[str, str], rules) -> list[tuple[str, str, str, list[str]]]:
    """(licence, category, pattern, patterns of earlier rules of other licences that hold all its sentences) of each rule."""
    table, out = sentence_table(sentences), []
    for k, (name, kind, rule) in enumerate(rules):
        wider = [_pattern(longer, sentences, table) for other, _, longer in rules[:k] if other != name and set(rule) < set(longer)]
        out.append((name, kind, _pattern(rule, sentences, table), wider))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """One row per input row: doc_id, sentence_ids, licenses, license, category.

    ``licenses`` are those of all rules whose sequence occurs without a gap among the
    known sentences, in the rules' order and once each; a rule whose sentences are part
    of an earlier matching rule of another licence adds none.  ``license`` and
    ``category`` are those of the first, null without any.  Lines are read both as
    wrapped text and as sentences of their own; whole texts are read, however long their
    sentences.  Null and empty texts have none;
    repeated rows give repeated results; an empty table gives an empty result.  Other
    columns of ``docs`` are not read.
    """
    table = sentence_table(sentences)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), known_sentences(text, SENTENCE_END, table).alias("wrapped"), known_sentences(text, LINE_END, table).alias("lined"))
    joined = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    out = out.withColumns({"w": joined("wrapped"), "l": joined("lined")})
    told = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(kind).alias("category"), F.lit(pattern).alias("p"), F.array(*[F.lit(x) for x in wider]).cast("array<string>").alias("wider")) for name, kind, pattern, wider in patterns(sentences, rules)])
    has = lambda p: F.col("w").contains(p) | F.col("l").contains(p)
    hits = F.filter(told, lambda r: has(r["p"]) & ~F.exists(r["wider"], has))
    hits = F.transform(hits, lambda r: F.struct(r["license"].alias("license"), r["category"].alias("category")))
    none = F.array().cast("array<struct<license:string,category:string>>")
    out = out.withColumn("found", F.when(F.size("wrapped") + F.size("lined") > 0, F.array_distinct(hits)).otherwise(none))
    ids = F.when(F.size("wrapped") >= F.size("lined"), F.col("wrapped")).otherwise(F.col("lined"))
    return out.select("doc_id", ids.alias("sentence_ids"), F.col("found.license").alias("licenses"), F.get("found", 0)["license"].alias("license"), F.get("found", 0)["category"].alias("category"))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "license", "category")


def oracle(sentences: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """The query in SQL: sentence ends become \\x01, at which texts are cut."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = lambda rows: ",\n".join("(" + ", ".join(rows_) + ")" for rows_ in rows)
    known = values([quoted(k), quoted(v)] for k, v in sentence_table(sentences).items())
    told = values([str(i), quoted(n), quoted(c), quoted(p), "CAST([" + ", ".join(map(quoted, w)) + "] AS VARCHAR[])"] for i, (n, c, p, w) in enumerate(patterns(sentences, rules)))
    blanks = r"[ \t\n\x0b\f\r]"
    return rf"""
WITH known(piece, id) AS (VALUES {known}),
told(k, license, category, p, wider) AS (VALUES {told}),
ends AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.!?:;]){blanks}+', '\1' || chr(1), 'g') AS t FROM documents),
cut AS (
  SELECT doc_id, 'w' AS how, string_split(regexp_replace(t, '\n[\x02-/:-@\[-`{{-\x7f]*\n', chr(1), 'g'), chr(1)) AS parts FROM ends
  UNION ALL SELECT doc_id, 'l', string_split(replace(t, chr(10), chr(1)), chr(1)) FROM ends),
parts AS (SELECT doc_id, how, i, trim(regexp_replace(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS piece
  FROM cut, unnest(range(1, len(parts) + 1)) AS u(i)),
ids AS (SELECT doc_id, how, string_agg(id, ',' ORDER BY i) AS ids, count(*) AS n FROM parts JOIN known USING (piece) GROUP BY 1, 2),
sides AS (SELECT d.doc_id, coalesce(w.ids, '') AS w, coalesce(l.ids, '') AS l, coalesce(w.n, 0) >= coalesce(l.n, 0) AS wrapped
  FROM documents d LEFT JOIN ids w ON w.doc_id = d.doc_id AND w.how = 'w' LEFT JOIN ids l ON l.doc_id = d.doc_id AND l.how = 'l'),
hits AS (SELECT doc_id, license, category, min(k) AS k FROM sides JOIN told
  ON (contains(',' || w || ',', p) OR contains(',' || l || ',', p))
  AND len(list_filter(wider, lambda x: contains(',' || w || ',', x) OR contains(',' || l || ',', x))) = 0
  WHERE w <> '' OR l <> '' GROUP BY 1, 2, 3),
found AS (SELECT doc_id, string_agg(license, ',' ORDER BY k) AS licenses, arg_min(license, k) AS license, arg_min(category, k) AS category FROM hits GROUP BY 1)
SELECT b.doc_id, CASE WHEN wrapped THEN w ELSE l END AS sentence_ids, coalesce(licenses, '') AS licenses, license, category
FROM sides b LEFT JOIN found f ON f.doc_id = b.doc_id
"""


ORACLE = oracle()
