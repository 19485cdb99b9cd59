"""License scans: known sentences, then ordered rules over their identifiers, in DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of well-known licences (lower case, words apart by one space).
SENTENCES = {
    "mit-name": "released under the mit license",
    "mit-name-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-name": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl-3-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3-later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "version-2-later": "either version 2 of the license or at your option any later version",
    "version-2-1-later": "either version 2 1 of the license or at your option any later version",
    "version-3-later": "either version 3 of the license or at your option any later version",
    "version-2": "version 2 of the license",
    "version-3": "version 3 of the license",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-holder": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "mit-title": "mit license",
    "mit-title-2": "the mit license",
    "mit-title-3": "the mit license mit",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-nc-4-name": "licensed under cc by nc 4 0",
    "cc-by-4-name": "licensed under cc by 4 0",
    "cc-by-sa-4-name": "licensed under cc by sa 4 0",
    "cc0-name": "licensed under cc0 1 0",
    "cc-work-by-4": "this work is licensed under a creative commons attribution 4 0 international license",
}

# Phrases that name a licence within a longer sentence, none part of another.
PHRASES = {
    "mit-under": "under the mit license",
    "mit-terms": "under the terms of the mit license",
    "apache-under": "under the apache license version 2 0",
    "apache-2-under": "under the apache license 2 0",
    "apache-under-2": "under the apache 2 0 license",
    "apache-terms": "under the terms of the apache license version 2 0",
    "gpl3-under": "under the gnu general public license version 3",
    "gpl3-under-v": "under the gnu general public license v3",
    "gpl2-under": "under the gnu general public license version 2",
    "gpl2-under-v": "under the gnu general public license v2",
    "agpl3-under": "under the gnu affero general public license version 3",
    "lgpl3-under": "under the gnu lesser general public license version 3",
    "mpl2-under": "under the mozilla public license version 2 0",
    "mpl2-terms": "terms of the mozilla public license version 2 0",
    "bsd3-under": "under the bsd 3 clause license",
    "bsd3-under-3": "under the 3 clause bsd license",
    "bsd2-under": "under the bsd 2 clause license",
    "bsd2-under-2": "under the 2 clause bsd license",
    "isc-under": "under the isc license",
}

# Licences that a tag may name.
TAGS = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Unlicense", "Zlib", "BSL-1.0",
    "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
TAG = "spdx license identifier"

# Licence rules in order of precedence. A rule matches where its
# identifiers follow each other; other sentences may lie between them. What a
# rule matches is used up, so a later, shorter rule does not report it again.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-name-2",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-2",)),
    ("MIT", ("mit-title-3",)),
    ("MIT", ("mit-under",)),
    ("MIT", ("mit-terms",)),
    ("Apache-2.0", ("apache-header", "apache-use", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-use")),
    ("Apache-2.0", ("apache-name",)),
    ("Apache-2.0", ("apache-under",)),
    ("Apache-2.0", ("apache-2-under",)),
    ("Apache-2.0", ("apache-under-2",)),
    ("Apache-2.0", ("apache-terms",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-3.0-or-later", ("gpl-terms", "version-3-later")),
    ("GPL-2.0-or-later", ("gpl-terms", "version-2-later")),
    ("GPL-2.0-only", ("gpl-terms", "version-2")),
    ("GPL-3.0-only", ("gpl-terms", "version-3")),
    ("GPL-3.0-only", ("gpl3-name",)),
    ("GPL-3.0-only", ("gpl3-under",)),
    ("GPL-3.0-only", ("gpl3-under-v",)),
    ("GPL-2.0-only", ("gpl2-under",)),
    ("GPL-2.0-only", ("gpl2-under-v",)),
    ("AGPL-3.0-or-later", ("agpl-3-later",)),
    ("AGPL-3.0-or-later", ("agpl-terms", "version-3-later")),
    ("AGPL-3.0-only", ("agpl-terms", "version-3")),
    ("AGPL-3.0-only", ("agpl3-under",)),
    ("LGPL-3.0-or-later", ("lgpl-3-later",)),
    ("LGPL-3.0-or-later", ("lgpl-terms", "version-3-later")),
    ("LGPL-2.1-or-later", ("lgpl-terms", "version-2-1-later")),
    ("LGPL-3.0-only", ("lgpl3-under",)),
    ("MPL-2.0", ("mpl-form", "mpl-copy")),
    ("MPL-2.0", ("mpl-form", "mpl-copy-2")),
    ("MPL-2.0", ("mpl2-under",)),
    ("MPL-2.0", ("mpl2-terms",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-holder")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd3-under",)),
    ("BSD-3-Clause", ("bsd3-under-3",)),
    ("BSD-2-Clause", ("bsd2-under",)),
    ("BSD-2-Clause", ("bsd2-under-2",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-under",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-name",)),
    ("CC-BY-4.0", ("cc-by-4-name",)),
    ("CC-BY-4.0", ("cc-work-by-4",)),
    ("CC0-1.0", ("cc0-name",)),
    *((tag, (f"tag-{tag}",)) for tag in TAGS),
)

# A sentence ends at a mark followed by white space, or at an empty line.
ENDS = r"([.!?:;])[ \t\r\n]+|\n[ \t\r]*\n"
CUT = "\x01"

# A tag's colon ends no sentence; a line that claims a copyright is one of its own.
TAGGED = r"(?i)(spdx-license-identifier):"
CLAIM = r"(?im)^([ \t#*/;%-]*(?:portions )?copyright[ \t]+(?:\(c\)|©|[0-9])[^\n]*)\n"

# Nor does the full stop behind a company's form before "nor".
COMPANY = r"(?i)\b(inc|ltd|corp|co)\.([ \t\r\n]+nor\b)"

# Whoever holds the rights, the clause is the same.
HOLDER = r"^neither the names? of .+ nor the names? of (?:its |their |any |the )?contributors may be used"
HELD = "neither the name of the copyright holder nor the names of its contributors may be used"


def normal(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def contained(phrases: dict[str, str]) -> list[tuple[str, str]]:
    """(identifier, words between spaces) of what is looked for within sentences about licences; tags after TAG only."""
    return [(name, f" {phrase} ") for name, phrase in phrases.items()]


def tagged() -> list[tuple[str, str]]:
    return [(f"tag-{tag}", f" {normal(tag)} ") for tag in TAGS]


def sentences(text: Column) -> Column:
    """Normalised sentences in order; one that spans lines is followed by its lines, which may be headings and sentences."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, TAGGED, "$1 "), CLAIM, "$1\n\n"), COMPANY, "$1$2")
    whole = F.split(F.regexp_replace(text, ENDS, f"$1{CUT}"), CUT)
    each = F.flatten(F.transform(whole, lambda s: F.when(F.contains(s, F.lit("\n")), F.concat(F.array(s), F.split(s, "\n"))).otherwise(F.array(s))))
    return F.transform(each, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", F.lit(" "))))


def identifiers(text: Column, known: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order; of a longer sentence those of the phrases and tags it holds.

    A line of a sentence that spans lines is a sentence too, so a phrase within
    one line is named for both.
    """
    known = SENTENCES if known is None else known
    table = F.create_map(*(F.lit(x) for name, sentence in known.items() for x in (sentence, name)))
    none = F.array().cast("array<string>")

    def held(s: Column, names: list[tuple[str, str]]) -> Column:
        spaced = F.concat(F.lit(" "), s, F.lit(" "))
        return F.array_compact(F.array(*[F.when(F.contains(spaced, F.lit(words)), F.lit(name)) for name, words in names])) if names else none

    def found(s: Column) -> Column:
        s = F.when(F.startswith(s, F.lit("neither the name")), F.regexp_replace(s, HOLDER, HELD)).otherwise(s)
        exact = F.try_element_at(table, s)
        about = F.contains(s, F.lit("license"))
        tag = F.contains(s, F.lit(TAG))
        within = F.when(about & tag, held(s, tagged())).when(about, held(s, contained(PHRASES if phrases is None else phrases))).otherwise(none)
        return F.when(exact.isNotNull(), F.array(exact)).otherwise(within)

    return F.flatten(F.transform(sentences(text), found))


def scanned(docs: DataFrame, known: dict[str, str] | None = None, rules: tuple = RULES) -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_sentences) for every row of ``docs`` (doc_id, text, ...).

    ``sentence_ids`` are the identifiers found, joined by bars; ``licenses``
    the licences of the rules that match, in the rules' order without repeats,
    joined by commas. Both are empty for null and empty texts and for texts
    without a known sentence. Repeated rows give equal rows; everything
    happens within a row, so an id may be null or repeated.
    """
    ids = F.coalesce(F.array_join(identifiers(F.col("text"), known), "|"), F.lit(""))
    out = docs.select("doc_id", ids.alias("sentence_ids")).withColumn("rest", F.concat(F.lit("||"), F.replace("sentence_ids", F.lit("|"), F.lit("||")), F.lit("||")))
    found = []
    for i, (_, sequence) in enumerate(rules):
        wanted = "".join(f"|{name}|" for name in sequence)
        out = out.withColumn(f"r{i}", F.contains("rest", F.lit(wanted))).withColumn("rest", F.replace("rest", F.lit(wanted), F.lit("||")))
        found.append(F.when(F.col(f"r{i}"), F.lit(rules[i][0])))
    licenses = F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ",")
    count = F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", r"\|"))).cast("long")
    return out.select("doc_id", "sentence_ids", licenses.alias("licenses"), count.alias("n_sentences"))


def scan_sql() -> str:
    """The same scan in SQL."""
    known = ", ".join(f"('{sentence}', '{name}')" for name, sentence in SENTENCES.items())
    steps, before = [], "d"
    for i, (_, sequence) in enumerate(RULES):
        wanted = "".join(f"|{name}|" for name in sequence)
        steps.append(f"x{i} AS (SELECT * REPLACE (replace(rest, '{wanted}', '||') AS rest), contains(rest, '{wanted}') AS r{i} FROM {before})")
        before = f"x{i}"
    found = ", ".join(f"CASE WHEN r{i} THEN '{name}' END" for i, (name, _) in enumerate(RULES))
    # Licences in the order of their first matching rule.
    order = list(dict.fromkeys(name for name, _ in RULES))
    place = "CASE x " + " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(order)) + " END"

    def held(names: list[tuple[str, str]]) -> str:
        each = ", ".join(f"CASE WHEN contains(' ' || s || ' ', '{words}') THEN '{name}' END" for name, words in names)
        return f"list_filter([{each}], lambda x: x IS NOT NULL)"

    return f"""
WITH known(sentence, name) AS (VALUES {known}),
m AS (SELECT map(list(sentence), list(name)) AS names FROM known),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{TAGGED}', '\\1 ', 'g'), '{CLAIM}', '\\1' || chr(10) || chr(10), 'g'), '{COMPANY}', '\\1\\2', 'g') AS text FROM documents),
c AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?:;])[ \\t\\r\\n]+|\\n[ \\t\\r]*\\n', '\\1' || chr(1), 'g'), chr(1)) AS whole FROM b),
e AS (SELECT doc_id, flatten(list_transform(whole, lambda s: CASE WHEN contains(s, chr(10)) THEN list_concat([s], string_split(s, chr(10))) ELSE [s] END)) AS each FROM c),
n AS (SELECT doc_id, list_transform(each, lambda s: regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), '{HOLDER}', '{HELD}')) AS each FROM e),
i AS (SELECT doc_id, array_to_string(flatten(list_transform(each, lambda s: CASE WHEN names[s] IS NOT NULL THEN [names[s]]
  WHEN contains(s, 'license') AND contains(s, '{TAG}') THEN {held(tagged())}
  WHEN contains(s, 'license') THEN {held(contained(PHRASES))} ELSE []::VARCHAR[] END)), '|') AS sentence_ids FROM n, m),
d AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, '||' || replace(coalesce(sentence_ids, ''), '|', '||') || '||' AS rest FROM i),
{", ".join(steps)}
SELECT doc_id, sentence_ids,
       coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter([{found}], lambda x: x IS NOT NULL)), lambda x: {{'p': {place}, 'x': x}})), lambda s: s.x), ','), '') AS licenses,
       CASE WHEN sentence_ids = '' THEN 0 ELSE len(string_split(sentence_ids, '|')) END::BIGINT AS n_sentences
FROM {before}
"""
