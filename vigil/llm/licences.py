"""Licence recognition: known sentences become identifiers, ordered rules read their sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import SPACE, let, text_of

#: Normalised sentences of published licences, fixed values.
SENTENCES = [
    ("gpl3-line", "this work is licensed under the gnu general public license version 3"),
    ("ccbync4-line", "licensed under cc by nc 4 0"),
    ("ccby4-line", "licensed under cc by 4 0"),
    ("ccby4-work", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit-line", "released under the mit license"),
    ("mit-under", "licensed under the mit license"),
    ("apache2-line", "licensed under the apache license version 2 0"),
    ("apache2-the", "licensed under the apache license version 2 0 the license"),
    ("apache2-comply", "you may not use this file except in compliance with the license"),
    ("apache2-obtain", "you may obtain a copy of the license at"),
    ("apache2-unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-details", "see the gnu general public license for more details"),
    ("mpl2-form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-apache2", "spdx license identifier apache 2 0"),
    ("spdx-gpl3", "spdx license identifier gpl 3 0 or later"),
]

#: Licence and the sentence identifiers that name it, longest evidence first; an earlier rule takes its sentences.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache2-the", "apache2-comply", "apache2-obtain", "apache2-unless", "apache2-see"]),
    ("Apache-2.0", ["apache2-the", "apache2-comply"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-only", ["gpl3-line"]),
    ("CC-BY-NC-4.0", ["ccbync4-line"]),
    ("CC-BY-4.0", ["ccby4-work"]),
    ("CC-BY-4.0", ["ccby4-line"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["mit-under"]),
    ("Apache-2.0", ["apache2-line"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Unlicense", ["unlicense-free"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["spdx-apache2"]),
    ("GPL-3.0-or-later", ["spdx-gpl3"]),
    ("Proprietary", ["reserved"]),
]

WRAP = r"([a-z,])\n[ \t*#/]*([a-z(])"
#: The plain cut of the oracle text, which knows no break inside a sentence.
STOP = rf"([.!?:;])[{SPACE}]+"


#: Stops in a normalised text: the end of a sentence or paragraph, a colon, semicolon or "v.", a line break.
BREAKS = [(rf"(?<=\bv)\.[{SPACE}]+|[:;][{SPACE}]+", " C "), (rf"[.!?][{SPACE}]+", " P "), (r"\n[ \t\r*#/]*\n", " P "), (r"\n", " L ")]


def normalised(text: Column) -> Column:
    """Lower-case words of letters and digits with the breaks between them as P, C or L, one at either end.

    A line break between small letters is none.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = F.translate(F.regexp_replace(text, WRAP, "$1 $2"), upper, upper.lower())
    for pattern, mark in BREAKS:
        out = F.regexp_replace(out, pattern, mark)
    return F.regexp_replace(F.concat(F.lit(" P "), out, F.lit(" P ")), "[^a-z0-9PCL]+", " ")


def _any_of(known) -> str:
    """Pattern of a whole known sentence between two breaks; inside it words may stand apart by C and L.

    Published texts have a colon, a semicolon or a line break before a capital inside a sentence, and text
    files wrap anywhere.  The longest sentence is tried first.
    """
    listed = sorted((s for _, s in known), key=len, reverse=True)
    return "(?<=[PCL] )(?:" + "|".join(s.replace(" ", "(?: [CL])*+ ") for s in listed) + ")(?= [PCL])"


def _mark(identifiers) -> str:
    return "".join(f"[{i}]" for i in identifiers)


def recognise(docs: DataFrame, known=tuple(SENTENCES), rules=tuple(RULES)) -> DataFrame:
    """(doc_id, n_known, sentence_ids, licences, n_unread) for every document.

    ``sentence_ids`` are the identifiers of the known sentences in order, repeats included.  Rules are
    tried in order on that sequence: one that finds its identifiers next to each other adds its licence and
    uses them up.  ``licences`` lists each licence once, in the order found; ``n_unread`` counts
    sentences that no rule used.  Both lists are comma-joined and empty where nothing is known.  Null text
    is empty; repeated rows are read one by one; extra columns are ignored.
    """
    names = F.array(*[F.lit(s) for _, s in known])
    ids = F.array(*[F.lit(i) for i, _ in known])
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_mark(seq)).alias("seq")) for name, seq in rules])

    def read(found):
        start = F.struct(F.array_join(F.transform(found, lambda i: F.concat(F.lit("["), i, F.lit("]"))), "").alias("left"),
                         F.array().cast("array<string>").alias("out"))
        return F.aggregate(steps, start, lambda s, r: F.when(F.contains(s["left"], r["seq"]), F.struct(
            F.replace(s["left"], r["seq"], F.lit("|")).alias("left"),
            F.concat(s["out"], F.array(r["name"])).alias("out"))).otherwise(s))

    def whole(found):
        state = F.when(F.size(found) > 0, read(found))
        return let(state, lambda s: F.struct(
            F.size(found).cast("long").alias("n_known"), F.array_join(found, ",").alias("sentence_ids"),
            F.coalesce(F.array_join(F.array_distinct(s["out"]), ","), F.lit("")).alias("licences"),
            F.coalesce(F.length(s["left"]) - F.length(F.replace(s["left"], F.lit("["), F.lit(""))), F.lit(0))
            .cast("long").alias("n_unread")))

    said = F.regexp_extract_all(normalised(F.col("_t")), F.lit(_any_of(known)), F.lit(0))
    found = F.transform(said, lambda s: F.element_at(ids, F.array_position(names, F.regexp_replace(s, "[PCL ]+", " ")).cast("int")))
    return docs.select("doc_id", text_of().alias("_t")).select("doc_id", F.inline(F.array(let(found, whole))))


def oracle(known=tuple(SENTENCES), rules=tuple(RULES)) -> str:
    """The same for DuckDB: one step per rule."""
    values = ", ".join(f"('{i}', '{s}')" for i, s in known)
    space = r"\x20\x09-\x0D"
    steps = ["r0 AS (SELECT *, marks AS left_0, ''::VARCHAR AS out_0 FROM found)"]
    for k, (name, seq) in enumerate(rules):
        steps.append(
            f"r{k + 1} AS (SELECT doc_id, n_known, sentence_ids, replace(left_{k}, '{_mark(seq)}', '|') AS left_{k + 1}, "
            f"CASE WHEN contains(left_{k}, '{_mark(seq)}') AND NOT contains(',' || out_{k} || ',', ',{name},') "
            f"THEN out_{k} || CASE WHEN out_{k} = '' THEN '' ELSE ',' END || '{name}' ELSE out_{k} END AS out_{k + 1} FROM r{k})")
    n = len(rules)
    return f"""
WITH known(id, sentence) AS (VALUES {values}),
cut AS (
  SELECT row_number() OVER () AS row_id, doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''),
         '([a-z,])\\n[ \\t*#/]*([a-z(])', '\\1 \\2', 'g'), '([.!?:;])[{space}]+', '\\1' || chr(10), 'g'), chr(10)) AS parts
  FROM documents),
lines AS (SELECT row_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS place FROM cut),
hits AS (SELECT row_id, id, place FROM lines JOIN known ON lower(trim(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))) = sentence),
found AS (
  SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(marks, '') AS marks
  FROM cut c LEFT JOIN (SELECT row_id, count(*) AS n, string_agg(id, ',' ORDER BY place) AS ids,
                        string_agg('[' || id || ']', '' ORDER BY place) AS marks FROM hits GROUP BY row_id) h USING (row_id)),
{", ".join(steps)}
SELECT doc_id, n_known, sentence_ids, out_{n} AS licences,
       (len(left_{n}) - len(replace(left_{n}, '[', '')))::BIGINT AS n_unread FROM r{n}
"""
