"""Licence scans by sentence rules.

A text is normalised with its sentence ends marked, and known licence sentences
are looked up from one end to another; the identifiers found, in text order,
form a sequence that is matched against ordered rules. A rule is a run of consecutive identifiers
(sentences that are not known in between do not matter), and names a licence.
Everything is a row expression: no shuffle, whatever the text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences (normalised: lower case, anything but
# a-z and 0-9 as one blank) with their identifiers.
SENTENCES = {
    "s01": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction including without limitation "
           "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
           "permit persons to whom the software is furnished to do so subject to the following conditions",
    "s02": "the above copyright notice and this permission notice shall be included in all copies or substantial "
           "portions of the software",
    "s03": "released under the mit license",
    "s04": "licensed under the mit license",
    "s05": "licensed under the apache license version 2 0",
    "s06": "licensed under the apache license version 2 0 the license",
    "s07": "you may not use this file except in compliance with the license",
    "s08": "unless required by applicable law or agreed to in writing software distributed under the license is "
           "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "s09": "this work is licensed under the gnu general public license version 3",
    "s10": "this work is licensed under the gnu general public license version 2",
    "s11": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
           "public license as published by the free software foundation either version 3 of the license or at your "
           "option any later version",
    "s12": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
           "public license as published by the free software foundation either version 2 of the license or at your "
           "option any later version",
    "s13": "licensed under cc by nc 4 0",
    "s14": "licensed under cc by 4 0",
    "s15": "licensed under cc by sa 4 0",
    "s16": "this work is licensed under a creative commons attribution 4 0 international license",
    "s17": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "s18": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "s19": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met",
    "s20": "redistributions of source code must retain the above copyright notice this list of conditions and the "
           "following disclaimer",
    "s21": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
           "following disclaimer in the documentation and or other materials provided with the distribution",
    "s22": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
           "products derived from this software without specific prior written permission",
    "s23": "this is free and unencumbered software released into the public domain",
    "s24": "spdx license identifier mit",
    "s25": "spdx license identifier apache 2 0",
    "s26": "spdx license identifier gpl 3 0 only",
    "s27": "spdx license identifier gpl 2 0 only",
}
# Ordered rules, (licence, identifiers in a row).
RULES = (
    ("MIT", ("s01", "s02")), ("MIT", ("s03",)), ("MIT", ("s04",)), ("MIT", ("s24",)),
    ("Apache-2.0", ("s05",)), ("Apache-2.0", ("s06", "s07")), ("Apache-2.0", ("s06", "s07", "s08")),
    ("Apache-2.0", ("s25",)),
    ("GPL-3.0", ("s09",)), ("GPL-3.0", ("s11",)), ("GPL-3.0", ("s26",)),
    ("GPL-2.0", ("s10",)), ("GPL-2.0", ("s12",)), ("GPL-2.0", ("s27",)),
    ("CC-BY-NC-4.0", ("s13",)), ("CC-BY-NC-4.0", ("s17",)),
    ("CC-BY-4.0", ("s14",)), ("CC-BY-4.0", ("s16",)), ("CC-BY-SA-4.0", ("s15",)), ("CC-BY-SA-4.0", ("s18",)),
    ("BSD-2-Clause", ("s19", "s20", "s21")), ("BSD-3-Clause", ("s19", "s20", "s21", "s22")),
    ("Unlicense", ("s23",)),
)
#: A sentence may begin and end at white space after a mark and at line ends.
SENTENCE_END = r"(?<=[.!?;:])[ \t\r\n]+|[\r\n]+"

#: Known sentences that are part of a longer one.
INNER = [(i, j) for i, a in SENTENCES.items() for j, b in SENTENCES.items() if i != j and f" {a} " in f" {b} "]


def _anywhere(sentences) -> str:
    """Pattern of the normalised sentences, ends of the text's sentences (``|``)
    allowed between their words; the longest first."""
    return "|".join(s.replace(" ", "[ |]") for s in sorted(sentences, key=len, reverse=True))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order (null: none).

    A known sentence begins and ends where one of the text does; in between
    any sentence ends may lie, so that line ends of hard-wrapped texts and
    marks inside a sentence do no harm. One-line notices and wrapped sentences
    of a text are all returned, and a known sentence within a longer one comes
    before it if it ends at a sentence end of its own."""
    marked = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "|", "/"), SENTENCE_END, "|")
    plain = F.regexp_replace(F.concat(F.lit("|"), marked, F.lit("|")), "[^a-z0-9|]+", " ")
    known = F.regexp_extract_all(F.regexp_replace(plain, r" ?\|[ |]*", "|"),
                                 F.lit(rf"\|({_anywhere(SENTENCES.values())})(?=\|)"), 1)
    table = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])

    def with_inner(found):
        own = table[F.translate(found, "|", " ")]
        inner = [F.when((own == j) & F.concat(F.lit("|"), found, F.lit("|")).rlike(rf"\|{_anywhere([SENTENCES[i]])}\|"), F.lit(i))
                 for i, j in INNER]
        return F.array_compact(F.array(*inner, own))

    return F.flatten(F.transform(known, with_inner))


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (array, text order) and ``licenses``
    (sorted, distinct). A null or empty text has neither. Columns of these
    names are replaced; repeated rows are kept."""
    base = docs.drop("sentence_ids", "licenses").withColumn("sentence_ids", sentence_ids(F.col(text_col)))
    row = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    hits = F.array(*[F.when(row.contains("," + ",".join(ids) + ","), F.lit(name)) for name, ids in RULES])
    return base.withColumn("licenses", F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))))
