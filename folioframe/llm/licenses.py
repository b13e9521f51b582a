"""Licence scan: normalised sentences become identifiers, whose sequences are matched with ordered rules.

Everything is column expressions over each document alone: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names by which notices call licences, ways they say so, and sentences of public licence texts.
NAMES = {
    "MIT": ("the mit license", "mit license", "the mit licence"),
    "Apache-2.0": ("the apache license version 2 0", "apache license 2 0", "the apache license 2 0", "apache 2 0"),
    "GPL-2.0": ("the gnu general public license version 2", "gnu gpl version 2", "gpl 2 0"),
    "GPL-3.0": ("the gnu general public license version 3", "gnu gpl version 3", "gpl 3 0", "the gnu gpl v3"),
    "LGPL-3.0": ("the gnu lesser general public license version 3", "lgpl 3 0"),
    "AGPL-3.0": ("the gnu affero general public license version 3", "agpl 3 0"),
    "MPL-2.0": ("the mozilla public license version 2 0", "mpl 2 0"),
    "BSD-3-Clause": ("the bsd 3 clause license", "a bsd style license", "the bsd license"),
    "ISC": ("the isc license",),
    "Unlicense": ("the unlicense",),
    "CC0-1.0": ("cc0", "cc0 1 0"),
    "CC-BY-4.0": ("cc by 4 0", "a creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0",),
}
WAYS = ("licensed under", "released under", "distributed under", "available under", "this work is licensed under", "this project is licensed under", "this software is released under", "this file is licensed under")
SENTENCES = {
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache.may": "you may not use this file except in compliance with the License",
    "apache.copy": "You may obtain a copy of the License at",
    "apache.basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl.copy": "You should have received a copy of the GNU General Public License along with this program",
    "unlicense.domain": "This is free and unencumbered software released into the public domain",
}
#: Sentences end here before white space or the end of the text; so does a line in the second reading of a text.
END = r"([.!?;:])\s+|\n[ \t\r]*\n"
END_OR_LINE = r"([.!?;:])\s+|\n"


def normal(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def sentences(name: str) -> dict[str, str]:
    """A known text's sentences as documents are split: identifier to sentence, numbered where there are several."""
    parts = [p for p in map(normal, re.sub(END, "\x01", SENTENCES[name]).split("\x01")) if p]
    return {name: parts[0]} if len(parts) == 1 else {f"{name}.{n}": p for n, p in enumerate(parts, 1)}


#: (licence, texts in order). A rule that lies inside another that fits is passed over.
TEXTS = (
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty")), ("MIT", ("mit.grant", "mit.notice")), ("ISC", ("isc.grant",)),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")), ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("Apache-2.0", ("notice.Apache-2.0", "apache.may")), ("Apache-2.0", ("apache.may", "apache.copy", "apache.basis")), ("Apache-2.0", ("notice.Apache-2.0", "apache.may", "apache.copy", "apache.basis")),
    ("GPL-3.0", ("gpl.free",)), ("GPL-3.0", ("gpl.free", "gpl.hope")), ("GPL-3.0", ("gpl.free", "gpl.hope", "gpl.copy")), ("Unlicense", ("unlicense.domain",)),
    *((name, (f"notice.{name}",)) for name in NAMES), *((name, ("spdx", f"spdx.{name}")) for name in NAMES),
)
#: The same with each text's sentences for it.
RULES = tuple((name, tuple(i for t in texts for i in (sentences(t) if t in SENTENCES else [t]))) for name, texts in TEXTS)
#: Every rule has a sentence that holds one of these words, so other texts need no look-up; every sentence but the names
#: below holds one of these or those in HELD.
ANCHORS = ("licen", "permission", "warrant", "redistribution", "domain", "under")
HELD = (*ANCHORS, "software", "copyright")
#: But the licences' own names, which stand alone after "SPDX-License-Identifier: ".
ALONE = "^[^a-z0-9]*(?:" + "|".join(normal(i).replace(" ", "[^a-z0-9]+") for i in NAMES) + ")[^a-z0-9]*$"


def dictionary() -> dict[str, str]:
    known = {s: i for name in SENTENCES for i, s in sentences(name).items()}
    known |= {f"{way} {name}{tail}": f"notice.{i}" for i, names in NAMES.items() for name in names for way in WAYS for tail in ("", " the license")}
    known |= {"spdx license identifier": "spdx"} | {normal(i): f"spdx.{i}" for i in NAMES}
    known |= {f"spdx license identifier {normal(i)}": f"notice.{i}" for i in NAMES}
    return known


def identifiers(text: Column, end: str) -> Column:
    """The known sentences' identifiers, in order, as >a>b>c>; > alone where there are none."""
    known = F.create_map(*[F.lit(x) for pair in dictionary().items() for x in pair])
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split(F.regexp_replace(lower, end, "\x01"), "\x01")
    # a name begins with its first two letters or after signs, which spares most sentences the second pattern
    alone = lambda s: (~F.substring(s, 1, 1).between("a", "z") | F.substring(s, 1, 2).isin(*sorted({normal(i)[:2] for i in NAMES}))) & F.rlike(s, F.lit(ALONE))
    likely = F.filter(parts, lambda s: F.rlike(s, F.lit("|".join(HELD))) | alone(s))
    ids = F.transform(likely, lambda s: known[F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))])
    return F.concat(F.lit(">"), F.array_join(F.transform(F.filter(ids, lambda i: i.isNotNull()), lambda i: F.concat(i, F.lit(">"))), ""))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, rule: a row for each licence rule that a document's sentences follow.

    Each text is read twice, with sentences running over line ends and with lines ending them. Null and empty texts
    hold none; null ids are kept; repeated rows are reported once.
    """
    text = F.col("text").cast("string")
    # plain searches spare nearly all texts the patterns; lower() knows more letters than the patterns do, which does no harm here
    held = reduce(or_, (F.contains(F.col("low"), F.lit(a)) for a in ANCHORS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("low", F.lower("text")).where(held).drop("low")
    # exploded from an array of one, since filters would otherwise move below and read the texts again
    rows = rows.select("doc_id", F.explode(F.array(F.array_distinct(F.array(identifiers(F.col("text"), END), identifiers(F.col("text"), END_OR_LINE))))).alias("sequences"))
    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(">" + ">".join(ids) + ">").alias("rule")) for name, ids in RULES])
    rows = rows.where(F.exists("sequences", lambda s: s != ">")).withColumn("fit", F.filter(rules, lambda r: F.exists("sequences", lambda s: F.contains(s, r["rule"]))))
    longest = F.filter("fit", lambda r: ~F.exists("fit", lambda o: (o["rule"] != r["rule"]) & F.contains(o["rule"], r["rule"])))
    return rows.select("doc_id", F.explode(longest).alias("r")).select("doc_id", F.col("r.license").alias("license"), F.col("r.rule").alias("rule")).distinct()


def oracle() -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(a)}, {q(b)})" for a, b in dictionary().items())
    rules = ", ".join(f"({q(n)}, {q('>' + '>'.join(i) + '>')})" for n, i in RULES)
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    read = " UNION ALL ".join(f"SELECT r, doc_id, {k} AS reading, unnest(string_split(regexp_replace({lower}, {q(end)}, chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace({lower}, {q(end)}, chr(1), 'g'), chr(1)), 1) AS i FROM d" for k, end in enumerate((END, END_OR_LINE)))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), known(key, id) AS (VALUES {known}), rules(license, rule) AS (VALUES {rules}),
    parts AS ({read}),
    seqs AS (SELECT r, doc_id, reading, '>' || string_agg(id || '>', '' ORDER BY i) AS seq FROM parts JOIN known ON key = trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) GROUP BY ALL),
    fit AS (SELECT DISTINCT r, doc_id, license, rule FROM seqs JOIN rules ON contains(seq, rule))
    SELECT DISTINCT doc_id, license, rule FROM fit f WHERE NOT EXISTS (SELECT 1 FROM fit o WHERE o.r = f.r AND o.rule <> f.rule AND contains(o.rule, f.rule))"""
