"""Licence recognition by sentence rules (DataFrame functions only).

A text is cut into sentences in three readings: at sentence ends and line ends;
at sentence ends only, lines joined; and, for the layout of licence files, at
sentence ends, blank lines, list marks, copyright lines and colons at a line
end, with comment marks taken off and the other lines joined.  Sentences are
normalised (lower case, each
run of other characters than letters and digits one space) and mapped to the
numbers of known licence sentences; unknown sentences drop out.  A licence
rule is an ordered list of such numbers that must follow each other; longer
rules are matched first and consume their sentences, so that a rule contained
in another is not reported beside it.  What the readings find is united; a rule
that another reading sees as part of a longer rule is left out, unless one
reading finds both.  Sentences with a slot for a holder's name are brought to
one wording first (``SLOTS``).

Everything runs inside one projection: no explode, no shuffle.

Defined cases: null and empty texts have no licence; null ids stay null;
rows that repeat are all returned; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices and texts, by rule.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["Released under the MIT License."]),
    ("MIT", ["Licensed under the MIT License."]),
    ("MIT", ["This project is licensed under the MIT License."]),
    ("MIT", ["SPDX-License-Identifier: MIT"]),
    (
        "MIT",
        [
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ],
    ),
    ("Apache-2.0", ["Licensed under the Apache License, Version 2.0."]),
    ("Apache-2.0", ["SPDX-License-Identifier: Apache-2.0"]),
    (
        "Apache-2.0",
        [
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ],
    ),
    (
        "Apache-2.0",
        [
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        ],
    ),
    ("GPL-3.0", ["This work is licensed under the GNU General Public License, version 3."]),
    ("GPL-3.0", ["SPDX-License-Identifier: GPL-3.0-only"]),
    (
        "GPL-3.0",
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ],
    ),
    (
        "GPL-2.0",
        [
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
        ],
    ),
    (
        "BSD-2-Clause",
        [
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ],
    ),
    (
        "BSD-3-Clause",
        [
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ],
    ),
    (
        "ISC",
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        ],
    ),
    (
        "Unlicense",
        [
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ],
    ),
    (
        "MPL-2.0",
        [
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        ],
    ),
    ("CC-BY-4.0", ["Licensed under CC BY 4.0."]),
    ("CC-BY-4.0", ["This work is licensed under a Creative Commons Attribution 4.0 International License."]),
    ("CC-BY-SA-4.0", ["Licensed under CC BY-SA 4.0."]),
    (
        "CC-BY-SA-4.0",
        ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    ),
    ("CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0."]),
    (
        "CC-BY-NC-4.0",
        ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    ),
    ("CC0-1.0", ["Licensed under CC0 1.0."]),
]

# Further notices and texts.  The oracle SQL knows only RULES.
MORE_RULES: list[tuple[str, list[str]]] = [
    (
        "MIT-0",
        [
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'
        ],
    ),
    (
        "GPL-3.0",
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        ],
    ),
    (
        "LGPL-3.0",
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        ],
    ),
    (
        "LGPL-2.1",
        [
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
        ],
    ),
    (
        "AGPL-3.0",
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        ],
    ),
    (
        "ISC",
        [
            "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        ],
    ),
    (
        "0BSD",
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
        ],
    ),
    (
        "BSL-1.0",
        [
            'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'
        ],
    ),
    (
        "Zlib",
        [
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
        ],
    ),
    ("Apache-2.0", ["Apache License", "Version 2.0, January 2004"]),
    ("GPL-3.0", ["GNU General Public License", "Version 3, 29 June 2007"]),
    ("GPL-2.0", ["GNU General Public License", "Version 2, June 1991"]),
    *(
        (name, [f"SPDX-License-Identifier: {name}{kind}"])
        for name, kinds in [
            ("GPL-3.0", ["-or-later"]), ("GPL-2.0", ["-only", "-or-later"]), ("BSD-2-Clause", [""]), ("BSD-3-Clause", [""]),
            ("ISC", [""]), ("MPL-2.0", [""]), ("Unlicense", [""]), ("CC0-1.0", [""]), ("CC-BY-4.0", [""]), ("CC-BY-SA-4.0", [""]),
        ]
        for kind in kinds
    ),
]

END_OF_SENTENCE = r"[.!?][ \t]+"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def known_sentences(rules) -> tuple[list[str], list[tuple[str, str]]]:
    """Distinct normalised sentences, and the rules (longest first) as
    (licence, sequence text), a sequence being '<1><2>' of their numbers.  A
    sentence with an inner sentence end stands for the parts it is cut into."""
    known: dict[str, int] = {}
    out = []
    for licence, sentences in rules:
        ids = []
        for s in sentences:
            for part in re.sub(END_OF_SENTENCE, "\n", s.lower()).split("\n"):
                plain = re.sub(r"[\W_]+", " ", part).strip()
                ids.append(known.setdefault(plain, len(known) + 1))
        out.append((licence, ids))
    order = sorted(range(len(out)), key=lambda k: (-len(out[k][1]), k))
    return list(known), [(out[k][0], "".join(f"<{i}>" for i in out[k][1])) for k in order]


# Sentences with a slot: the pattern, its wording in RULES.
SLOTS = [
    (
        r"neither the names? of .{1,300}?[ \t]+nor the names? of (?:its|their) contributors",
        "neither the name of the copyright holder nor the names of its contributors",
    )
]


def sequence(text: Column, known: list[str]) -> Column:
    """The known sentences of a text (cut at line ends) as '<4><2>...'."""
    # no condition around it: the text would be made twice
    for pattern, wording in SLOTS:
        text = F.regexp_replace(text, pattern, wording)
    marked = F.regexp_replace(text, END_OF_SENTENCE, "\n")
    parts = F.split(F.regexp_replace(marked, NOT_WORD, " "), "\n")
    numbers = F.array(*[F.lit(s) for s in known])
    # membership is a look-up in a hash set; only what is known is numbered
    hits = F.filter(parts, lambda s: F.trim(s).isin(*known))
    ids = F.transform(hits, lambda s: F.array_position(numbers, F.trim(s)))
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")


# Licence files and comment blocks: what is replaced, in this order, so that a
# blank line stands where a sentence must end.
LAYOUT = [
    (r"\r\n?", "\n"),
    # comment marks; a star before text is left, as it may mark a list
    (r"(?m)^[ \t]*(?:/\*+|\*+/|\*(?=[ \t]*$)|//+|#+|;+|--+|>+|<!--|%+|dnl\b)[ \t]*|[ \t]*(?:\*+/|-->)[ \t]*$", ""),
    # an address on lines of its own ends the sentence before it
    (r"\s*\n[ \t*]*(https?://\S+)[ \t]*(?=\n|$)", " $1\n\n"),
    # copyright lines
    (r"(?m)^[ \t*]*(?:(?:copyright[ \t]*)?(?:\(c\)|©)[ \t]|copyright[ \t]+[0-9]{4})[^\n]*$", "\n$0\n"),
    # a star that the line before has not: a list, not a comment
    (r"(?m)^(?![ \t]*\*)([^\n]*)\n[ \t]*\*[ \t]+", "$1\n\n"),
    (r"(?m)^[ \t*]*(?:[-•·]|\(?(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})[.)])[ \t]+", "\n"),
    (r"(?<!free software):[ \t]*\n", ":\n\n"),
    (r"\n[ \t*]*\n\s*", "\u0001"),
]


def paragraphs(text: Column) -> Column:
    """A lower-case text with line ends only where the layout ends a sentence."""
    x = text
    for pattern, new in LAYOUT:
        x = F.regexp_replace(x, pattern, new)
    return F.translate(x, "\n\u0001", " \n")


FOUND = "array<struct<licence:string,p:string>>"


def matches(seq: Column, rules: list[tuple[str, str]]) -> Column:
    """Rules (licence, sequence) found in a sequence, once per occurrence."""
    table = F.array(*[F.struct(F.lit(a).alias("licence"), F.lit(p).alias("p")) for a, p in rules])
    start = F.struct(seq.alias("left"), F.array().cast(FOUND).alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        p = rule["p"]
        n = ((F.length(acc["left"]) - F.length(F.replace(acc["left"], p, F.lit("")))) / F.length(p)).cast("int")
        return F.struct(
            F.replace(acc["left"], p, F.lit("#")).alias("left"), F.concat(acc["found"], F.array_repeat(rule, n)).alias("found")
        )

    return F.when(seq == "", F.array().cast(FOUND)).otherwise(F.aggregate(table, start, step, lambda acc: acc["found"]))


def united(found: list[Column]) -> Column:
    """Distinct rules of all readings without those that are part of a longer
    one of another reading."""
    every = F.array_distinct(F.concat(*found))

    def beside(a: Column, b: Column) -> Column:
        one = F.lit(False)
        for f in found:
            one = one | (F.array_contains(F.transform(f, lambda x: x["p"]), a) & F.array_contains(F.transform(f, lambda x: x["p"]), b))
        return one

    def part(x: Column) -> Column:
        return F.exists(every, lambda q: (q["p"] != x["p"]) & F.contains(q["p"], x["p"]) & ~beside(x["p"], q["p"]))

    return F.filter(every, lambda x: ~part(x))


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: list[tuple[str, list[str]]] = RULES + MORE_RULES,
) -> DataFrame:
    """One row per document: doc_id, n_sentences (known licence sentences),
    n_matches (occurrences of rules in the reading with most, at least the
    number of different rules), licences (distinct, sorted, comma-joined)."""
    known, table = known_sentences(rules)
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    lines = F.translate(text, "\r", "\n")
    seqs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        sequence(lines, known).alias("by_line"),
        sequence(F.translate(lines, "\n", " "), known).alias("wrapped"),
        # without line ends the two readings are one
        F.when(F.instr(lines, "\n") > 0, sequence(paragraphs(text), known)).otherwise("").alias("laid_out"),
    )
    readings = ["by_line", "wrapped", "laid_out"]
    found = seqs.select("doc_id", *readings, *[matches(F.col(r), table).alias(f"{r}_found") for r in readings])

    def count(seq: str) -> Column:
        return F.length(seq) - F.length(F.replace(F.col(seq), F.lit("<"), F.lit("")))

    found = found.withColumn("all_found", united([F.col(f"{r}_found") for r in readings]))
    return found.select(
        "doc_id",
        F.greatest(*[count(r) for r in readings]).cast("long").alias("n_sentences"),
        F.greatest(*[F.size(f"{r}_found") for r in readings], F.size("all_found")).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("all_found", lambda x: x["licence"]))), ",").alias("licences"),
    )


def oracle_sql(rules=RULES) -> str:
    """The scan of ``documents`` by ``rules`` in DuckDB SQL, in the first two
    readings."""
    known, table = known_sentences(rules)
    quoted = ", ".join("'" + s.replace("'", "''") + "'" for s in known)

    def seq(text: str) -> str:
        marked = f"regexp_replace({text}, '[.!?][ \\t]+', chr(10), 'g')"
        parts = f"string_split(regexp_replace({marked}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10))"
        ids = f"list_filter(list_transform({parts}, lambda s: coalesce(list_position([{quoted}], trim(s, ' ')), 0)), lambda i: i > 0)"
        return f"coalesce(list_aggregate(list_transform({ids}, lambda i: '<' || i || '>'), 'string_agg', ''), '')"

    cols, numbers = [], []
    for side in ("a", "b"):
        for k, (_, p) in enumerate(table):
            was = f"{side}{k}"
            cols.append(f"(length({was}) - length(replace({was}, '{p}', ''))) // {len(p)} AS n{side}{k}")
            cols.append(f"replace({was}, '{p}', '#') AS {side}{k + 1}")
            numbers.append(f"n{side}{k}")
    shown = []
    for k, (licence, p) in enumerate(table):
        # left out: part of a longer rule that only the other reading has
        part = [
            f"((na{j} > 0 OR nb{j} > 0) AND NOT (na{k} > 0 AND na{j} > 0) AND NOT (nb{k} > 0 AND nb{j} > 0))"
            for j, (_, q) in enumerate(table) if q != p and p in q
        ]
        free = f" AND NOT ({' OR '.join(part)})" if part else ""
        shown.append(f"CASE WHEN (na{k} > 0 OR nb{k} > 0){free} THEN '{licence}|{p}' END")
    total = {side: " + ".join(n for n in numbers if n[1] == side) for side in ("a", "b")}
    slots = "{x}"
    for pattern, wording in SLOTS:
        slots = f"regexp_replace({slots}, '{pattern}', '{wording}', 'g')"
    by_line, wrapped = (slots.replace("{x}", x) for x in ("x", "translate(x, chr(10), ' ')"))
    return f"""
WITH t AS (
  SELECT doc_id, translate(lower(coalesce(text, '')), chr(13), chr(10)) AS x FROM documents
), s AS (
  SELECT doc_id, {seq(by_line)} AS a0, {seq(wrapped)} AS b0 FROM t
), m AS (
  SELECT doc_id, a0, b0, {", ".join(cols)} FROM s
), r AS (
  SELECT *, list_distinct(list_filter([{", ".join(shown)}], lambda x: x IS NOT NULL)) AS found FROM m
)
SELECT doc_id,
       CAST(greatest(length(a0) - length(replace(a0, '<', '')), length(b0) - length(replace(b0, '<', ''))) AS BIGINT) AS n_sentences,
       CAST(greatest({total["a"]}, {total["b"]}, len(found)) AS BIGINT) AS n_matches,
       array_to_string(list_sort(list_distinct(list_transform(found, lambda x: split_part(x, '|', 1)))), ',') AS licences
FROM r
"""
