"""BPE, mixing, quality, licences: against libraries, brute force, edges."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from normsmith.llm.bpe import Bpe, bpe_encode
from normsmith.llm.license_scan import MORE_RULES, RULES, license_scan
from normsmith.llm.mixing import mix
from normsmith.llm.quality_gbdt import FEATURES, fit, score_quality, statistics
from normsmith.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
EDGE = [
    (1, None, None, 7), (2, "", "x", 1), (3, " \n ", "x", 2), (4, "word " * 30000, "y", 3), (5, "same", None, 4),
    (5, "same", None, 4), (None, "no id", "é", 5), (6, "a|b\x00c", "z", 6),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, source string, size int")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return Bpe(f.read())


def same(library, own, texts):
    for x, a, b in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.encode(texts)):
        assert a.ids == b.tolist(), ascii(x)
        assert library.decode(a.ids, skip_special_tokens=False) == own.decode(b)


def test_bpe_code_points(library, own):
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x11000), *range(0x1D000, 0x1F000)]]
    same(library, own, [f"a{c}b" for c in points])


def test_bpe_mixtures(library, own):
    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "don't", "  ", "\x1c", "é", "́", "Σ", "İ", "aaaaaaa"]
    parts += ["!!!!!", "123", "\n", "<|endof", "text|>", "࢘", "᷷", "࡛", "՘", "Ɤ", "x" * 50]
    same(library, own, ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)])
    same(library, own, ["ab" * 5000, "x" * 3000, ""])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_bpe_any_text(library, own, text):
    same(library, own, [text])


def test_bpe_query(spark, library, edge):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = d.union(edge.select("doc_id", "text"))
    want = []
    for i, t in map(tuple, d.collect()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = bpe_encode(d, tokenizer_path(), digest=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    plain = bpe_encode(edge, tokenizer_path()).where("doc_id = 5").first()
    assert plain.decoded == "same</w>" and len(plain.ids) == plain.n_tokens == 1
    assert bpe_encode(edge.limit(0), tokenizer_path()).count() == 0


# -------------------------------------------------------------------- mixing
def brute_targets(sizes):
    keys = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [k for k in keys if k not in capped]
        rest, w = total - sum(2 * sizes[k] for k in capped), sum(weight[k] for k in open_)
        above = {k for k in open_ if rest * weight[k] / w > 2 * sizes[k]}
        if not above:
            return {k: 2.0 * sizes[k] if k in capped else rest * weight[k] / w for k in keys}
        capped |= above


def test_mix(spark, edge):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in d.collect()]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes, largest = Counter(), Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
        largest[s] = max(largest[s], size[i])
    targets, source, taken = brute_targets(sizes), {i: s for i, _, s in rows}, Counter()
    out = mix(d).collect()
    assert len(out) == len(rows)
    for r in out:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[s]
        assert r.target == pytest.approx(targets[s]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mix(d.repartition(3)).collect()))


def test_mix_edges(spark, edge):
    got = mix(edge).collect()
    assert len(got) == len(EDGE)
    assert [r.source_size for r in got if r.doc_id == 5] == [2, 2]
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert mix(edge.limit(0)).count() == 0


# ------------------------------------------------------------------- quality
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = score_quality(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    m = out.merge(labels.toPandas(), on="doc_id")
    held = m[m.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame(
        [(1, 1, None), (5, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int"
    )
    assert score_quality(edge, labels).count() == len(EDGE)
    assert {r.score for r in score_quality(edge, labels.limit(0)).collect()} == {0.8}
    assert score_quality(edge.limit(0), labels).count() == 0


def test_statistics_by_hand():
    import pyarrow as pa

    x = dict(zip(FEATURES, statistics(pa.array(["", "Aa b b!\né 12 b!"]))[1].tolist()))
    n = len("Aa b b!\né 12 b!".encode())
    assert x["upper"] == pytest.approx(1 / n) and x["digit"] == pytest.approx(2 / n)
    assert x["line"] == pytest.approx(1 / n) and x["mark"] == pytest.approx(2 / n)
    assert x["distinct_words"] == pytest.approx(5 / 6) and x["top_word"] == pytest.approx(2 / 6)
    assert x["marked_words"] == pytest.approx(2 / 6)


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = model.start
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.cut[at] else model.right[at]
            total += model.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], model.score(x[:50]))


# ------------------------------------------------------------------ licences
def test_license_rules(spark, edge):
    rows = [(k, " \n".join(["foo bar.", *s]) + "\nrest here") for k, (_, s) in enumerate(RULES)]
    rows.append((900, "# Licensed under the Apache License,\n# Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License."))
    rows.append((901, "no stop %%%\nReleased under the MIT License.\nReleased under the MIT License."))
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, _) in enumerate(RULES):
        assert got[k].licences == name and got[k].n_matches == 1
    assert got[900].licences == "Apache-2.0"
    assert (got[901].licences, got[901].n_matches) == ("MIT", 2)
    out = license_scan(edge).collect()
    assert len(out) == len(EDGE) and {r.licences for r in out} == {""}
    assert license_scan(edge.limit(0)).count() == 0
    plan = license_scan(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


MIT = """MIT License

Copyright (c) 2020 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
APACHE = """Copyright 2020 Foo

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""
GPL = """Copyright (C) 2020  Foo

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
ISC = """ISC License

Copyright (c) 2020 Foo

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
BSD = """BSD 3-Clause License

Copyright (c) 2020, Foo

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_license_files_as_published(spark):
    """Licence texts in their published columns, plain and in comments."""
    texts = {"MIT": (MIT, 2), "Apache-2.0": (APACHE, 2), "GPL-3.0": (GPL, 2), "ISC": (ISC, 1), "BSD-3-Clause": (BSD, 3), "MPL-2.0": (MPL, 2)}
    rows, want = [], {}
    for name, (t, n) in texts.items():
        c_block = "/*\n" + "".join(f" * {line}".rstrip() + "\n" for line in t.splitlines()) + " */\nint x;\n"
        forms = [t, "A heading\n\n" + t + "\nmore text", t.replace("\n", "\r\n"), c_block]
        forms += ["".join(f"{mark} {line}".rstrip() + "\n" for line in t.splitlines()) for mark in ("#", "//", "--", ";")]
        for f in forms:
            want[len(rows)] = (name, n)
            rows.append((len(rows), f))
    # other list marks, no blank line behind the copyright line
    for old, new in ((r"(?m)^(\d)\. ", r"(\1) "), (r"(?m)^(\d)\. ", r"\1) "), (r"(?m)^\d\. ", "* "), (r"(?m)^\d\. ", "- ")):
        want[len(rows)] = ("BSD-3-Clause", 3)
        rows.append((len(rows), re.sub(r"\n\n", "\n", re.sub(old, new, BSD))))
    for name, t in (("MIT", MIT), ("Apache-2.0", APACHE), ("GPL-3.0", GPL)):
        want[len(rows)] = (name, 2)
        rows.append((len(rows), t.replace("Foo\n\n", "Foo\n")))
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licences, r.n_sentences) for r in got} == want
    assert {r.n_matches for r in got} == {1}


def test_more_license_rules(spark):
    rows = [(k, "Copyright 2020 Foo\n" + "\n".join(s) + "\n\nrest") for k, (_, s) in enumerate(MORE_RULES)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licences, r.n_matches) for r in got} == {k: (name, 1) for k, (name, _) in enumerate(MORE_RULES)}


def test_readings_are_united(spark):
    """A licence part of which only one reading sees, a holder's name in a
    clause, two licences seen by different readings."""
    bsd2, bsd3 = (next(t for n, t in RULES if n == name) for name in ("BSD-2-Clause", "BSD-3-Clause"))
    third = bsd3[2].replace("may be used", "may be\nused")
    named = bsd3[2].replace("the copyright holder", "Example Corp. Inc.")
    rows = [
        (1, "\n".join([*bsd3[:2], third])),
        (2, "\n".join([*bsd3[:2], named])),
        (3, "\n".join(bsd2)),
        (4, "\n".join([*bsd2, "", "Released under the MIT License.", "", *bsd3])),
        (5, "Released under the MIT License.\nLicensed under the Apache License,\nVersion 2.0."),
    ]
    got = {r.doc_id: (r.licences, r.n_matches) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == ("BSD-3-Clause", 1) and got[3] == ("BSD-2-Clause", 1)
    assert got[4][0] == "BSD-2-Clause,BSD-3-Clause,MIT" and got[4][1] >= 3
    assert got[5][0] == "Apache-2.0,MIT" and got[5][1] == 2
