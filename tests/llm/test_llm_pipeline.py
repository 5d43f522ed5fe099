"""The pipeline's stages against brute force, on whole small tables."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as C
from normsmith.llm.common import stage
from normsmith.llm.quality_gbdt import score_quality
from test_llm_dedup import brute_exact, brute_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The result of each stage, from documents with repeated rows, nulls
    and a further column."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (3, None, "en", "src1", 0), (3, None, "en", "src1", 0)], docs.schema
    )
    docs = docs.union(docs.limit(5)).union(odd).selectExpr("*", "1 as kept", "'x' as sha", "2 as copies")
    out = [docs]
    for _, f in C.STAGES:
        out.append(stage(f(spark, out[-1], SF)))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(tables):
    for t in tables[1:-1]:
        assert t.columns == tables[0].columns


def test_quality_stage(spark, tables):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {(r.doc_id, r.text_hash) for r in score_quality(tables[0], labels).where("predicted = 1").collect()}
    hashed = tables[0].selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as h").collect()
    want = Counter((r.doc_id, r.text) for r in hashed if (r.doc_id, r.h) in good)
    assert Counter(rows(tables[1])) == want


def test_rows_that_share_an_id_are_judged_apart(spark):
    """Two rows without id, of which the classifier keeps one, and near copies
    without id, of which one stays and is taken at most twice."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = score_quality(docs, labels)
    some = {v: scored.where(f"predicted = {v}").select("doc_id").first()[0] for v in (0, 1)}
    pair = docs.where(docs.doc_id.isin(list(some.values()))).withColumn("doc_id", F.lit(None).cast("long"))
    both = docs.unionByName(pair)
    kept = C.quality(spark, both, SF).where("doc_id is null").select("text").collect()
    good = docs.where(docs.doc_id == some[1]).first().text
    assert [r.text for r in kept] == [good]
    base = " ".join(f"word{i}" for i in range(300))
    near = [(None, base + " tail one", "en", "s", 1), (None, base + " tail two", "en", "s", 1), (None, "another text of its own kind", "en", "s", 1)]
    left = C.dedup_near(spark, spark.createDataFrame(near, docs.schema), SF)
    assert sorted(r.text[-4:] for r in left.collect()) in (["kind", " one"[-4:]], ["kind", " two"[-4:]], [" one", "kind"], [" two", "kind"])
    mixed = Counter(r.text for r in C.mix_sources(spark, left, SF).collect())
    assert set(mixed) <= {r.text for r in left.collect()} and max(mixed.values()) <= 2


def test_exact_stage(tables):
    was = rows(tables[1])
    first = {}
    for i, t in sorted(was, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    got = rows(tables[2])
    assert Counter(i for i, _ in got) == Counter(first.values())
    assert len(brute_exact([r for r in got if r[0] is not None])) == len([r for r in got if r[0] is not None])


def test_near_stage(tables):
    was = rows(tables[2])
    want = [i for i, c, _ in brute_join(sorted(was, key=lambda r: (r[0] is None, r[0] or 0))) if i == c]
    assert sorted((i for i, _ in rows(tables[3])), key=str) == sorted(want, key=str)


def test_mix_stage(tables):
    was, got = Counter(rows(tables[3])), Counter(rows(tables[4]))
    assert all(r in was and n <= 2 for r, n in got.items())
    words = lambda c: sum(len((t or "").split()) * n for (_, t), n in c.items())
    assert words(got) == pytest.approx(1.5 * words(was), rel=0.1)


def test_token_stage(tables):
    t = Tokenizer.from_file(C.tokenizer_path())
    want = Counter()
    for i, text in rows(tables[4]):
        ids = t.encode(text or "", add_special_tokens=False).ids
        shown = t.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(shown.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in tables[5].collect()) == want


def test_registered():
    names = list(E.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
