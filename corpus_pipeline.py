"""Corpus pipeline: documents in, token digests of a training mix out.

Each stage takes (spark, docs, sf_dir), works on all documents that the one
before it kept and returns the columns of documents (the last one the token
digests).  The driver's check writes each result as Parquet and reads it
again; ``run`` does the same through the shared checkpoint folder, so that no
stage recomputes another and the loss of an executor costs only its tasks.

1. quality: documents that the quality classifier rejects go.
2. exact dedup: of equal texts the document with the smallest id stays.
3. near dedup: of each group linked by n-gram Jaccard similarity one stays.
4. mix: documents left out of the mix go, those taken twice come twice.
5. tokens: BPE digests per remaining row.

A classifier has no SQL form, so there is no oracle SQL for the whole; the
tests compare the stages with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normsmith.llm.bpe import bpe_encode
from normsmith.llm.common import delete, table
from normsmith.llm.exact_dedup import exact_dedup
from normsmith.llm.mixing import mix
from normsmith.llm.ngram_join import ngram_join
from normsmith.llm.quality_gbdt import score_quality
from normsmith.llm.queries import tokenizer_path
from normsmith.session import ensure_checkpoint_dir, scratch, track

ORACLE_SQL: str | None = None


def numbered(docs: DataFrame) -> tuple[DataFrame, str, list]:
    """``docs`` under names that clash with nothing, the name of its id
    column, and the columns that restore it."""
    names = [f"_{k}" for k in range(len(docs.columns))]
    restore = [F.col(n).alias(c) for n, c in zip(names, docs.columns)]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], restore


def told_apart(docs: DataFrame) -> tuple[DataFrame, str, list]:
    """``numbered`` with the hash of the text as ``text_hash``: rows that share
    an id, or have none, are judged by id and text together."""
    rows, at, restore = numbered(docs)
    text = F.coalesce(F.col(f"_{docs.columns.index('text')}").cast("string"), F.lit(""))
    return rows.withColumn("text_hash", F.xxhash64(text)), at, restore


def keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are among the decisions'."""
    rows, at, restore = told_apart(docs)
    kept = decisions.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    same = F.col(at).eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    return rows.join(kept, same, "left_semi").select(*restore)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = score_quality(docs, table(spark, sf_dir, "labels"))
    return keep(docs, scores.where("predicted = 1"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    rows, at, restore = numbered(docs)
    text = F.coalesce(F.col(f"_{docs.columns.index('text')}"), F.lit(""))
    # the digest again, as rows may share an id
    rows = rows.withColumn("sha", F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), 256))
    one = rows.join(kept, F.col(at).eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
    return one.dropDuplicates([at, "sha"]).select(*restore)  # rows that repeat both id and text


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, ngram_join(docs).where("kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    taken = mix(docs).select(F.col("doc_id").alias("mix_id"), F.col("text_hash").alias("mix_hash"), copies.alias("copies"))
    # rows that repeat id and text are taken alike
    taken = taken.groupBy("mix_id", "mix_hash").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows, at, restore = told_apart(docs)
    out = rows.join(taken, F.col(at).eqNullSafe(F.col("mix_id")) & (F.col("text_hash") == F.col("mix_hash")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*restore)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_encode(docs, tokenizer_path(), digest=True).withColumnsRenamed(
        {"ids": "ids_sha256", "decoded": "decoded_sha256"}
    )


STAGES = [
    ("quality", quality),
    ("exact dedup", dedup_exact),
    ("near dedup", dedup_near),
    ("mix", mix_sources),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, f in STAGES[:-1]:
        made: list[DataFrame] = []
        with scratch(spark):  # what a stage's operator staged goes when its documents are written
            made.append(f(spark, docs, sf_dir))
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/normsmith-docs-{uuid.uuid4().hex}"
            made[0].write.option("compression", "zstd").parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.schema(made[0].schema).parquet(path), path
    track(last)
    return STAGES[-1][1](spark, docs, sf_dir)
