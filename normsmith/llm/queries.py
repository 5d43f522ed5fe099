"""Registered queries of the llm operators: thin callers over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import table
from .conversation_repair import repair_damaged
from .exact_dedup import exact_dedup
from .html_template import extract_main_text
from .kd_shards import kd_shards
from .langid import identify_languages
from .lexical_search import ranked_search
from .license_scan import license_scan
from .license_scan import oracle_sql as license_oracle
from .mixing import mix
from .ngram_join import ngram_join
from .pivot_index import near_duplicates
from .quality_gbdt import score_quality
from .warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


@register("op9_exact_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op9_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def tokenizer_path() -> str:
    """The tokenizer file of the word BPE (a file on the driver)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op6_bpe_encode_decode")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), digest=True).withColumnsRenamed(
        {"ids": "ids_sha256", "decoded": "decoded_sha256"}
    )


@register("op4_mix_sources")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("text_hash")


@register("op10_quality_gbdt")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


@register("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("text_hash")


ORACLE["op3_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, len(ws) AS n, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END AS grams
  FROM w
), g AS (SELECT DISTINCT doc_id, md5(unnest(grams)) AS gram FROM s),
c AS (SELECT doc_id, count(*) AS k FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE p.k * 9 >= 4 * (cx.k + cy.k)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x),
m AS (SELECT doc_id, min(o) AS class_id FROM r GROUP BY doc_id),
d AS (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x)
SELECT s.doc_id, m.class_id, coalesce(d.n_links, 0) AS n_links,
       CASE WHEN s.n = 0 THEN 0 ELSE greatest(s.n - 4, 1) END AS n_grams, s.doc_id = m.class_id AS kept
FROM s JOIN m ON s.doc_id = m.doc_id LEFT JOIN d ON s.doc_id = d.doc_id
"""


@register("op8_pivot_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op7_warc_reassembly")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE["op7_warc_reassembly"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


@register("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


ORACLE["op1_license_scan"] = license_oracle()


@register("op2_html_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@register("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@register("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


@register("op12_ranked_search")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op12_ranked_search"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), d AS (SELECT k, doc_id, CAST(len(ts) AS BIGINT) AS n FROM t WHERE len(ts) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM t) GROUP BY k, term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), r AS (
  SELECT item_id, doc_id, p.k,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (k), s
  GROUP BY item_id, doc_id, p.k
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
         doc_id, score
  FROM r WHERE score > 0
) WHERE rank <= 50
"""


@register("op13_kd_shards")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
