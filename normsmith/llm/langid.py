"""Language identification of web pages by Bayesian evidence fusion.

Four pieces of evidence give a posterior over the languages of a labelled
text table:

* text: naive Bayes over hashed byte trigrams of the page's main text, with
  counts from all labelled texts; as neighbouring trigrams are not
  independent, a text counts as at most ``worth`` trigrams;
* declared markup language (``lang`` of the html element): right with
  probability ``trust``, otherwise any other language;
* address: the country suffix of the host, where it names a language, with
  probability ``suffix_trust``;
* host prior: soft counts of the text evidence, summed by host and by suffix
  in grouped aggregations, smoothed hierarchically (host to suffix to all
  pages) and without the page's own share.

Per page only a few numbers are kept; counts, sums and joins run in Spark,
and the driver sees one trigram table per language.

Defined cases: null or empty html has no text evidence; an undeclared or
unknown language and a suffix without language are neutral; a page without
host has the prior of all pages; without labelled texts the result has null
languages; rows that repeat are all returned; null ids stay null; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rid, small_batches, stage, unrid
from .html_template import attributes, block_text, main_parts, parse, TOKEN, Node

BITS = 13  # of the hashed trigrams
# Country suffixes and the language that they suggest.
SUFFIXES = {
    "de": "de", "at": "de", "li": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es",
    "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl",
    "se": "sv", "dk": "da", "no": "no", "fi": "fi", "ru": "ru", "cz": "cs", "gr": "el", "tr": "tr", "jp": "ja", "cn": "zh",
}
DECLARED = re.compile(r"<html\b", re.I)


def trigrams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of a lower-cased text with single spaces."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def plain(text: str) -> bytes:
    return f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table of trigram counts per language and task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            t = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
            t += np.bincount(trigrams(plain(text)), minlength=1 << BITS)
    for lang, t in total.items():
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(t[at])], names=["lang", "gram", "n"]
        )


def fit_text(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language x trigram)."""
    rows = labelled.select(
        F.lower(F.col(lang_col).cast("string")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).where("lang is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow().to_pydict()  # at most 2**BITS rows per language
    langs = sorted(set(table["lang"]))
    number = {x: k for k, x in enumerate(langs)}
    out = np.full((len(langs), 1 << BITS), 0.5)
    for lang, gram, n in zip(table["lang"], table["gram"], table["n"]):
        out[number[lang], gram] += n
    return langs, np.log(out / out.sum(1, keepdims=True))


def declared_language(html: str) -> str | None:
    """Primary subtag of the html element's lang attribute."""
    start = DECLARED.search(html)
    m = TOKEN.match(html, start.start()) if start else None
    if not m:
        return None
    a = attributes(Node("html", (m[3] if m[2] else m[6]) or "", None))
    tag = a.get("lang") or a.get("xml:lang") or ""
    return tag.strip().lower().replace("_", "-").split("-")[0] or None


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def evidence(langs: list[str], logp: np.ndarray, worth: float, trust: float):
    """Pages in; text log likelihoods, their posterior and the declared
    language's log likelihoods out."""
    number = {x: k for k, x in enumerate(langs)}
    many = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            text, declared, size, said = np.zeros((n, many)), np.zeros((n, many)), [], []
            for k, html in enumerate(batch.column("html").to_pylist()):
                grams = trigrams(plain(block_text(main_parts(parse(html))[0])))
                size.append(len(grams))
                if len(grams):
                    text[k] = logp[:, grams].sum(1) * min(1.0, worth / len(grams))
                tag = declared_language(html)
                said.append(tag)
                if tag in number and many > 1:
                    declared[k] = math.log((1 - trust) / (many - 1))
                    declared[k, number[tag]] = math.log(trust)
            lists = [
                pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * many, pa.array(x.ravel()))
                for x in (text, softmax(text), declared)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("page", "url", "host", "suffix")]
                + [pa.array(size, pa.int64()), pa.array(said, pa.string()), *lists],
                names=["page", "url", "host", "suffix", "n", "declared", "text", "soft", "markup"],
            )

    return run


def summed(df: DataFrame, by: list[str], many: int) -> DataFrame:
    """Sum of the ``soft`` arrays by group, as array ``sums``."""
    sums = [F.sum(F.col("soft")[k]).alias(f"s{k}") for k in range(many)]
    out = df.groupBy(*by).agg(*sums) if by else df.agg(*sums)
    return out.select(*by, F.array(*[F.coalesce(f"s{k}", F.lit(0.0)) for k in range(many)]).alias("sums"))


def smoothed(sums: Column, prior: Column, strength: float) -> Column:
    """(counts + strength * prior) / (all counts + strength), per language."""
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(sums, prior, lambda n, p: (n + strength * p) / (total + strength))


def identify_languages(
    pages: DataFrame,
    labelled: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    worth: float = 40.0,
    trust: float = 0.9,
    suffix_trust: float = 0.7,
    strength: float = 10.0,
) -> DataFrame:
    """One row per page: page_id, lang (most probable), confidence (its
    posterior), text_lang (by text alone), declared, n_trigrams."""
    small_batches(pages.sparkSession)
    langs, logp = fit_text(labelled)
    many = len(langs)
    host = F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(
        rid(id_col).alias("page"),
        F.col(url_col).cast("string").alias("url"),
        F.when(host != "", host).alias("host"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("suffix", F.substring_index("host", ".", -1))
    if not many:
        return rows.select(
            unrid("page").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"),
            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(0).cast("long").alias("n_trigrams"),
        )
    seen = stage(
        rows.mapInArrow(
            evidence(langs, logp, worth, trust),
            "page long, url string, host string, suffix string, n long, declared string, "
            "text array<double>, soft array<double>, markup array<double>",
        ),
        "evidence",
    )
    # soft counts: pages with text only; hosts first, then suffixes, then all
    hosts = stage(summed(seen.where("n > 0 and host is not null"), ["host", "suffix"], many), "hosts")
    suffixes = summed(hosts.withColumnRenamed("sums", "soft"), ["suffix"], many)
    flat = F.array(*[F.lit(1.0 / many)] * many)
    everything = summed(seen.where("n > 0"), [], many).select(smoothed(F.col("sums"), flat, strength).alias("p"))
    of_all = F.array(*[F.lit(x) for x in everything.first()["p"]])  # one number per language
    none = F.array(*[F.lit(0.0)] * many)
    priors = (
        hosts.join(suffixes.withColumnRenamed("sums", "of_suffix"), "suffix")
        .select("host", "sums", smoothed(F.col("of_suffix"), of_all, strength).alias("prior"))
    )
    by_suffix = F.create_map(
        *[
            x
            for s, lang in SUFFIXES.items()
            if lang in langs
            for x in (
                F.lit(s),
                F.array(*[F.lit(math.log(suffix_trust if l == lang else (1 - suffix_trust) / max(many - 1, 1))) for l in langs]),
            )
        ],
        F.lit(""),
        none,
    )
    own = F.when(F.col("n") > 0, F.col("soft")).otherwise(none)
    rest = F.zip_with(F.coalesce("sums", own), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    score = F.zip_with(
        F.zip_with("text", "markup", lambda a, b: a + b),
        F.zip_with(
            F.coalesce(F.element_at(by_suffix, F.coalesce("suffix", F.lit(""))), none),
            smoothed(rest, F.coalesce("prior", of_all), strength),
            lambda a, p: a + F.log(p),
        ),
        lambda a, b: a + b,
    )
    names = F.array(*[F.lit(x) for x in langs])

    def best(x: Column) -> Column:
        return F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))

    return (
        seen.join(priors, "host", "left")
        .withColumn("score", score)
        .select(
            unrid("page").alias("page_id"),
            best(F.col("score")).alias("lang"),
            (1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))).alias("confidence"),
            F.when(F.col("n") > 0, best(F.col("text"))).alias("text_lang"),
            "declared",
            F.col("n").alias("n_trigrams"),
        )
    )
