"""Language evidence with dictionaries, and boosted trees with plain loops,
against the operators on whole small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from normsmith.llm import langid, quality_gbdt as Q
from normsmith.llm.html_template import block_text, main_parts, parse

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ language
def gram_numbers(text):
    b = f" {' '.join(text.lower().split())} ".encode()
    out = []
    for x, y, z in zip(b, b[1:], b[2:]):
        h = (x * 0x9E3779B1 & 0xFFFFFFFF) ^ (y * 0x85EBCA6B & 0xFFFFFFFF) ^ (z * 0xC2B2AE35 & 0xFFFFFFFF)
        out.append(((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 19)
    return out


def brute_languages(pages, docs, worth=40.0, trust=0.9, suffix_trust=0.7, strength=10.0):
    counts = defaultdict(Counter)
    for lang, text in docs:
        if lang is not None:
            counts[lang.lower()].update(gram_numbers(text or ""))
    langs = sorted(counts)
    total = {x: sum(c.values()) + 0.5 * 8192 for x, c in counts.items()}
    many, seen = len(langs), []
    for page, url, html in pages:
        grams = gram_numbers(block_text(main_parts(parse(html or ""))[0]))
        share = min(1.0, worth / len(grams)) if grams else 0
        text = {x: share * sum(math.log((counts[x][g] + 0.5) / total[x]) for g in grams) for x in langs}
        top = max(text.values())
        norm = sum(math.exp(v - top) for v in text.values())
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        host = m[1].lower() if m else None
        tag = re.search(r"<html\b[^>]*\blang=[\"']?([A-Za-z]+)", html or "", re.I)
        soft = {x: math.exp(text[x] - top) / norm for x in langs} if grams else None
        seen.append((page, host, text, soft, tag[1].lower() if tag else None))
    hosts, suffixes, everything = (defaultdict(lambda: dict.fromkeys(langs, 0.0)) for _ in range(3))
    for _, host, _, soft, _ in seen:
        if soft:
            for x in langs:
                everything[None][x] += soft[x]
                if host:
                    hosts[host][x] += soft[x]
                    suffixes[host.rsplit(".", 1)[-1]][x] += soft[x]

    def smooth(sums, prior):
        n = sum(sums.values())
        return {x: (sums[x] + strength * prior[x]) / (n + strength) for x in langs}

    of_all = smooth(everything[None], dict.fromkeys(langs, 1 / many))
    out = {}
    for page, host, text, soft, tag in seen:
        prior = smooth(suffixes[host.rsplit(".", 1)[-1]], of_all) if host in hosts else of_all
        rest = {x: max(hosts[host][x] - soft[x], 0.0) if host in hosts and soft else hosts[host][x] if host in hosts else 0.0
                for x in langs}
        score = {x: text[x] + math.log(p) for x, p in smooth(rest, prior).items()}
        told = langid.SUFFIXES.get(host.rsplit(".", 1)[-1]) if host else None
        for x in langs:
            if tag in langs:
                score[x] += math.log(trust if x == tag else (1 - trust) / (many - 1))
            if told in langs:
                score[x] += math.log(suffix_trust if x == told else (1 - suffix_trust) / (many - 1))
        best = max(score, key=score.get)
        out[page] = (best, 1 / sum(math.exp(v - score[best]) for v in score.values()))
    return out


def test_language_of_all_pages(spark):
    pages, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    want = brute_languages([tuple(r) for r in pages.select("page_id", "url", "html").collect()],
                           [tuple(r) for r in docs.select("lang", "text").collect()])
    got = {r.page_id: (r.lang, r.confidence) for r in langid.identify_languages(pages, docs).collect()}
    assert set(got) == set(want)
    for k, (lang, confidence) in want.items():
        assert got[k][0] == lang and got[k][1] == pytest.approx(confidence, abs=1e-6)


# --------------------------------------------------------------------- trees
def plain_boosting(x, y, trees, depth, rate=0.15, bins=64, ridge=5.0, least=20):
    """Scores of the training rows: every split tried at every cut."""
    n, m = len(x), len(x[0])
    base = (sum(y) + 4) / (n + 5)
    margin = [math.log(base / (1 - base))] * n
    columns = [[r[f] for r in x] for f in range(m)]
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for c in columns]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in margin]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]

        def gain_of(rows):
            return math.fsum(g[i] for i in rows) ** 2 / (math.fsum(h[i] for i in rows) + ridge)

        def grow(rows, level):
            best = (1e-6, None, None)
            for f in range(m) if level < depth else ():
                for c in cuts[f]:
                    left = [i for i in rows if columns[f][i] <= c]
                    if len(left) < least or len(rows) - len(left) < least:
                        continue
                    there = set(left)
                    right = [i for i in rows if i not in there]
                    gain = gain_of(left) + gain_of(right) - gain_of(rows)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, left, right)
            if best[1] is None:
                v = -rate * math.fsum(g[i] for i in rows) / (math.fsum(h[i] for i in rows) + ridge)
                for i in rows:
                    margin[i] += v
            else:
                grow(best[1], level + 1)
                grow(best[2], level + 1)

        grow(list(range(n)), 0)
    return [1 / (1 + math.exp(-v)) for v in margin]


def test_boosting_equals_plain_loops():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(260, 4)).round(2)
    y = (x[:, 0] + x[:, 1] ** 2 + 0.5 * rng.normal(size=260) > 0.6).astype(float)
    got = Q.fit(x, y, trees=5, depth=3).score(x)
    assert got == pytest.approx(plain_boosting(x.tolist(), y.tolist(), 5, 3), abs=1e-9)


def test_query_scores_are_those_of_the_trees(spark):
    """The scores of the whole table are those of a walk through the trees,
    fitted on the labelled rows outside the fold and on no others."""
    import zlib

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = Q.document_statistics(docs)
    model = Q.fit_quality(stats, labels)
    rows = {r.doc_id: np.array(r.x, np.float32) for r in stats.collect()}
    got = {r.doc_id: r for r in Q.score_quality(docs, labels).collect()}
    assert len(got) == len(rows)
    for k, x in rows.items():
        total = model.start
        for root in model.roots:
            node = root
            while model.left[node] != node:
                node = model.left[node] if x[model.feature[node]] <= model.cut[node] else model.right[node]
            total += model.value[node]
        score = 1 / (1 + math.exp(-total))
        assert got[k].score == pytest.approx(score, abs=1e-9) and got[k].predicted == int(got[k].score >= 0.7)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    inside = labels.where("crc32(cast(doc_id as string)) % 4 <> 2")
    assert {r.score for r in Q.score_quality(docs, inside).collect()} == {r.score for r in got.values()}
