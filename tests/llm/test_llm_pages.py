"""HTML extraction, language identification, WARC, vectors."""

import html
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from normsmith.llm.common import forest
from normsmith.llm.html_template import block_text, extract_main_text, main_parts, parse
from normsmith.llm.langid import declared_language, identify_languages, plain, trigrams
from normsmith.llm.pivot_index import near_duplicates, unit
from normsmith.llm.warc import chunked, http_payload, page_records, parse as parse_warc, read_warc, round_trip, unchunked, write_warc

SF = "/root/testdata/sf0.001"


def text(markup):
    return block_text(main_parts(parse(markup))[0])


def test_main_text_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)
        want = " ".join(html.unescape(want).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_main_text_cases():
    assert (
        text(
            '<body class="no-sidebar"><header><h1>Site</h1></header><div class="has-sidebar"><main><article>'
            "<header><h1>T &amp; x</h1><nav>n</nav></header><p>One<b> two</p><p>th<i>r</i>ee&nbsp;4<br>five"
            '<div class="ad-slot">AD</div><aside>side</aside><ul><li>a<li>b</ul><form>f</form>'
            '<section id="comments"><article class="comment">c</article></section><script>x<y</script></article>'
            '</main></div><div class="cookie-notice">C</div><footer>F</footer><!-- x > y -->'
        )
        == "T & x One two three 4 five a b"
    )
    assert text("plain < text & more <p>a <b>unclosed <table><tr><td>x<td>y</table> 5 < 6 <a href=\"q") == (
        "plain < text & more a unclosed x y 5 < 6"
    )
    assert text("<main><p>m</p><div role=navigation>n</div></main><p>out") == "m"
    assert text("<div><p hidden>h</p><p style='display: none'>n</p>shown</div>") == "shown"
    assert text("") == "" and text("<article></article>") == ""


def test_main_beside_teasers_and_page_forms():
    long = "<p>" + "A sentence of the main text. " * 10 + "</p>"
    told = ("A sentence of the main text. " * 10).strip()
    assert text(f"<main>{long}<div><article>teaser <a href=x>link</a></article></div></main>") == f"{told} teaser link"
    assert text(f"<main><p>intro</p><article>{long}</article></main>") == told
    assert text(f"<body><form action=/><article>{long}</article><input><button>Go</button></form>") == told
    assert text(f"<body><form action=/><nav>n</nav>{long}<input></form>") == told
    assert text("<body><p>t</p><form><label>Name</label><input><p>Short.</p></form>") == "t"


def test_names_propose_or_decide():
    long = "<p>" + "A sentence of the main text. " * 10 + "</p>"
    told = ("A sentence of the main text. " * 10).strip()
    for name in ("ad-hoc-networks", "menu-prices", "widget-theory", "commentOnLaw", "has-sidebar"):
        assert text(f"<body><div class='{name}'>{long}</div>") == told
        assert text(f"<body><p>t</p><div id='{name}'>short</div>") == "t"
    links = "<ul>" + "<li><a href=x>A sentence in a link, long enough to count</a>" * 10 + "</ul>"
    assert text(f"<body><p>t</p><div class='menu-prices'>{links}</div>") == "t"
    for name in ("sidebar", "left-sidebar", "cookie-notice", "ad", "ad-box-3", "commentList", "site-header"):
        assert text(f"<body><p>t</p><div class='{name}'>{long}</div>") == "t"


@pytest.mark.parametrize("opening", ["<div>", "<div class=widget-x>", "<p><table><tr><td>", "<li>", "<form>", "<b><p>"])
def test_deep_nesting_takes_linear_time(opening):
    import time

    began = time.perf_counter()
    got = text("<body>" + opening * 100_000 + "deep text")
    took = time.perf_counter() - began
    assert took < 4 * opening.count("<") and got in ("deep text", "")  # quadratic: minutes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b", "<!--", "-->", "a", " ", "<li>", "</ul>", "'", '"', ">", "<script>", "&am", "&amp"]), max_size=30))
def test_parser_never_fails(parts):
    text("".join(parts))


def test_templates_go(spark):
    rows = [
        (k, f"https://h.example/{k}", f"<body><div class=x1><a>Home</a> | <a>About</a></div><div class=c><p>Own {k} text</p></div><div class=x9>All rights</div>")
        for k in range(12)
    ]
    # copies of one page are no template, a passage on some pages stays
    rows += [(100 + k, "https://c.example/", "<article><p>copied</p></article>") for k in range(20)]
    rows += [(200 + k, "https://d.example/", f"<article><p>own {k}</p>{'<p>often</p>' if k < 4 else ''}</article>") for k in range(12)]
    rows += [(300, None, None), (None, "nohost", "<p>q</p>"), (301, "http://z/", ""), (301, "http://z/", "<p>r")]
    got = extract_main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int"))
    out = {r.page_id: r.text for r in got.collect() if r.page_id != 301}
    assert [out[k] for k in range(12)] == [f"Own {k} text" for k in range(12)]
    assert {out[100 + k] for k in range(20)} == {"copied"}
    assert out[200] == "own 0 often" and out[211] == "own 11"
    assert out[300] == "" and out[None] == "q"
    assert sorted(r.text for r in got.where("page_id = 301").collect()) == ["", "r"]
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_near_copies_keep_their_text(spark):
    def others(host, n, make):
        return [(f"https://{host}/{k}", make(k)) for k in range(n)]

    story = "".join(f"<p>Paragraph {k} of the story that many pages print again.</p>" for k in range(4))
    link = "<div class=x1><a href=/>Home</a> <a href=/a>About</a></div>"
    rows = []
    # copies of one article in a container, a few on a large host, and most of a host
    for host, n in (("a.example", 94), ("b.example", 3)):
        rows += [(f"https://{host}/c{k}", f"<body><div class=c><p>same article</p></div><p>printed {k}</p></body>") for k in range(6)]
        rows += others(host, n, lambda k: f"<body><p>quite another text, number {k}</p></body>")
    # near copies that differ in one paragraph, with and without article; their template still goes
    for host, left, right in (("c.example", "<article>", "</article>"), ("d.example", "<div>", "</div>")):
        rows += [(f"https://{host}/c{k}", f"<body>{left}{link}{story}<p>Printed on day {k}.</p>{right}</body>") for k in range(12)]
        rows += others(host, 10, lambda k: f"<body>{left}{link}<p>Own text number {k}.</p>{right}</body>")
    # a quotation in a container on a few pages that differ otherwise
    quote = "<div class=q><p>A quoted passage</p></div>"
    rows += others("e.example", 40, lambda k: f"<body><p>a text of its own, which is number {k}</p>{quote if k < 6 else ''}</body>")
    got = extract_main_text(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string"))
    out = {r.url: r for r in got.collect()}
    told = " ".join(re.findall("<p>(.*?)</p>", story))
    for k in range(6):
        assert out[f"https://a.example/c{k}"].text == out[f"https://b.example/c{k}"].text == f"same article printed {k}"
        assert out[f"https://e.example/{k}"].text == f"a text of its own, which is number {k} A quoted passage"
    for host in ("c.example", "d.example"):
        for k in range(12):
            assert out[f"https://{host}/c{k}"].text == f"{told} Printed on day {k}."
        assert out[f"https://{host}/3"].text == "Own text number 3."


# ------------------------------------------------------------------ language
def test_languages(spark):
    pages, docs = spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.page_id: r for r in identify_languages(pages, docs).collect()}
    truth = {r.page_id: re.search(r"//[^/]*/(\w\w)/", r.url)[1] for r in pages.collect()}
    assert np.mean([got[k].lang == v for k, v in truth.items()]) > 0.98
    assert np.mean([got[k].text_lang == v for k, v in truth.items()]) > 0.98
    assert all(0 < r.confidence <= 1 for r in got.values())


def test_language_evidence_by_hand(spark):
    """Two pages without text on one host, ten with: the host prior, the
    declared language and the suffix decide as computed by hand."""
    labelled = spark.createDataFrame([("aa", "aba " * 50), ("de", "xyx " * 50), (None, "q")], "lang string, text string")
    rows = [(k, "http://h.com/", "<p>" + "aba " * 30) for k in range(10)]
    rows += [(50, "http://h.com/", None), (51, "http://i.de/", "<html lang='xx'>"), (52, None, "<html lang='de-AT'>")]
    got = {r.page_id: r for r in identify_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), labelled).collect()}
    everything = (10 + 10 * 0.5) / (10 + 10)  # share of aa over all pages
    suffix = (10 + 10 * everything) / 20
    host = (10 + 10 * suffix) / 20
    assert got[50].lang == "aa" and got[50].confidence == pytest.approx(host, abs=1e-3)
    a, d = everything * 0.3, (1 - everything) * 0.7  # unknown declared language, suffix de
    assert got[51].confidence == pytest.approx(max(a, d) / (a + d), abs=1e-3)
    a, d = everything * 0.1, (1 - everything) * 0.9
    assert got[52].lang == "de" and got[52].confidence == pytest.approx(d / (a + d), abs=1e-3)
    assert got[0].lang == "aa" and got[0].text_lang == "aa" and got[50].text_lang is None


def test_language_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "x", "<p>t")], "page_id long, url string, html string")
    none = spark.createDataFrame([], "lang string, text string")
    assert {r.lang for r in identify_languages(pages, none).collect()} == {None}
    some = spark.createDataFrame([("en", None)], "lang string, text string")
    assert identify_languages(pages.limit(0), some).count() == 0
    assert declared_language("<!-- --><HTML dir=ltr LANG='pt_BR'>") == "pt" and declared_language("<p>") is None
    assert len(trigrams(plain("ab"))) == 2


# ---------------------------------------------------------------------- WARC
@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 50))
def test_chunked_round_trip(data, size):
    assert unchunked(chunked(data, size)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.integers(40, 400))
def test_records_round_trip(payload, segment):
    records = page_records(3, "http://x/\r\nY: z", "d", 3, payload, segment)
    got = list(parse_warc(b"".join(r + b"\r\n\r\n" for r in records)))
    assert http_payload(b"".join(b for _, b in got)) == payload
    if len(got) > 1:
        assert {f.get("warc-segment-origin-id") for f, _ in got[1:]} == {got[0][0]["warc-record-id"]}
        assert int(got[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in got)


PAGES = [
    (1, "u", "h" * 200), (1, "u", "h" * 200), (2, "v\r\nX: y", "h" * 200), (None, None, "h" * 200), (3, "w", None),
    (4, "w", ""), (5, "é", "é\r\n\r\n" * 20000), (5, "é", "é\r\n\r\n" * 20000), (6, "q", "é\r\n\r\n" * 20000),
]


def test_warc_edges(spark):
    d = spark.createDataFrame([(*r, 1) for r in PAGES], "page_id long, url string, html string, digest int")
    got = round_trip(d, segment=1000, archive=50_000).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [
            (1, 200, "response", None), (1, 200, "response", None), (2, 200, "revisit", 1), (None, 200, "revisit", 1),
            (3, 0, "response", None), (4, 0, "response", None), (5, 120000, "response", None),
            (5, 120000, "response", None), (6, 120000, "revisit", 5),
        ],
        key=str,
    )
    assert round_trip(d.limit(0)).count() == 0


def test_warc_damage_is_seen(spark, tmp_path):
    with pytest.raises(ValueError):
        list(parse_warc(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError):
        unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    d = spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    write_warc(d, folder, segment=1000)
    assert read_warc(spark, folder).first().payload_bytes == 5000


# ------------------------------------------------------------------- vectors
@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_vectors_recall(spark, chunk):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 64))
    for k in range(100):  # near pairs just above the bound, and a hot cluster
        z = rng.normal(size=64)
        a = x[k] / np.linalg.norm(x[k])
        z -= z @ a * a
        x[600 + k] = 0.955 * a + np.sqrt(1 - 0.955**2) * z / np.linalg.norm(z)
    x[300:400] = x[300] + 0.05 * rng.normal(size=(100, 64))
    u = unit(x)
    want = u @ u.T >= 0.95
    np.fill_diagonal(want, False)
    d = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, near_duplicates(d, chunk=chunk).select("vec_id", "n_links", "component_id").collect()))
    links = np.array([g[1] for g in got])
    assert (links <= want.sum(1)).all() and links.sum() >= 0.97 * want.sum()
    if links.sum() == want.sum():
        assert [g[2] for g in got] == forest(700, *np.nonzero(want)).tolist()


def test_near_vectors_edges(spark):
    nan = float("nan")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.01]), (4, None), (5, []), (6, [0.0, 0.0]),
        (7, [None, 1.0]), (8, [nan, 1.0]), (9, [1.0]), (10, [3.0]), (11, [1e300, 1e300]), (12, [1.0, 1.0]),
    ]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, near int")
    got = {(r.vec_id, r.n_links, r.component_id) for r in near_duplicates(d).collect()}
    assert got == {
        (1, 3, 1), (2, 3, 1), (None, 3, 1), (9, 1, 9), (10, 1, 9), (11, 1, 11), (12, 1, 11),
        *((k, 0, k) for k in (4, 5, 6, 7, 8)),
    }
    assert near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("pivots", [1024, 4096, 32_768])
def test_pivot_recall_at_the_bound(pivots):
    """Pairs at cosine 0.95 exactly: the share that meets on three pivots."""
    from normsmith.llm.pivot_index import nearest_count, spread

    rng = np.random.default_rng(pivots)
    a = unit(rng.normal(size=(600, 64)))
    b = rng.normal(size=(600, 64))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)
    points = spread(np.zeros((0, 64)), pivots)
    k = nearest_count(pivots)
    near = [np.argpartition(-(x @ points.T), k, axis=1)[:, :k] for x in (a, 0.95 * a + (1 - 0.95**2) ** 0.5 * b)]
    shared = (near[0][:, :, None] == near[1][:, None, :]).any(2).sum(1)
    assert (shared >= 3).mean() >= 0.96
