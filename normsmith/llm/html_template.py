"""Main text of web pages with site template removal.

Each page is parsed into elements, in time linear in its length however
deeply they are nested.  Elements that by their kind, role or class are no
article text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) are left out; the rest is the page's main
part: its ``article`` elements, else ``main``, else the body.  ``main`` comes
before articles inside it that hold less running text than it has beside
them (teasers).  A class or id that consists of words for such parts decides;
one that only contains such a word (``ad-hoc-networks``) proposes, and the
element goes if it is mostly links or holds little running text.  A form is
left out unless it wraps the page: it holds an article or ``main``, or at
least ``SHORT`` characters of running text.

Template removal: the subtrees of the main part are hashed (kind and text)
and counted per host in Spark, over distinct main parts, so that copies of a
page count once.  A subtree is a candidate when it recurs on at least
``least`` of a host's pages and on a share of them: ``chrome`` for containers
outside an explicit article that are mostly links, or short and without
running text, list items or cells; ``in_article`` for all others.  Text
recurring on fewer pages stays, as quotations and shared passages do.

Recurrence alone does not tell template from the text of near copies.  A page
speaks for its candidates only if its own text (what does not recur on
``least`` pages) is at least as long as its recurring text, links left out of
both.  A candidate is deleted, from all pages of the host, when the distinct
own texts beside it reach ``least`` and the same share of the host's distinct
own texts.  Where all pages of a host repeat more than they say themselves,
nothing is deleted.

Only counts are shuffled; the pages themselves are read a second time, and
the few deletions join them by page.

Text rules: character references are decoded, white space inside a block
becomes one space, blocks are joined by one space, nothing is dropped or cut
otherwise.  Defined cases: null or empty html gives the empty text; a page
without url or host takes part in no count; rows that repeat a page are all
returned; null ids stay null; an empty table gives an empty result; other
columns are ignored; unclosed or wrongly nested markup is closed like a
browser would.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rid, small_batches, stage, unrid

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption td th dd dt b i em strong span a code q cite u s".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption li dt dd tr td th".split())
ENOUGH = 80  # characters of running text that outweigh a word of a name
SHORT = 200  # characters of a container that may be template at the chrome share
NOISE = frozenset(
    "nav footer aside form script style noscript template iframe object embed svg canvas audio video map head title "
    "button select textarea input option optgroup datalist fieldset dialog menu applet".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split()
)
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside footer masthead banner cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup signin login ad "
    "ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion share "
    "sharing social related recommended recommendations comment comments commentlist disqus replies respond widget "
    "widgets toolbar pagination pager search hidden skip skiplink".split()
)
# Words that say where or how, not what: beside one of the above they leave it as sure as it is.
NEUTRAL = frozenset(
    "site page main global local top bottom left right upper lower first last fixed sticky box list item items wrapper "
    "wrap container holder area bar inner outer block section primary secondary btn button buttons link links icon icons "
    "row col column columns grid panel module slot unit group dialog banner message thread form header title".split()
)
HEADERS = frozenset("header site-header page-header top-header topbar top-bar".split())
# An opening p, li ... ends an open one of these, up to the nearest boundary.
P_ENDS = BLOCK - {"br", "hr", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = (
        "kind", "attrs", "children", "hash", "parent", "direct", "chars", "links", "prose", "running", "linked", "article",
    )

    def __init__(self, kind: str, attrs: str, parent: Node | None):
        self.kind, self.attrs, self.parent = kind, attrs, parent
        self.children: list[Node | str] = []
        self.hash = 0
        # set by hash_subtrees: texts outside any child; lengths of all text and of links; holds running text
        self.direct, self.chars, self.links, self.prose = "", 0, 0, False
        # set by measure: lengths of running text and of link text; holds an article or main
        self.running, self.linked, self.article = 0, 0, False


def parse(html: str) -> Node:
    root = Node("html", "", None)
    at, end = 0, len(html)
    # the open elements, and by kind their places among them: what an end tag
    # closes is looked up, not walked to
    opened, places = [root], {}

    def close(kinds, stops) -> None:
        """Leave the nearest open element of these kinds, if it is open
        below the nearest stop."""
        place = max((places[k][-1] for k in kinds if places.get(k)), default=0)
        if place > max((places[k][-1] for k in stops if places.get(k)), default=0):
            while len(opened) > place:
                places[opened.pop().kind].pop()

    while at < end:
        m = TOKEN.search(html, at)
        node = opened[-1]
        if not m:
            node.children.append(html[at:])
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.end()
        kind = m[2] or m[5]
        if not kind:
            continue
        kind = kind.lower()
        if m[1] or m[4]:
            if kind not in VOID:
                close((kind,), ())
            elif kind == "br":
                node.children.append(Node("br", "", node))
            continue
        attrs = (m[3] if m[2] else m[6]) or ""
        if kind in P_ENDS:
            close(("p",), ("table", "td", "th", "caption", "button", "object"))
        if kind in ENDS:
            close(*ENDS[kind])
        node = opened[-1]
        new = Node(kind, attrs, node)
        if kind == "html":
            continue
        node.children.append(new)
        if kind in RAW:
            stop = re.compile(rf"</{kind}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
            if kind == "textarea" or kind == "title":
                new.children.append(html[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        elif kind not in VOID:
            places.setdefault(kind, []).append(len(opened))
            opened.append(new)
    return root


def attributes(node: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(node.attrs):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def named_noise(names: list[str]) -> int:
    """2: a name says that this is no article text; 1: a name contains a word
    that says so; 0: none does."""
    found = 0
    for n in names:
        words = [w.lower() for w in WORD.findall(n)]
        if n.lower() in HEADERS:
            return 2
        if any(w in NOISE_WORDS for w in words):
            if all(w in NOISE_WORDS or w in NEUTRAL or w.isdigit() for w in words):
                return 2
            found = 1
    return found


def wraps_page(node: Node) -> bool:
    return node.article or (node.running >= SHORT and node.running > node.linked)


def is_noise(node: Node, in_article: bool) -> bool:
    """For elements that ``measure`` has seen."""
    kind = node.kind
    if kind == "form":
        return not wraps_page(node)
    if kind in NOISE:
        return True
    if kind == "header":
        # an article's own header is its title
        return not (in_article and any(isinstance(c, Node) and c.kind in ("h1", "h2", "hgroup") for c in node.children))
    if not node.attrs or kind in ("html", "body"):
        return False
    a = attributes(node)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    sure = named_noise(f"{a.get('class', '')} {a.get('id', '')}".split())
    return sure == 2 or (sure == 1 and (node.running < ENOUGH or node.linked >= node.running))


def measure(root: Node) -> None:
    """Set ``running`` (text of prose elements outside links), ``linked`` and
    ``article`` of every element, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        own, running, linked, article = 0, 0, 0, False
        for c in node.children:
            if isinstance(c, str):
                own += len(c.strip())
            elif c.kind not in NOISE or c.kind == "form":
                # chars: all text below, links too, until hash_subtrees sets it
                own, running, linked = own + c.chars, running + c.running, linked + c.linked
                article = article or c.article
                if c.kind in ("article", "main") and not article:
                    article = not (c.attrs and is_noise(c, True))
        node.chars = own
        node.linked = own if node.kind == "a" else linked
        node.running = own - node.linked if node.kind in PROSE else running
        node.article = article


def own_running(top: Node) -> int:
    """Running text of a main part outside the articles in it."""
    total, todo = 0, [top]
    while todo:
        node = todo.pop()
        below = [c for c in node.children if isinstance(c, Node) and c.kind != "article"]
        if node.kind in PROSE:
            total += node.running - sum(c.running for c in node.children if isinstance(c, Node) and c.kind == "article")
        else:
            todo += below
    return total


def main_parts(root: Node) -> tuple[list[Node], bool]:
    """The main part's elements in page order (noise taken out of the tree),
    and whether the page says which they are."""
    measure(root)
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    nested = teasers = 0  # running text of articles inside main, and how many
    todo = [(root, "body", False)]
    while todo:
        node, inside, in_main = todo.pop()
        keep: list[Node | str] = []
        below = []
        for c in node.children:
            if isinstance(c, Node):
                if is_noise(c, inside == "article"):
                    # a wrapper's class does not speak against the article that it wraps
                    if c.kind in NOISE or c.kind == "header" or inside == "article" or not c.article:
                        continue
                at = inside
                if inside != "article" and c.kind == "article":
                    at = "article"
                    if in_main:
                        nested, teasers = nested + c.running, teasers + 1
                elif inside == "body" and (c.kind == "main" or "main" == attributes(c).get("role")):
                    at = "main"
                if at != inside:
                    found[at].append(c)
                below.append((c, at, in_main or at == "main"))
            keep.append(c)
        node.children = keep
        todo += reversed(below)
    if found["main"] and (teasers or not found["article"]) and sum(map(own_running, found["main"])) > nested:
        return found["main"], True
    for kind in ("article", "main"):
        if found[kind]:
            return found[kind], True
    return [root], False


def digest(*parts: str) -> int:
    h = hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(h.digest(), "little", signed=True)


def hash_subtrees(top: Node) -> list[Node]:
    """Hash every element below ``top`` from its kind, texts and children
    (children first); returns those that hold text."""
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    out = []
    for node in reversed(order):
        parts, direct, chars, links, prose = [node.kind], [], 0, 0, False
        for c in node.children:
            if isinstance(c, Node):
                parts.append(f"<{c.hash}" if c.hash else "<")
                chars, links, prose = chars + c.chars, links + c.links, prose or c.prose
            elif c.strip():
                direct.append(" ".join(c.split()))
                parts.append(direct[-1])
                chars += len(direct[-1])
        node.direct, node.chars, node.links = "\0".join(direct), chars, chars if node.kind == "a" else links
        node.prose = prose or (chars > node.links and node.kind in PROSE)
        node.hash = digest(*parts) or 1 if chars else 0
        if chars:
            out.append(node)
    return out


def link_heavy(node: Node) -> bool:
    return 2 * node.links >= node.chars


def block_text(tops: list[Node], drop: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks in page order; subtrees whose hash is in ``drop`` left out."""
    out: list[str] = []
    todo: list[Node | str | None] = list(reversed(tops))
    while todo:
        c = todo.pop()
        if c is None:
            out.append(" ")
        elif isinstance(c, str):
            out.append(entities.unescape(c) if "&" in c else c)
        elif c.hash == 0 or c.hash not in drop:
            if c.kind in BLOCK:
                out.append(" ")
                todo.append(None)
            todo += reversed(c.children)
    return " ".join("".join(out).split())


def page_subtrees(html: str) -> tuple[int, list[tuple[int, bool, int, int]]]:
    """(hash of the main part, (hash, may be deleted at the chrome share,
    length and hash of the text that is the subtree's own and no link) of
    each subtree that holds text)."""
    tops, told = main_parts(parse(html))
    seen: dict[int, tuple[bool, int, int]] = {}
    whole = []

    def add(key: int, chrome: bool, node: Node, linked: bool) -> None:
        said = node.direct and not linked
        before = seen[key][1] if key in seen else 0
        seen[key] = (chrome, before + (len(node.direct) if said else 0), digest(node.direct) if said else 0)

    for top in tops:
        nodes = hash_subtrees(top)
        linked = {id(top)} if top.kind == "a" else set()
        for node in reversed(nodes):  # parents first
            if node is top:
                if node.direct:  # counts as text, under a key that no subtree has
                    add(digest("top", node.direct), False, node, False)
                continue
            inside = node.kind == "a" or id(node.parent) in linked
            if inside:
                linked.add(id(node))
            heavy = link_heavy(node)
            boilerplate = heavy or (not node.prose and node.chars - node.links <= SHORT)
            add(node.hash, not told and node.kind not in FLOW and boilerplate, node, inside or heavy)
        whole.append(str(top.hash))
    return digest(*whole), [(h, *v) for h, v in seen.items()]


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for page, host, html in zip(*(batch.column(c).to_pylist() for c in ("page", "host", "html"))):
            body, subtrees = page_subtrees(html)
            for row in subtrees:
                for column, v in zip(out, (page, host, body, *row)):
                    column.append(v)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(c, pa.int64()) for c in out[:4]),
                pa.array(out[4], pa.bool_()),
                *(pa.array(c, pa.int64()) for c in out[5:]),
            ],
            names=["page", "host", "body", "subtree", "chrome", "size", "said"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, drop in zip(batch.column("html").to_pylist(), batch.column("drop").to_pylist()):
            tops, _ = main_parts(parse(html))
            if drop:
                for top in tops:
                    hash_subtrees(top)
            texts.append(block_text(tops, set(drop or ())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page"), batch.column("url"), pa.array(texts, pa.string()), batch.column("drop")],
            names=["page", "url", "text", "drop"],
        )


def page_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page, url, host, html): host is a 64-bit hash, null without a host."""
    small_batches(pages.sparkSession)
    name = F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(
        rid(id_col).alias("page"),
        F.col(url_col).cast("string").alias("url"),
        F.when(name != "", F.xxhash64(name)).alias("host"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )


def extract_main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = 5,
    in_article: float = 0.5,
    chrome: float = 0.01,
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_removed (template
    subtrees that were deleted)."""
    rows = page_rows(pages, id_col, url_col, html_col)
    subtrees = stage(
        rows.where("host is not null")
        .select("page", "host", "html")
        .mapInArrow(_subtrees, "page long, host long, body long, subtree long, chrome boolean, size long, said long"),
        "subtrees",
    )
    # distinct main parts, per host and per subtree of a host
    parts = subtrees.groupBy("host", "subtree", "body").agg(
        F.bool_and("chrome").alias("chrome"), F.max("size").alias("size"), F.max("said").alias("said")
    )
    bodies = subtrees.groupBy("host", "body").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    counts = (
        parts.groupBy("host", "subtree")
        .agg(F.count("*").alias("n"), F.bool_and("chrome").alias("chrome"))
        .where(F.col("n") >= least)
    )
    counts = stage(counts, "counts")
    share = F.when(F.col("chrome"), F.lit(chrome)).otherwise(F.lit(in_article))
    candidates = (
        counts.join(bodies, "host").where(F.col("n") >= F.col("pages") * share).select("host", "subtree", share.alias("share"))
    )
    # pages that say more themselves than they repeat, by the hash of their own text
    again = counts.select("host", "subtree", F.lit(True).alias("again"))
    texts = parts.where("size > 0").join(again, ["host", "subtree"], "left")
    own = F.col("again").isNull()
    speakers = (
        texts.groupBy("host", "body")
        .agg(
            F.sum(F.when(own, F.col("size")).otherwise(-F.col("size"))).alias("more"),
            F.max(own).alias("own"),
            F.sum(F.when(own, F.shiftright("said", 24))).alias("remainder"),
        )
        .where("own and more >= 0")
        .select("host", "body", "remainder")
    )
    speakers = stage(speakers, "speakers")
    voices = speakers.groupBy("host", "remainder").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("voices"))
    templates = (
        subtrees.select("host", "subtree", "body")
        .join(candidates, ["host", "subtree"])
        .join(speakers, ["host", "body"])
        .groupBy("host", "subtree", "share", "remainder")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "subtree", "share")
        .agg(F.count("*").alias("beside"))
        .join(voices, "host")
        .where((F.col("beside") >= least) & (F.col("beside") >= F.col("voices") * F.col("share")))
        .select("host", "subtree")
    )
    drops = stage(
        subtrees.join(templates, ["host", "subtree"])
        .groupBy("page", "host")
        .agg(F.collect_set("subtree").alias("drop")),
        "drops",
    )
    out = rows.join(drops, ["page", "host"], "left").select("page", "url", "html", "drop")
    return out.mapInArrow(_texts, "page long, url string, text string, drop array<long>").select(
        unrid("page").alias("page_id"),
        "url",
        "text",
        F.char_length("text").cast("long").alias("n_chars"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"),
    )
