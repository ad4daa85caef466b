"""Main text of pages: site templates go by counting subtrees, other furniture by what its markup says.

A page is read into a tree of its block elements (inline tags are transparent, so an unclosed ``<b>`` does no harm). Two hashes of
subtrees are counted host by host in Spark, over pages that differ: the exact one, of tags, attributes and text, and the shape, of tags
and words of class alone, with like neighbours as one and the path above it, which still recurs where the text of a menu or advert is another
on every page. One that stands on ``PAGES`` such pages of a host at least, and on ``SHARE`` of them, is a template, and its subtrees are deleted.

The core is the ``article`` and ``main`` elements, else the least block with half of the page's text. Shapes count only outside and not around it, and not those of bare paragraphs, headings and the like. Articles and
what is around them are never deleted for recurring, and inside them an exact subtree counts only if it has attributes, so that
paragraphs and lists which articles share stay. Copies of one article (of one page, where there is none) count as one page.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles also go by element, role or the
words of class and id, for hosts of few pages. Inside an article a class or id goes so only if all its words name furniture or its parts
(``comment-list``); one with other words too (``rail-network``) only proposes, and its subtree goes if it is a template or if half of its text is links. If a page has an article (else ``main``), only it is text; a ``header`` inside it keeps its headings.
Character references are decoded, white space inside a block becomes one space, blocks are joined by line breaks.

Null and empty html give an empty text. A missing or odd url has the host ''. Pages without mark-up are one block. Repeated rows get equal
texts and count once. Other columns, whatever their names, are ignored. Long pages are read in one pass, whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import stash

PAGES, SHARE = 4, 0.1
#: Up to so many template hashes (eight bytes each) all hosts' templates go to every task; beyond, pages meet theirs in a join.
BROADCAST_HASHES = 500_000

# HTML's void, raw-text and inline elements, and elements that end an open paragraph's like.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var center".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table tbody thead tfoot select body div section article main".split())
#: Elements of running text: without attributes their shape says nothing.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr figcaption address summary".split())
# Furniture by element, by role, by a word of class or id.
FURNITURE = frozenset("script style noscript template svg nav footer aside form button select option textarea dialog menu iframe object canvas audio video head title xmp noembed noframes datalist map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail footer comment comments reply replies respond disqus share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login search pager pagination toolbar widget copyright disclaimer masthead".split()
)
#: Words that say what part of furniture it is.
PARTS = frozenset("area article articles bar block body box btn button buttons card cards col column container content feed field form group heading icon icons inner inline input item items label left line link links list main more outer panel post posts right row section slot stories text title top bottom unit wrap wrapper".split())
_HEAD_WORDS = frozenset({"header", "site-header", "page-header", "site_header", "top-bar", "topbar"})
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: From behind a tag's name to its end: a quote opens a value only behind an equals sign, and ``>`` is free inside one.
_REST = re.compile(r"""(?:[^>=]|=\s*(?:"[^"]*"|'[^']*')|=(?!\s*["']))*+>""")
_NUMBER = re.compile(r"[0-9]+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    dropped: bool
    article: bool
    heading: bool
    #: Sorted attributes, and the words of class.
    said: tuple = ()
    kind: str = ""
    parts: list = field(default_factory=list)
    shapes: list = field(default_factory=list)
    digest: int = 0
    shape: int = 0
    #: Characters of text, and those of links.
    size: int = 0
    linked: int = 0
    #: Its class or id has a word of furniture among others.
    proposed: bool = False


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, block, text) in page order
    runs: list[tuple[int, int, str]] = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def furniture(tag: str, a: dict[str, str], inside: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "main", "article") and not ("comment" in a.get("class", "").lower()):
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    named = f"{a.get('class', '')} {a.get('id', '')}".lower()
    if not inside:
        return bool(named.strip()) and (not WORDS.isdisjoint(_SPLIT.split(named)) or not _HEAD_WORDS.isdisjoint(named.split()))
    return any(_all_furniture(name) for name in named.split())


def _all_furniture(name: str) -> bool:
    words = {w for w in _SPLIT.split(name) if w and not w.isdigit()}
    return not WORDS.isdisjoint(words) and words <= WORDS | PARTS


def proposes(a: dict[str, str]) -> bool:
    return bool(a) and not WORDS.isdisjoint(_SPLIT.split(f"{a.get('class', '')} {a.get('id', '')}".lower()))


def read(source: str) -> Page:
    """One pass over the source; linear, whatever is left unclosed."""
    from xxhash import xxh3_64_intdigest

    page = Page()
    nodes, runs = page.nodes, page.runs
    nodes.append(Node("", -1, False, False, False))
    stack, block, at, n, anchor = [0], 0, 0, len(source), False
    #: Places in the stack of the open elements of each name, and of those that a list's end tag doesn't pass.
    opened: dict[str, list[int]] = {}
    bounds: list[int] = []

    def text(t: str) -> None:
        if t:
            node = nodes[stack[-1]]
            runs.append((stack[-1], block, t))
            node.parts.append(t)
            node.size += len(t.strip())
            node.linked += len(t.strip()) * anchor

    def close() -> None:
        node = nodes[stack.pop()]
        opened[node.tag].pop()
        if node.tag in LISTS:
            bounds.pop()
        up = nodes[node.parent]
        whole = "\x01".join(p if isinstance(p, str) else format(p[0], "x") for p in node.parts)
        node.digest = xxh3_64_intdigest(f"{node.tag}\x02{node.said}\x02{whole}".encode("utf-8", "surrogatepass"))
        node.shape = xxh3_64_intdigest(f"{node.tag}\x03{node.kind}\x03{node.shapes}".encode("utf-8", "surrogatepass"))
        if node.tag not in RAW:
            up.size += node.size
            up.linked += node.linked
        up.parts.append((node.digest,))
        if up.shapes[-1:] != [node.shape]:
            up.shapes.append(node.shape)
        node.parts, node.shapes = [1] if node.parts else [], []

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            text(source[at:])
            break
        follows = source[lt + 1 : lt + 2]
        if not (follows.isalpha() or follows in "/!?") or not follows:
            text(source[at : lt + 1])
            at = lt + 1
            continue
        text(source[at:lt])
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        gt = source.find(">", lt)
        if gt < 0:
            break  # a tag that never ends
        if follows in "!?":
            at = gt + 1
            continue
        closing = follows == "/"
        name = _NAME.match(source, lt + 1 + closing, gt)
        if not name:
            at = gt + 1
            continue
        tag = name[0].lower().rstrip("/")
        raw = source[name.end() : gt]
        if not closing and ('"' in raw or "'" in raw):
            rest = _REST.match(source, name.end())
            if rest:  # else a quote is never closed: the tag ends at the first >
                gt, raw = rest.end() - 1, source[name.end() : rest.end() - 1]
        at = gt + 1
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                block += 1
            continue
        if tag == "a":
            anchor = not closing
        if closing:
            if tag in INLINE and not any(nodes[k].tag == tag for k in stack[-2:]):
                continue
            depth = opened[tag][-1] if opened.get(tag) else 0
            if depth and not (tag in CLOSES and bounds and bounds[-1] > depth):
                while len(stack) > depth:
                    close()
                block += tag not in INLINE
            continue
        a = attributes(raw) if raw else {}
        inside = any(nodes[k].article for k in stack[-1:])
        off = furniture(tag, a, inside)
        if tag in INLINE and not off:
            continue
        if tag not in INLINE:
            if nodes[stack[-1]].tag == "p":
                close()
            while tag in CLOSES and len(stack) > 1 and nodes[stack[-1]].tag in CLOSES[tag]:
                close()
            block += 1
        up = nodes[stack[-1]]
        heading = up.heading and tag not in ("h1", "h2", "h3", "h4", "h5", "h6") or (tag == "header" and inside)
        article = up.article or tag in ("article", "main") or a.get("role", "").lower() == "main"
        kind = _NUMBER.sub("0", " ".join(sorted(a.get("class", "").lower().split())))
        nodes.append(Node(tag, stack[-1], up.dropped or off, article, heading, tuple(sorted(a.items())), kind, proposed=inside and proposes(a)))
        opened.setdefault(tag, []).append(len(stack))
        if tag in LISTS:
            bounds.append(len(stack))
        stack.append(len(nodes) - 1)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}", re.I).search(source, at)
            at = n if end is None else end.start()
            close()
            if end is not None:
                gt = source.find(">", at)
                at = n if gt < 0 else gt + 1
    while len(stack) > 1:
        close()
    return page


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def core(page: Page) -> list[int]:
    """For each node: 2 inside the core, 1 around it, else 0."""
    nodes = page.nodes
    roots = [k for k, x in enumerate(nodes) if x.article and not nodes[x.parent].article]
    if not roots:
        at, more = 0, True
        below: dict[int, list[int]] = {}
        for k, x in enumerate(nodes[1:], 1):
            below.setdefault(x.parent, []).append(k)
        while more:  # down to the least block with half of the text
            best = max(below.get(at, ()), key=lambda k: nodes[k].size, default=-1)
            more = best >= 0 and nodes[best].tag not in RAW and 2 * nodes[best].size >= nodes[0].size > 0
            at = best if more else at
        roots = [at]
    place = [0] * len(nodes)
    for k in roots:
        place[k] = 2
        up = nodes[k].parent
        while up >= 0 and place[up] == 0:
            place[up] = 1
            up = nodes[up].parent
    for k, x in enumerate(nodes):
        if x.parent >= 0 and place[x.parent] == 2:
            place[k] = 2
    return place


def subtrees(page: Page) -> list[tuple[int, int]]:
    """(node, hash) of the subtrees that count: exact ones and shapes, as signed 64-bit values."""
    from xxhash import xxh3_64_intdigest

    out, place, paths = [], core(page), [0]  # of a path the hash of its parent's, the tag and the words of class
    articles = any(x.article for x in page.nodes)
    for k, x in enumerate(page.nodes[1:], 1):
        paths.append(xxh3_64_intdigest(f"{paths[x.parent]}>{x.tag}.{x.kind}".encode("utf-8", "surrogatepass")) if place[x.parent] != 2 else 0)
        if not x.parts or x.tag in ("html", "head", "body"):
            continue
        around = articles and (place[k] == 1 or (place[k] == 2 and place[x.parent] != 2))
        if not around and (not x.article or x.said):
            out.append((k, _signed(x.digest)))
        if place[k] == 0 and (x.said or x.tag not in TEXT):
            out.append((k, _signed(xxh3_64_intdigest(f"{paths[k]}\x04{x.shape}".encode("utf-8", "surrogatepass")))))
    return out


def core_text(page: Page) -> str:
    """Text of the articles, or of the whole page without them."""
    articles = [t for k, _, t in page.runs if page.nodes[k].article]
    return "".join(articles or (t for _, _, t in page.runs))


def main_text(page: Page, templates: frozenset[int] = frozenset()) -> str:
    counted = {k for k, h in subtrees(page) if h in templates} if templates else set()
    gone: list[bool] = []
    for k, node in enumerate(page.nodes):
        links = node.proposed and 2 * node.linked >= node.size > 0
        gone.append(node.dropped or links or k in counted or (node.parent >= 0 and gone[node.parent]))
    chosen = [True] * len(page.nodes)
    for tag in ("article", "main"):
        roots = [k for k, x in enumerate(page.nodes) if x.tag == tag and not gone[k]]
        if roots:
            is_root, chosen = set(roots), []
            for k, node in enumerate(page.nodes):
                chosen.append(k in is_root or (node.parent >= 0 and chosen[node.parent]))
            break
    blocks: dict[int, list[str]] = {}
    for node, block, run in page.runs:
        if chosen[node] and not gone[node] and not page.nodes[node].heading:
            blocks.setdefault(block, []).append(run)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.withColumn("host", host)


def templates(pages: DataFrame) -> DataFrame:
    """(host, hash): subtrees that recur across a host's pages of different cores. ``pages`` has host and html."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                hosts, trees, whole = [], [], []
                for host, source in zip(batch.column(0).slice(i, 500).to_pylist(), batch.column(1).slice(i, 500).to_pylist()):
                    page = read(source)
                    own = [0, *{h for _, h in subtrees(page)}]  # 0 stands for the page
                    kind = xxh3_64_intdigest(core_text(page).encode("utf-8", "surrogatepass")) - 2**63
                    hosts += [host] * len(own)
                    trees += own
                    whole += [kind] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(trees, pa.int64()), pa.array(whole, pa.int64())], names=["host", "hash", "kind"])

    seen = pages.filter("html <> ''").select("host", "html").mapInArrow(emit, "host string, hash long, kind long")
    counts = seen.distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = stash(counts.filter((F.col("hash") == 0) | (F.col("n") >= PAGES)), "templates")
    totals = counts.filter("hash = 0").select("host", F.col("n").alias("all"))
    return counts.filter("hash <> 0").join(totals, "host").filter(F.col("n") >= F.col("all") * SHARE).select("host", "hash")


def main_texts(pages: DataFrame) -> DataFrame:
    """The query's columns for pages (page_id, url, html)."""
    hosted = with_host(pages.select("page_id", "url", "html"))
    found = stash(templates(hosted), "host-templates")
    # a host has at most (subtrees of its pages) / SHARE / (pages) of them: a bounded list each
    of_host = found.groupBy("host").agg(F.collect_set("hash").alias("known"))
    small = found.count() <= BROADCAST_HASHES
    joined = hosted.join(F.broadcast(of_host) if small else of_host, "host", "left").select("page_id", "url", "html", "known")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                text = [main_text(read(h), frozenset(k or ())) if h else "" for h, k in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
