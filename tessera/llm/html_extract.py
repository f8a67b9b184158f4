"""Main text of web pages by wrapper induction.

All pages of each host are parsed, and their DOM trees are aligned from the root:
blocks are aligned if the labels (tag and classes) on their paths are equal. This is
simple tree matching with equal siblings merged, so it needs no comparison of pages
with each other; merged siblings are told apart by their texts. A text which every page
that has its path holds there, on two different pages at least, belongs to the host's
template; all other texts are slots. Texts in menus, headers, footers, sidebars,
notices, adverts, forms and comments are neither.

The main element of a page is the deepest under which most text of its slots lies, or
the outermost ``article`` around it. Everything in it is content, template text too, as
an article may well be printed twice; outside it every slot is content as well. Pages
without slots, and hosts without two different pages, give their ``article`` or ``main``
elements, or the body without its boilerplate elements.

Blocks are block-level elements; white space in a block becomes one space, blocks
are joined by a line feed.

Defined results: null, empty or tagless pages give what text they hold; repeated
rows and equal URLs give equal texts; a URL without host belongs to the host "".
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import BROADCAST_BYTES, broadcast_if_small, python_batches, stored

#: Part of the text of a page's slots that the main element holds.
MOST = 0.6
#: Held back counts of a task before they are handed on.
HELD = 200_000
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NEVER = set("head nav header footer aside form script style noscript template iframe button select option input textarea svg canvas object embed noembed noframes dialog menu title".split())
_SMALL = set("p li h1 h2 h3 html td blockquote ul ol pre dd".split())
_KINDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adbox|adslot|banner|sponsor(?:ed|s)?|promo(?:tion)?s?|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|footer|header|masthead|cookies?|consent|notices?|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|commentlist|respond|replies|disqus|share|sharing|social|related|recommended|widgets?|toolbar|pagination|pager|search|skip)(?:$|[\s_-])",
    re.I,
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TO_END = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*+>")
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")


class Node:
    __slots__ = ("children", "hidden", "label", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children, self.label, self.hidden = tag, [], tag, tag in _NEVER
        if attrs and not attrs.isspace():
            a = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
            names = f"{a.get('class', '')} {a.get('id', '')}".strip()
            if names:
                self.label = f"{tag}.{'.'.join(sorted(html.unescape(a.get('class', '')).split()))}"
                self.hidden = self.hidden or (tag not in ("html", "body", "article", "main") and bool(_KINDS.search(names)))
            self.hidden = self.hidden or a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true"


class _Tags:
    """The tags of a page one after the other, in time linear in its length whatever stands in it.

    From the first tag whose quotes never end, quotes no longer count; text behind the last ``>``
    holds no tag.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at ``at``."""
        if self.quotes:
            if m := _TO_END.match(self.page, at):
                return m.end() - 1
            self.quotes = False
        return self.page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """Start, end, name (empty: a comment or a declaration), attributes and whether it is an end tag."""
        page = self.page
        while (lt := page.find("<", at)) >= 0:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                return lt, len(page) if end < 0 else end + 3, "", "", False
            if lt > self.last:
                return None
            if page.startswith(("<!", "<?"), lt):
                return lt, page.find(">", lt) + 1, "", "", False
            closing = page.startswith("</", lt)
            m = _NAME.match(page, lt + 1 + closing)
            end = self._end(m.end()) if m and m.end() <= self.last else -1
            if end >= 0:
                return lt, end + 1, m[0].lower(), page[m.end() : end], closing
            at = lt + 1
        return None


class _Open:
    """The open elements, outermost first. Each tag's places are kept, so that closing looks at what it closes only."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.outer = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag not in _INLINE:
            self.outer.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag not in _INLINE:
                self.outer.pop()


def parse(page: str) -> Node:
    """A forgiving DOM: children are nodes and strings (references still encoded)."""
    root = Node("#page")
    opened, tags = _Open(root), _Tags(page)
    at, n = 0, len(page)

    def close(same: set[str], barrier: set[str]) -> None:
        if (i := opened.last(same)) > opened.last(barrier):
            opened.cut(i)

    while at < n:
        found = tags.next(at)
        if found is None:
            opened.nodes[-1].children.append(page[at:])
            break
        start, end, tag, attrs, closing = found
        if start > at:
            opened.nodes[-1].children.append(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            i = opened.places[tag][-1] if opened.places.get(tag) else 0
            if i > 0 and (tag not in _INLINE or i > opened.outer[-1]):
                opened.cut(i)
            continue
        if tag in _CLOSES_P and opened.nodes[opened.outer[-1]].tag == "p":
            opened.cut(opened.outer[-1])
        if tag in _SAME:
            close(*_SAME[tag])
            if tag == "tr":
                close(*_SAME["tr"])
        node = Node(tag, attrs)
        opened.nodes[-1].children.append(node)
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            body = page[at : stop.start() if stop else n]
            at = stop.end() if stop else n
            if tag == "textarea":
                node.children.append(body)
        elif tag not in _VOID and (not attrs.rstrip().endswith("/") or tag not in ("svg", "path")):  # <div/> opens in HTML
            opened.push(node)
    return root


def _clean(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


def _blocks(node: Node, out: list[str], held: list[str], skip: Container[int] = ()) -> None:
    """Adds the blocks under ``node`` but for the own texts of the blocks whose id is in ``skip``;
    depth is bounded by an explicit stack."""
    work: list = [(node, iter(node.children), id(node) not in skip)]
    while work:
        top, rest, said = work[-1]
        for c in rest:
            if isinstance(c, str):
                if said:
                    held.append(c)
            elif c.tag == "br":
                held.append(" ")
            elif not c.hidden:
                if c.tag not in _INLINE:
                    _end(out, held)
                work.append((c, iter(c.children), said if c.tag in _INLINE else id(c) not in skip))
                break
        else:
            work.pop()
            if top.tag not in _INLINE:
                _end(out, held)


def _end(out: list[str], held: list[str]) -> None:
    if held:
        text = _clean(held)
        held.clear()
        if text:
            out.append(text)


@dataclass
class Block:
    """A block-level element that is not hidden, with the text of its inline elements."""

    node: Node
    above: int
    path: int
    text: str = ""
    key: int = 0


def _key(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _page_blocks(root: Node) -> list[Block]:
    """The blocks of a page in its order; ``path`` stands for the labels from the root on,
    ``key`` for path and text, ``above`` is the number of the block around."""
    blocks = [Block(root, -1, 0)]
    pieces: list[list[str]] = [[]]
    work: list = [(iter(root.children), 0, 0)]
    while work:
        rest, at, path = work[-1]
        for c in rest:
            if isinstance(c, str):
                pieces[at].append(c)
            elif c.tag == "br":
                pieces[at].append(" ")
            elif not c.hidden:
                below = _key(path.to_bytes(8, "little", signed=True), c.label.encode("utf-8", "replace"))
                if c.tag not in _INLINE:
                    blocks.append(Block(c, at, below))
                    pieces.append([])
                work.append((iter(c.children), at if c.tag in _INLINE else len(blocks) - 1, below))
                break
        else:
            work.pop()
    for b, p in zip(blocks, pieces, strict=True):
        b.text = _clean(p)
        if b.text:
            b.key = _key(b.path.to_bytes(8, "little", signed=True), b.text.encode("utf-8", "replace"))
    return blocks


def _main(blocks: list[Block], template: Container[int], part: float) -> int | None:
    """The number of the deepest element under which ``part`` of the text of the slots lies,
    None if all text is the template's."""
    weight = [0 if b.key in template else len(b.text) for b in blocks]
    for i in range(len(blocks) - 1, 0, -1):
        weight[blocks[i].above] += weight[i]
    if not weight[0]:
        return None
    # with a part over a half, the elements that qualify stand within each other
    return max((i for i, b in enumerate(blocks) if weight[i] >= part * weight[0] and b.node.tag not in _SMALL), default=0)


def _within(blocks: list[Block], top: int) -> set[int]:
    inside = {top}
    for i in range(top + 1, len(blocks)):
        if blocks[i].above in inside:
            inside.add(i)
    return inside


def _article(blocks: list[Block], at: int) -> int:
    """The outermost ``article`` around block ``at``, or else the block."""
    best = at
    while at >= 0:
        best = at if blocks[at].node.tag == "article" else best
        at = blocks[at].above
    return best


def _path(blocks: list[Block], at: int) -> str:
    labels = []
    while at > 0:
        labels.append(blocks[at].node.label)
        at = blocks[at].above
    return "/" + "/".join(reversed(labels))


def _outermost(blocks: list[Block], found: list[int]) -> list[Node]:
    nodes: list[Node] = []
    inside: set[int] = set()
    for i in found:
        if i not in inside:
            inside |= _within(blocks, i)
            nodes.append(blocks[i].node)
    return nodes


def content_text(page: str | None, wrapper: str | None = None, template: Container[int] | None = None) -> str:
    """The main text of one page. ``template`` has the keys of its host's template texts, None if
    nothing is known of the host; ``wrapper`` is the path of a content element to take instead."""
    root = parse(page or "")
    blocks = _page_blocks(root)
    main = None if template is None else _main(blocks, template, MOST)
    found = [i for i in range(len(blocks)) if _path(blocks, i) == wrapper] if wrapper else []
    skip: set[int] = set()
    if found or main is None:
        for tag in ("article", "main"):
            found = found or [i for i, b in enumerate(blocks) if b.node.tag == tag]
        found = found or [i for i, b in enumerate(blocks) if b.node.tag == "body"][-1:] or [0]
        tops = _outermost(blocks, found)
    else:
        inside = _within(blocks, _article(blocks, main))
        tops, skip = [root], {id(b.node) for i, b in enumerate(blocks) if i not in inside and b.key in template}
    out: list[str] = []
    held: list[str] = []
    for node in tops:
        _blocks(node, out, held, skip)
        _end(out, held)
    return "\n".join(out)


def _counted(page: str) -> tuple[int, set[tuple[int, int]]]:
    """The key of a page, and its different (path, key) of texts, with (path, 0) once for each path."""
    blocks = [b for b in _page_blocks(parse(page)) if b.text]
    return _key(page.encode("utf-8", "replace")), {(b.path, k) for b in blocks for k in (b.key, 0)}


def induce(pages: list[str]) -> str | None:
    """The path, in the first page, of the smallest element that holds all its slots."""
    counts: Counter[tuple[int, int]] = Counter()
    different = {}
    for key, seen in map(_counted, pages):
        if key not in different:
            different[key] = seen
            counts.update(seen)
    if len(different) < 2:
        return None
    template = {k for (path, k), n in counts.items() if k and 1 < n == counts[path, 0]}
    blocks = _page_blocks(parse(pages[0]))
    at = _main(blocks, template, 1)
    return None if at is None else _path(blocks, at)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


_COUNTS = "host string, path long, text long, n long, least long, most long"


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``_COUNTS``, added up over the batches of a task: how many pages hold a text on a
    path (0: any text), and the least and greatest key of these pages."""
    held: dict[tuple, list] = {}

    def given() -> pd.DataFrame:
        rows = [(*k, *v) for k, v in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["host", "path", "text", "n", "least", "most"])

    for batch in batches:
        for host, page in zip(batch["host"], batch["page"], strict=True):
            key, seen = _counted(page or "")
            for path, text in seen:
                v = held.get((host, path, text))
                if v is None:
                    held[host, path, text] = [1, key, key]
                else:
                    v[0], v[1], v[2] = v[0] + 1, min(v[1], key), max(v[2], key)
            if len(held) > HELD:
                yield given()
    yield given()


def host_templates(pages: DataFrame, url_col: str, html_col: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """host, template: the keys of its template texts, for each host with two different pages that hold text.
    All pages count; only texts that two different pages hold on a path are joined."""
    rows = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).alias("page"))
    seen = rows.mapInPandas(_count_batches, _COUNTS).groupBy("host", "path", "text")
    seen = seen.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    seen = stored(seen.filter((F.col("least") < F.col("most")) | (F.col("text") == 0)), "texts")
    paths = seen.filter("text = 0 and least < most").select("host", "path", F.col("n").alias("pages"))
    paths = broadcast_if_small(paths, F.length("host") * 4 + 32, broadcast_bytes)
    fixed = seen.filter("text <> 0").join(paths, ["host", "path"]).filter("n = pages")
    fixed = fixed.groupBy("host").agg(F.collect_list("text").alias("template"))
    hosts = seen.filter("text = 0").groupBy("host").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most").select("host")
    return hosts.join(fixed, "host", "left").select("host", F.coalesce("template", F.array().cast("array<long>")).alias("template"))


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per row: id, url, text, n_chars."""
    python_batches(pages.sparkSession)
    templates = stored(host_templates(pages, url_col, html_col, broadcast_bytes), "templates")
    templates = broadcast_if_small(templates, F.length("host") * 4 + F.size("template") * 8 + 32, broadcast_bytes)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for docs, keys in batches:
            yield pd.Series([content_text(d, template=None if k is None else set(k.tolist())) for d, k in zip(docs, keys, strict=True)], dtype=object)

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), _host(F.col(url_col)).alias("host"), F.col(html_col).alias("page"))
    rows = rows.join(templates, "host", "left").select("id", "url", text_of("page", "template").alias("text"))
    return rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
