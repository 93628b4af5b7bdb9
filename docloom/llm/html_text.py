"""Main text of web pages by composite text density.

A page becomes a tree; what is never article text (scripts, menus, controls, parts named as adverts,
notices or comments, hidden parts) is cut first. A form goes where it is mostly controls, but not with most of
the text. Inside a marked article, names that may be a topic's (an id "privacy", a class "notice") cut only what
consists mostly of links, and never headings. Every node then has its composite density:
characters per tag, adjusted by how much of it is links relative to the whole body. The density sum of a
block adds those of the blocks in it and of its own runs of text with the inline elements in them. The block with the largest
sum is content; the smallest density on the way from it to the body is the page's threshold. Where parts beside it reach
that, the block around them is chosen instead, and so on towards the body; a heading right before the content belongs to it.
Which elements the page calls article or main has no part in the choice. Blocks that consist of links are left out,
unless they stand in such an element.

Text: character references are decoded, white space within a block becomes one space, blocks
are trimmed and joined by newlines in page order; a line break within a block is white space.

Defined results: a null or empty page, and one without text outside what is cut, give an empty
text. Unclosed, misnested and cut-off markup is read as far as it goes, in time that grows with the page's length. One row for each row of
the input, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import table

TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|/?[a-zA-Z][^>]*+(?:>|\Z)|/[^>]*+>)""", re.DOTALL)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"\s+")
#: Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul".split())
#: An element ends open ones of these names, but not beyond the limits named after them.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
#: Elements that never hold article text.
CUT = frozenset("script style noscript template textarea title iframe noembed noframes xmp head nav footer aside button select option input svg canvas object applet audio video map dialog menu datalist fieldset".split())
#: Words of class and id names, and roles, that say the same of a part.
CUT_WORDS = frozenset("ad adbox ads adv advert adverts advertisement advertising advertorial adsense adslot alert aside banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus dropdown feedback footer gdpr leftnav login mainnav masthead megamenu menu menubar menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup popups privacy promo promos promoted promotion rail reactions register related recommended recommendations replies reply respond responses search share sharing sidebar sidebars signin signup sitenav skip social sponsor sponsored sponsors subnav subscribe subscription toolbar topbar topnav widget widgets".split())
#: Those that may be a topic's or a paragraph's inside an article, as a class; as an id only the next ones may not.
TOPIC_WORDS = frozenset("advertising alert aside banner banners comment consent cookie cookies copyright disclaimer discussion feedback menu menus navigation notice notices privacy promotion rail reactions register related recommended recommendations reply responses search sharing skip social subscription".split())
ID_WORDS = frozenset("ad adbox ads adsense adslot advert advertisement adverts commentlist comments disqus leftnav mainnav menubar nav navbar respond sidebar sitenav subnav toolbar topnav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("button input select textarea".split())
#: A form with so many characters for each control, and as many again, is not mostly controls.
FORM_CHARS = 100
#: A part named header is cut like the element, unless it is named as an article's.
ARTICLE_WORDS = frozenset("article body content entry main post story title".split())
CUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of wrappers, which are named after what they hold: such a part may hold the article too.
WRAPPER_WORDS = frozenset("center col cols column columns container grid has inner layout left no off outer page right site theme two with wrap wrapper".split())
KEEP = frozenset("html body article main".split())


class Node:
    __slots__ = ("name", "parent", "children", "chars", "tags", "links", "linked", "density", "sum", "cut", "soft", "sure", "controls")

    def __init__(self, name: str, parent: Node | None, cut: bool = False) -> None:
        self.name, self.parent, self.cut, self.soft = name, parent, cut, 0
        self.sure, self.controls = False, 0
        self.children: list[Node | str] = []


def _is_named(name: str, attrs: str) -> tuple[int, bool]:
    """1 where the attributes name a part that is to be cut, 2 where that may be a wrapper's name, else 0; whether that is sure inside an article."""
    if name in KEEP or not attrs or attrs.isspace():
        return 0, False
    soft, sure = 0, False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id"):
            words = set(re.findall(r"[a-z]+", value))
            if not CUT_WORDS.isdisjoint(words) or words & {"header", "siteheader", "pageheader"} and ARTICLE_WORDS.isdisjoint(words):
                soft = soft or (1 if WRAPPER_WORDS.isdisjoint(words) else 2)
                sure = sure or bool(words & CUT_WORDS - TOPIC_WORDS if key == "class" else words & ID_WORDS and name not in HEADINGS)
        if key == "role" and value in CUT_ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return soft or 1, True
    return soft, sure


def parse(page: str) -> Node:
    """The tree of a page; parts that are cut stay as nodes without children."""
    root = Node("html", None)
    stack, at, end = [root], 0, len(page)
    places: dict[str, list[int]] = {}  # where elements of a name are open
    solid = [0]  # where elements that aren't inline are open
    cutting = 0  # the depth at which cutting began

    def last(names: Iterable[str]) -> int:
        """The innermost open element of one of the names; 0 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def text(a: int, b: int) -> None:
        if a < b and not cutting:
            stack[-1].children.append(html.unescape(page[a:b]))

    def close_to(depth: int) -> None:
        nonlocal cutting
        while len(stack) > depth:
            name = stack.pop().name
            places[name].pop()
            if solid[-1] == len(stack):
                solid.pop()
        if cutting > len(stack):
            cutting = 0

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        if m["cdata"] is not None and not cutting:
            stack[-1].children.append(m["cdata"])
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if k := last((name,)):
                close_to(k)
            continue
        if name == "html" and len(stack) > 1 or name == "body" and last(("body",)) in (1, 2):
            continue
        if name == "body":
            close_to(1)  # a head that was left open
        if name in CLOSES_P and solid[-1] and stack[solid[-1]].name == "p":
            close_to(solid[-1])
        if name in IMPLIED:
            ends, limits = IMPLIED[name]
            while (k := last(ends)) > last(limits):
                close_to(k)
                if name not in ("tr", "tbody", "tfoot"):
                    break
        if name in CONTROLS and (k := last(("form",))) and not re.search(r"""type\s*=\s*["']?hidden""", m["attrs"] or "", re.IGNORECASE):
            stack[k].controls += 1
        if name in VOID:
            if not cutting and name in ("br", "hr"):
                stack[-1].children.append(Node(name, stack[-1]))
            continue
        node = Node(name, stack[-1], not cutting and (name in CUT or name == "header" and not last(("article", "main"))))
        if not cutting and not node.cut:
            node.soft, node.sure = _is_named(name, m["attrs"])
            if name == "form":
                node.soft = node.soft or 2
        if not cutting:
            stack[-1].children.append(node)
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        places.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            solid.append(len(stack))
        stack.append(node)
        if node.cut and not cutting:
            cutting = len(stack)
    return _without_named(root)


def _without_named(root: Node) -> Node:
    """Cut the parts whose attributes say so, and forms, but for those that hold an article and, on a page that has none, wrappers of
    most of the text. Where nothing would be left, parts with most of the text stay whatever their names. Inside an article
    only sure names and parts that are mostly links go; forms of mostly text stay everywhere."""
    nodes = _order(root)
    if not any(n.soft for n in nodes):
        return root
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    marked: dict[int, bool] = {}  # holds an article element
    article: dict[int, bool] = {}
    for n in reversed(nodes):
        below = [c for c in n.children if isinstance(c, Node)]
        size[id(n)] = sum(len(c.strip()) for c in n.children if isinstance(c, str)) + sum(size[id(c)] for c in below)
        linked[id(n)] = size[id(n)] if n.name == "a" else sum(linked[id(c)] for c in below)
        marked[id(n)] = n.name == "article" or any(marked[id(c)] for c in below)
        article[id(n)] = n.name in ("article", "main") or any(article[id(c)] for c in below)
    inside: dict[int, int] = {}  # the size of the article around a node
    for n in nodes:
        up = n.parent
        inside[id(n)] = 0 if up is None else inside[id(up)] or (size[id(up)] if up.name == "article" or up.name == "main" and not marked[id(up)] else 0)
    most = {id(n) for n in nodes if 2 * size[id(n)] > size[id(root)]} if not article[id(root)] else set()

    def goes(n: Node, spared: int) -> bool:
        """Whether a node is cut if parts with most of the text are spared whose mark is at least so high."""
        if not n.soft or article[id(n)] or id(n) in most and n.soft >= spared:
            return False
        if n.name == "form" and not n.sure and size[id(n)] - linked[id(n)] >= FORM_CHARS * (n.controls + 1):
            return False
        if not inside[id(n)]:
            return True
        if n.sure:
            return True
        if n.name == "form":
            return 2 * size[id(n)] <= inside[id(n)]
        return n.name not in HEADINGS and 2 * linked[id(n)] > size[id(n)]

    def left(spared: int) -> int:
        """Characters that stay."""
        todo, total = [root], 0
        while todo:
            n = todo.pop()
            if goes(n, spared):
                continue
            total += sum(len(c.strip()) for c in n.children if isinstance(c, str))
            todo += [c for c in n.children if isinstance(c, Node)]
        return total

    spared = 2 if left(2) else 1
    for n in nodes:
        if goes(n, spared):
            n.cut, n.children = True, []
    return root


def _order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def composite_density(chars: int, tags: int, linked: int, links: int, ratio: float) -> float:
    """Characters per tag, less for links; ratio: the share of the body's characters that are links."""
    if not chars:
        return 0.0
    tags, free = max(tags, 1), max(chars - linked, 1)
    base = math.log(chars * linked / free + ratio * chars + math.e)
    share = math.log(max(chars * tags / (max(linked, 1) * max(links, 1)), 1.0))
    return chars / tags * share / (math.log(max(base, 1.0 + 1e-9)) if base > 1 else 1.0)


def _is_inline(node: Node | str) -> bool:
    return isinstance(node, str) or node.name in INLINE or node.name == "br"


def measure(root: Node) -> list[Node]:
    """Set counts, composite densities and density sums; the nodes, parents first."""
    nodes = _order(root)
    for n in reversed(nodes):
        below = [c for c in n.children if isinstance(c, Node)]
        n.chars = sum(len(SPACE.sub(" ", c).strip()) for c in n.children if isinstance(c, str)) + sum(c.chars for c in below)
        n.tags = len(below) + sum(c.tags for c in below)
        n.linked = n.chars if n.name == "a" else sum(c.linked for c in below)
        n.links = (n.name == "a") + sum(c.links for c in below)
    body = next((n for n in nodes if n.name == "body"), root)
    ratio = body.linked / max(body.chars, 1)
    for n in reversed(nodes):
        n.density = composite_density(n.chars, n.tags, n.linked, n.links, ratio)
        n.sum = 0.0
        run = [0, 0, 0, 0]
        for c in [*n.children, None]:
            if c is not None and _is_inline(c):
                own = (len(SPACE.sub(" ", c).strip()), 0, 0, 0) if isinstance(c, str) else (c.chars, c.tags + 1, c.linked, c.links)
                run = [x + y for x, y in zip(run, own, strict=True)]
                continue
            n.sum += composite_density(*run, ratio) + (c.density if c is not None else 0.0)
            run = [0, 0, 0, 0]
    return nodes


def select(root: Node) -> list[Node]:
    """The nodes that hold the article: a block, or headings and the block they stand before."""
    nodes = measure(root)
    body = next((n for n in nodes if n.name == "body"), root)
    best = max((n for n in nodes if not _is_inline(n)), key=lambda n: n.sum)  # of equal ones the outermost, as parents come first
    path = [best]
    while path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    limit = min(n.density for n in path)
    # Parts beside the best one that reach the threshold widen the choice to what holds them all.
    chosen = [best]
    for parent in path[1:]:
        at = next(i for i, c in enumerate(parent.children) if c is chosen[0])
        own = {id(c) for c in chosen}
        loose = any(isinstance(c, str) and c.strip() for c in parent.children)
        beside = [c for c in parent.children if isinstance(c, Node) and id(c) not in own and not c.cut and c.chars]
        if not loose and not any(c.density >= limit and 2 * c.linked <= c.chars for c in beside):
            while at and (isinstance(parent.children[at - 1], str) or parent.children[at - 1].name in HEADINGS or parent.children[at - 1].cut):
                at -= 1
                if isinstance(parent.children[at], Node) and not parent.children[at].cut:
                    chosen.insert(0, parent.children[at])
            own = {id(c) for c in chosen}
            if any(id(c) not in own for c in beside):
                break
        chosen = [parent]
    return chosen


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks below nodes, in page order; without blocks that are links only, unless the page marks them as its article's."""
    up, marked = nodes[0], False
    while up is not None and not marked:
        up, marked = up.parent, up.name in ("article", "main")
    out: list[str] = []
    run: list[str] = []
    free = [False]  # whether the block has text outside links

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        if text and free[0]:
            out.append(text)
        run.clear()
        free[0] = False

    todo: list[tuple[Node | str | None, bool, bool]] = [(n, False, marked) for n in reversed(nodes)]
    while todo:
        item, link, own = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
            free[0] = free[0] or (own or not link) and not item.isspace() and bool(item)
        elif item.name == "br":
            run.append(" ")
        elif not item.cut:
            inner = [(c, link or item.name == "a", own or item.name in ("article", "main")) for c in reversed(item.children)]
            if item.name in INLINE:
                todo += inner
            else:
                flush()
                todo += [(None, False, own), *inner]
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(select(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id"))


QUERIES = {"op2_text_density": op2_text_density}
