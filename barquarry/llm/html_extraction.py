"""Main text of web pages by tree scoring.

A page is parsed into a tree of elements, with the end tags that HTML lets authors leave
out.  Elements that are never article text (menus, scripts, forms, adverts, comments, by
element, role, hiding or a word that a class or id names them by) are cut off first.  A
class such as has-sidebar or content-sidebar-wrap names no sidebar; and no form, class or
id cuts an element that holds most of the page's text outside links, unless it is named as
comments or an article or main element stands outside it.  Then each paragraph gives
its ancestors points: one, one per comma, one per 100 characters up to three; the parent
gets them whole, the grandparent half, the k-th ancestor 1 / (3 k).  An ancestor's points
are discounted by its link density (characters inside links by all its characters).  The
best container is kept with those siblings that have a fifth of its points, or that are
paragraphs with few links.  The text of what is kept is returned whole, block by block.

Defined results: null or empty html, or a page without text: empty text.  A page in which
nothing scores is taken from its body.  Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquarry.llm import storage
from barquarry.llm.words import pieces

# no alternative gives anything back, so a search takes a time in proportion to what it passes
_OPEN = r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
TAG = re.compile(_OPEN + r"""((?:=\s*+"[^"]*"|=\s*+'[^']*'|[^>])*+)>|<[!?][^>]*+(?:>|\Z)""", re.S)
BARE_TAG = re.compile(_OPEN + r"([^>]*+)>|<[!?][^>]*+(?:>|\Z)", re.S)  # ends at the first >, quoted or not
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
MARKS = frozenset("class id role hidden aria-hidden style".split())
PARTS = re.compile(r"[a-z]+")

# Element names of HTML by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math noembed noframes".split())
CUT = frozenset("nav footer aside form script style noscript iframe button select option textarea input label title head template svg math object canvas audio video dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPHS = frozenset("p pre td th blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tr", "td", "th")}
FENCE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "thead": ("table",)}
WORDS_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer form gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promotion related replies reply respond share sharing shoutbox sidebar signup social sponsor sponsored sponsors subscribe taboola toolbar widget widgets".split()
)
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
STRONG_OUT = frozenset("ad ads advert comment comments cookie cookies disqus footer menu nav navbar navigation sidebar".split())
BOXES = frozenset("area bar block box btn button buttons container group holder icon icons inner item items label link links list panel row section slot tool tools unit wrap wrapper".split())
WORDS_IN = frozenset("article body content entry main post story text page".split())
STATES = frozenset("has have no not with without hide hides show shows is".split())  # a class that tells of a part elsewhere
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("name", "attrs", "parent", "children", "points", "size", "linked", "commas")

    def __init__(self, name: str, attrs: str, parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.linked = self.commas = 0


class Open:
    """The innermost open element, and how many of each name are open."""

    def __init__(self, root: Node):
        self.now, self.count = root, Counter()

    def enter(self, node: Node) -> None:
        self.now = node
        self.count[node.name] += 1

    def leave_to(self, node: Node) -> None:
        while self.now is not node:
            self.count[self.now.name] -= 1
            self.now = self.now.parent


def parse(source: str) -> Node:
    """The tree of a page. Whatever is left open ends with the page.

    Quotes count as such behind an equals sign only.  Where one is never closed, so that no tag could end any more,
    tags end at the first > from there on.
    """
    root = Node("#root", "", None)
    tree = Open(root)
    at, for_end, last = 0, len(source), source.rfind(">")
    tag = TAG
    while at < for_end:
        m = tag.search(source, at) if at <= last or "<!" in source[at:] else None
        begin = re.compile(r"<[a-zA-Z/]").search(source, at, last + 1 if m is None else m.start()) if tag is TAG else None
        if begin is not None and source.find(">", begin.start()) >= 0:
            tag = BARE_TAG
            continue
        if m is None:
            rest = source[at:]
            cut = re.search(r"<[a-zA-Z/!]", rest)  # a tag that the page's end cuts off
            tree.now.children.append(rest[: cut.start()] if cut else rest)
            break
        if m.start() > at:
            tree.now.children.append(source[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            _end(tree, name)
            continue
        if name in CLOSES_P and tree.count["p"]:
            tree.leave_to(_closed(tree.now, ("p",), ("article", "td", "th", "li", "div", "section", "blockquote", "body")))
        if name in HEADINGS and tree.now.name in HEADINGS:
            tree.leave_to(tree.now.parent)
        if name in ENDS and any(tree.count[x] for x in ENDS[name]):
            tree.leave_to(_closed(tree.now, ENDS[name], FENCE.get(name, ())))
        node = Node(name, m.group(3), tree.now)
        tree.now.children.append(node)
        if name in ("svg", "math") and _empty(m.group(3)):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            if name in ("title", "textarea"):
                node.children.append(source[at : end.start() if end else for_end])
            at = end.end() if end else for_end
        elif name not in VOID and not (m.group(3).endswith("/") and name in INLINE):
            tree.enter(node)
    return root


def _end(tree: Open, name: str) -> None:
    """An end tag: of the innermost open element of that name, but the end of a mark does not end a block."""
    if tree.count[name]:
        node = tree.now
        while node.name != name:
            if name in INLINE and node.name not in INLINE:
                return
            node = node.parent
        tree.leave_to(node.parent)
    elif name == "p":
        tree.now.children.append(Node("p", "", tree.now))


def _closed(now: Node, names: tuple[str, ...], fence: tuple[str, ...]) -> Node:
    """Where to go on after the innermost open element of these names has ended, if no fence stands before it."""
    node = now
    out = now
    while node.parent is not None:
        if node.name in names:
            out = node.parent
            if names == ("p",):
                return out
        elif node.name in fence:
            return out
        node = node.parent
    return out


def _empty(attrs: str) -> bool:
    """Whether a tag ends in a slash of its own, not in that of a value without quotes."""
    return attrs.endswith("/") and not any(m.group(4) and m.end() == len(attrs) for m in ATTR.finditer(attrs))


def _marks(attrs: str) -> dict[str, str]:
    """The attributes that may tell what an element is; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for key, a, b, c in ATTR.findall(attrs):
        key = key.lower()
        if key in MARKS:
            out.setdefault(key, (a or b or c).lower())
    return out


def _names(value: str, inside: bool) -> set[str]:
    """The words that a class or id names an element by. inside an article or main, share-price names none: only
    whole tokens do, and those that name a box (share-buttons)."""
    out: set[str] = set()
    for token in value.split():
        parts = PARTS.findall(token)
        if inside and len(parts) > 1 and not all(x in BOXES or x in WORDS_OUT for x in parts):
            continue
        if len(parts) > 1 and not STATES.isdisjoint(parts):
            continue
        if len(parts) > 1 and not WORDS_IN.isdisjoint(parts):
            parts = parts[-1:]  # post-footer is a footer, content-sidebar-wrap a wrap
        out.update(parts)
    return out


def _unwanted(node: Node, inside: bool) -> str | None:
    """Why an element is no article text: "sure", or "name" or "comments" if only a form, class or id says so. inside: of an article or main."""
    if node.name == "form":
        return "name"
    if node.name in CUT or (node.name == "header" and not inside):
        return "sure"
    if not node.attrs or node.name in ("html", "body", "article", "main"):
        return None
    marks = _marks(node.attrs)
    role = marks.get("role")
    if "hidden" in marks or marks.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", marks.get("style", "")) or (role in ROLES_OUT and role != "form"):
        return "sure"
    names = _names(marks.get("class", ""), inside) | _names(marks.get("id", ""), inside)
    if names & STRONG_OUT or (names & WORDS_OUT and not names & WORDS_IN):
        return "comments" if names & COMMENTS else "name"
    return "name" if role == "form" else None


def _prune(root: Node) -> None:
    """Cut off what is no article text, in place."""
    stack, named = [(root, False)], []
    while stack:
        node, inside = stack.pop()
        inside = inside or node.name in ("article", "main")
        kept = []
        for x in node.children:
            if not isinstance(x, str):
                why = _unwanted(x, inside)
                if why == "sure":
                    continue
                if why:
                    named.append((x, why))
                stack.append((x, inside))
            kept.append(x)
        node.children = kept
    if not named:
        return
    held, marked = _held(root)
    gone = {node for node, why in named if why == "comments" or 2 * held[node] <= held[root] or marked[node] < marked[root]}
    for parent in {node.parent for node in gone}:
        parent.children = [x for x in parent.children if isinstance(x, str) or x not in gone]


def _held(root: Node) -> tuple[dict[Node, int], dict[Node, int]]:
    """Per element its characters outside links, and the article and main elements in it, itself included."""
    held, marked = {}, {}
    for node in reversed(_ordered(root)):
        below = [x for x in node.children if not isinstance(x, str)]
        held[node] = 0 if node.name == "a" else sum(len(x.strip()) for x in node.children if isinstance(x, str)) + sum(held[x] for x in below)
        marked[node] = (node.name in ("article", "main")) + sum(marked[x] for x in below)
    return held, marked


def _ordered(root: Node) -> list[Node]:
    """All elements, each after its parent."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.children) if not isinstance(x, str))
    return out


def _score(nodes: list[Node]) -> None:
    """Give sizes, link sizes and points to all elements."""
    for node in reversed(nodes):
        own = [x for x in node.children if isinstance(x, str)]
        node.size += sum(len(x.strip()) for x in own)
        node.commas += sum(x.count(",") + x.count("、") + x.count("，") for x in own)
        if node.name == "a":
            node.linked = node.size
        if node.parent is not None:
            node.parent.commas += node.commas
            node.parent.size += node.size
            node.parent.linked += node.linked
    for node in nodes:
        loose = node.name not in PARAGRAPHS and node.name not in INLINE and any(isinstance(x, str) and x.strip() for x in node.children)
        if node.name not in PARAGRAPHS and not loose:
            continue
        size, commas = (node.size, node.commas) if not loose else _loose(node)
        if not size:
            continue
        points = (1 + commas + min(size / 100, 3)) * (1 if size >= 25 else size / 25)
        at, k = (node if loose else node.parent), 0
        while at is not None and at.name not in ("#root", "html") and k < 5:
            at.points += points / (1, 2, 6, 9, 12)[k]
            at, k = at.parent, k + 1


def _loose(node: Node) -> tuple[int, int]:
    """Size and commas of the text that stands in a container itself."""
    own = [x.strip() for x in node.children if isinstance(x, str)]
    return sum(map(len, own)), sum(x.count(",") for x in own)


def _worth(node: Node) -> float:
    return node.points * (1 - node.linked / node.size) if node.size else 0.0


def _chosen(root: Node, nodes: list[Node]) -> list[Node]:
    """The best container, and those siblings that belong to it, in page order."""
    for name in ("article", "main"):  # what the author marked is a candidate that its parts do not outdo
        for node in nodes:
            if node.name == name:
                node.points *= 2
    best = max(nodes, key=_worth, default=None)
    if best is None or _worth(best) <= 0:
        return [next((n for n in nodes if n.name == "body"), root)]
    # a part of an article stands for the whole of it
    up = best
    while up.parent is not None:
        if up.name in ("article", "main"):
            best = up
            if up.name == "article":
                break
        up = up.parent
    if best.parent is None:
        return [best]
    least = max(3.0, 0.2 * _worth(best))
    out = []
    for x in best.parent.children:
        if x is best:
            out.append(x)
        elif isinstance(x, Node) and x.size:
            links = x.linked / x.size
            if _worth(x) >= least or (x.name == "p" and (links < 0.25 if x.size > 80 else not links and best.name not in ("article", "main"))):
                out.append(x)
            elif x.name in HEADINGS and not links and best.name not in ("article", "main"):
                out.append(x)
    return out


def _blocks(node: Node, out: list[str]) -> None:
    """The text of an element, a string for each block, white space made one space."""
    run: list[str] = []

    def close() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(text)
            run.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(entities.unescape(x) if "&" in x else x)  # a reference does not go on behind a tag
        else:
            if x.name in ("br", "img", "wbr"):
                run.append(" " if x.name == "br" else "")
            block = x.name not in INLINE
            if block:
                close()
                stack.append(None)
            stack.extend(reversed(x.children))
    close()


def main_text(source: str | None) -> str:
    """The page's article, blocks joined by two line feeds."""
    if not source:
        return ""
    root = parse(source)
    _prune(root)
    nodes = _ordered(root)
    _score(nodes)
    out: list[str] = []
    for node in _chosen(root, nodes):
        _blocks(node, out)
    return "\n\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "html", 1 << 22):
        found = [main_text(x) for x in piece.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    storage.small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
