"""Main text of web pages by scoring the element tree.

Paragraphs pass points for their length and commas to the elements above them; an element's points
are discounted by the share of its text that stands in links. The best element, widened to
the article around it, and those of its siblings that hold text like it are kept.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea input "
    "iframe object embed svg canvas audio video map dialog menu label fieldset noembed noframes".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup "
    "hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | DROPPED
#: An opening tag ends an open element of these names (up to a boundary of the second set).
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ENDS_P = BLOCKS - {"html", "body"}
_P_SCOPE = frozenset(["td", "th", "caption", "table", "button", "object", "html", "body"])

#: Words in a class, id or role that mark what is not the article.
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|breadcrumbs?|combx|comment|comments|"
    r"complementary|consent|contentinfo|cookie|cookies|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|overlay|pager|pagination|popup|promo|recommended|related|"
    r"respond|rss|shoutbox|sidebar|sidebars|skip|sponsor|sponsored|subscribe|teaser|"
    r"toolbar|tooltip|widget|widgets)(?:$|[\s_-])"
    # Words that articles use too (a share price, a notice of intent): alone, last, or before a part of a page.
    r"|(?:^|[\s_-])(?:notice|notices|promoted|replies|reply|search|share|sharing|social)"
    r"(?=$|\s|[_-](?:area|banner|bar|block|box|button|container|count|form|icon|link|list|panel|popup|row|section|tool|"
    r"widget|wrapper)s?(?:$|[\s_-]))", re.I)
#: Compounds that speak of the layout, not of the element itself.
LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_][\w-]+", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|articlebody|entry-content|post-content|story|main)(?:$|[\s_-])", re.I)

#: A comment, a tag (with any number of attributes, none with a bare ``<``), or other markup. Quotes count behind ``=`` only;
#: every step is possessive and told by its first character, so a tag is read once.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)"
    r"((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)?+|[\"'])*+)>|<[!?/][^<>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

LEAST_PARAGRAPH = 25
COMMA = re.compile("[,،、，]")


@dataclass
class Node:
    name: str
    parent: "Node | None"
    unwanted: bool = False
    article: bool = False
    points: float = 0.0
    chars: int = 0
    link_chars: int = 0
    order: int = 0
    children: list["Node"] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def density(self) -> float:
        return self.link_chars / self.chars if self.chars else 0.0


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether the attributes mark an element as unwanted, as the article."""
    words, hidden = [], False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and "=" not in m[0]:
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            words.append(value)
    text = LAYOUT.sub("", " ".join(words))
    article = bool(ARTICLE.search(text))
    return hidden or (bool(UNWANTED.search(text)) and not article), article


def parse(source: str) -> Node:
    """The tree of the elements that hold blocks; each block is the text between two block-level tags."""
    root = Node("html", None)
    node, held, links, dropped = root, [], 0, 0
    open_: list[tuple[str, Node, bool]] = [("html", root, False)]
    named: Counter[str] = Counter()
    linked = 0
    place = 0

    def flush() -> None:
        nonlocal held, place, linked
        text = " ".join(references.unescape("".join(held)).split())
        held = []
        if text:
            place += 1
            node.blocks.append((place, text))
            node.chars += len(text)
            node.link_chars += min(linked, len(text))
        linked = 0

    def close(depth: int) -> None:
        nonlocal node, links, dropped
        while len(open_) > depth:
            name, _, hidden = open_.pop()
            named[name] -= 1
            if name in BLOCKS:
                flush()
            if name == "a":
                links -= 1
            dropped -= hidden
            node = open_[-1][1]

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        end = m.start() if m else size
        if end > at and not dropped:
            piece = source[at:end]
            held.append(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(open_) - 1, 0, -1) if open_[k][0] == name), 0) if named[name] else 0
            if depth:
                close(depth)
            elif name == "p" and not dropped:
                flush()
            continue
        if name in ("html", "body"):
            continue
        if name in ENDS_P and named["p"]:
            _end_open(open_, close, frozenset(["p"]), _P_SCOPE)
        if name in CLOSES and any(named[x] for x in CLOSES[name][0]):
            _end_open(open_, close, *CLOSES[name])
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCKS:
            if name in BLOCKS:
                flush()
            elif name == "br":
                held.append(" ")
            continue
        if name in BLOCKS:
            flush()
        unwanted, article = _marks(m[3]) if "=" in m[3] or "hidden" in m[3] else (False, False)
        hidden = name in DROPPED or unwanted
        if name in BLOCKS and not hidden and not dropped:
            child = Node(name, node, unwanted, article or name in ("article", "main"), order=place)
            node.children.append(child)
        else:
            child = node
        open_.append((name, child, hidden))
        named[name] += 1
        node = child
        dropped += hidden
        links += name == "a"
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
            if not hidden and not dropped:
                held.append(source[at:stop.start() if stop else size])
            at = stop.end() if stop else size
            close(len(open_) - 1)
    close(1)
    flush()
    return root


def _end_open(open_: list, close, names: frozenset, scope: frozenset) -> None:
    for k in range(len(open_) - 1, 0, -1):
        if open_[k][0] in names:
            close(k)
            return
        if open_[k][0] in scope:
            return


def _ordered(root: Node) -> list[Node]:
    """Every node before those below it."""
    out = [root]
    for n in out:
        out += n.children
    return out


def score(root: Node) -> list[Node]:
    """Passes points up: a block counts one, its commas and its length in hundreds (three at most).

    The element it stands in gets half if it is a paragraph, else all; the parent all, those above a share that falls with the distance.
    """
    nodes = _ordered(root)
    for n in nodes:
        for _, text in n.blocks:
            if len(text) < LEAST_PARAGRAPH:
                continue
            points = 1 + len(COMMA.findall(text)) + min(len(text) / 100, 3)
            up = n.parent if n.name in ("p", "pre", "blockquote", "li", "td") and n.parent else n
            share, level = 1.0, 1
            while up is not None:
                up.points += points * share
                level += 1
                share = 1 / level if level == 2 else 1 / (level * 3)
                up = up.parent
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars
    for n in nodes:
        n.points *= 1 - n.density()
    return nodes


def _is_link_list(n: Node) -> bool:
    return n.name in ("ul", "ol", "dl", "div", "section", "table", "p") and n.chars > 0 and n.density() > 0.6


def _blocks(n: Node, out: list[tuple[int, str]]) -> None:
    todo = [n]
    while todo:
        x = todo.pop()
        if x is not n and _is_link_list(x):
            continue
        out += x.blocks
        todo += x.children


def main_text(source: str | None) -> str:
    """The article's blocks in page order, joined by one space; empty without any text."""
    if not source:
        return ""
    root = parse(source)
    nodes = score(root)
    best = max(nodes, key=lambda n: (n.points, n.chars))
    if not best.points:
        marked = [n for n in nodes if n.article and n.chars]
        best = max(marked or nodes, key=lambda n: n.chars)
    up = best
    while up is not None:
        if up.article:
            best = up
            break
        up = up.parent
    kept = [best]
    if best.parent is not None and not best.article:
        least = max(10.0, best.points * 0.2)
        kept += [n for n in best.parent.children if n is not best and (
            n.points >= least or (n.name == "p" and n.chars > 80 and n.density() < 0.25)
            or n.name in ("h1", "h2", "h3") and n.order <= best.order)]
        if best.parent.blocks and sum(len(t) for _, t in best.parent.blocks) > 80:
            kept.append(Node("div", None, blocks=best.parent.blocks))
    out: list[tuple[int, str]] = []
    for n in kept:
        _blocks(n, out)
    return " ".join(text for _, text in sorted(out))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; null, empty and tag-only pages give an empty text.

    Very long pages are read once from front to back, and whole; rows that repeat give equal results; other columns are not read.
    """

    @F.pandas_udf("string")
    def text(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(x if isinstance(x, str) else None) for x in sources], dtype=object)

    return pages.select("page_id", "url", text.asNondeterministic()(F.col("html")).alias("text")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
