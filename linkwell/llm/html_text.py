"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks of text where block-level tags begin and end. A small log-linear
classifier looks at each block's length, sentence marks, share of linked text, the unlinked words of its
container (the nearest element that is more than a paragraph, heading, list or table) beside the
richest container's, and what the elements around it say by their names; its cost against either
label becomes the capacity of the block's edge from the source (content) or to the sink
(boilerplate). Edges between neighbours, strong ones within a container, are the smoothness terms.
A maximum flow separates the two, and blocks on the source's side, in page order, are the text. So a
line without signs of its own goes with the text around it, on pages whose classes say nothing too.

Within a block, character references are decoded, white space becomes one space and ends are
trimmed; blocks are joined by one space. Scripts, styles, comments and the head never are text.

Cases: a null, empty or textless page gives an empty text; a page that is cut off, unclosed or
misnested is read as far as it goes (an end tag closes its nearest open element, others are
ignored); pages of any length and depth are read whole, in time that grows with their length; a
block whose two costs are equal is boilerplate; repeated rows give repeated results; an empty table
gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices, filled

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_NAMING = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# fixed values: element names by what HTML says of them
_RAW = frozenset("script style noscript template title textarea iframe svg noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mtable mtr mtd semantics annotation".split()
)
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("article section main body div ul ol table td th aside nav header footer form blockquote figure dl".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption address hr".split())
# fixed values: what element names and the words in class, id and role say; strong signs replace what is said around them, weak ones add to it
_STRONG_TAGS = {"article": 3.0, "main": 2.0, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "button": -6.0, "select": -6.0, "header": -5.0, "head": -20.0}
_STRONG_NAMES = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription signup login "
        "sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments reply replies respond disqus footer popup modal "
        "overlay complementary contentinfo hidden"
    ).split()
)
_WEAK_NAMES = frozenset("promo promotion banner notice alert aside toc discussion related recommended share sharing social follow foot header masthead topbar toolbar widget copyright legal disclaimer search".split())
_CONTENT_NAMES = frozenset("article articlebody post content entry story main maincontent text prose".split())
STRONG, WEAK, NAMED = -6.0, -2.5, 2.0
LINK, LENGTH, SENTENCE, START, MASS = -5.0, 0.45, 0.8, -1.2, 2.0  # weights: share of linked text, log of words, sentence marks, constant, words of the container
NEXT, SIBLING = 0.5, 2.0  # smoothness: neighbours in two containers, neighbours in one


def _said(tag: str, attrs: str, inside: float) -> float:
    """What is said of the text in an element. inside: what the elements around it say."""
    value = _STRONG_TAGS.get(tag, inside)
    if tag == "header" and inside > 0:
        value = inside  # an article's own head
    if attrs:
        for key, *quoted in _NAMING.findall(attrs):
            key, text = key.lower(), "".join(quoted)
            if key == "hidden" or key == "aria-hidden" and text.lower() == "true":
                return STRONG
            words = {w.lower() for w in _TOKEN.findall(text)}
            if words & _STRONG_NAMES:
                return STRONG
            if words & _WEAK_NAMES:
                value += WEAK
            elif words & _CONTENT_NAMES:
                value = max(value, NAMED)
    return value


def blocks(page: str) -> list[tuple[str, float, float, int]]:
    """(text, what the elements around say, share of linked characters, container's number) of each block."""
    out, stack, opened = [], [], Counter()  # stack: (tag, says, container's number)
    parts, linked, number = [], 0, 0
    in_link, at, end = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            _, said, container = stack[-1] if stack else ("", 0.0, 0)
            out.append((text, said, min(1.0, linked / len(text)), container))
        parts.clear()
        linked = 0

    def pop_to(index: int) -> None:
        nonlocal in_link
        for tag, _, _ in stack[index:]:
            in_link -= tag == "a"
            opened[tag] -= 1
        del stack[index:]

    def put(raw: str, plain: bool = False) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw and not plain else raw
            parts.append(text)
            if in_link:
                linked += len(text)

    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not closing and tag in ("svg", "math") and attrs.rstrip().endswith("/"):
            continue
        if not closing and tag == "xmp":
            stop = re.compile(r"</xmp(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            flush()
            put(page[at : stop.start() if stop else end], plain=True)
            flush()
            at = stop.end() if stop else end
            continue
        if not closing and tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else at if tag == "svg" else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    if not inline or all(s[0] in _INLINE for s in stack[i + 1 :]):
                        pop_to(i)
                    break
            continue
        if tag in _VOID:
            continue
        shut = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        if any(opened[t] for t in shut):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    pop_to(i)
                elif stack[i][0] in _SCOPES:
                    break
        number += 1
        _, around, container = stack[-1] if stack else ("", 0.0, 0)
        says = _said(tag, attrs, around)
        if attrs.rstrip().endswith("/") and inline:
            continue
        if inline and says != around:
            flush()
        stack.append((tag, says, container if inline or tag in _LEAVES else number))
        opened[tag] += 1
        in_link += tag == "a"
    flush()
    return out


def evidence(text: str, said: float, linked: float, share: float) -> float:
    """Positive for content; the classifier's log odds. share: unlinked words of the block's container beside the richest one's."""
    words = text.count(" ") + 1
    return START + said + LINK * linked + LENGTH * math.log(1 + words) + (SENTENCE if words > 3 and any(c in text for c in ".!?。") else 0.0) + MASS * (2 * share - 1)


def cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: whether each node is on the source's side.

    unary: capacity from the source (positive) or to the sink (negative); edges: (i, j, capacity both
    ways). Flow is sent along shortest augmenting paths from nodes with excess to nodes with room.
    """
    n = len(unary)
    excess = [max(0.0, u) for u in unary]
    room = [max(0.0, -u) for u in unary]
    near: list[list[list]] = [[] for _ in range(n)]  # [other node, residual capacity, index of the reverse edge]
    for i, j, c in edges:
        near[i].append([j, c, len(near[j])])
        near[j].append([i, c, len(near[i]) - 1])
    tiny = 1e-9
    dead = [False] * n  # no way to the sink; later flow cannot open one
    for source in range(n):
        while excess[source] > tiny and not dead[source]:
            came, queue, goal = {source: None}, deque([source]), -1
            while queue:
                i = queue.popleft()
                if room[i] > tiny:
                    goal = i
                    break
                for k, (j, c, _) in enumerate(near[i]):
                    if c > tiny and j not in came and not dead[j]:
                        came[j] = (i, k)
                        queue.append(j)
            if goal < 0:
                for i in came:
                    dead[i] = True
                break
            flow, i = min(excess[source], room[goal]), goal
            while came[i] is not None:
                j, k = came[i]
                flow, i = min(flow, near[j][k][1]), j
            i = goal
            while came[i] is not None:
                j, k = came[i]
                near[j][k][1] -= flow
                near[i][near[j][k][2]][1] += flow
                i = j
            excess[source] -= flow
            room[goal] -= flow
    side = [e > tiny for e in excess]
    queue = deque(i for i in range(n) if side[i])
    while queue:
        i = queue.popleft()
        for j, c, _ in near[i]:
            if c > tiny and not side[j]:
                side[j] = True
                queue.append(j)
    return side


def labelled(page: str) -> tuple[list[str], list[float], list[tuple[int, int, float]]]:
    """Blocks of a page with their evidence and the smoothness edges between them."""
    parts = blocks(page)
    words: dict[int, float] = {}
    for text, said, linked, container in parts:
        words[container] = words.get(container, 0.0) + ((text.count(" ") + 1) * (1 - linked) if said > STRONG else 0.0)
    most = max(words.values(), default=0.0) or 1.0
    unary = [evidence(text, said, linked, words[container] / most) for text, said, linked, container in parts]
    edges = [(i, i + 1, SIBLING if x[3] == y[3] else NEXT) for i, (x, y) in enumerate(pairwise(parts))]
    return [p[0] for p in parts], unary, edges


def main_text(page: str) -> str:
    texts, unary, edges = labelled(page)
    return " ".join(t for t, keep in zip(texts, cut(unary, edges), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with out, the main text, instead of the html column."""
    rows = pages.drop(out) if out != html_col else pages
    at = rows.columns.index(html_col)
    keep = [i for i in range(len(rows.columns)) if i != at]

    def run(batches):
        for batch in batches:
            for a, n in byte_slices(batch.column(at)):
                part = batch.slice(a, n)
                texts = [main_text(h) for h in filled(part.column(at)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(texts, pa.string())], [*(part.schema.names[i] for i in keep), out])

    fields = [rows.schema.fields[i] for i in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{schema}{', ' if fields else ''}`{out}` string")
