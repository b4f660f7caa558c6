"""Main-text extraction by minimum-cut labelling.

A page is cut into text blocks with their DOM paths. A linear classifier over
the path, link share, length and punctuation gives each block a score: its
positive part is the capacity from the source (content), its negative part the
capacity to the sink (boilerplate). Neighbours in page order and blocks near in
the DOM are joined by smoothness edges, stronger the nearer they are in the
DOM. The minimum cut labels the blocks. Blocks whose own capacity exceeds all
their edges are labelled at once, one after another; max-flow by blocking flows
labels what is left.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

#: Comments, declarations, elements of raw text with all they hold, tags, and text; an unclosed one runs to the end.
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|select|textarea|head|object|canvas)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q ruby rt rp s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the same kind, and what they do not reach past.
SELF_CLOSING = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("article main section div ul ol dl table body nav aside header footer form blockquote".split())
#: Fixed classifier weights: of ancestors by element, and of words in their class and id.
ELEMENTS = {"article": 3.0, "main": 3.0, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "header": -4.0, "menu": -6.0, "button": -6.0, "dialog": -6.0, "figcaption": -0.5, "address": -2.0, "title": -6.0}
BAD = re.compile(
    r"(?:^|[-_ ])(?:ad(?:s|vert\w*|box|slot|unit|\d+)?|banner|breadcrumbs?|comment\w*|respond|cookies?|consent|gdpr|notices?|alert|disclaimer"
    r"|footer|header|masthead|menu\w*|nav\w*|topbar|newsletter|popup|modal|dialog|overlay|promo\w*|related|recommend\w*|share|sharing|sidebar|side"
    r"|complementary|contentinfo|social|sponsor\w*|subscribe|subscription|toolbar|widget|login|signup|register|search|form|disqus|replies|reply"
    r"|discussion|pagination|pager|skip|legal|copyright|hidden)(?:$|[-_ ])",
    re.I,
)
GOOD = re.compile(r"(?:^|[-_ ])(?:article|content|entry|main|post|story|text|body)(?:$|[-_ ])", re.I)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ENDS = re.compile(r"[.!?,;:…](?:\s|$)")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
INVISIBLE = re.compile(r"display\s*:\s*none|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)
SMOOTH, NEAR, EPSILON = 0.3, 0.6, 1e-9


class Node:
    """A block element: its parent and its depth."""

    __slots__ = ("depth", "tag", "up")

    def __init__(self, tag: str, up: Node | None):
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0


@dataclass
class Block:
    """A text block: its text, the share of it inside links, its element, and the weight of the path to it."""

    text: str
    links: float
    node: Node
    weight: float


def own_weight(tag: str, attributes: str, inside: float) -> float:
    weight = ELEMENTS.get(tag, 0.0)
    if tag == "header" and inside >= 3.0:
        weight = -0.5  # an article's own header holds its title
    if attributes:
        names = " ".join(a or b or c for _, a, b, c in NAMES.findall(attributes))
        if INVISIBLE.search(attributes):
            weight -= 6.0
        if names:
            names = CAMEL.sub("-", names)
            if BAD.search(names):
                weight -= 6.0
            elif GOOD.search(names):
                weight += 1.5
    return weight


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, in time that grows with the page."""
    root = Node("", None)
    stack: list[tuple[str, Node, float]] = [("", root, 0.0)]  # element, block element around it, weight of the path
    opened: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                share = min(1.0, linked / max(1, len(raw)))
                out.append(Block(text, share, stack[-1][1], stack[-1][2]))
            parts.clear()
        linked = 0

    def leave(k: int) -> None:
        for name, _, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    for m in PIECE.finditer(page):
        text = m[8]
        if text is not None:
            parts.append(text)
            if opened["a"]:
                linked += len(text)
            continue
        tag = m[3] or m[6]
        if not tag:
            if m[1]:
                parts.append(" ") if m[1].lower() in ("svg", "canvas") else close()
            continue
        tag = tag.lower()
        ending = bool(m[2] or m[5])
        inline = tag in INLINE
        if not inline:
            close()
        if ending:
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        leave(k)
                        break
                    if inline and stack[k][0] not in INLINE:
                        break
            continue
        if not inline and stack[-1][0] in INLINE:  # a block ends the inline elements left open before it
            k = len(stack)
            while stack[k - 1][0] in INLINE:
                k -= 1
            leave(k)
        for other in SELF_CLOSING.get(tag, "").split():
            for k in range(len(stack) - 1, 0, -1) if opened[other] else ():
                if stack[k][0] == other:
                    leave(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        if tag in VOID:
            continue
        opened[tag] += 1
        _, node, inside = stack[-1]
        stack.append((tag, node if inline else Node(tag, node), inside + own_weight(tag, m[4] or m[7] or "", inside)))
    close()
    return out


def score_block(b: Block) -> float:
    """Log-odds of content."""
    size = len(b.text)
    score = b.weight - 4.0 * b.links - 0.6
    score += min(2.5, size / 80) + min(1.0, 0.25 * len(ENDS.findall(b.text)))
    if b.node.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"):
        score += 1.0
    if b.text[0] == "©" or "All rights reserved" in b.text[:200] and size < 200:
        score -= 2.0
    return score


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut (of several, of the one with the fewest).

    ``gain`` above 0 is a capacity from the source, below 0 one to the sink. A
    node whose capacity exceeds those of all its edges has its side, and its
    edges become capacities of its neighbours.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    own, bound = list(gain), [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is not None or -bound[i] + EPSILON < own[i] <= bound[i] + EPSILON:
            continue
        side[i] = own[i] > 0
        for j, c in near[i].items():
            if side[j] is None:
                own[j] += c if side[i] else -c
                bound[j] -= c
                todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        place = {x: i for i, x in enumerate(rest)}
        between = [(place[a], place[b], c) for a in rest for b, c in near[a].items() if a < b and b in place]
        for i, content in zip(rest, maximum_flow([own[i] for i in rest], between), strict=True):
            side[i] = content
    return [bool(x) for x in side]


def maximum_flow(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The nodes that the source still reaches beside a maximum flow, found by blocking flows in layers."""
    n = len(gain)
    source, sink = n, n + 1
    heads: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(heads))
        out[b].append(len(heads) + 1)
        heads.extend((b, a))
        room.extend((there, back))

    for i, g in enumerate(gain):
        if g > 0:
            join(source, i, g, 0.0)
        elif g < 0:
            join(i, sink, -g, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        layer = [-1] * (n + 2)
        layer[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > EPSILON and layer[heads[e]] < 0:
                    layer[heads[e]] = layer[a] + 1
                    queue.append(heads[e])
        if layer[sink] < 0:
            return [x >= 0 for x in layer[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= EPSILON)
                at = heads[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if room[e] > EPSILON and layer[heads[e]] == layer[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(out[at]):
                path.append(out[at][turn[at]])
                at = heads[path[-1]]
            elif path:  # a dead end
                layer[at] = -1
                at = heads[path.pop() ^ 1]
            else:
                break


def apart(a: Node, b: Node) -> int:
    """Steps from one element to the other along the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order, and between each block and the next of the same parent."""
    edges = []
    last: dict[Node | None, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SMOOTH + NEAR / (1 + apart(blocks[i - 1].node, b.node))))
        parent = b.node.up
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, NEAR / 2))
        last[parent] = i
    return edges


def main_text(page: str | None) -> str:
    """The main text of a page; empty for a null or empty one, or one without content."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    gain = [score_block(b) for b in blocks]
    # no edge can turn a label if all scores have one sign
    content = minimum_cut(gain, smoothness(blocks)) if min(gain) < 0 < max(gain) else [g > 0 for g in gain]
    return "\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages(page_id, url, html)``.

    A null or empty html gives an empty text; a very long or deeply nested page
    is read whole by one task, in time that grows with its length; repeated rows
    are extracted row by row; an empty table gives an empty result; other
    columns are not read.
    """
    ship_package(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    return source.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
