"""HTML extraction by minimum-cut labelling of text blocks.

The graph of a page has a node for each block of text and for each landmark, an
element whose tag or name says what it is for. A block's capacity to a terminal
is the log-odds that a logistic regression gives its own text: length, share of
link text, sentence end, kind of element, copyright marks. A landmark's capacity
is what its name says. What stands around a block isn't in its own capacity but
in edges: to the landmark it stands in, to the block before and after it (less,
the farther apart they are in the tree), and to the one that follows in the same
parent. So a single word inside an article, or a full sentence inside an advert,
is labelled by the cut against its own score; so is a form around a whole page.

The regression is fitted on the blocks inside landmarks of a bounded sample of
pages, towards the fixed weights PRIOR; pages without landmarks leave it there.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_NAME = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CAPITAL = re.compile(r"[a-z](?=[A-Z])")
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

#: Elements whose content is never text of a page.
RAW = frozenset("script style noscript template svg math iframe object embed canvas audio video head textarea select datalist".split())
#: Those of them whose content is no markup, so that only their own end tag ends them, and the tags that may stand in a head.
LITERAL = frozenset("script style textarea".split())
HEAD = frozenset("html head title base basefont bgsound link meta noscript noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
#: Tags and words of classes, ids and roles that make an element a landmark: no content inside, rather none, rather content, content.
AGAINST = frozenset("nav footer aside menu dialog button".split())
FOR = frozenset("article main".split())
NAMES_AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments reply replies respond discussion disqus "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar widget related "
    "recommended menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer copyright masthead toolbar skip search searchbox complementary contentinfo".split()
)
NAMES_RATHER_AGAINST = frozenset("header side tags meta byline toc aside links teaser alert".split())
NAMES_RATHER_FOR = frozenset("articlebody content post entry story body text maintext prose".split())
#: Capacities: of a landmark alone, for each block in it, and of the edges for content in a landmark against it, and for none in one for content.
ALONE, EACH, INTO, OUT = 9.0, 7.0, 6.5, 4.2
RATHER = 2.0
#: Weights of a block's features (see features()) before any page was seen.
PRIOR = (-1.0, 1.2, -5.0, 0.6, 1.0, -0.4, -4.0)
_SCOPES = frozenset("div ul ol table td article section".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCALE = 1000


@dataclass(slots=True, eq=False)
class Landmark:
    """An element that says what it is for: kind -2 (no content), -1, 1 or 2 (content), or 0 where one around it overrules it; lone ones count once, however much they hold, and give way to an article inside."""

    kind: int
    lone: bool
    around: Landmark | None
    depth: int = 0
    blocks: int = 0  # in it and in the landmarks inside it


@dataclass(slots=True, eq=False)
class Node:
    """An open element; landmark is the nearest one at it or around it, scope whether a p or li that it could close is open."""

    tag: str
    parent: Node | None
    depth: int
    landmark: Landmark | None = None
    in_p: bool = False
    in_li: bool = False


@dataclass(slots=True)
class TextBlock:
    text: str
    node: Node
    linked: int


def _kind(tag: str, attributes: str) -> tuple[int, bool]:
    """What an element's tag and names say, and whether that counts once only."""
    if tag in AGAINST:
        return -2, False
    if attributes:
        if _HIDDEN.search(attributes):
            return -2, False
        words = {part for m in _NAME.finditer(attributes) for part in _PART.findall(_CAPITAL.sub(lambda x: x[0] + " ", m[1] or m[2] or m[3] or "").lower())}
        if words & NAMES_AGAINST:
            return -2, tag in ("html", "body")
        if tag in ("form", "header"):
            return -2, tag == "form"
        if words & NAMES_RATHER_AGAINST:
            return -1, True
        if tag in FOR or "article" in words or "main" in words:
            return 2, False
        if words & NAMES_RATHER_FOR:
            return 1, False
    if tag in ("form", "header"):
        return -2, tag == "form"
    return (2, False) if tag in FOR else (0, False)


def _landmark(tag: str, attributes: str, around: Landmark | None) -> Landmark | None:
    kind, lone = _kind(tag, attributes)
    if tag == "header" and around and around.kind > 0:
        kind = 0  # the heading of an article
    if not kind:
        return around
    if kind == -1 and around and around.kind == 2:
        return around  # a byline or a table of contents is part of its article
    if kind > 0 and around and around.kind <= 0 and not around.lone:
        return Landmark(0, False, around, around.depth + 1)
    if kind > 0 and around and around.kind >= kind:
        return around
    return Landmark(kind, lone, around, around.depth + 1 if around else 0)


def blocks_of(page: str) -> list[TextBlock]:
    """The blocks of text of a page, in order: white space collapsed, character references decoded, raw elements skipped.

    A raw element ends with its own end tag or that of an element around it; a
    head also ends before text, or a tag that can't stand in it. Without its end
    tag a script, style or textarea goes on to the end of the page.
    """
    root = Node("", None, 0)
    at, out, pos, linked, in_link = root, [], 0, 0, 0
    held: list[str] = []
    raw: Node | None = None  # the outermost open raw element
    inline: dict[str, int] = {}
    is_open: dict[str, int] = {}  # open elements of each tag, so that no end tag looks for one in vain

    def enter(tag: str, landmark: Landmark | None) -> Node:
        is_open[tag] = is_open.get(tag, 0) + 1
        free = tag not in _SCOPES
        return Node(tag, at, at.depth + 1, landmark, tag == "p" or (free and at.in_p), tag == "li" or (free and at.in_li))

    def leave(up: Node) -> Node:
        """Closes up and all inside it; each element is closed once."""
        x = at
        while True:
            is_open[x.tag] -= 1
            if x is up:
                return up.parent
            x = x.parent

    def flush():
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(TextBlock(text, home, linked))
            held.clear()
        linked = 0

    home = root
    scan = _MARKUP.finditer(page)
    while m := next(scan, None):
        if m.start() > pos:
            piece = page[pos : m.start()]
            if raw and raw.tag == "head" and at is raw and piece.strip():
                at, raw = leave(raw), None
            if not raw:
                held.append(piece)
                if in_link:
                    linked += len(piece.strip())
        pos = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1]
        opens = not closing and not m[3].endswith("/") and tag not in VOID
        if tag in LITERAL or (tag == "title" and raw and raw.tag == "head" and at is raw):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos) if opens else None
            if end or (opens and tag in LITERAL):
                pos = end.end() if end else len(page)
                scan = _MARKUP.finditer(page, pos)
            if tag in LITERAL:
                flush()
            if tag in LITERAL or end:
                continue
        if raw:
            if raw.tag == "head" and not closing and (tag == "body" or (at is raw and tag not in HEAD)):
                ends = True
            elif closing:
                up = at if is_open.get(tag) else raw.parent
                while up is not raw.parent and up.tag != tag:
                    up = up.parent
                if up is not raw.parent:
                    at, raw = leave(up), None if up is raw else raw
                    continue
                ends = inline.get(tag, 0) > 0 if tag in INLINE else is_open.get(tag, 0) > 0
            else:
                ends = False
            if not ends:
                if opens:
                    at = enter(tag, at.landmark)
                continue
            at, raw = leave(raw), None
        if tag in RAW:
            flush()
            if opens:
                raw = at = enter(tag, at.landmark)
            continue
        if tag == "a":
            in_link = max(0, in_link + (-1 if closing else 1)) if closing else 1
        if tag in INLINE:
            if opens or closing:
                inline[tag] = max(0, inline.get(tag, 0) + (-1 if closing else 1))
            if tag == "br":
                held.append(" ")
            continue
        flush()
        if closing:
            if is_open.get(tag):
                up = at
                while up.tag != tag:
                    up = up.parent
                at = leave(up)
            in_link = 0
            inline.clear()
        elif tag not in VOID:
            if at.in_li if tag == "li" else tag in _CLOSES_P and at.in_p:
                up, kind = at, "li" if tag == "li" else "p"
                while up.tag != kind:
                    up = up.parent
                at = leave(up)
            at = enter(tag, _landmark(tag, m[3], at.landmark))
        home = at
    if pos < len(page) and (not raw or (raw.tag == "head" and at is raw)):
        held.append(page[pos:])
    flush()
    return out


def features(block: TextBlock) -> tuple[float, ...]:
    """What the classifier sees: only the block's own text and element, nothing of what is around it."""
    text, tag = block.text, block.node.tag
    words = text.count(" ") + 1
    link = min(1.0, block.linked / max(1, len(text)))
    heading = tag[:1] == "h" and tag[1:].isdigit()
    owned = text[:1] == "©" or "all rights reserved" in text.lower()
    return (1.0, min(6.0, math.log2(1 + words / 8)), link, float(text[-1] in ".!?…:;\"'”»"), float(heading), float(tag == "li"), float(owned))


def content_score(block: TextBlock, weights=PRIOR) -> float:
    """Log-odds of being content by the block alone, within -4 to 4; text that is mostly links may have -5.2."""
    x = features(block)
    return max(-5.2 if x[2] > 0.5 else -4.0, min(4.0, sum(w * v for w, v in zip(weights, x, strict=True))))


def fit_weights(x: np.ndarray, y: np.ndarray, counts_as: float = 500.0, steps: int = 25) -> tuple[float, ...]:
    """Logistic regression by Newton steps towards PRIOR; each class of blocks counts as counts_as / 2 rows at most."""
    prior = np.array(PRIOR)
    good = y.sum()
    if not 0 < good < len(y):
        return PRIOR
    weight = np.where(y > 0, min(1.0, counts_as / 2 / good), min(1.0, counts_as / 2 / (len(y) - good)))
    w = prior.copy()
    for _ in range(steps):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ w)))
        gradient = x.T @ (weight * (p - y)) + (w - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        w = w - step
        if abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def graph_of(blocks: list[TextBlock], smooth: float, weights=PRIOR) -> tuple[list[int], dict[tuple[int, int], int]]:
    """(capacities, arcs) of a page: the blocks are the first nodes, landmarks follow. arcs[i, j] is what it costs if i is content and j is not."""
    own = [content_score(b, weights) for b in blocks]
    arcs: dict[tuple[int, int], float] = {}
    place: dict[int, int] = {}
    marks: list[Landmark] = []

    def arc(i: int, j: int, there: float, back: float) -> None:
        arcs[i, j] = arcs.get((i, j), 0.0) + there
        arcs[j, i] = arcs.get((j, i), 0.0) + back

    def node_of(m: Landmark) -> int:
        if id(m) not in place:
            place[id(m)] = len(blocks) + len(marks)
            m.blocks = 0
            marks.append(m)
            own.append(0.0)
        return place[id(m)]

    last: dict[int, int] = {}
    for j, b in enumerate(blocks):
        if j:
            tie = smooth * 1.2 / (1 + _distance(blocks[j - 1].node, b.node))
            arc(j - 1, j, tie, tie)
        parent = id(b.node.parent or b.node)
        if parent in last:
            arc(last[parent], j, smooth * 0.6, smooth * 0.6)
        last[parent] = j
        if m := b.node.landmark:
            k, weak = node_of(m), abs(m.kind) == 1
            m.blocks += 1
            arc(j, k, RATHER if weak else INTO, RATHER if weak else OUT)
    for m in marks:  # grows while the landmarks around others join
        if m.around:
            node_of(m.around)
    for m in sorted(marks, key=lambda m: -m.depth):
        if m.around:
            m.around.blocks += m.blocks
    for m in marks:
        if m.around and m.around.kind <= 0:
            # No landmark is content inside one that isn't.
            arc(place[id(m)], place[id(m.around)], 2 * (ALONE + EACH * len(blocks)), 0.0)
    for m in marks:
        size = ALONE if m.lone else ALONE + EACH * m.blocks
        own[place[id(m)]] = (m.kind > 0) * size - (m.kind < 0) * size if abs(m.kind) > 1 else m.kind * (RATHER if m.lone else RATHER * (1 + m.blocks))
    return [round(SCALE * v) for v in own], {e: round(SCALE * c) for e, c in arcs.items() if c > 0}


def min_cut(unary: list[int], arcs: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut.

    unary[i] > 0 is a capacity from the source, < 0 one to the sink; arcs[i, j] is
    cut if i lies on the source's side and j doesn't. A node whose own capacity
    exceeds all arcs that could speak against it keeps its side in every minimum
    cut, so it is taken out first and its arcs fold into its neighbours; Dinic's
    max-flow decides about the rest.
    """
    n = len(unary)
    near: list[dict[int, list[int]]] = [{} for _ in range(n)]
    out, into = [0] * n, [0] * n
    for (i, j), c in arcs.items():
        if c > 0 and i != j:
            near[i].setdefault(j, [0, 0])[0] += c
            near[j].setdefault(i, [0, 0])[1] += c
            out[i] += c
            into[j] += c
    unary, side = list(unary), [None] * n
    queue = list(range(n))
    while queue:
        i = queue.pop()
        if side[i] is None and (unary[i] > out[i] or -unary[i] > into[i]):
            side[i] = unary[i] > 0
            for j, (there, back) in near[i].items():
                unary[j] += there if side[i] else -back
                out[j] -= back
                into[j] -= there
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        place = {i: k + 2 for k, i in enumerate(rest)}
        graph: list[list[list[int]]] = [[] for _ in range(len(rest) + 2)]

        def add(u, v, c, back):
            graph[u].append([v, c, len(graph[v])])
            graph[v].append([u, back, len(graph[u]) - 1])

        for i in rest:
            if unary[i] > 0:
                add(0, place[i], unary[i], 0)
            elif unary[i] < 0:
                add(place[i], 1, -unary[i], 0)
            for j, (there, back) in near[i].items():
                if i < j:
                    add(place[i], place[j], there, back)
        while (level := _levels(graph))[1] >= 0:
            _block(graph, level)
        for i in rest:
            side[i] = level[place[i]] >= 0
    return side


def _levels(arcs) -> list[int]:
    level = [-1] * len(arcs)
    level[0], queue = 0, [0]
    for u in queue:
        for v, c, _ in arcs[u]:
            if c > 0 and level[v] < 0:
                level[v] = level[u] + 1
                queue.append(v)
    return level


def _block(arcs, level) -> None:
    """A blocking flow from node 0 to node 1 over the levels."""
    following, path = [0] * len(arcs), []
    u = 0
    while True:
        if u == 1:
            flow = min(arc[1] for _, arc in path)
            for k, (v, arc) in enumerate(path):
                arc[1] -= flow
                arcs[arc[0]][arc[2]][1] += flow
            k = next(k for k, (_, arc) in enumerate(path) if not arc[1])
            u = path[k][0]
            del path[k:]
            continue
        while following[u] < len(arcs[u]):
            arc = arcs[u][following[u]]
            if arc[1] > 0 and level[arc[0]] == level[u] + 1:
                break
            following[u] += 1
        else:
            if not path:
                return
            u, _ = path.pop()
            following[u] += 1
            continue
        path.append((u, arc))
        u = arc[0]


def labels_of(blocks: list[TextBlock], smooth: float = 1.0, weights=PRIOR) -> list[bool]:
    """Which blocks the minimum cut makes content."""
    return min_cut(*graph_of(blocks, smooth, weights))[: len(blocks)]


def main_text(page: str | None, smooth: float = 1.0, weights=PRIOR) -> str:
    """The content blocks of a page, joined by line ends."""
    found = blocks_of(page or "")
    return "\n".join(b.text for b, ok in zip(found, labels_of(found, smooth, weights), strict=True) if ok)


def fit(pages: DataFrame, fit_pages: int = 1_000) -> tuple[float, ...]:
    """Weights of the block classifier, from the blocks inside plain landmarks of at most fit_pages pages (a documented bound), those of the least hashes of their ids.

    Blocks inside an article count as content, those inside menus, adverts, footers
    and the like as none; other blocks teach nothing. Each page sends its sums of
    features to the driver, rounded to distinct rows: at most 64 for each page and
    class.
    """
    first = pages.select(F.col("page_id").cast("long").alias("page_id")).where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages)
    some = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").where("html is not null").join(F.broadcast(first), "page_id", "left_semi").dropDuplicates(["page_id"])

    def run(batches):
        for batch in batches:
            for page in batch.column(1):
                rows, y = [], []
                for b in blocks_of(page.as_py()):
                    m = b.node.landmark
                    if m and abs(m.kind) == 2 and sum(v == (m.kind > 0) for v in y) < 64:
                        rows += features(b)
                        y.append(m.kind > 0)
                yield pa.RecordBatch.from_arrays([pa.array([np.array(rows, np.float64).tobytes()]), pa.array([np.array(y, np.int8).tobytes()])], ["x", "y"])

    got = some.mapInArrow(run, "x binary, y binary").toArrow()
    x = np.concatenate([np.zeros(0), *[np.frombuffer(v.as_buffer()) for v in got.column("x")]]).reshape(-1, len(PRIOR))
    y = np.concatenate([np.zeros(0), *[np.frombuffer(v.as_buffer(), np.int8) for v in got.column("y")]])
    order = np.lexsort([*x.T, y])  # sums don't depend on the order of arrival
    return fit_weights(x[order], y[order])


def extract(pages: DataFrame, smooth: float = 1.0, fit_pages: int = 1_000) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html).

    Each block's classifier score is its capacity to one terminal, landmarks and
    tree distance set the capacities between nodes, and the minimum cut labels
    them. Null and empty pages, and pages without content, give an empty text; text
    outside any element is a block; unclosed elements end with the one around
    them. Rows that repeat are extracted each; other columns are ignored. An empty
    table gives an empty result.
    """
    weights = fit(pages, fit_pages)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), smooth, weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
