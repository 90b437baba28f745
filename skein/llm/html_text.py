"""Main text of web pages by minimum-cut labelling.

The page is cut into text blocks. A classifier gives each a cost for either label: log-odds of being content, summed
over evidence from the tag, its ancestors, their class and id words, link density and length. Positive odds are the
capacity from the source, negative ones that to the sink. Neighbours in page order and siblings in the tree are joined
by edges that are the stronger the closer they are in the tree. The minimum cut labels all blocks at once; what stays
with the source is content.

The weights of the evidence are a logistic regression with the stated weights as prior means, fitted to the blocks of
pages that mark their content themselves (article, main; what stands in these isn't itself evidence in the fit). The
strength of the edges is the one, of a stated few, with the fewest wrong blocks after the cut on those pages; the
largest of several.

Siblings nest as the tree does, so the edges are a path with chords that don't cross. On such a graph the minimum cut
needs no flow: a block with at most two neighbours left is solved for each of their labels, which leaves one edge, and
so on. That takes time in proportion to the blocks. Pages are independent, so there is nothing to shuffle.
"""

from __future__ import annotations

import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import frugal, text_slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements by what they do to text, and words that tell what an element is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select head".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {
    "p": BLOCK - frozenset(("body", "html", "button")), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",)), "option": frozenset(("option",)),
}
SCOPES = frozenset("ul ol dl table article section div main aside footer header nav form body blockquote".split())
AWAY_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
HOME_WORDS = frozenset("article body content entry main post story text".split())


class Element:
    __slots__ = ("tag", "parent", "depth", "away", "home", "named", "holder", "mixed")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        inside = bool(parent and parent.home)
        away, self.home, named = _evidence(tag, attributes, inside)
        # Of several reasons to leave an element out one is enough: nested menus aren't more of a menu.
        self.away = away or bool(parent and parent.away)
        self.named = not self.away and (named or bool(parent and parent.named))
        self.holder = self if tag in BLOCK or parent is None else parent.holder
        self.mixed = False  # has blocks inside


def _evidence(tag: str, attributes: str, home: bool) -> tuple[bool, bool, bool]:
    """Of one element: whether it says that it isn't content, whether what it holds is inside the article, whether its name says content."""
    named = False
    if tag in ("article", "main"):
        home = True
    away = tag in AWAY_TAGS or tag == "header" and not home
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id") and tag not in ("html", "body"):
                words = [w.lower() for w in WORD.findall(value)]
                found = AWAY_WORDS.intersection(words)
                if found and (tag not in ("article", "main") or len(words) == 1) and not (home and found <= {"header"}):
                    away = True
                elif HOME_WORDS.intersection(words):
                    named = True
            elif name == "role" and value.lower() in AWAY_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                away = True
            elif name == "itemprop" and value == "articleBody":
                home = True
    return away, home, named


class TextBlock:
    __slots__ = ("text", "linked", "holder")

    def __init__(self, text: str, linked: int, holder: Element):
        self.text, self.linked, self.holder = text, linked, holder


class _Open:
    """The open elements: the nearest of a name, and of a scope, is known without a walk."""

    def __init__(self):
        self.stack = [Element("#", "", None)]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.links = 0

    def push(self, tag: str, attributes: str) -> None:
        parent = self.stack[-1]
        if tag in BLOCK:
            parent.holder.mixed = True
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(Element(tag, attributes, parent))
        self.links += tag == "a"

    def close(self, tag: str, scoped: bool) -> None:
        """Closes the nearest open element of that name, unless scoped and an element of SCOPES is nearer."""
        places = self.at.get(tag)
        if not places or scoped and self.scopes and self.scopes[-1] > places[-1]:
            return
        for _ in range(len(self.stack) - places[-1]):
            gone = self.stack.pop()
            self.at[gone.tag].pop()
            if gone.tag in SCOPES:
                self.scopes.pop()
            self.links -= gone.tag == "a"


def blocks(page: str) -> list[TextBlock]:
    """Text blocks in page order, white space collapsed and references decoded; what no reader sees is left out."""
    out: list[TextBlock] = []
    open_ = _Open()
    parts: list[str] = []
    linked, at, n = 0, 0, len(page)

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(TextBlock(text, linked, open_.stack[-1].holder))
            parts, linked = [], 0

    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            piece = html.unescape(page[at:stop]) if "&" in page[at:stop] else page[at:stop]
            parts.append(piece)
            if open_.links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            open_.close(tag, False)
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag == "head":
                end = end or re.compile(r"<body\b", re.I).search(page, at)
                at = (end.end() if end[0][1] == "/" else end.start()) if end else at
            else:
                at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            for open_tag, by in CLOSED_BY.items():
                if tag in by:
                    open_.close(open_tag, True)
        if tag not in VOID and not m[3].endswith("/"):
            open_.push(tag, m[3])
    flush()
    return out


#: Evidence about a block, and its weight before any page is seen.
PRIOR = {"away": -9.0, "home": 4.0, "named": 2.0, "length": 1.0, "linked": -3.0, "paragraph": 1.0, "heading": 0.5, "quoted": 0.5, "copyright": -2.0, "always": -0.5}
FEATURES = tuple(PRIOR)
WEIGHTS = np.array(list(PRIOR.values()))
SMOOTHNESS = 1.0
SMOOTH = (0.25, 0.5, 1.0, 2.0, 4.0)


def features(found: list[TextBlock]) -> np.ndarray:
    """(block, feature) evidence."""
    out = np.zeros((len(found), len(FEATURES)))
    for k, b in enumerate(found):
        n, tag = len(b.text), b.holder.tag
        out[k] = (
            b.holder.away, b.holder.home and not b.holder.away, b.holder.named, min(n / 100, 1.5), min(1.0, b.linked / n), tag == "p", tag in ("h1", "h2", "h3"), tag in ("blockquote", "pre"),
            b.text.startswith(("©", "Copyright ")), 1.0,
        )
    return out


def edges(found: list[TextBlock]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next one, and with the next one under the same parent; no two cross.

    Text beside blocks of an element counts as a child of it.
    """
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, block in enumerate(found):
        if k:
            out[k - 1, k] = 1.0 / (1 + distance(found[k - 1].holder, block.holder))
        parent = id(block.holder if block.holder.mixed else block.holder.parent)
        if parent in last:
            pair = (last[parent], k)
            out[pair] = out.get(pair, 0.0) + 0.3
        last[parent] = k
    return [(i, j, w) for (i, j), w in out.items()]


def distance(a: Element, b: Element) -> int:
    """Edges between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut; of equal cuts one that keeps less.

    Nodes with at most two neighbours left are eliminated: what the best label costs for each pair of labels of the
    neighbours becomes an edge between them. Where none is left (edges that cross), the rest is solved by flow.
    """
    n = len(scores)
    own = [[max(s, 0.0), max(-s, 0.0)] for s in scores]  # cost of leaving a node out, and of keeping it
    near: list[dict[int, list[float]]] = [{} for _ in range(n)]  # costs of the labels (0 0, 0 1, 1 0, 1 1) of node and neighbour

    def join(i: int, j: int, cost: list[float]) -> None:
        if j in near[i]:
            cost = [x + y for x, y in zip(near[i][j], cost)]
        near[i][j] = cost
        near[j][i] = [cost[0], cost[2], cost[1], cost[3]]

    for i, j, w in links:
        if i != j:
            join(i, j, [0.0, w, w, 0.0])
    queue = deque(i for i in range(n) if len(near[i]) <= 2)
    gone, solved = [False] * n, []
    while queue:
        i = queue.popleft()
        if gone[i] or len(near[i]) > 2:
            continue
        gone[i] = True
        others = list(near[i])
        best = {}
        for labels in range(1 << len(others)):
            held = [labels >> k & 1 for k in range(len(others))]
            cost = [own[i][x] + sum(near[i][j][2 * x + y] for j, y in zip(others, held)) for x in (0, 1)]
            best[tuple(held)] = (min(cost), cost[1] < cost[0])
        solved.append((i, others, best))
        for j in others:
            del near[j][i]
        if len(others) == 1:
            for y in (0, 1):
                own[others[0]][y] += best[(y,)][0]
        elif others:
            join(*others, [best[y, z][0] for y in (0, 1) for z in (0, 1)])
        queue.extend(j for j in others if len(near[j]) <= 2)
        near[i] = {}
    keep = [False] * n
    rest = [i for i in range(n) if not gone[i]]
    if rest:
        for i, side in zip(rest, _flow(rest, own, near)):
            keep[i] = side
    for i, others, best in reversed(solved):
        keep[i] = best[tuple(int(keep[j]) for j in others)][1]
    return keep


def _flow(rest: list[int], own: list[list[float]], near: list[dict[int, list[float]]]) -> list[bool]:
    """The minimum cut of the nodes that are left, by augmenting paths of fewest edges."""
    place = {i: k for k, i in enumerate(rest)}
    room: list[dict[int, float]] = [{} for _ in rest]
    need = [own[i][1] - own[i][0] for i in rest]  # what keeping costs over leaving out
    for i in rest:
        for j, (c00, c01, c10, c11) in near[i].items():
            if i < j:  # submodular costs: labels that differ pay, the rest goes to either node
                a, b = place[i], place[j]
                room[a][b] = room[b][a] = (c01 + c10 - c00 - c11) / 2
                need[a] += (c10 - c01 + c11 - c00) / 2
                need[b] += (c01 - c10 + c11 - c00) / 2
    supply, need, tiny = [max(-x, 0.0) for x in need], [max(x, 0.0) for x in need], 1e-9
    while True:
        came: dict[int, int] = {i: -1 for i in range(len(rest)) if supply[i] > tiny}
        queue = deque(came)
        end = -1
        while queue:
            i = queue.popleft()
            if need[i] > tiny:
                end = i
                break
            for j, left in room[i].items():
                if left > tiny and j not in came:
                    came[j] = i
                    queue.append(j)
        if end < 0:
            return [i in came for i in range(len(rest))]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(need[end], supply[path[-1]], *(room[b][a] for a, b in zip(path, path[1:])))
        supply[path[-1]] -= flow
        need[end] -= flow
        for a, b in zip(path, path[1:]):
            room[b][a] -= flow
            room[a][b] += flow


class Model:
    """Weights of the evidence and strength of the edges."""

    def __init__(self, weights: np.ndarray = WEIGHTS, smoothness: float = SMOOTHNESS):
        self.weights, self.smoothness = weights, smoothness

    def label(self, found: list[TextBlock]) -> list[bool]:
        """Which blocks are content."""
        if not found:
            return []
        return min_cut((features(found) @ self.weights).tolist(), [(i, j, w * self.smoothness) for i, j, w in edges(found)])


def learn(pages: list[str], strength: float = 1.0, rounds: int = 25) -> Model:
    """A model fitted to the pages that mark their content by article or main; the stated one if there are none.

    strength: how firmly the weights are held at their prior means (one over their variance).
    """
    held, rows, labels = [], [], []
    home = FEATURES.index("home")
    for page in pages:
        found = blocks(page)
        if any(b.holder.home for b in found) and not all(b.holder.home for b in found):
            x = features(found)
            y = x[:, home].copy()
            x[:, home] = 0.0  # the label itself isn't evidence
            held.append((found, x, y.astype(bool)))
            rows.append(x)
            labels.append(y)
    if not held:
        return Model()
    x, y, w = np.concatenate(rows), np.concatenate(labels), WEIGHTS.copy()
    for _ in range(rounds):  # Newton steps for the posterior mode
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(held) + strength * (w - WEIGHTS)
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(held) + strength * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    wrong = {}
    for smooth in SMOOTH:
        wrong[smooth] = sum(int(k) != int(want) for found, own, ok in held for k, want in zip(min_cut((own @ w).tolist(), [(i, j, e * smooth) for i, j, e in edges(found)]), ok.tolist()))
    least = min(wrong.values())
    return Model(w, max(s for s, k in wrong.items() if k == least))


def fit(pages: DataFrame, html_col: str = "html", sample: int = 400) -> Model:
    """learn() on about `sample` pages, chosen by a hash of their text; long ones count whole. Null pages don't count."""
    known = pages.select(F.col(html_col).cast("string").alias("page")).where("page is not null")
    n = known.count()
    chosen = known if n <= sample else known.where(F.pmod(F.xxhash64("page"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    return learn([r.page for r in chosen.where(F.length("page") < 1 << 20).limit(2 * sample).toLocalIterator()])


def main_text(page: str, model: Model | None = None) -> str:
    """The content blocks of a page, joined by newlines."""
    found = blocks(page)
    return "\n".join(b.text for b, ok in zip(found, (model or Model()).label(found), strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), model: Model | None = None) -> DataFrame:
    """One row per page: id_col, the columns of keep, text (empty if there is none), n_chars. model: of fit(); else the stated weights.

    Null and empty pages have empty text; very long ones are read whole, in time in proportion to their length; blocks
    whose labels cost the same are left out; repeated rows stay; other columns aren't read, whatever their names; an
    empty table gives an empty result.
    """
    source = pages.select(F.col(id_col).alias("_id"), *keep, F.col(html_col).cast("string").alias("_html"))
    at = len(keep) + 1
    names = ["_id", *keep, "_text", "_n"]
    model = model or Model()

    def run(batches):
        for rows, texts in text_slices(batches, at):
            out = [main_text(p, model) if p else "" for p in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(at)), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", _text string, _n long"
    return source.mapInArrow(frugal(run), schema).toDF(id_col, *keep, "text", "n_chars")
