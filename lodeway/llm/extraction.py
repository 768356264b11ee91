"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A logistic model of markup, length, links and
wording, fitted on labelled pages (``lodeway.llm.training_pages``), gives each
block the log-odds of being content, which is its capacity to a terminal;
neighbouring blocks and blocks of one parent are joined by smoothness edges on
the same scale, stronger the nearer they are in the tree. The maximum flow
separates content from boilerplate. Blocks whose terminal outweighs all their
edges keep their label in every minimum cut, so only the others enter the flow.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of the HTML standard by how they are read.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select button head".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these ends an open p, as the standard says.
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot".split())
SIBLINGS = {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option", "tbody": "tbody thead tfoot",
}
SIBLINGS = {k: frozenset(v.split()) for k, v in SIBLINGS.items()}
_LISTS = frozenset("ul ol menu dl table".split())

#: Elements that hold boilerplate, and content.
AGAINST_TAG = frozenset("nav footer aside form menu dialog".split())
FOR_TAG = frozenset("article main".split())
#: What is counted of the elements around a block, at most twice each.
AROUND = ("against_tag", "header", "for_tag", "against_name", "for_name", "against_role", "for_role", "hidden")
#: Features of a block: those, and what it is itself.
FEATURES = (*AROUND, "links", "mostly_links", "words_25", "words_10", "words_below_4", "paragraph", "heading", "item", "wording", "bias")
RIDGE = 0.3
#: Smoothness that is tried on the labelled pages.
STRENGTHS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0)
AGAINST_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_AGAINST_NAME = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert\w*|adsense|adbox|adslot|banner\w*|sponsor\w*|promo\w*|sidebar\w*|side|menu\w*|nav\w*|breadcrumb\w*|"
    r"cookie\w*|consent\w*|gdpr|notice\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login\w*|comment\w*|disqus\w*|repl(?:y|ies)|"
    r"respond|discussion\w*|share\w*|sharing|social\w*|related\w*|recommend\w*|footer\w*|header\w*|masthead|toolbar|widget\w*|pagination|pager|"
    r"copyright|legal|disclaimer|hidden|skip\w*|search\w*|tags?|outbrain|taboola)(?:$|[-_ ])", re.I,
)
_FOR_NAME = re.compile(r"(?:^|[-_ ])(?:article\w*|post|posts|entry|story|content|main|body|text|hentry)(?:$|[-_ ])", re.I)
_BOILERPLATE = re.compile(
    r"©|&copy|all rights reserved|cookie|privacy policy|terms of (?:use|service)|sign up|log ?in|subscribe|newsletter|share (?:this|on)|"
    r"advertisement|sponsored|read more|click here|skip to", re.I,
)
_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)|([!?/])[^>]*(?:>|\Z))", re.S)
_REST = re.compile(r"[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")
_ATTR = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


class Block:
    """Text, its block element, that element's number, linked characters, and what stands around."""

    __slots__ = ("text", "tag", "node", "linked", "around")

    def __init__(self, text: str, tag: str, node: int, linked: int, around: tuple[int, ...]) -> None:
        self.text, self.tag, self.node, self.linked, self.around = text, tag, node, linked, around


class Page:
    """Blocks of a page in order, and the parent and depth of every element."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parent, self.depth = [0], [0]

    def distance(self, a: int, b: int) -> int:
        """Steps between two elements."""
        steps = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
            steps += 1
        return steps


def _evidence(tag: str, attrs: str, in_article: bool) -> tuple[int, ...]:
    """Counts of ``AROUND`` for one element."""
    named: dict[str, str] = {}
    if attrs.strip(" /\t\r\n"):
        for k, a, b, c in _ATTR.findall(attrs):
            named.setdefault(k.lower(), a or b or c)
    names = f"{named.get('class', '')} {named.get('id', '')}".strip() if tag not in ("html", "body") else ""
    against = bool(names and _AGAINST_NAME.search(names))
    role = named.get("role", "").lower()
    style = named.get("style", "").replace(" ", "").lower()
    return (
        tag in AGAINST_TAG, tag == "header" and not in_article, tag in FOR_TAG, against, bool(names) and not against and bool(_FOR_NAME.search(names)),
        role in AGAINST_ROLE, role in FOR_TAG or "articlebody" in named.get("itemprop", "").lower(),
        "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in style,
    )


def blocks_of(page: str) -> Page:
    """The text blocks of a page, with what the elements around them say."""
    tree = Page()
    # tag, node number, summed evidence, whether inside an article
    stack: list[tuple[str, int, tuple[int, ...], bool]] = [("#", 0, (0,) * len(AROUND), False)]
    opened: Counter[str] = Counter()  # tags of the stack
    texts: list[str] = []
    links, linked_at = 0, -1

    def close() -> None:
        nonlocal linked_at, links
        if texts:
            text = _SPACE.sub(" ", html.unescape("".join(texts))).strip()
            if text:
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] in BLOCK or at == 0:
                        break
                tree.blocks.append(Block(text, stack[at][0], stack[at][1], links, stack[at][2]))
            texts.clear()
        links = 0

    def pop(to: int) -> None:
        nonlocal linked_at
        if any(x[0] in BLOCK for x in stack[to:]):
            close()
        opened.subtract(x[0] for x in stack[to:])
        del stack[to:]
        if linked_at >= to:
            linked_at = -1

    at, n = 0, len(page)
    while at < n:
        tag = _TAG.search(page, at)
        if tag is None:
            piece, end = page[at:], n
        else:
            piece, end = page[at : tag.start()], tag.end()
        if piece:
            texts.append(piece)
            if linked_at >= 0:
                links += len(piece)
        at = end
        if tag is None or tag[3] is None:
            continue
        name = tag[3].lower()
        rest = _REST.match(page, at)
        at = rest.end() if rest else (page.find(">", at) + 1 or n)
        attrs = page[end : at - 1]
        if tag[2]:
            if opened[name] > 0:
                pop(next(to for to in range(len(stack) - 1, 0, -1) if stack[to][0] == name))
            elif name in BLOCK:
                close()
            continue
        if name in RAW and not attrs.endswith("/"):
            if name == "head":  # only what holds text is skipped, as heads are often left open
                continue
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if stop is None and name not in ("script", "style", "title", "textarea"):
                continue
            at = stop.start() if stop else n
            texts.append(" ")
            continue
        if name in BLOCK:
            if name in ENDS_P:
                for to in range(len(stack) - 1, 0, -1):
                    if stack[to][0] == "p":
                        pop(to)
                        break
                    if stack[to][0] in BLOCK:
                        break
            same = SIBLINGS.get(name)
            if same:
                for to in range(len(stack) - 1, 0, -1):
                    if stack[to][0] in same:
                        pop(to)
                        break
                    if stack[to][0] in _LISTS:
                        break
            close()
        elif name in ("br", "img", "input"):
            texts.append(" ")
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        above = stack[-1]
        tree.parent.append(above[1])
        tree.depth.append(tree.depth[above[1]] + 1)
        told = _evidence(name, attrs, above[3])
        around = tuple(min(2, x + y) for x, y in zip(above[2], told)) if any(told) else above[2]
        stack.append((name, len(tree.parent) - 1, around, above[3] or name in FOR_TAG))
        opened[name] += 1
        if name == "a" and linked_at < 0:
            linked_at = len(stack) - 1
    close()
    return tree


def features(block: Block) -> list[float]:
    """The values of ``FEATURES``."""
    words = block.text.count(" ") + 1
    share = min(1.0, block.linked / max(1, len(block.text)))
    own = (
        share, share > 0.5, words >= 25, words >= 10, words < 4, block.tag in ("p", "blockquote", "pre"), block.tag in ("h1", "h2", "h3"),
        block.tag in ("li", "td", "dd", "dt"), words < 40 and bool(_BOILERPLATE.search(block.text)), True,
    )
    return [float(x) for x in (*block.around, *own)]


def smoothness(page: Page, strength: float) -> dict[tuple[int, int], float]:
    """Edges between neighbours in the page and between the next blocks of one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(page.blocks):
        if i:
            edges[i - 1, i] = strength / (1 + page.distance(page.blocks[i - 1].node, b.node) / 2)
        parent = page.parent[b.node]
        j = last.get(parent)
        if j is not None:
            edges[j, i] = edges.get((j, i), 0.0) + strength / 2
        last[parent] = i
    return edges


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic model with a ridge, by Newton's method."""
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@functools.lru_cache(maxsize=1)
def model() -> tuple[tuple[float, ...], float]:
    """Weights of ``FEATURES``, and the smoothness with fewest errors on labelled pages that the weights have not seen."""
    from lodeway.llm import training_pages

    def labelled(seeds):
        for seed in seeds:
            text, content = training_pages.page(seed)
            tree = blocks_of(text)
            yield tree, [b.text in content for b in tree.blocks]

    half = training_pages.PAGES // 2
    first, second = (list(labelled(range(k * half, (k + 1) * half))) for k in (0, 1))
    w = fit_weights(np.array([features(b) for t, _ in first for b in t.blocks]), np.array([y for _, ys in first for y in ys], float))
    costs = [[float(np.dot(w, features(b))) for b in t.blocks] for t, _ in second]
    wrong = lambda s: sum(a != b for c, (t, ys) in zip(costs, second) for a, b in zip(minimum_cut(c, smoothness(t, s)), ys))
    return tuple(map(float, w)), min(STRENGTHS, key=lambda s: (wrong(s), s))


def minimum_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The content side of the minimum cut: a positive score is the capacity from the source."""
    n = len(scores)
    weight = [0.0] * n
    for (i, j), c in edges.items():
        weight[i] += c
        weight[j] += c
    label: list[bool | None] = [s > 0 if abs(s) > w else None for s, w in zip(scores, weight)]
    free = [i for i in range(n) if label[i] is None]
    if free:
        place = {i: k for k, i in enumerate(free)}
        caps = [scores[i] for i in free]
        graph = _Flow(len(free))
        for (i, j), c in edges.items():
            a, b = place.get(i), place.get(j)
            if a is not None and b is not None:
                graph.join(a, b, c)
            elif a is not None:  # an edge to a fixed block is a terminal's
                caps[a] += c if label[j] else -c
            elif b is not None:
                caps[b] += c if label[i] else -c
        for k, on in enumerate(graph.source_side(caps)):
            label[free[k]] = on
    return [bool(x) for x in label]


class _Flow:
    """Maximum flow by blocking flows on level graphs."""

    def __init__(self, n: int) -> None:
        self.n, self.to, self.cap = n, [], []
        self.out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(self, a: int, b: int, forth: float, back: float | None = None) -> None:
        for x, y, c in ((a, b, forth), (b, a, forth if back is None else back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def source_side(self, scores: list[float]) -> list[bool]:
        s, t = self.n, self.n + 1
        for i, c in enumerate(scores):
            if c > 0:
                self.join(s, i, c, 0.0)
            elif c < 0:
                self.join(i, t, -c, 0.0)
        while (level := self._levels(s))[t] >= 0:
            nxt = [0] * (self.n + 2)
            while self._augment(s, t, level, nxt):
                pass
        return [x >= 0 for x in level[: self.n]]

    def _levels(self, s: int) -> list[int]:
        level = [-1] * (self.n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            x = todo.popleft()
            for e in self.out[x]:
                if self.cap[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    todo.append(self.to[e])
        return level

    def _augment(self, s: int, t: int, level: list[int], nxt: list[int]) -> bool:
        path, x = [], s
        while x != t:
            edges = self.out[x]
            while nxt[x] < len(edges):
                e = edges[nxt[x]]
                if self.cap[e] > 1e-12 and level[self.to[e]] == level[x] + 1:
                    break
                nxt[x] += 1
            if nxt[x] < len(edges):
                path.append(edges[nxt[x]])
                x = self.to[path[-1]]
            elif path:
                x = self.to[path.pop() ^ 1]
                nxt[x] += 1
            else:
                return False
        room = min(self.cap[e] for e in path)
        for e in path:
            self.cap[e] -= room
            self.cap[e ^ 1] += room
        return True


def main_text(page: str | None, fitted: tuple[tuple[float, ...], float] | None = None) -> str:
    """Content blocks in page order, one a line; empty for null or empty pages and pages without content."""
    if not page:
        return ""
    weights, strength = fitted or model()
    tree = blocks_of(page)
    scores = [sum(w * x for w, x in zip(weights, features(b)) if x) for b in tree.blocks]
    chosen = minimum_cut(scores, smoothness(tree, strength))
    return "\n".join(b.text for b, on in zip(tree.blocks, chosen) if on)


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    Null and empty pages give an empty text; repeated rows come back repeated,
    an empty table gives an empty result. White space inside a block, ``br``
    included, is one space. What scripts, styles, titles, buttons, lists to
    select from, embedded drawings, formulas and other objects hold is no text
    of the page. Other columns are ignored.
    """
    fitted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), fitted) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.encode("utf-8", "replace").decode() for x in texts], pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
