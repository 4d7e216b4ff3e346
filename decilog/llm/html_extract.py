"""Main text of HTML pages by a tree-structured graphical model.

The nodes are the page's block elements and the runs of text in them; each is content
(it is or holds article text) or not. A node's potential comes from its element name,
class and id words, role, length and links; a parent's and a child's labels weigh for
each other. Sum-product messages go up from the leaves and down from the root and give
every run's marginal. All weights are learned by gradient ascent on labelled pages, with
the same messages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decilog.llm.common import need
from decilog.llm.html_pages import labelled_pages

#: A comment, a CDATA mark, a declaration, or a tag. Nothing in it is tried twice, so the
#: scan is linear: a quote without an end is a plain character, and a tag that is not
#: closed ends before the next "<" or with the page, and is dropped.
TAG = re.compile(r"""<!--(?:-?>|.*?--!?>|.*\Z)|<!\[CDATA\[|<[!?][^<>]*+(?:>|(?=<)|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"<]*+"|'[^'<]*+'|[^<>])*+)(?:>|(?=<)|\Z)""", re.S)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Fixed values of HTML: elements without an end, with raw text, and that stand as blocks.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp template noscript svg math select".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head button label".split()
)
#: Element -> the open elements that its start closes, up to a block that holds them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = set("ul ol dl table article section div main body aside nav header footer form td th blockquote figure".split())
#: Words of class, id and role attributes, by what they tell.
HINTS = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs search toc skip login signin",
    "head": "header masthead logo banner site",
    "foot": "footer copyright legal colophon contentinfo imprint disclaimer bottom",
    "side": "sidebar side aside widget related recommended popular trending complementary more rail",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion affiliate",
    "notice": "cookie cookies consent notice alert gdpr popup modal newsletter subscribe signup paywall overlay dialog message",
    "comment": "comment comments reply replies disqus discussion respond reader",
    "share": "share sharing social follow tags byline meta author",
    "text": "article content post entry story body main text",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
GROUP = {"h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "tr": "table", "tbody": "table", "thead": "table", "label": "form", "button": "form", "fieldset": "form"}


class Node:
    """An element (text is None) or a run of text in its nearest block element."""

    __slots__ = ("up", "features", "text", "links", "label")

    def __init__(self, up: int, features: tuple[str, ...], text: str | None, links: int, label: int | None) -> None:
        self.up, self.features, self.text, self.links, self.label = up, features, text, links, label


def element_features(name: str, attrs: str) -> tuple[tuple[str, ...], int | None]:
    """Feature names of an element, and its ``data-y`` if it has one."""
    found, label = {"tag:" + GROUP.get(name, name)}, None
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            found |= {"hint:" + HINT_OF[w] for w in re.split(r"[^a-z]+", value) if w in HINT_OF}
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            found.add("hidden")
        elif key == "data-y":
            label = int(value)
    return tuple(sorted(found)), label


def run_features(text: str, links: int) -> tuple[str, ...]:
    """Feature names of a run of text."""
    n = len(text)
    found = ["run", "long" if n >= 80 else "middle" if n >= 25 else "brief"]
    ended = text[-1] in ".!?\"'”»"
    if links > 0.5 * n and not (ended and n >= 25):  # a linked sentence may be text; its surroundings tell
        found.append("linked")
    if ended:
        found.append("ended")
    return tuple(found)


class Parser:
    """HTML to nodes; keeps the features of attribute strings that it has met."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], tuple[tuple[str, ...], int | None]] = {}

    def described(self, name: str, attrs: str) -> tuple[tuple[str, ...], int | None]:
        key = (name, attrs)
        if key not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[key] = element_features(name, attrs)
        return self.known[key]

    def __call__(self, page: str) -> list[Node]:
        """Nodes in page order, parents first; node 0 is the root."""
        nodes = [Node(-1, ("tag:root",), None, 0, None)]
        stack: list[tuple[str, int]] = []  # open elements: name, and the node of their nearest block
        opened: Counter[str] = Counter()  # names in the stack
        marked = True  # whether a CDATA end may still come
        parts: list[str] = []
        links = depth = at = 0

        def flush() -> None:
            nonlocal links
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    nodes.append(Node(stack[-1][1] if stack else 0, run_features(text, links), text, 0, None))
                links = 0

        def shut(name: str, scope: set[str]) -> None:
            """Close the nearest open ``name`` and what is open inside it."""
            nonlocal depth
            if not opened[name]:
                return
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(n in BLOCK for n, _ in stack[k:]):
                        flush()
                    depth -= sum(n == "a" for n, _ in stack[k:])
                    opened.subtract(n for n, _ in stack[k:])
                    del stack[k:]
                    return
                if stack[k][0] in scope:
                    return

        size = len(page)
        while at < size:
            m = TAG.search(page, at)
            text = page[at : m.start() if m else size]
            if text:
                parts.append(text)
                if depth:
                    links += len(text)
            if not m:
                break
            at = m.end()
            if not m[2]:
                if m[0] == "<![CDATA[":
                    end = page.find("]]>", at) if marked else -1
                    marked = end >= 0
                    at = end + 3 if marked else page.find(">", at) + 1 or size
                continue
            if page[at - 1] != ">":  # not closed: markup, but no element
                continue
            name = m[2].lower()
            if m[1]:
                shut(name, set() if name in SCOPE or name not in BLOCK else SCOPE)
                continue
            if name in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{name}\b[^<>]*+(?:>|(?=<)|\Z)", re.I).search(page, at)
                    at = end.end() if end else size
                parts.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                else:
                    parts.append(" " if name == "br" else "")
                continue
            if name in BLOCK:
                flush()
                if opened["p"] and name not in ("label", "button"):
                    shut("p", SCOPE)
                for other in CLOSES.get(name, ()):
                    shut(other, SCOPE - CLOSES[name])
                features, label = self.described(name, m[3])
                nodes.append(Node(stack[-1][1] if stack else 0, features, None, 0, label))
                stack.append((name, len(nodes) - 1))
                opened[name] += 1
            elif not m[3].endswith("/"):
                depth += name == "a"
                opened[name] += 1
                stack.append((name, stack[-1][1] if stack else 0))
        flush()
        return nodes


def softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


class TreeModel:
    """Log-odds weights of features, and weights of a child's label given its parent's.

    ``pair``: for runs and elements, log-potential of (parent, child) = (0, 1), (1, 0)
    and (1, 1) against (0, 0).
    """

    def __init__(self, weights: dict[str, float] | None = None, pair: dict[str, list[float]] | None = None) -> None:
        self.weights = weights or {}
        self.pair = pair or {"run": [-2.0, 0.0, 0.0], "element": [-2.0, 0.0, 0.0]}
        self.sums: dict[tuple[str, ...], float] = {}

    def odds(self, features: tuple[str, ...]) -> float:
        found = self.sums.get(features)
        if found is None:
            found = self.sums[features] = sum(self.weights.get(f, 0.0) for f in features)
        return found

    def messages(self, nodes: list[Node]) -> tuple[list[float], list[float]]:
        """Log-odds of each node from below (itself included), and from its parent's side."""
        below = [self.odds(n.features) for n in nodes]
        sent = [0.0] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            t01, t10, t11 = self.pair["element" if nodes[k].text is None else "run"]
            b = below[k]
            sent[k] = softplus(b + t11 - t10) + t10 - softplus(b + t01)
            below[nodes[k].up] += sent[k]
        above = [0.0] * len(nodes)
        for k in range(1, len(nodes)):
            t01, t10, t11 = self.pair["element" if nodes[k].text is None else "run"]
            up = nodes[k].up
            rest = below[up] + above[up] - sent[k]
            above[k] = softplus(rest + t11 - t01) + t01 - softplus(rest + t10)
        return below, above

    def marginals(self, nodes: list[Node]) -> list[float]:
        below, above = self.messages(nodes)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, b + a)))) for b, a in zip(below, above)]


def gold_labels(nodes: list[Node]) -> list[int]:
    """Runs take the nearest mark above them; an element is 1 if a run below it is."""
    out = [0] * len(nodes)
    mark: list[int] = [0] * len(nodes)
    for k, n in enumerate(nodes):
        mark[k] = n.label if n.label is not None else mark[n.up] if n.up >= 0 else 0
        out[k] = mark[k] if n.text is not None else 0
    for k in range(len(nodes) - 1, 0, -1):
        if out[k]:
            out[nodes[k].up] = 1
    return out


def fit(pages: list[str], steps: int = 60, rate: float = 0.3, penalty: float = 0.02) -> TreeModel:
    """Gradient ascent of the labelled pages' likelihood; expectations are sum-product marginals."""
    parse = Parser()
    trees = [(t, gold_labels(t)) for t in map(parse, pages)]
    model = TreeModel()
    squares: dict[object, float] = {}
    for _ in range(steps):
        slope: dict[object, float] = {f: -penalty * w for f, w in model.weights.items()}
        for nodes, gold in trees:
            below, above = model.messages(nodes)
            for k, n in enumerate(nodes):
                p = 1 / (1 + math.exp(-max(-500.0, min(500.0, below[k] + above[k]))))
                for f in n.features:
                    slope[f] = slope.get(f, 0.0) + gold[k] - p
                if k:
                    kind = "element" if n.text is None else "run"
                    t01, t10, t11 = model.pair[kind]
                    up = below[n.up] + above[n.up] - (softplus(below[k] + t11 - t10) + t10 - softplus(below[k] + t01))
                    logs = [0.0, t01 + below[k], t10 + up, t11 + up + below[k]]
                    top = max(logs)
                    total = sum(math.exp(v - top) for v in logs)
                    seen = 2 * gold[n.up] + gold[k]
                    for j in (1, 2, 3):
                        slope[kind, j] = slope.get((kind, j), 0.0) + (seen == j) - math.exp(logs[j] - top) / total
        for key, g in slope.items():
            squares[key] = squares.get(key, 0.0) + g * g
            move = rate * g / (math.sqrt(squares[key]) + 1e-6)
            if isinstance(key, tuple):
                model.pair[key[0]][key[1] - 1] += move
            else:
                model.weights[key] = model.weights.get(key, 0.0) + move
        model.sums.clear()
    return model


def main_text(page: str | None, parse: Parser, model: TreeModel, least: float = 0.5) -> str:
    """The runs whose marginal reaches ``least``, joined by empty lines."""
    if not page:
        return ""
    nodes = parse(page)
    keep = model.marginals(nodes)
    return "\n\n".join(n.text for n, p in zip(nodes, keep) if n.text is not None and p >= least)


def extract(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages, and pages without content, have an empty text. Cut-off
    pages are read to their end; elements left open end with the page, and a tag that is
    cut off is dropped. White space is what ``str.split`` takes for it, no-break spaces
    and U+0085 included. Null and repeated page ids are kept, a row for each row; an
    empty table gives no rows; other columns are not read. Time is linear in a page.
    """
    model = model or fit(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Parser()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(p.as_py(), parse, model) for p in part.column(2)]
                if len(model.sums) > 50_000:
                    model.sums.clear()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = need(pages, id_col, url_col, html_col).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
