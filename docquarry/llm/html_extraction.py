"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element is a binary variable, content or not. Node potentials weigh its tag,
names, length, links and punctuation; parent-child potentials say how labels go together
along an edge. Sum-product messages, once up and once down the tree, give every node's
exact content marginal; text of nodes above one half is kept. Weights are trained on
labelled pages by the gradient of the conditional likelihood, from the same marginals.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import dom
from docquarry.llm.common import bound_batches, texts_of
from docquarry.llm.labelled_pages import labelled_pages

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Edges are told apart by the kind of their child.
_KINDS = {t: "text" for t in "p pre blockquote dd figcaption".split()} | {t: "heading" for t in "h1 h2 h3 h4 h5 h6".split()}
_KINDS |= {t: "item" for t in "li ul ol tr td th tbody table dl dt".split()} | {t: "section" for t in "article main section div body html".split()}


def _bin(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def _attr_features(raw: str) -> tuple[str, ...]:
    """Features of the class, id and role names and of being hidden."""
    if not raw or "=" not in raw and "hidden" not in raw:
        return ()
    attrs = dom.attributes(raw)
    out = set()
    for part in (attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""), attrs.get("aria-label", "")):
        for w in map(str.lower, _NAME.findall(part)):
            out |= {f"name:{w}", f"stem:{w[:5]}"}
    if "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", ""):
        out.add("hidden")
    return tuple(sorted(out))


def node_key(node: dom.Node) -> tuple:
    """What a node's potential depends on."""
    chars = node.chars
    return (
        node.tag, node.under, node.attrs, _bin(chars, (1, 25, 80, 200, 500, 1500)),
        _bin(node.link_chars / chars if chars else 0.0, (0.05, 0.25, 0.5, 0.8)),
        _bin(100 * node.stops / chars if chars else 0.0, (0.5, 1.5)), min(node.depth, 6), _bin(node.paragraphs, (1, 2, 4)),
    )


def features(key: tuple) -> list[str]:
    """Names of the indicator features of a ``node_key``."""
    tag, under, attrs, size, links, stops, depth, paragraphs = key
    out = ["bias", f"tag:{tag}", f"size:{size}", f"links:{links}", f"stops:{stops}", f"depth:{depth}", f"paragraphs:{paragraphs}", f"size-links:{size}:{links}", f"under:{under}", f"tag-under:{tag}:{under}"]
    return out + list(_attr_features(attrs))


@dataclass
class TreeModel:
    """Weights of node features and, by kind of edge, of (parent, child) label pairs."""

    weights: dict[str, float] = field(default_factory=dict)
    edges: dict[str, list[float]] = field(default_factory=dict)  # at 2 * parent + child
    _known: dict[tuple, float] = field(default_factory=dict, repr=False)

    def potential(self, node: dom.Node) -> float:
        """The log-odds that the node's own features give."""
        key = node_key(node)
        found = self._known.get(key)
        if found is None:
            if len(self._known) > 100_000:
                self._known.clear()
            found = self._known[key] = math.fsum(self.weights.get(f, 0.0) for f in features(key))
        return found

    def edge(self, node: dom.Node) -> list[float]:
        return self.edges.get(_KINDS.get(node.tag, "other"), _FLAT)

    def messages(self, page: dom.Page) -> tuple[list[float], list[float], list[float]]:
        """Marginal log-odds of each node, and for its edge to the parent the log-odds of
        the subtree alone and of the parent without it."""
        nodes = page.nodes
        low = [self.potential(x) for x in nodes]
        up = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            up[i] = _message(low[i], *self.edge(nodes[i]))
            low[nodes[i].parent] += up[i]
        full, above = low[:], [0.0] * len(nodes)
        for i in range(1, len(nodes)):
            above[i] = full[nodes[i].parent] - up[i]
            a, b, c, d = self.edge(nodes[i])
            full[i] = low[i] + _message(above[i], a, c, b, d)
        return full, low, above

    def content(self, page: dom.Page) -> list[bool]:
        return [x > 0 for x in self.messages(page)[0]]

    def extract(self, html: str) -> str:
        """The main text of a page."""
        page = dom.parse(html)
        return dom.text_of(page, self.content(page))


_FLAT = [0.0, 0.0, 0.0, 0.0]


def _softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def _message(odds: float, off_off: float, off_on: float, on_off: float, on_on: float) -> float:
    """Log-odds sent along an edge by an end with ``odds``; pairs are (receiver, sender)."""
    return on_off + _softplus(on_on - on_off + odds) - off_off - _softplus(off_on - off_off + odds)


def _labels(page: dom.Page) -> list[int]:
    out = []
    for node in page.nodes:
        told = re.search(r"data-y=(\d)", node.attrs)
        out.append(int(told[1]) if told else -1)
        node.attrs = re.sub(r"\s*data-y=\d", "", node.attrs).strip()
    out[0] = 1
    for i, y in enumerate(out):
        if y < 0:
            out[i] = out[page.nodes[i].parent]
    return out


def train(pages: Iterable[str], epochs: int = 25, rate: float = 0.15, decay: float = 2e-3) -> TreeModel:
    """Fits the weights to pages whose elements carry their label in ``data-y``.

    Stochastic gradient with per-weight step sizes, a page at a time, in the given order.
    """
    data = [(page, _labels(page)) for page in map(dom.parse, pages)]
    model, squares = TreeModel(), {}

    def step(table, key, gradient: float) -> None:
        value = table[key]
        gradient -= decay * value
        at = (id(table), key)
        squares[at] = total = squares.get(at, 1e-3) + gradient * gradient
        table[key] = value + rate * gradient / math.sqrt(total)

    for _ in range(epochs):
        for page, labels in data:
            model._known.clear()
            full, low, above = model.messages(page)
            push: dict[str, float] = {}
            for node, y, odds in zip(page.nodes, labels, full):
                off = y - 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
                for f in features(node_key(node)):
                    push[f] = push.get(f, 0.0) + off
            pull: dict[str, list[float]] = {}
            for i in range(1, len(page.nodes)):
                node = page.nodes[i]
                e = model.edge(node)
                logs = [e[0], e[1] + low[i], e[2] + above[i], e[3] + above[i] + low[i]]
                top = max(logs)
                mass = [math.exp(x - top) for x in logs]
                total = sum(mass)
                mine = pull.setdefault(_KINDS.get(node.tag, "other"), [0.0] * 4)
                for k in range(4):
                    mine[k] -= mass[k] / total
                mine[2 * labels[node.parent] + labels[i]] += 1
            for f, g in push.items():
                model.weights.setdefault(f, 0.0)
                step(model.weights, f, g)
            for kind, gs in pull.items():
                table = model.edges.setdefault(kind, [0.0] * 4)
                for k, g in enumerate(gs):
                    step(table, k, g)
    model._known.clear()
    return model


@functools.lru_cache(maxsize=1)
def default_model() -> TreeModel:
    """Trained on ``labelled_pages()``, once a process."""
    return train(labelled_pages())


def extract_pages(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` as (id, url, text). A map without a shuffle.

    Null or empty html gives an empty text; so does a page without content. Ids and urls
    are passed on as they are, repeated or null; other columns aren't read.
    """
    bound_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, htmls in texts_of(batches, "html"):
            texts = pa.array([shared.value.extract(h) for h in htmls], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["id", "url", "text"])

    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, "id long, url string, text string")
