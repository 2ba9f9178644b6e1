"""Hard negatives by dual-tree search over anchors and candidates, exact.

Scores are inner products of whole-numbered vectors. Of each anchor the best rows of its
own label are its positives; for each of them, the best rows of other labels are wanted
whose score lies between two shares of the positive's.

All rows are dealt to the leaves of a ball tree that is fitted on a bounded sample, and kept
in that order, so what a task reads lies together. Anchors are taken in the same order, in
blocks of ``ANCHORS``, which is what the driver and a broadcast hold of them. A block has a
ball tree too. The scores between two balls lie in an interval around the product of their
centres; a pair of nodes is given up, with all anchors in it, where the interval lies below
the worst result that each of them has so far, or outside the shares they ask for, or where
no label fits. It is tried first on the leaves, whose rows then aren't read, and on in each
task on a tree of every ``CHUNK`` rows; pairs of leaves are scored exactly by one product of
matrices. The rows of the sample give every anchor a first bound. Tasks send the best that
they have of each anchor, so no more than that is shuffled, whatever the labels or copies.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import bound_batches, number_rows, stable, stored

POSITIVES, NEGATIVES = 5, 10
#: Hundredths of the positive's score that a negative's must have, at least and at most.
LOWEST, HIGHEST = 30, 90
#: Vectors are multiplied by this and rounded down.
SCALE = 256
#: Rows that the index tree is fitted on; rows of one of its leaves; its levels at most.
SAMPLE, LEAF_ROWS, LEVELS = 20_000, 1024, 10
#: Anchors searched at once, rows a task builds a tree of, rows of a leaf there.
ANCHORS, CHUNK, LEAF = 4096, 4096, 64

_NONE = np.iinfo(np.int64).min
_LIMIT = np.iinfo(np.int64).max


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    """``rows`` with zeros to ``width`` columns."""
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def matrix(column: pa.Array, scale: int) -> np.ndarray:
    """A list column as whole numbers, scaled and rounded down; shorter vectors end in zeros."""
    offsets = column.offsets.to_numpy()
    values = np.floor(scale * column.values.to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
    lengths = np.diff(offsets)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values[offsets[0] : offsets[-1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows as 64-bit integers, exact; beyond those, the limit."""
    width = max(a.shape[1], b.shape[1])
    a, b = widened(a, width), widened(b, width)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(whole, -_LIMIT, _LIMIT).astype(np.int64)


def _direction(rows: np.ndarray) -> np.ndarray:
    """A direction along which the rows vary much: a few steps towards the first principal one."""
    apart = rows - rows.mean(axis=0)
    out = np.random.default_rng(13).normal(size=rows.shape[1])
    for _ in range(3):
        out = apart.T @ (apart @ out)
        out /= np.linalg.norm(out) or 1.0
    return out


@dataclass
class Tree:
    """A ball tree: node i holds rows start[i]:end[i] of ``order`` within radius[i] of center[i]."""

    rows: np.ndarray
    labels: np.ndarray
    order: np.ndarray
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    children: list[tuple[int, int] | None] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    center: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    norm: list[float] = field(default_factory=list)
    kinds: list[set[int]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> Tree:
        tree = cls(rows, labels, np.arange(len(rows)))
        todo = [(0, len(rows), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            own, node = tree.order[start:end], len(tree.start)
            if parent >= 0:
                pair = tree.children[parent] or (-1, -1)
                tree.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            here = rows[own]
            center = here.mean(axis=0)
            tree.add(start, end, parent, center, float(np.sqrt(((here - center) ** 2).sum(axis=1).max())), set(labels[own].tolist()))
            if end - start > leaf:
                # equal rows are cut as well: any cut is right
                tree.order[start:end] = own[np.argsort(here @ _direction(here), kind="stable")]
                middle = (start + end) // 2
                todo += [(middle, end, node, 1), (start, middle, node, 0)]
        return tree

    def add(self, start: int, end: int, parent: int, center: np.ndarray, radius: float, kinds: set[int]) -> None:
        self.start.append(start)
        self.end.append(end)
        self.children.append(None)
        self.parent.append(parent)
        self.center.append(center)
        self.radius.append(radius)
        self.norm.append(float(np.linalg.norm(center)))
        self.kinds.append(kinds)


def interval(dot: float, norm_a: float, radius_a: float, norm_b: float, radius_b: float) -> tuple[float, float]:
    """Least and greatest inner product of rows in two balls whose centres have the product ``dot``."""
    apart = radius_a * norm_b + radius_b * norm_a + radius_a * radius_b
    apart += 1e-9 * (norm_a + radius_a) * (norm_b + radius_b) + 1e-6  # rounding
    return dot - apart, dot + apart


@dataclass
class Search:
    """What a block of anchors looks for: in each of its slots the best ``keep`` rows.

    ``low`` and ``high`` bound the scores of a slot (anchors, slots), ``bound`` is a score that
    the last of ``keep`` rows reaches anyhow. ``same``: rows of the anchor's label, else others.
    """

    tree: Tree
    ids: np.ndarray
    same: bool
    keep: int
    low: np.ndarray
    high: np.ndarray
    bound: np.ndarray

    def __post_init__(self) -> None:
        shape = (*self.low.shape, self.keep)
        self.scores, self.others = np.full(shape, _NONE), np.zeros(shape, np.int64)
        idle = self.low > self.high
        self.least = np.where(idle, _LIMIT, np.maximum(self.low, self.bound)).min(axis=1)
        self.most = np.where(idle, _NONE, self.high).max(axis=1)
        pick = [self.tree.order[s:e] for s, e in zip(self.tree.start, self.tree.end)]
        self.node_least, self.node_most = ([f(x[p]) for p in pick] for f, x in ((np.min, self.least), (np.max, self.most)))

    def given_up(self, node: int, center: np.ndarray, norm: float, radius: float, kinds: set[int] | None) -> bool:
        """Whether no anchor of the node can gain from a ball of rows with the labels ``kinds``,
        or with any where that is None."""
        own, tree = self.tree.kinds[node], self.tree
        if kinds and (own.isdisjoint(kinds) if self.same else len(own) == 1 and own == kinds):
            return True
        width = min(len(center), len(tree.center[node]))
        low, high = interval(float(tree.center[node][:width] @ center[:width]), tree.norm[node], tree.radius[node], norm, radius)
        return high < self.node_least[node] or low > self.node_most[node]

    def needs(self, center: np.ndarray, radius: float, kinds: set[int] | None) -> bool:
        """Whether any anchor may gain from such a ball."""
        todo, norm = [0], float(np.linalg.norm(center))
        while todo:
            node = todo.pop()
            if not self.given_up(node, center, norm, radius, kinds):
                if self.tree.children[node] is None:
                    return True
                todo += self.tree.children[node]
        return False

    def allowed(self, own: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, slot: int) -> np.ndarray:
        """Scores of the rows that a slot of the anchors ``own`` may take, else ``_NONE``."""
        fits = (labels == self.tree.labels[own][:, None]) == self.same
        if self.same:
            fits &= ids != self.ids[own][:, None]
        fits &= (scores >= np.maximum(self.low, self.bound)[own, slot, None]) & (scores <= self.high[own, slot, None])
        return np.where(fits, scores, _NONE)

    def take(self, node: int, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Scores some rows against the anchors of a leaf."""
        own = self.tree.order[self.tree.start[node] : self.tree.end[node]]
        scores = products(self.tree.rows[own], rows)
        for slot in range(self.low.shape[1]):
            found = self.allowed(own, scores, ids, labels, slot)
            gains = np.flatnonzero((found > _NONE).any(axis=1) & (found.max(axis=1) >= self.scores[own, slot, -1]))
            if len(gains):
                at = own[gains]
                both = np.concatenate([self.scores[at, slot], found[gains]], axis=1)
                who = np.concatenate([self.others[at, slot], np.broadcast_to(ids, (len(gains), len(ids)))], axis=1)
                best = np.lexsort((who, -np.maximum(both, -_LIMIT)), axis=1)[:, : self.keep]
                self.scores[at, slot] = np.take_along_axis(both, best, axis=1)
                self.others[at, slot] = np.take_along_axis(who, best, axis=1)
        idle = self.low[own] > self.high[own]
        worst = np.maximum(np.maximum(self.low, self.bound)[own], self.scores[own, :, -1])
        self.least[own] = np.where(idle, _LIMIT, worst).min(axis=1)
        self.node_least[node] = self.least[own].min()
        while (node := self.tree.parent[node]) >= 0:
            self.node_least[node] = min(self.node_least[c] for c in self.tree.children[node])

    def meet(self, other: Tree, ids: np.ndarray) -> None:
        """Both trees against each other; ``ids`` of the other's rows."""
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            if self.given_up(a, other.center[b], other.norm[b], other.radius[b], other.kinds[b]):
                continue
            of_a, of_b = self.tree.children[a], other.children[b]
            if of_a is None and of_b is None:
                own = other.order[other.start[b] : other.end[b]]
                self.take(a, other.rows[own], ids[own], other.labels[own])
            else:
                cut_own = of_b is None or of_a is not None and self.tree.radius[a] >= other.radius[b]
                pairs = [(c, b) for c in of_a] if cut_own else [(a, c) for c in of_b]
                width = min(len(self.tree.center[a]), len(other.center[b]))
                # the greater product last, to be taken first: it raises the bounds most
                todo += sorted(pairs, key=lambda x: float(self.tree.center[x[0]][:width] @ other.center[x[1]][:width]))

    def results(self) -> list[np.ndarray]:
        """Anchor, slot, id and score of all that was found."""
        anchor, slot, place = np.nonzero(self.scores > _NONE)
        return [anchor, slot, self.others[anchor, slot, place], self.scores[anchor, slot, place]]


class _Index:
    """A complete binary tree of cuts fitted on a sample; only tells which rows lie together."""

    def __init__(self, sample: np.ndarray, levels: int) -> None:
        self.levels, self.width = levels, sample.shape[1]
        self.cuts, self.at = np.zeros((2**levels - 1, self.width)), np.zeros(2**levels - 1)
        self.centers, parts = np.zeros((2**levels, self.width)), [sample]
        for level in range(levels):
            split = []
            for i, own in enumerate(parts):
                node = 2**level - 1 + i
                if len(own):
                    self.cuts[node] = _direction(own)
                    along = own @ self.cuts[node]
                    self.at[node] = np.median(along)
                    split += [own[along <= self.at[node]], own[along > self.at[node]]]
                else:
                    split += [own, own]
            parts = split
        for i, own in enumerate(parts):
            if len(own):
                self.centers[i] = own.mean(axis=0)

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        rows, node = widened(rows, self.width)[:, : self.width], np.zeros(len(rows), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + ((rows * self.cuts[node]).sum(axis=1) > self.at[node])
        return node - (2**self.levels - 1)


def _indexed(rows: DataFrame, index: _Index, scale: int) -> DataFrame:
    """(id, label, anchor, leaf, away, v): whole-numbered vectors in the order of the leaves."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(3), scale)
                leaf = shared.value.leaf_of(v)
                width = max(v.shape[1], shared.value.width)
                away = np.sqrt(((widened(v, width) - widened(shared.value.centers[leaf], width)) ** 2).sum(axis=1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(leaf.astype(np.int32)), pa.array(away), lists], _INDEXED)

    made = rows.mapInArrow(run, "id long, label long, anchor boolean, leaf int, away double, v array<double>")
    return stored(made.repartitionByRange("leaf", F.xxhash64("id")).sortWithinPartitions("leaf"))


_INDEXED = ["id", "label", "anchor", "leaf", "away", "v"]


def _found(index: DataFrame, search: Search, leaves: list[tuple[int, np.ndarray, float, set[int] | None]], keep: int) -> DataFrame:
    """(at, slot, id, score, place): what a search finds in the index."""
    needed = [leaf for leaf, center, radius, kinds in leaves if search.needs(center, radius, kinds)]
    shared, name = index.sparkSession.sparkContext.broadcast(search), uuid.uuid4().hex
    rows = index if len(needed) == len(leaves) else index.where(F.col("leaf").isin(needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Search(*(getattr(shared.value, x) for x in ("tree", "ids", "same", "keep", "low", "high", "bound")))
        for ids, labels, v in _chunks(batches):
            own.meet(Tree.of(v, labels), ids)
        at, slot, ids, scores = own.results()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(ids), pa.array(scores)], ["at", "slot", "id", "score"])

    best = Window.partitionBy("at", "slot").orderBy(F.desc("score"), F.asc("id"))
    found = rows.select("id", "label", "v").mapInArrow(run, "at int, slot int, id long, score long")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held, n = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = max(x[2].shape[1] for x in held)
        return np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([widened(x[2], width) for x in held])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), 1)))
            n += batch.num_rows
        if n >= CHUNK:
            yield joined()
            held, n = [], 0
    if held:
        yield joined()


def _bounds(search: Search, sample: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each slot the worst of the best rows of the sample, where it has enough."""
    ids, labels, v = sample
    search.meet(Tree.of(v, labels), ids)
    return search.scores[:, :, -1].copy()


def _block(index: DataFrame, anchors: pa.Table, sample: tuple, leaves: list, positives: int, negatives: int, lowest: int, highest: int) -> DataFrame:
    """The results of one block of anchors."""
    spark, batch = index.sparkSession, anchors.combine_chunks().to_batches()[0]
    ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), 1)
    tree, one = Tree.of(v, labels), (len(ids), 1)

    def search(same: bool, keep: int, low: np.ndarray, high: np.ndarray) -> Search:
        bound = np.full(low.shape, _NONE)
        return Search(tree, ids, same, keep, low, high, _bounds(Search(tree, ids, same, keep, low, high, bound), sample))

    first = search(True, positives, np.full(one, -_LIMIT), np.full(one, _LIMIT))
    near = _found(index, first, leaves, positives).select("at", "place", "id", "score").toArrow()  # ANCHORS times positives at most
    at, place = near["at"].to_numpy(), near["place"].to_numpy() - 1
    low, high = np.full((len(ids), positives), _LIMIT), np.full((len(ids), positives), _NONE)
    scores = near["score"].to_pylist()
    low[at, place] = [max(-_LIMIT, -(-lowest * s // 100)) for s in scores]
    high[at, place] = [highest * s // 100 for s in scores]
    pairs = pa.table({"at": near["at"], "slot": pa.array(place.astype(np.int32)), "anchor_id": pa.array(ids[at]), "positive_id": near["id"], "positive_score": near["score"]})
    far = _found(index, search(False, negatives, low, high), leaves, negatives)
    named = far.join(F.broadcast(spark.createDataFrame(pairs)), ["at", "slot"])
    return named.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, block: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is asked of the rows as they come. A row without id, label or vector, or with
    a component that is null or not finite takes no part. Scores are exact; beyond 64 bits they
    are the greatest or least 64-bit number. Shorter vectors count as ending in zeros. Equal
    scores go by id. Rows of the anchor's own id are none of its positives; repeated rows count
    as often as they occur, as candidates and as anchors. A positive with a negative score has
    no negatives. Other columns aren't read; an empty table, or one without anchors, gives no
    rows.
    """
    bound_batches(rows.sparkSession)
    v = F.col(vector_col)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), v.alias("v"))
    own = own.where("id is not null and label is not null and v is not null").where(~bad)
    total = own.count()
    empty = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not total:
        return empty
    some = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "label", "v").toArrow().combine_chunks().to_batches()[0]
    sample = some.column(0).to_numpy(), some.column(1).to_numpy(), matrix(some.column(2), scale)
    tree = _Index(sample[2], min(LEVELS, max(0, math.ceil(math.log2(total / LEAF_ROWS)))))
    index = _indexed(own, tree, scale)
    # a leaf's labels count only where they are one
    stats = index.groupBy("leaf").agg(F.max("away").alias("radius"), F.min("label").alias("one"), F.max("label").alias("other")).collect()
    numbered, n = number_rows(index.where("anchor").select("id", "label", "v", "leaf"), "leaf", "id")
    numbered, out = stable(numbered), None
    leaves = [(r["leaf"], tree.centers[r["leaf"]], r["radius"], {r["one"]} if r["one"] == r["other"] else None) for r in stats]
    for at in range(0, n, block):
        part = numbered.where((F.col("row") >= at) & (F.col("row") < at + block)).orderBy("row").select("id", "label", "v").toArrow()
        found = stored(_block(index, part, sample, leaves, positives, negatives, lowest, highest))
        out = found if out is None else out.unionByName(found)
    return empty if out is None else out
