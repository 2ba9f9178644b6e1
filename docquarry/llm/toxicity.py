"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts is the unlabelled set. With
class prior p, the risk of the negative class is estimated as R_u(-) - p R_p(-), which a
flexible model can drive below zero; the non-negative estimator climbs back whenever that
happens (Kiryo et al., 2017). The model is logistic over the presence of words and stems.

Fitting uses at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` documents, those with the
lowest hash of their id. Scoring covers every document, whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import bound_batches, stored, texts_of

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
#: Bytes of a stem.
STEM = 6
#: Features the model may use, and how clearly they must set positives and unlabelled apart.
MAX_FEATURES = 2_000
LEAST_G = 10.83
#: Everything in ASCII but letters, digits and the apostrophe parts words; A-Z is lower-cased.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256)).lower()


def features_of(text: str) -> set[bytes]:
    """The distinct words of a text, and the stems that several of its words share.

    A stem is the first ``STEM`` bytes of a longer word; it counts from two distinct words
    on, and again from four.
    """
    found = set(text.encode("utf-8", "replace").translate(_FOLD).split())
    for stem, n in Counter([w[:STEM] for w in found if len(w) > STEM]).items():
        if n > 1:
            found.add(stem + b"**")
            if n > 3:
                found.add(stem + b"****")
    return found


@dataclass(frozen=True)
class ToxicityModel:
    """Word weights of the linear margin, and its bias."""

    weights: dict[bytes, float]
    bias: float

    def score(self, text: str) -> float:
        """The probability, by this model, that a text is toxic."""
        known = self.weights
        margin = self.bias + math.fsum(known[w] for w in known.keys() & features_of(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, margin))))


def _select(counts: DataFrame, n_p: int, n_u: int, limit: int) -> list[bytes]:
    """The features that set positives and unlabelled texts apart, by the likelihood ratio G.

    ``counts`` has feature, p, u. Either may hold them more often; at least ``LEAST_G`` and
    five texts; ties by name.
    """
    p, u = F.col("p"), F.col("u")
    share = (p + u) / (n_p + n_u)
    cell = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g = 2 * (cell(p, n_p * share) + cell(n_p - p, n_p * (1 - share)) + cell(u, n_u * share) + cell(n_u - u, n_u * (1 - share)))
    kept = counts.where(p + u >= 5).withColumn("g", g).where(F.col("g") >= LEAST_G)
    return [bytes(r["feature"]) for r in kept.orderBy(F.desc("g"), "feature").limit(limit).collect()]


def fit(positive: list[list[int]], unlabelled: list[list[int]], names: list[bytes], prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> ToxicityModel:
    """Minimises the non-negative risk with the logistic loss, by Adam over the whole sample.

    ``positive`` and ``unlabelled`` have, for each text, the indices of the ``names`` it
    holds. Without positives or unlabelled texts the model is constant, the prior.
    """
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    if not positive or not unlabelled:
        return ToxicityModel({}, math.log(prior / (1 - prior)))
    sides = []
    for texts in (positive, unlabelled):
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        sides.append((row, np.fromiter((i for t in texts for i in t), np.int64, len(row)), len(texts)))
    w = np.zeros(len(names) + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def margins(side: tuple) -> np.ndarray:
        row, column, n = side
        return np.bincount(row, w[column], minlength=n) + w[-1]

    def mean_gradient(side: tuple, by: np.ndarray) -> np.ndarray:
        row, column, n = side
        return np.append(np.bincount(column, by[row], minlength=len(names)), by.sum()) / n

    for step in range(1, steps + 1):
        zp, zu = margins(sides[0]), margins(sides[1])
        # the logistic losses are log(1 + e^-z) for the positive class, log(1 + e^z) for the negative
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_negative = mean_gradient(sides[1], sigmoid(zu)) - prior * mean_gradient(sides[0], sigmoid(zp))
        if negative >= 0:
            grad = prior * mean_gradient(sides[0], sigmoid(zp) - 1) + grad_negative
        else:
            grad = -grad_negative
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        now = rate / (1 + 4 * step / steps)
        w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel({x: float(w[i]) for i, x in enumerate(names)}, float(w[-1]))


def _lowest(ids: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` distinct ids of lowest hash; the ids themselves break ties."""
    return ids.where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(limit)


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, prior: float | None = None,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> ToxicityModel:
    """Fits on a bounded sample of ``docs``.

    ``usable`` says, from the column ``id``, which documents may be learned from. Only
    labels of 1 are used as labels; ``prior`` defaults to their share among the usable
    labels, which is right where texts were chosen for labelling without regard to toxicity:
    else give it. Null labels and ids are ignored; a document labelled more than once is
    positive if any label is.
    """
    bound_batches(docs.sparkSession)
    usable = F.lit(True) if usable is None else usable
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where(usable)
    marks = marks.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = marks.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = _lowest(marks.where("toxic = 1").select("id"), max_positive).withColumn("kind", F.lit(1))
    chosen = chosen.unionByName(_lowest(own.select("id").where(usable), max_unlabelled).withColumn("kind", F.lit(0)))
    ids = chosen.collect()  # bounded by max_positive + max_unlabelled
    if not ids:
        return fit([], [], [], prior)
    picked = docs.sparkSession.createDataFrame(ids, chosen.schema)
    sample = stored(own.join(F.broadcast(picked), "id").select("id", "kind", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: tuple[Counter, Counter] = (Counter(), Counter())
        for batch, texts in texts_of(batches, "text"):
            for kind, text in zip(batch.column(1).to_pylist(), texts):
                of[kind].update(features_of(text))
        names = sorted(of[0].keys() | of[1].keys())
        for i in range(0, len(names), 20_000):
            part = names[i : i + 20_000]
            columns = [pa.array(part, pa.binary()), pa.array([of[1][x] for x in part], pa.int64()), pa.array([of[0][x] for x in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "p", "u"])

    sizes = {r["kind"]: r["count"] for r in sample.groupBy("kind").count().collect()}
    counts = sample.mapInArrow(count, "feature binary, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    names = _select(counts, sizes.get(1, 0), sizes.get(0, 0), MAX_FEATURES)
    column = {x: i for i, x in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches, "text"):
            have = pa.array([sorted(column[x] for x in column.keys() & features_of(t)) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), have], ["id", "kind", "have"])

    found = sorted((r["kind"], r["id"], r["have"]) for r in sample.mapInArrow(rows, "id long, kind int, have array<int>").collect())
    sets: tuple[list, list] = ([], [])
    for kind, _, have in found:
        sets[kind].append(have)
    return fit(sets[1], sets[0], names, float(prior))


def scorer(spark: SparkSession, model: ToxicityModel) -> Callable[[Column], Column]:
    """The model as a function of a text column. Null text counts as empty."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # MAX_FEATURES entries at most

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t or "") for t in text], dtype="float64")

    return score


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as (id, score). A map without a shuffle.

    Null text counts as empty and gets the model's bias; null ids stay null; repeated rows
    each get their score; only the two named columns are read.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))
