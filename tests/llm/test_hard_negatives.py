"""Hard negatives against every pair, scored in whole numbers."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import hard_negatives, registry

SF = "/root/testdata/sf0.001"


def plain(rows, every=100, positives=5, negatives=10):
    """(id, label, vector) rows; anchors are ids divisible by ``every``."""
    use = []
    for key, label, v in rows:
        if key is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((key, label, [math.floor(256 * x) for x in v]))
    out = []
    for key, label, v in use:
        if key % every:
            continue
        scored = [(max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), other, kind) for other, kind, w in use]
        near = sorted((-s, other) for s, other, kind in scored if kind == label and other != key)[:positives]
        for s, positive in near:
            s = -s
            far = sorted((-t, other) for t, other, kind in scored if kind != label and 30 * s <= 100 * t <= 90 * s)[:negatives]
            out += [(key, positive, rank, other, s, -t) for rank, (t, other) in enumerate(far, 1)]
    return sorted(out)


def found(frame, every=100, **how):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % every == 0, **how).collect())


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, id string, leaf int")


def clustered(n, seed, width=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 2, (6, width))
    return [(i, int(rng.integers(0, 4)), np.float32(centers[rng.integers(0, 6)] + rng.normal(0, 0.2, width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [3, 4096])
def test_against_every_pair(spark, monkeypatch, block):
    """Small chunks, leaves and blocks, so that nodes are cut, pruned and searched in turn."""
    for name, value in (("CHUNK", 100), ("LEAF", 8), ("LEAF_ROWS", 50), ("SAMPLE", 60)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(600, 1) + [(1000 + i, 1, [0.5] * 8) for i in range(200)]
    got = found(frame_of(spark, rows).repartition(5), every=50, block=block)
    assert got == plain(rows, 50) and got


def test_nodes_are_given_up():
    """Of well parted groups hardly any leaf is scored, and results stay the same."""
    rng = np.random.default_rng(3)
    centers = np.concatenate([50 * np.eye(16), -50 * np.eye(16)])
    v = np.round(centers[rng.integers(0, 32, 4000)] * 20 + rng.normal(0, 20, (4000, 16)))
    labels, ids = rng.integers(0, 3, 4000), np.arange(4000)
    tree, low = hard_negatives.Tree.of(v[:800], labels[:800], 8), np.full((800, 1), -hard_negatives._LIMIT)
    search = hard_negatives.Search(tree, ids[:800], True, 5, low, -low, np.full((800, 1), hard_negatives._NONE))
    scored, take = [], search.take
    search.take = lambda node, rows, *rest: (scored.append(len(rows)), take(node, rows, *rest))
    search.meet(hard_negatives.Tree.of(v, labels, 32), ids)
    want = [sorted((-int(v[a] @ v[i]), i) for i in range(4000) if labels[i] == labels[a] and i != a)[:5] for a in range(800)]
    assert [list(zip((-search.scores[a, 0]).tolist(), search.others[a, 0].tolist())) for a in range(800)] == want
    assert sum(scored) < 0.4 * 4000 * sum(c is None for c in tree.children)


def test_query_against_every_pair_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    rows = [(key, (label + 1) % 10 if key % 7 == 0 else label, v) for key, label, v in rows]
    query = registry.QUERIES["op13_hard_negatives"](spark, SF)
    assert query.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    got = sorted(tuple(r) for r in query.collect())
    assert got == plain(rows) and got
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    names = con.sql(registry.ORACLE_SQL["op13_hard_negatives"])
    assert names.columns == query.columns and got == sorted(names.fetchall())


def test_odd_input(spark):
    inf, nan = math.inf, math.nan
    rows = [
        (0, 1, [1.0, 2.0, -0.001]), (100, 1, [1.0, 2.0]), (200, 2, []), (300, None, [1.0]), (400, 1, None), (500, 1, [1.0, None]), (600, 1, [nan, 1.0]), (700, 1, [inf]), (None, 1, [1.0, 1.0]),
        (1, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0]), (3, 2, [0.8, 1.0]), (4, 2, [0.8, 1.0]), (5, 3, [0.5, 0.9, 7.0]), (6, 3, [-1.0, -1.0]), (7, 1, [-3.0, -3.0]), (8, 2, [0.0, 0.0]), (9, 1, [1e-9]),
        (3, 2, [0.8, 1.0]), (100, 1, [1.0, 2.0]), (None, None, None), (-100, 3, [0.1, 0.1]), (10, 3, [0.4]),
    ]
    got = found(frame_of(spark, rows))
    assert got == plain(rows) and got
    large = [(0, 1, [3e38, 1.0]), (100, 2, [1e19, 1e19]), (1, 1, [2e38, 0.0]), (2, 2, [1e10, 1e10]), (3, 2, [1e8, 3.0]), (4, 1, [1e8, 1e8])]
    assert found(frame_of(spark, large)) == plain(large)


def test_no_rows_or_anchors(spark):
    assert found(frame_of(spark, [])) == found(frame_of(spark, [(1, 1, [1.0]), (2, 1, [1.0])])) == []
    assert found(frame_of(spark, [(0, 1, [1.0]), (1, 1, [1.0])])) == []
