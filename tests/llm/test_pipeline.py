"""The pipeline's stages against brute force over what each is given."""

import pytest
from test_operators import brute

import corpus_pipeline
from docquarry.llm import decontamination
from docquarry.llm.common import read_table, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns
        kept.append(docs)
    start, clean, single, safe = ({r.doc_id: r.text for r in d.collect()} for d in kept)
    assert set(safe) <= set(single) <= set(clean) <= set(start) and len(clean) > 0.8 * len(start)
    want = {key for key, _, least in brute(sorted(clean.items())) if key == least}
    assert set(single) == want
    items = [x for part in decontamination.benchmark_parts(read_table(spark, SF, "benchmark")) for x in decontamination.benchmark_items(part)]
    windows = {w for _, t in items for w in decontamination.windows_of(decontamination.words_of(t), 10)}
    dirty = lambda t: any(f" {w.decode()} " in f" {b' '.join(decontamination.words_of(t)).decode()} " for w in windows)
    assert set(safe) == {k for k, t in single.items() if not dirty(t)}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(safe)


def test_empty(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.mark.parametrize("name", ["extra"])
def test_other_columns_pass(spark, name):
    docs = read_table(spark, SF, "documents").selectExpr("*", "1 AS id", "'x' AS component_id", f"2 AS {name}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
    assert name in docs.columns and docs.count() > 0


def test_near_duplicates_by_row(spark, tmp_path):
    """Copies, repeated rows, shared and null ids: one row of each text stays."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (None, d), (None, d), (None, a), (8, None), (8, None), (9, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(t for _, t in kept if t and t.strip()) == [a, b, c, d]
    assert sorted((repr(x) for x in kept if not (x[1] or "").strip())) == sorted(map(repr, rows[-3:]))
    assert set(kept) <= set(rows)
