"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import difflib

import duckdb
import pytest

from docquarry import catalog
from docquarry.sources import corpus

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    rows = found.collect()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(want.columns)
        assert _rows(found.columns, [tuple(r) for r in rows]) == _rows(want.columns, want.fetchall())


def test_fuzzy_matches_are_the_best(spark, duck):
    """Against the ratio of every word."""
    words = [r[0] for r in duck.sql(f"WITH {corpus.SQL} SELECT DISTINCT word FROM words").fetchall()]
    ratio = lambda w: difflib.SequenceMatcher(None, w, "licence").ratio()
    want = sorted(((-ratio(w), w) for w in words if ratio(w) >= 0.6))[:20]
    assert [(-r.ratio, r.word) for r in catalog.QUERIES["fuzzy_close_matches"](spark, SF).collect()] == want
