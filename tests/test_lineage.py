"""Ancestors against the recursive query in DuckDB."""

import duckdb

from docquarry import catalog


def test_more_rows_than_a_recursive_query_may_have(spark, tmp_path):
    """Nodes that are missing, repeated, null or below the root, and a bound on recursion far too low."""
    keys = [k for k in range(-2, 3000) if k % 97 != 5] + [4, 4, 300, 2999, 1, None]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["lineage_ancestors"])
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        found = catalog.QUERIES["lineage_ancestors"](spark, str(tmp_path))
        assert found.columns == want.columns
        assert sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
