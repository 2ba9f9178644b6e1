"""Totals and what they rest on; fingerprints that don't depend on order."""

from pyspark.sql import functions as F

from docquarry.operators import totals
from docquarry.sources.fingerprint import fingerprint


def test_a_whole_table_is_counted_from_its_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 7 AS k", "cast(id AS string) AS s").repartition(3).write.parquet(path)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")}
    assert totals.total(spark, path) == totals.Total(1000, "statistics")
    assert totals.bounds(spark, path, "id", "k") == {"rows": 1000, "min_id": 0, "max_id": 999, "min_k": 0, "max_k": 6}
    assert {k: spark.conf.get(k, None) for k in before} == before
    with totals.from_footers(spark):
        plan = spark.read.parquet(path).agg(F.count("*"), F.max("id"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MAX(id)]" in plan
    assert totals.total(spark, path, F.col("k") == 3) == totals.Total(143, "counted")
    empty = str(tmp_path / "e")
    spark.range(0).write.parquet(empty)
    assert totals.total(spark, empty).rows == 0 and totals.bounds(spark, empty, "id")["max_id"] is None


def test_joins_that_repeat_rows(spark):
    left, right = spark.range(10), spark.createDataFrame([(1,), (1,), (2,), (20,)], "x long")
    assert totals.total_of_joined(left.join(right, F.col("id") == F.col("x")), "id") == totals.Total(2, "counted")


def test_estimates(spark):
    """Analysed tables are estimated; a small estimate is counted."""
    spark.sql("DROP TABLE IF EXISTS docquarry_totals")
    spark.range(10_000).selectExpr("id", "id % 100 AS k").write.saveAsTable("docquarry_totals")
    spark.sql("ANALYZE TABLE docquarry_totals COMPUTE STATISTICS FOR ALL COLUMNS")
    spark.conf.set("spark.sql.cbo.enabled", "true")
    try:
        own = spark.table("docquarry_totals").where("k = 7")
        assert 50 <= totals.estimate(own) <= 200
        assert totals.total_or_estimate(own, 10).basis == "estimated" and totals.total_or_estimate(own, 10_000) == totals.Total(100, "counted")
    finally:
        spark.conf.unset("spark.sql.cbo.enabled")
        spark.sql("DROP TABLE docquarry_totals")


def test_fingerprints(spark):
    rows = [(1, "a", None), (2, "", "x"), (2, "", "x"), (3, None, "")]
    frame = lambda r: spark.createDataFrame(r, "k long, a string, b string")
    print_ = lambda r, *c: tuple(fingerprint(frame(r), *c).first())
    assert print_(rows) == print_(rows[::-1]) == tuple(fingerprint(frame(rows).repartition(7)).first())
    others = [rows[:3], rows + rows[3:], [(1, "a", ""), *rows[1:]], [(1, None, "a"), *rows[1:]], [(1, "a,-", None), *rows[1:]], [*rows[:3], (3, "", None)], []]
    assert len({print_(r) for r in [rows, *others]}) == len(others) + 1
    assert print_(rows, "a") != print_(rows, "b") and print_([])[0] == 0
