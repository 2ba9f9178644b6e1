"""Totals of tables and results: from statistics where these are enough, else counted.

A whole Parquet table's rows are in its footers: Spark answers the count, and least and
greatest values, from them and reads no data. With a condition the rows are counted; over joins, which
can repeat a row, distinct keys are. A result may also be estimated by the optimizer first, and
counted only where the estimate is small enough to be worth it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.plans.registry import query

#: What a total rests on.
STATISTICS, COUNTED, ESTIMATED = "statistics", "counted", "estimated"


@dataclass(frozen=True)
class Total:
    """A number of rows and what it rests on."""

    rows: int
    basis: str


@contextmanager
def from_footers(spark: SparkSession) -> Iterator[None]:
    """Within, tables read from Parquet answer counts and bounds from their footers."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bounds(spark: SparkSession, location: str, *columns: str) -> dict[str, object]:
    """rows, and min_ and max_ of each of the ``columns`` (of a plain type), from the footers."""
    with from_footers(spark):
        asked = [F.count("*").alias("rows"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max)))]
        found = spark.read.parquet(location).agg(*asked).first().asDict()
    return found | {"rows": found["rows"] or 0}  # no files, no footers


def total(spark: SparkSession, location: str, condition: Column | None = None) -> Total:
    """The rows of a Parquet table, or those of them that meet a condition."""
    if condition is None:
        return Total(bounds(spark, location)["rows"], STATISTICS)
    return Total(spark.read.parquet(location).where(condition).count(), COUNTED)


def total_of_joined(joined: DataFrame, key: str) -> Total:
    """The distinct keys of a join, which may have repeated its rows."""
    return Total(joined.agg(F.countDistinct(key)).first()[0], COUNTED)


def estimate(df: DataFrame) -> int | None:
    """The optimizer's number of rows, where it has one: from the statistics of analysed tables,
    with cost-based optimization on (``spark.sql.cbo.enabled``)."""
    rows = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return int(str(rows.get())) if rows.isDefined() else None


def total_or_estimate(df: DataFrame, counted_below: int) -> Total:
    """The estimate where it is at least ``counted_below``; else, or without one, the count."""
    guess = estimate(df)
    return Total(df.count(), COUNTED) if guess is None or guess < counted_below else Total(guess, ESTIMATED)


_TABLES = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, '{STATISTICS}' AS basis, CAST(min({k}) AS BIGINT) AS least, CAST(max({k}) AS BIGINT) AS greatest FROM {t}" for t, k in _TABLES.items()))
def table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, least and greatest key of the larger tables; their data isn't read."""
    rows = []
    for name, key in _TABLES.items():
        found = bounds(spark, f"{sf_dir}/{name}.parquet", key)
        rows.append((name, found["rows"], STATISTICS, found[f"min_{key}"], found[f"max_{key}"]))
    return spark.createDataFrame(rows, "table_name string, rows long, basis string, least long, greatest long")


@query(
    f"SELECT 'documents' AS asked, count(*) AS rows, '{COUNTED}' AS basis FROM documents WHERE lang = 'fr' "
    f"UNION ALL SELECT 'orders', count(DISTINCT o_orderkey), '{COUNTED}' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45"
)
def filtered_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals with a condition, and over a join that repeats rows."""
    own = total(spark, f"{sf_dir}/documents.parquet", F.col("lang") == "fr")
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    joined = total_of_joined(orders.join(lines.where("l_quantity > 45"), F.col("l_orderkey") == F.col("o_orderkey")), "o_orderkey")
    return spark.createDataFrame([("documents", own.rows, own.basis), ("orders", joined.rows, joined.basis)], "asked string, rows long, basis string")
