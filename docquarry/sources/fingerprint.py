"""The fingerprint of a table, whatever the order and partitions of its rows.

Each row has a digest of its values; digests are summed, so partial sums meet in any order and
no task or driver ever holds the rows. Sums tell repeated rows, which an exclusive or wouldn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.plans.registry import query
from docquarry.sources import corpus

#: Hex digits of each of the two halves of a digest that are summed, as numbers of 60 bits.
DIGITS = 15


def canonical(*columns: str) -> Column:
    """A row's values as one text: each with its length, null told from empty."""
    shown = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws(",", *shown)


def fingerprint(table: DataFrame, *columns: str) -> DataFrame:
    """One row: rows, and the digest of the ``columns`` (all where none are named) of all rows.

    Columns count by their order. Arrays and structs count as Spark shows them as text.
    """
    digest = F.md5(canonical(*(columns or table.columns)))
    half = lambda at: F.conv(F.substring(digest, at, DIGITS), 16, 10).cast("decimal(38,0)")
    one = table.agg(F.count("*").alias("rows"), F.sum(half(1)).alias("a"), F.sum(half(17)).alias("b"))
    zero = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    return one.select("rows", F.md5(F.concat_ws("/", F.col("rows").cast("string"), zero("a"), zero("b"))).alias("fingerprint"))


def fingerprint_sql(source: str, *columns: str) -> str:
    """The same over a source."""
    text = "concat_ws(',', " + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"
    half = lambda at: f"coalesce(sum(CAST(('0x' || substr(md5({text}), {at}, {DIGITS})) AS BIGINT)), 0)"
    return f"SELECT n AS rows, md5(n || '/' || a || '/' || b) AS fingerprint FROM (SELECT count(*) AS n, CAST({half(1)} AS VARCHAR) AS a, CAST({half(17)} AS VARCHAR) AS b FROM {source})"


@query(fingerprint_sql("documents", "doc_id", "text", "lang", "source"))
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of all documents."""
    return fingerprint(corpus.table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")


@query(fingerprint_sql("(SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey)", "n_nationkey", "n_name", "r_name"))
def gazetteer_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of the places as they would be matched: each with its region."""
    nation, region = corpus.table(spark, sf_dir, "nation"), corpus.table(spark, sf_dir, "region")
    return fingerprint(nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")), "n_nationkey", "n_name", "r_name")
