"""Detectors over tables: dates and places as rows, contacts and plain text of pages."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.detectors import PlaceFinder, name_runs, temporal_signals
from docquarry.plans.registry import query
from docquarry.sources import corpus

SIGNALS = "id long, char_start int, char_end int, surface string, kind string, calendar string, day date, readings int"
PLACES = "id long, char_start int, char_end int, surface string, place int, readings int"
MAX_NAMES = 200_000


def detect_dates(texts: DataFrame) -> DataFrame:
    """Dates in (id, text, anchor): a row a reading. A map without a shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (key, s.start, s.end, s.surface, s.kind, s.calendar, s.day, s.readings)
                for key, text, anchor in zip(part["id"], part["text"], part["anchor"])
                for s in temporal_signals(text or "", anchor if isinstance(anchor, date) else None)
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SIGNALS.split(", ")])

    return texts.select("id", "text", "anchor").mapInPandas(run, SIGNALS)


def detect_places(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Mentions in (id, text) of the gazetteer's (name, place): a row a candidate place.

    Up to ``MAX_NAMES`` names the gazetteer is broadcast and a task finds the longest names
    itself. A larger one is joined: each run of words that could be a name, by its key.
    """
    names = [(r["name"], r["place"]) for r in gazetteer.select("name", "place").limit(MAX_NAMES + 1).collect()]
    if len(names) > MAX_NAMES:
        return _joined_places(texts, gazetteer)
    shared = texts.sparkSession.sparkContext.broadcast(names)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = PlaceFinder(shared.value)
        for part in parts:
            rows = [(key, a, b, s, p, len(ps)) for key, text in zip(part["id"], part["text"]) for a, b, s, ps in finder.find(text or "") for p in ps]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLACES.split(", ")])

    return texts.select("id", "text").mapInPandas(run, PLACES)


def _joined_places(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The same mentions by a join: runs of words that a name of the gazetteer equals, of
    which those inside a longer one that starts before or with them are left out."""
    named = gazetteer.select(F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))).alias("key"), "place").groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    longest = named.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 0

    def runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(row, key, *r) for row, key, text in zip(part["_row"], part["id"], part["text"]) for r in name_runs(text or "", longest)]
            yield pd.DataFrame(rows, columns=["_row", "id", "i", "k", "char_start", "char_end", "surface", "key"])

    schema = "_row long, id long, i int, k int, char_start int, char_end int, surface string, key string"
    met = texts.select("id", "text").withColumn("_row", F.monotonically_increasing_id()).mapInPandas(runs, schema).join(named, "key")
    # a text's few mentions, from left to right: each starts behind the end of the last taken
    steps = F.sort_array(F.collect_list(F.struct("i", (-F.col("k")).alias("shorter"), "char_start", "char_end", "surface", "places")))
    chosen = F.aggregate(
        "found", F.struct(F.lit(-1).alias("end"), F.array().cast("array<int>").alias("taken")),
        lambda a, x: F.when(x["i"] > a["end"], F.struct((x["i"] - x["shorter"] - 1).alias("end"), F.concat(a["taken"], F.array(x["i"])).alias("taken"))).otherwise(a),
    )
    best = met.groupBy("_row", "id").agg(steps.alias("found")).withColumn("taken", chosen["taken"])
    each = best.select("id", "taken", F.inline("found")).withColumn("first", F.min("shorter").over(Window.partitionBy("id", "char_start")))
    kept = each.where(F.array_contains("taken", F.col("i")) & (F.col("shorter") == F.col("first")))
    return kept.select("id", "char_start", "char_end", "surface", F.explode("places").alias("place"), F.size("places").alias("readings"))


@query(
    "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, 'iso' AS kind, CAST(1 AS INTEGER) AS readings FROM orders "
    "UNION ALL SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 14 AS DATE), 'relative', 1 FROM orders "
    "UNION ALL SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 5 MONTH AS DATE), 'relative', 1 FROM orders "
    "UNION ALL SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 YEAR AS DATE), 'relative', 1 FROM orders"
)
def temporal_signals_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in sentences made of all orders: one written out, three relative to it."""
    o = corpus.table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    texts = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Placed on "), day, F.lit(", to be paid within 2 weeks, returned within 5 months and kept in 3 years.")).alias("text"), F.col("o_orderdate").cast("date").alias("anchor"))
    return detect_dates(texts).select("id", "day", "kind", "readings")


@query("SELECT c_custkey AS id, n_nationkey AS place, CAST(1 AS INTEGER) AS readings FROM customer JOIN nation ON c_nationkey = n_nationkey")
def place_signals_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in sentences made of all customers."""
    nation = corpus.table(spark, sf_dir, "nation")
    c = corpus.table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    texts = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("the parcel left "), F.col("n_name"), F.lit("'s main port.")).alias("text"))
    return detect_places(texts, nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("place"))).select("id", "place", "readings")


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(rf"WITH m AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '{_MAIL}'))) AS contact FROM documents) SELECT doc_id, contact, CAST((length(text) - length(replace(text, contact, ''))) // length(contact) AS BIGINT) AS n, CAST(len(string_split(split_part(text, contact, 1), chr(10))) AS BIGINT) AS first_line FROM m")
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses of documents: how often and from which line on."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0)))
    m = corpus.table(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", "text", F.explode(found).alias("contact"))
    n = F.floor((F.length("text") - F.length(F.replace("text", F.col("contact"), F.lit("")))) / F.length("contact"))
    before = F.expr("substring(text, 1, instr(text, contact) - 1)")
    return m.select("doc_id", "contact", n.cast("long").alias("n"), F.size(F.split(before, "\n", -1)).cast("long").alias("first_line"))


_STEPS = ((r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n"), (r"<[^>]+>", ""), (r"[ \t\f\r]+", " "))


def _html_sql() -> str:
    out = "html"
    for pattern, by in _STEPS:
        put = "chr(10)" if by == "\n" else f"'{by}'"
        out = f"regexp_replace({out}, '{pattern}', {put}, 'g')"
    return out


@query(f"SELECT page_id, trim({_html_sql()}) AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text of pages: markup, scripts and comments taken out, blocks on lines."""
    out = F.col("html")
    for pattern, by in _STEPS:
        out = F.regexp_replace(out, pattern, by)
    return corpus.table(spark, sf_dir, "pages").select("page_id", F.trim(out).alias("text"))
