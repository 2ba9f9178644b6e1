"""The corpus model over the test tables: contents, contexts, occurrences, words, signals.

A content is a distinct text, known by the least doc_id that holds it. A context is a
content in a source and side (its language). An occurrence (path) is one document row.
Only digests of texts are shuffled to find equal ones, never the texts: what a query wants
of a text (words, a flag, its lines) is taken from it where it is read.

Occurrences, word rows and signals are kept tables: built by the first query that asks for them, as
an ingest would, and read by all later ones. A word row's count is null where it is unknown.

``SQL`` holds the same tables as common table expressions for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources.shared import kept, staged

WORD = r"[\p{L}\p{N}_]+"

SQL = r"""
occ AS (
  SELECT doc_id AS path_id, min(doc_id) OVER (PARTITION BY text) AS hash_id, source, lang AS side, lang AS file_type,
         n_chars AS file_size, CASE WHEN doc_id % 10 = 0 THEN 'Unread' ELSE 'Read' END AS file_status,
         CAST(DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS DATE) AS file_date, 'doc' || doc_id || '.' || lang AS file_name
  FROM documents
), contents AS (SELECT doc_id AS hash_id, text FROM documents JOIN (SELECT DISTINCT hash_id AS h FROM occ) ON doc_id = h
), contexts AS (SELECT hash_id, source, side, min(path_id) AS context_id, count(*) AS n_paths FROM occ GROUP BY hash_id, source, side
), words AS (
  SELECT hash_id, word, CASE WHEN hash_id % 50 <> 7 OR length(word) % 5 <> 0 THEN count(*) END AS n
  FROM (SELECT hash_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM contents) GROUP BY hash_id, word
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_in(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: path_id, hash_id, source, side, type, size, status, date, name."""

    def build() -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("digest"))
        first = docs.groupBy("digest").agg(F.min("doc_id").alias("hash_id"))
        return docs.join(first, "digest").select(
            F.col("doc_id").alias("path_id"), "hash_id", "source", F.col("lang").alias("side"), F.col("lang").alias("file_type"),
            F.col("n_chars").alias("file_size"),
            F.when(F.col("doc_id") % 10 == 0, "Unread").otherwise("Read").alias("file_status"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")).alias("file_date"),
            F.concat(F.lit("doc"), F.col("doc_id"), F.lit("."), F.col("lang")).alias("file_name"),
        )

    return kept(spark, sf_dir, "occurrences", build)


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_id of each distinct content."""
    return occurrences(spark, sf_dir).where("path_id = hash_id").select("hash_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_id and text of every document row, copies among them.

    Select from the text what is wanted of it, then join that on ``hash_id`` with contents or
    occurrences: only contents' own ids are met there.
    """
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hash_id"), "text")


def contents(spark: SparkSession, sf_dir: str, *wanted: Column) -> DataFrame:
    """hash_id of each distinct content with the ``wanted`` columns, made from its text."""
    return texts(spark, sf_dir).select("hash_id", *wanted).join(content_ids(spark, sf_dir), "hash_id", "left_semi")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_id, source, side, context_id and the number of paths."""
    return occurrences(spark, sf_dir).groupBy("hash_id", "source", "side").agg(F.min("path_id").alias("context_id"), F.count("*").alias("n_paths"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_id, word and its count in the content, null where that is unknown.

    As a test of unknown counts, those of words of five or ten letters are unknown in
    contents of some ids. Rows stand in the order of the words, so a word is found by the
    files' statistics; ranges are cut inside a common word too, which then no task gathers.
    """

    def build() -> DataFrame:
        # words are counted in their row, so what moves is a row a content, then one a word
        row = texts(spark, sf_dir).select("hash_id", F.array_sort(words_in(F.col("text"))).alias("w")).where("size(w) > 0")
        begins = row.withColumn("at", F.expr("filter(sequence(0, size(w) - 1), i -> i = 0 or w[i] <> w[i - 1])"))
        counted = begins.select("hash_id", F.expr("transform(at, (a, i) -> struct(w[a] AS word, cast(coalesce(get(at, i + 1), size(w)) - a AS bigint) AS n))").alias("counted"))
        own = staged(counted.join(content_ids(spark, sf_dir), "hash_id", "left_semi"))
        known = F.when((F.col("hash_id") % 50 != 7) | (F.length("word") % 5 != 0), F.col("n"))
        rows = own.select("hash_id", F.inline("counted")).select("hash_id", "word", known.alias("n"))
        return rows.repartitionByRange("word", "hash_id").sortWithinPartitions("word", "hash_id")

    return kept(spark, sf_dir, "words", build)


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_id, tokens (of known counts) and unknown (word rows without a count) of each content
    that has words; a kept table, so that sizes don't take a pass over all word rows."""
    own = lambda: words(spark, sf_dir).groupBy("hash_id").agg(F.sum("n").alias("tokens"), F.count(F.when(F.col("n").isNull(), 1)).alias("unknown"))
    return kept(spark, sf_dir, "lengths", own)


#: What the test signals say of themselves, picked by the event's id.
_LANGUAGES, _CALENDARS = ("en", "fa", "ar"), ("gregorian", "hijri", "jalali")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals from the event table, with every column that a detector records.

    Dates are ranges; one of eleven has none. Confidence, language and orientation are null
    where they weren't recorded. A place stands for each signal's user. A kept table.
    """
    return kept(spark, sf_dir, "signals", lambda: _signals(spark, sf_dir), ("events",))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    dated = k % 11 != 0
    pick = lambda values, by: F.get(F.array(*(F.lit(x) for x in values)), F.pmod(by, F.lit(len(values) + 1)).cast("int"))  # noqa: E731  one remainder more: null
    return e.select(
        k.alias("signal_id"), F.col("user_id").alias("hash_id"), F.col("event_type").alias("signal_type"),
        F.when(k % 13 == 0, "place").otherwise("temporal").alias("detector"),
        F.when(dated, F.col("ts").cast("date")).alias("date_from"),
        F.when(dated, F.date_add(F.col("ts").cast("date"), (k % 4).cast("int"))).alias("date_to"),
        F.when(F.col("value") >= 75, "high").when(F.col("value") >= 25, "medium").when(F.col("value").isNotNull(), "low").alias("confidence"),
        pick(_LANGUAGES, k).alias("language"), pick(_CALENDARS, F.floor(k / 3)).alias("calendar"),
        F.when(~dated, "unresolved").when(k % 9 == 1, "ambiguous").otherwise("resolved").alias("resolution"),
        pick(("pattern", "gazetteer"), F.floor(k / 5)).alias("method"), pick(("future", "past"), F.floor(k / 7)).alias("text_orientation"),
        F.concat(F.col("event_type"), F.lit(" "), k % 100).alias("surface"), F.concat(F.lit("At "), F.col("props")).alias("evidence_sentence"),
        (F.col("user_id") % 25).alias("place_id"), "ts", "value",
    )


SIGNALS_SQL = """
sig AS (
  SELECT event_id AS signal_id, user_id AS hash_id, event_type AS signal_type, CASE WHEN event_id % 13 = 0 THEN 'place' ELSE 'temporal' END AS detector,
         CASE WHEN event_id % 11 <> 0 THEN CAST(ts AS DATE) END AS date_from, CASE WHEN event_id % 11 <> 0 THEN CAST(ts AS DATE) + CAST(event_id % 4 AS INTEGER) END AS date_to,
         CASE WHEN value >= 75 THEN 'high' WHEN value >= 25 THEN 'medium' WHEN value IS NOT NULL THEN 'low' END AS confidence,
         CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fa' WHEN 2 THEN 'ar' END AS language,
         CASE (event_id // 3) % 4 WHEN 0 THEN 'gregorian' WHEN 1 THEN 'hijri' WHEN 2 THEN 'jalali' END AS calendar,
         CASE WHEN event_id % 11 = 0 THEN 'unresolved' WHEN event_id % 9 = 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution,
         CASE (event_id // 5) % 3 WHEN 0 THEN 'pattern' WHEN 1 THEN 'gazetteer' END AS method,
         CASE (event_id // 7) % 3 WHEN 0 THEN 'future' WHEN 1 THEN 'past' END AS text_orientation,
         event_type || ' ' || (event_id % 100) AS surface, 'At ' || props AS evidence_sentence, user_id % 25 AS place_id, ts, value
  FROM events
)"""

#: The small taxonomy of the test queries (category, word).
TAXONOMY = [
    ("determiners", "the"), ("determiners", "la"), ("determiners", "der"), ("determiners", "das"),
    ("links", "and"), ("links", "et"), ("links", "und"), ("links", "of"), ("links", "de"),
    ("rare", "trash"), ("rare", "clown"), ("none", "zzzznothing"),
]
#: Keywords as word sequences (id, phrase).
KEYWORDS = [(1, "of the"), (2, "and the"), (3, "de la"), (4, "in"), (5, "apache license"), (6, "never here")]


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "category string, word string")


TAXONOMY_SQL = "tax AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{w}')" for c, w in TAXONOMY) + ") AS t(category, word))"
KEYWORDS_SQL = "kw AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in KEYWORDS) + ") AS t(keyword_id, phrase))"
