"""What has changed since a reader last looked, and what detectors still have to measure.

Changes are read against a reader's watermark for one view; who has never looked has seen
nothing, so everything shows. Additions come from the days on which occurrences came,
modifications and removals from a log of revisions, which alone has previous values. A field
that a revision doesn't name is unknown: null, not empty.

Runs of detectors are laid side by side, one row a content with the state of each detector, so
coverage and what is stale come from one pass however many detectors there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.filters import matched
from docquarry.plans.registry import query
from docquarry.sources import corpus

LIMIT = 5000
_OCC = f"WITH {corpus.SQL}"
_SHOWN = ("path_id", "file_name", "file_type", "file_size", "source", "side")


def since(rows: DataFrame, marks: DataFrame, reader: int, view: str) -> DataFrame:
    """``rows`` with ``last_seen_at`` of a reader's view; null where they have never looked."""
    mark = marks.where((F.col("reader") == reader) & (F.col("view") == view)).agg(F.max("last_seen_at").alias("last_seen_at"))
    return rows.crossJoin(F.broadcast(mark))  # one row


def added(paths: DataFrame, marks: DataFrame, reader: int, view: str) -> DataFrame:
    """Occurrences that came on the day of the watermark or later, newest first, at most ``LIMIT``."""
    new = since(paths, marks, reader, view).where(F.col("last_seen_at").isNull() | (F.col("file_date") >= F.col("last_seen_at").cast("date")))
    shown = new.orderBy(F.desc("file_date"), F.desc("path_id")).limit(LIMIT)  # a capped dataset
    return shown.select(*_SHOWN, F.lit("added").alias("change_kind"), F.col("file_date").alias("detected_at"), F.lit(None).cast("string").alias("previous_value"), F.col("file_name").alias("current_value"))


def revised(paths: DataFrame, revisions: DataFrame, kind: str, marks: DataFrame, reader: int, view: str) -> DataFrame:
    """Every revision of a kind after the watermark, newest first, at most ``LIMIT``.

    ``revisions``: revision_id, path_id, change_kind, changed_at, old_values and new_values as JSON.
    """
    own = revisions.where(F.col("change_kind") == kind).join(paths.select(*_SHOWN), "path_id")
    new = since(own, marks, reader, view).where(F.col("changed_at") > F.coalesce("last_seen_at", F.lit(0).cast("timestamp")))
    shown = new.orderBy(F.desc("changed_at"), F.desc("revision_id")).limit(LIMIT)  # a capped dataset
    told = [F.get_json_object(c, "$.file_name").alias(n) for c, n in (("old_values", "previous_value"), ("new_values", "current_value"))]
    return shown.select("revision_id", *_SHOWN, "change_kind", F.col("changed_at").cast("timestamp_ntz").alias("detected_at"), *told)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of revisions from the event table: clicks and views modify the occurrence of their
    user's number, errors remove it. One in five names no file."""
    e = corpus.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "error"))
    removed = F.col("event_type") == "error"
    old = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("doc"), "user_id", F.lit(".v"), F.col("event_id") % 3))
    new = F.when(~removed, F.concat(F.lit("doc"), "user_id", F.lit(".v"), (F.col("event_id") + 1) % 3))
    return e.select(
        F.col("event_id").alias("revision_id"), F.col("user_id").alias("path_id"), F.when(removed, "removed").otherwise("modified").alias("change_kind"), F.col("ts").cast("timestamp").alias("changed_at"),
        F.to_json(F.struct(old.alias("file_name"))).alias("old_values"), F.to_json(F.struct(new.alias("file_name"))).alias("new_values"),
    )


#: The readers of the test queries, their view and when they last saw it.
_MARKS = [(1, "en", "2024-01-15 12:00:00"), (1, "en", "2024-01-03 00:00:00"), (1, "fr", "2024-06-30 12:00:00"), (2, "de", "2024-01-01 00:00:00")]


def _marks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_MARKS, "reader int, view string, last_seen_at string").withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp"))


_LOG = """, revs AS (
  SELECT event_id AS revision_id, user_id AS path_id, CASE WHEN event_type = 'error' THEN 'removed' ELSE 'modified' END AS change_kind, ts AS changed_at,
         CASE WHEN event_id % 5 <> 0 THEN 'doc' || user_id || '.v' || (event_id % 3) END AS previous_value, CASE WHEN event_type <> 'error' THEN 'doc' || user_id || '.v' || ((event_id + 1) % 3) END AS current_value
  FROM events WHERE event_type IN ('click', 'view', 'error')
)"""


def _revised_sql(kind: str, side: str, after: str) -> str:
    return (
        f"{_OCC}{_LOG} SELECT revision_id, o.path_id, file_name, file_type, file_size, source, side, change_kind, changed_at AS detected_at, previous_value, current_value "
        f"FROM revs JOIN occ o ON o.path_id = revs.path_id WHERE change_kind = '{kind}' AND side = '{side}' AND changed_at > TIMESTAMP '{after}' ORDER BY changed_at DESC, revision_id DESC LIMIT {LIMIT}"
    )


@query(_OCC + f" SELECT path_id, file_name, file_type, file_size, source, side, 'added' AS change_kind, file_date AS detected_at, CAST(NULL AS VARCHAR) AS previous_value, file_name AS current_value FROM occ WHERE side = 'fr' AND file_date >= DATE '2024-06-30' ORDER BY file_date DESC, path_id DESC LIMIT {LIMIT}")
def change_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched occurrences from the day on which the reader last saw the view."""
    return added(matched(spark, sf_dir, sides=("fr",)), _marks(spark), 1, "fr")


@query(_OCC + f" SELECT path_id, file_name, file_type, file_size, source, side, 'added' AS change_kind, file_date AS detected_at, CAST(NULL AS VARCHAR) AS previous_value, file_name AS current_value FROM occ WHERE side = 'es' ORDER BY file_date DESC, path_id DESC LIMIT {LIMIT}")
def change_added_first_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader who has never seen the view: all of it is new."""
    return added(matched(spark, sf_dir, sides=("es",)), _marks(spark), 1, "es")


@query(_revised_sql("modified", "en", "2024-01-15 12:00:00"))
def change_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every modification of matched occurrences since the reader last saw the view."""
    return revised(matched(spark, sf_dir, sides=("en",)), log(spark, sf_dir), "modified", _marks(spark), 1, "en")


@query(_revised_sql("removed", "de", "1970-01-01 00:00:00"))
def change_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every removal in a view that this reader has never seen: what was, and no current value."""
    return revised(matched(spark, sf_dir, sides=("de",)), log(spark, sf_dir), "removed", _marks(spark), 1, "de")


# --- detectors


def states(runs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """hash_id and, for each detector, the state of its best run: ``current``, ``failed`` (of the
    current version), or ``stale``; null without a run.

    ``runs``: hash_id, detector, version, status. One conditional aggregate for all detectors.
    """
    def best(detector: str, version: str) -> Column:
        own, now = F.col("detector") == detector, F.col("version") == version
        current, failed = F.bool_or(own & now & (F.col("status") != "failed")), F.bool_or(own & now & (F.col("status") == "failed"))
        return F.when(current, "current").when(failed, "failed").when(F.bool_or(own), "stale").alias(detector)

    return runs.groupBy("hash_id").agg(*(best(d, v) for d, v in versions.items()))


def coverage(contents: DataFrame, runs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """A row a detector: contents, current, failed, stale and never; and all_current, the contents
    for which every detector is current."""
    laid = contents.join(states(runs, versions), "hash_id", "left")
    every = reduce(lambda a, b: a & b, [F.col(d).eqNullSafe("current") for d in versions])
    kinds = ("current", "failed", "stale")
    counts = [F.struct(F.lit(d).alias("detector"), *(F.count(F.when(F.col(d) == k, 1)).alias(k) for k in kinds), F.count(F.when(F.col(d).isNull(), 1)).alias("never")) for d in versions]
    one = laid.agg(F.count("*").alias("contents"), F.count(F.when(every, 1)).alias("all_current"), F.array(*counts).alias("each"))
    return one.select("contents", "all_current", F.inline("each"))


def to_measure(contents: DataFrame, runs: DataFrame, versions: dict[str, str], after: int, size: int) -> DataFrame:
    """The next ``size`` contents behind a key for which some detector has no run of its current
    version that didn't fail."""
    laid = contents.where(F.col("hash_id") > after).join(states(runs, versions), "hash_id", "left")
    stale = reduce(lambda a, b: a | b, [~F.col(d).eqNullSafe("current") for d in versions])
    return laid.where(stale).select("hash_id").orderBy("hash_id").limit(size)


#: The detectors of the test queries and their current versions.
_VERSIONS = {"temporal": "v2", "place": "g1", "contact": "c3"}


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from the labels, each kept for the content of its document."""
    paths = corpus.occurrences(spark, sf_dir).select("path_id", "hash_id")
    own = corpus.table(spark, sf_dir, "labels").join(paths, F.col("doc_id") == F.col("path_id"))
    run = lambda d, v, s: F.struct(F.lit(d).alias("detector"), v.alias("version"), s.alias("status"))
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    each = F.array(
        run("temporal", F.when(quality, "v2").otherwise("v1"), F.when(toxic, "failed").otherwise("complete")),
        run("place", F.when(toxic, "g0").otherwise("g1"), F.when(quality, "complete").otherwise("truncated")),
        run("contact", F.lit("c3"), F.when(quality & toxic, "failed").when(quality, "complete").otherwise("no_text")),
    )
    return own.select("hash_id", F.inline(each))


_RUNS_SQL = f"""{_OCC}, runs AS (
  SELECT o.hash_id, d.detector, CASE d.detector WHEN 'temporal' THEN CASE WHEN quality = 1 THEN 'v2' ELSE 'v1' END WHEN 'place' THEN CASE WHEN toxic = 1 THEN 'g0' ELSE 'g1' END ELSE 'c3' END AS version,
         CASE d.detector WHEN 'temporal' THEN CASE WHEN toxic = 1 THEN 'failed' ELSE 'complete' END WHEN 'place' THEN CASE WHEN quality = 1 THEN 'complete' ELSE 'truncated' END ELSE CASE WHEN quality = 1 AND toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'complete' ELSE 'no_text' END END AS status
  FROM labels l JOIN occ o ON o.path_id = l.doc_id CROSS JOIN (VALUES ('temporal'), ('place'), ('contact')) AS d(detector)
), v AS (SELECT * FROM (VALUES ('temporal', 'v2'), ('place', 'g1'), ('contact', 'c3')) AS v(detector, now)
), st AS (
  SELECT c.hash_id, v.detector, CASE WHEN EXISTS (SELECT 1 FROM runs r WHERE r.hash_id = c.hash_id AND r.detector = v.detector AND version = now AND status <> 'failed') THEN 'current'
         WHEN EXISTS (SELECT 1 FROM runs r WHERE r.hash_id = c.hash_id AND r.detector = v.detector AND version = now) THEN 'failed' WHEN EXISTS (SELECT 1 FROM runs r WHERE r.hash_id = c.hash_id AND r.detector = v.detector) THEN 'stale' END AS state
  FROM contents c CROSS JOIN v
)"""


@query(
    _RUNS_SQL + " SELECT detector, count(*) AS contents, count(*) FILTER (WHERE state = 'current') AS current, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'stale') AS stale, count(*) FILTER (WHERE state IS NULL) AS never, "
    "(SELECT count(*) FROM (SELECT hash_id FROM st GROUP BY hash_id HAVING bool_and(coalesce(state = 'current', false)))) AS all_current FROM st GROUP BY detector"
)
def detectors_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far all detectors have come, from one pass over contents and runs."""
    return coverage(corpus.content_ids(spark, sf_dir), _runs(spark, sf_dir), _VERSIONS)


@query(_RUNS_SQL + " SELECT DISTINCT hash_id FROM st WHERE coalesce(state, '') <> 'current' AND hash_id > 100 ORDER BY 1 LIMIT 200")
def redetection_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next contents that some detector's current version hasn't measured without failing."""
    return to_measure(corpus.content_ids(spark, sf_dir), _runs(spark, sf_dir), _VERSIONS, 100, 200)
