"""The signal explorer: filters whose value lists may ask for nulls, evidence, places, windows, pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.dates import overlaps
from docquarry.plans.criteria import literal
from docquarry.plans.registry import query
from docquarry.sources import corpus

_SIG = f"WITH {corpus.SIGNALS_SQL}"
#: What asks for a null in a list of values.
UNRECORDED, UNSPECIFIED = "unrecorded", "unspecified"


def any_of(column: str, values: tuple[str, ...], null_token: str | None = None) -> Column:
    """Membership in ``values``, none of which leaves it open; the token among them stands for null."""
    if not values:
        return F.lit(True)
    plain = [v for v in values if v != null_token]
    hit = F.coalesce(F.col(column).isin(*plain), F.lit(False)) if plain else F.lit(False)
    return hit | F.col(column).isNull() if null_token in values else hit


@dataclass(frozen=True)
class SignalFilter:
    """What the explorer shows. An empty list leaves its dimension open."""

    detectors: tuple[str, ...] = ()
    signal_types: tuple[str, ...] = ()
    resolutions: tuple[str, ...] = ()
    confidence: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    calendars: tuple[str, ...] = ()
    methods: tuple[str, ...] = ()
    orientations: tuple[str, ...] = ()
    hash_ids: tuple[int, ...] = ()
    evidence_text: str = ""
    event_from: str | None = None
    event_to: str | None = None

    def where(self) -> Column:
        """The predicate over signals. Undated ones are in no event window."""
        out = any_of("detector", self.detectors) & any_of("signal_type", self.signal_types) & any_of("resolution", self.resolutions)
        out = out & any_of("confidence", self.confidence, UNRECORDED) & any_of("language", self.languages, UNSPECIFIED) & any_of("calendar", self.calendars)
        out = out & any_of("method", self.methods) & any_of("text_orientation", self.orientations, UNRECORDED)
        if self.hash_ids:
            out = out & F.col("hash_id").isin(*self.hash_ids)
        if self.evidence_text:
            said = lambda c: F.coalesce(literal(F.col(c), self.evidence_text), F.lit(False))
            out = out & (said("evidence_sentence") | said("surface"))
        if self.event_from or self.event_to:
            start, end = (F.lit(day or open_).cast("date") for day, open_ in ((self.event_from, "0001-01-01"), (self.event_to, "9999-12-31")))
            out = out & overlaps(F.col("date_from"), F.col("date_to"), start, end)
        return out


def at_places(signals: DataFrame, places: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The signals that some place of ``places`` (place_id, place_key) with one of the keys stands for."""
    return signals.join(places.where(F.col("place_key").isin(*keys)).select("place_id"), "place_id", "left_semi")


def page(found: DataFrame, *order: Column, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of ``found`` with ``total``, the exact number of all: an aggregate of one row. Both
    read the kept table; neither moves more than a page or a count from each task."""
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def capped(found: DataFrame, *order: Column, limit: int) -> DataFrame:
    """The first rows of a capped report, with ``truncated``: whether there were more. One row
    more than the limit is looked at, never all, and the input is planned once."""
    some = found.orderBy(*order).limit(limit + 1).withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) > limit)
    return some.orderBy(*order).limit(limit)


@query(f"{_SIG} SELECT signal_id, confidence, language FROM sig WHERE (confidence IN ('high') OR confidence IS NULL) AND (language IN ('fa') OR language IS NULL) AND (text_orientation IN ('past') OR text_orientation IS NULL)")
def signal_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by values, where what isn't recorded is a value to ask for."""
    f = SignalFilter(confidence=("high", UNRECORDED), languages=(UNSPECIFIED, "fa"), orientations=("past", UNRECORDED))
    return corpus.signals(spark, sf_dir).where(f.where()).select("signal_id", "confidence", "language")


@query(f"{_SIG} SELECT signal_id, surface FROM sig WHERE (contains(lower(evidence_sentence), 'click 7') OR contains(lower(surface), 'click 7')) AND detector IN ('temporal') AND calendar IN ('gregorian', 'hijri')")
def signal_evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals whose evidence or surface holds a text, no character of it special."""
    f = SignalFilter(detectors=("temporal",), calendars=("gregorian", "hijri"), evidence_text="click 7")
    return corpus.signals(spark, sf_dir).where(f.where()).select("signal_id", "surface")


@query(f"{_SIG} SELECT signal_id, place_id FROM sig WHERE place_id IN (SELECT n_nationkey FROM nation WHERE lower(n_name) IN ('nation_3', 'nation_7')) AND method IN ('gazetteer')")
def signal_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that stand for one of two places."""
    places = corpus.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("place_id"), F.lower("n_name").alias("place_key"))
    found = corpus.signals(spark, sf_dir).where(SignalFilter(methods=("gazetteer",)).where())
    return at_places(found, places, ("nation_3", "nation_7")).select("signal_id", "place_id")


@query(f"{_SIG} SELECT signal_id, date_from, date_to FROM sig WHERE date_to >= DATE '2024-01-09' AND date_from <= DATE '2024-01-11' AND resolution IN ('resolved', 'ambiguous')")
def signal_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals whose range shares a day with a window; undated ones never do."""
    f = SignalFilter(resolutions=("resolved", "ambiguous"), event_from="2024-01-09", event_to="2024-01-11")
    return corpus.signals(spark, sf_dir).where(f.where()).select("signal_id", "date_from", "date_to")


@query(f"{_SIG} SELECT signal_id, date_from, count(*) OVER () AS total FROM sig WHERE signal_type IN ('purchase') ORDER BY date_from NULLS LAST, signal_id LIMIT 100 OFFSET 200")
def signal_explorer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of signals by event date, with the exact total."""
    found = corpus.signals(spark, sf_dir).where(SignalFilter(signal_types=("purchase",)).where()).select("signal_id", "date_from")
    return page(found, F.col("date_from").asc_nulls_last(), F.col("signal_id"), limit=100, offset=200)


@query(f"{_SIG} SELECT signal_id, value, (SELECT count(*) > 500 FROM sig WHERE confidence = 'high') AS truncated FROM sig WHERE confidence = 'high' ORDER BY value DESC, signal_id LIMIT 500")
def signal_capped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of 500 rows at most that says whether it left any out."""
    found = corpus.signals(spark, sf_dir).where(F.col("confidence") == "high").select("signal_id", "value")
    return capped(found, F.desc("value"), F.col("signal_id"), limit=500)


@query(f"{_SIG}, r AS (SELECT *, row_number() OVER (PARTITION BY hash_id ORDER BY ts, signal_id) AS n FROM sig) SELECT hash_id, count(*) AS signals, CAST(count(*) FILTER (WHERE confidence = 'high') AS BIGINT) AS high, min(ts) FILTER (WHERE n = 1) AS entered FROM r GROUP BY hash_id")
def signal_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each content entered, and its signals: filtered aggregates instead of windows."""
    s = corpus.signals(spark, sf_dir)
    return s.groupBy("hash_id").agg(F.count("*").alias("signals"), F.count(F.when(F.col("confidence") == "high", 1)).alias("high"), F.min("ts").alias("entered"))
