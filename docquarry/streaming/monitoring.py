"""Monitoring rules and scenarios over signals, evaluated incrementally.

A rule's ledger holds every subject once: a run takes what matches now, drops the subjects
it knows by an anti-join, and appends the rest. The first run of a rule is its baseline and
notifies nobody. A scenario turns signals into conditions, conditions into cases and cases
into outcomes in one plan; only changed outcomes are appended.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.dates import imminent
from docquarry.plans.registry import query
from docquarry.sources import corpus

_SIG = f"WITH {corpus.SIGNALS_SQL}"
RANK = {"high": 3, "medium": 2, "low": 1}
AS_OF = "2024-01-15"


def confidence_rank(column: Column) -> Column:
    """The order of confidence; unrecorded is 0."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[column], F.lit(0))


@dataclass(frozen=True)
class Rule:
    """What a rule looks for: signal types, a least confidence and a date window."""

    types: tuple[str, ...]
    least_confidence: str = "low"
    date_from: str | None = None
    date_to: str | None = None

    def matches(self, signals: DataFrame) -> DataFrame:
        out = signals.where(F.col("signal_type").isin(*self.types) & (confidence_rank(F.col("confidence")) >= RANK[self.least_confidence]))
        if self.date_from:
            out = out.where(F.col("date_from") >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            out = out.where(F.col("date_from") <= F.lit(self.date_to).cast("date"))
        return out


def evaluate(rule: Rule, signals: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Rows to append to the ledger: new subjects, ``baseline`` on a first run.

    ``ledger``: earlier rows (hash_id among their columns), or None when there are none.
    The best signal of a subject stands for it; an aggregate, so one row a subject is
    shuffled from each task.
    """
    best = F.min_by(F.struct("signal_id", "confidence", "date_from"), F.struct(-confidence_rank(F.col("confidence")), F.col("signal_id")))
    found = rule.matches(signals).groupBy("hash_id").agg(best.alias("b"), F.count("*").alias("signals"))
    if ledger is not None:
        found = found.join(ledger.select("hash_id"), "hash_id", "left_anti")
    state = "baseline" if ledger is None else "pending"
    return found.select("hash_id", "b.signal_id", "b.confidence", "b.date_from", "signals", F.lit(state).alias("state"))


RULE = Rule(("purchase", "signup"), "medium", "2024-01-10")
_RULE_SQL = "SELECT * FROM sig WHERE signal_type IN ('purchase', 'signup') AND confidence IN ('medium', 'high') AND date_from >= DATE '2024-01-10'"
_RANK_SQL = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(
    f"{_SIG}, m AS ({_RULE_SQL}), old AS (SELECT DISTINCT hash_id FROM m WHERE date_from < DATE '2024-01-20'), r AS (SELECT *, row_number() OVER (PARTITION BY hash_id ORDER BY {_RANK_SQL} DESC, signal_id) AS k, count(*) OVER (PARTITION BY hash_id) AS signals FROM m) "
    "SELECT hash_id, signal_id, confidence, date_from, signals, 'pending' AS state FROM r WHERE k = 1 AND hash_id NOT IN (SELECT hash_id FROM old)"
)
def rule_match_new_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that enter a rule after its baseline."""
    s = corpus.signals(spark, sf_dir)
    baseline = evaluate(RULE, s.where("date_from < DATE '2024-01-20'"), None)
    return evaluate(RULE, s, baseline)


@query(f"{_SIG}, m AS ({_RULE_SQL}) SELECT signal_type, count(DISTINCT hash_id) AS subjects, max({_RANK_SQL}) AS best, bool_or(confidence = 'high' AND date_from < DATE '2024-01-17') AS urgent FROM m GROUP BY signal_type")
def rule_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's matches by group."""
    m = RULE.matches(corpus.signals(spark, sf_dir))
    urgent = F.bool_or((F.col("confidence") == "high") & (F.col("date_from") < F.lit("2024-01-17").cast("date")))
    return m.groupBy("signal_type").agg(F.countDistinct("hash_id").alias("subjects"), F.max(confidence_rank(F.col("confidence"))).alias("best"), urgent.alias("urgent"))


def priority(matches: DataFrame, as_of: Column, *keys: str) -> DataFrame:
    """The priority of each group of matches, by ``keys``, with what it is derived from.

    high: some match is both of high confidence and imminent; medium: some is of high or
    medium confidence; else low. What isn't recorded raises nothing.
    """
    rank = confidence_rank(F.col("confidence"))
    urgent = F.bool_or((rank == 3) & imminent(F.col("date_from"), F.col("date_to"), as_of))
    named = F.when(F.col("high_and_imminent"), "high").when(F.col("best") >= 2, "medium").otherwise("low")
    facts = matches.groupBy(*keys).agg(urgent.alias("high_and_imminent"), F.max(rank).alias("best"), F.count(F.when(rank == 0, 1)).alias("unrecorded"), F.min("date_from").alias("earliest"))
    return facts.select(*keys, named.alias("priority"), "high_and_imminent", "unrecorded", "earliest")


_IMMINENT = f"(date_from IS NOT NULL AND coalesce(date_to, date_from) >= DATE '{AS_OF}' AND date_from < DATE '{AS_OF}' + 7)"
_PRIORITY = f"CASE WHEN bool_or(confidence = 'high' AND {_IMMINENT}) THEN 'high' WHEN bool_or(confidence IN ('high', 'medium')) THEN 'medium' ELSE 'low' END"


@query(f"{_SIG} SELECT hash_id, {_PRIORITY} AS priority, coalesce(bool_or(confidence = 'high' AND {_IMMINENT}), false) AS high_and_imminent, count(*) FILTER (WHERE confidence IS NULL) AS unrecorded, min(date_from) AS earliest FROM sig GROUP BY hash_id")
def priority_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content's priority and what it is derived from."""
    return priority(corpus.signals(spark, sf_dir), F.lit(AS_OF).cast("date"), "hash_id")


@dataclass(frozen=True)
class Case:
    """Holds when all, some and none of the named conditions hold; gives an outcome."""

    name: str
    outcome: str
    rank: int
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()

    def holds(self) -> Column:
        out = F.lit(True)
        for c in self.all_of:
            out = out & F.col(c)
        if self.any_of:
            some = F.lit(False)
            for c in self.any_of:
                some = some | F.col(c)
            out = out & some
        for c in self.none_of:
            out = out & ~F.col(c)
        return out


@dataclass(frozen=True)
class Scenario:
    """Conditions are SQL predicates over a signal; a content has one if any signal does."""

    conditions: dict[str, str]
    cases: tuple[Case, ...]
    default: str = "none"
    strategy: str = "first_match"  # or all_matching, highest_priority
    known: tuple[str, ...] = field(default=("first_match", "all_matching", "highest_priority"))

    def decide(self, signals: DataFrame) -> DataFrame:
        """hash_id and its outcomes, in one aggregation."""
        if self.strategy not in self.known:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        flags = [F.coalesce(F.bool_or(F.expr(p)), F.lit(False)).alias(c) for c, p in self.conditions.items()]
        state = signals.groupBy("hash_id").agg(*flags)
        cases = sorted(self.cases, key=lambda c: (-c.rank, c.name)) if self.strategy == "highest_priority" else list(self.cases)
        if self.strategy == "all_matching":
            got = F.array_compact(F.array(*(F.when(c.holds(), F.lit(c.outcome)) for c in cases)))
            got = F.array_sort(F.array_distinct(got))
            return state.select("hash_id", F.when(F.size(got) > 0, F.array_join(got, ",")).otherwise(self.default).alias("outcomes"))
        out = F.lit(self.default)
        for c in reversed(cases):
            out = F.when(c.holds(), F.lit(c.outcome)).otherwise(out)
        return state.select("hash_id", out.alias("outcomes"))


def changes(old: DataFrame, new: DataFrame, default: str = "none") -> DataFrame:
    """hash_id, previous and outcomes where they differ; who has left gets the default."""
    both = old.select("hash_id", F.col("outcomes").alias("previous")).join(new, "hash_id", "full_outer")
    both = both.withColumn("outcomes", F.coalesce("outcomes", F.lit(default)))
    return both.where(~F.col("previous").eqNullSafe(F.col("outcomes")))


_CONDITIONS = {"bought": "signal_type = 'purchase'", "joined": "signal_type = 'signup'", "sure": "confidence = 'high'", "erred": "signal_type = 'error'"}
_CASES = (
    Case("a", "customer", 1, all_of=("bought", "sure"), none_of=("erred",)),
    Case("b", "troubled", 3, all_of=("erred",), any_of=("bought", "joined")),
    Case("c", "member", 2, any_of=("joined",)),
)
_FLAGS = "f AS (SELECT hash_id, " + ", ".join(f"coalesce(bool_or({p}), false) AS {c}" for c, p in _CONDITIONS.items()) + " FROM sig GROUP BY hash_id)"
_HOLDS = {"customer": "bought AND sure AND NOT erred", "troubled": "erred AND (bought OR joined)", "member": "joined"}


def _strategy(name: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Scenario(_CONDITIONS, _CASES, strategy=name).decide(corpus.signals(spark, sf_dir))

    run.__name__, run.__doc__ = f"scenario_{name}", f"Outcomes by the strategy {name}."
    return query(f"{_SIG}, {_FLAGS} SELECT hash_id, {sql} AS outcomes FROM f")(run)


_case = lambda order: "CASE " + " ".join(f"WHEN {_HOLDS[o]} THEN '{o}'" for o in order) + " ELSE 'none' END"
scenario_first_match = _strategy("first_match", _case(("customer", "troubled", "member")))
scenario_highest_priority = _strategy("highest_priority", _case(("troubled", "member", "customer")))
_ALL = " UNION ALL ".join(f"SELECT '{o}' AS o WHERE {h}" for o, h in _HOLDS.items())
scenario_all_matching = _strategy("all_matching", f"coalesce((SELECT string_agg(o, ',' ORDER BY o) FROM ({_ALL})), 'none')")

_EARLY = "2024-01-03"
_FLAGS_EARLY = _FLAGS.replace("f AS", "g AS", 1).replace("FROM sig", f"FROM sig WHERE date_from < DATE '{_EARLY}'")
_FIRST = _case(("customer", "troubled", "member"))


@query(
    f"{_SIG}, {_FLAGS}, {_FLAGS_EARLY}, n AS (SELECT hash_id, {_FIRST} AS outcomes FROM f), o AS (SELECT hash_id, {_FIRST} AS previous FROM g) "
    "SELECT coalesce(n.hash_id, o.hash_id) AS hash_id, previous, coalesce(outcomes, 'none') AS outcomes FROM n FULL JOIN o ON n.hash_id = o.hash_id WHERE previous IS DISTINCT FROM coalesce(outcomes, 'none')"
)
def scenario_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that changed between two evaluations."""
    s, scenario = corpus.signals(spark, sf_dir), Scenario(_CONDITIONS, _CASES)
    return changes(scenario.decide(s.where(F.col("date_from") < F.lit(_EARLY).cast("date"))), scenario.decide(s))


def dry_run(scenario: Scenario, signals: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row of what an evaluation would do, writing nothing: contents, contents by outcome
    as a map, and how many would change."""
    new = scenario.decide(signals)
    counts = new.groupBy("outcomes").agg(F.count("*").alias("n"))
    by = counts.agg(F.sum("n").alias("contents"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcomes", "n")))).alias("by_outcome"))  # as many entries as outcomes
    return by.crossJoin(F.broadcast(changes(recorded, new, scenario.default).agg(F.count("*").alias("changed"))))  # one row


@query(
    f"{_SIG}, {_FLAGS}, {_FLAGS_EARLY}, n AS (SELECT hash_id, {_FIRST} AS outcomes FROM f), o AS (SELECT hash_id, {_FIRST} AS previous FROM g), "
    "c AS (SELECT count(*) AS changed FROM n FULL JOIN o ON n.hash_id = o.hash_id WHERE previous IS DISTINCT FROM coalesce(outcomes, 'none')), k AS (SELECT outcomes, count(*) AS m FROM n GROUP BY 1) "
    "SELECT CAST((SELECT sum(m) FROM k) AS BIGINT) AS contents, (SELECT string_agg(outcomes || '=' || m, ',' ORDER BY outcomes) FROM k) AS by_outcome, changed FROM c"
)
def scenario_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an evaluation would change, as one row."""
    s, scenario = corpus.signals(spark, sf_dir), Scenario(_CONDITIONS, _CASES)
    report = dry_run(scenario, s, scenario.decide(s.where(F.col("date_from") < F.lit(_EARLY).cast("date"))))
    shown = F.array_join(F.transform(F.map_entries("by_outcome"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return report.select("contents", shown.alias("by_outcome"), "changed")


def ledger_stream(rule: Rule, signals: DataFrame, ledger_path: str, checkpoint: str):
    """A stream of signals into a rule's ledger, batch by batch, each subject once.

    A batch owns one partition of the ledger and looks for its subjects in those of earlier
    batches, of which it reads the ids only. A batch that is run again writes the same rows
    over its own, the first one its baseline.
    """

    def take(batch: DataFrame, number: int) -> None:
        known = None
        if number:
            ledger = batch.sparkSession.read.schema("hash_id long, batch long").parquet(ledger_path)
            known = ledger.where(F.col("batch") < number)
        evaluate(rule, batch, known).write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")

    return signals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts by window and type; on a stream, rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of all events."""
    e = corpus.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
