"""History of a scenario's outcomes: append-only versions, the latest by content, and alerts.

An evaluation decides the outcomes of the contents of its population and records those that
differ from what was recorded last; a content without a record counts as having the default
outcome. A content that has left the population goes back to the default. Records of the
first evaluation are ``baseline``. In later ones a content that enters an outcome to be told
is ``notified``; of more than ``CAP`` of them the first ``CAP`` - 1 by priority are, the others
``overflow``; all else is ``recorded``. A priority belongs to what is told only.

``History`` keeps the records below a folder, one folder an evaluation, and beside them what
is current as a table of versions (``sources.snapshots``) in which only changed buckets are
written. An evaluation that is run again finds the state from before it and writes the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.dates import imminent
from docquarry.plans.registry import query
from docquarry.sources import corpus
from docquarry.sources.shared import staged
from docquarry.sources.snapshots import Snapshots
from docquarry.streaming.monitoring import Case, Scenario, confidence_rank

#: Contents that one evaluation tells of.
CAP = 50
CURRENT = "hash_id long, outcomes array<string>"
RECORD = ("hash_id", "outcomes", "matched_cases", "previous_outcomes", "delivery", "priority", "left_population")


def decide(scenario: Scenario, signals: DataFrame, as_of: Column) -> DataFrame:
    """hash_id, outcomes, matched_cases and priority of every content that has a signal.

    One aggregation: each condition's truth, and of the signals that make it true whether one
    is urgent and how confident the best is. The priority comes from the conditions that the
    deciding cases ask for.
    """
    rank = confidence_rank(F.col("confidence"))
    urgent = (rank == 3) & imminent(F.col("date_from"), F.col("date_to"), as_of)
    facts = []
    for name, predicate in scenario.conditions.items():
        true = F.coalesce(F.expr(predicate), F.lit(False))
        facts += [F.bool_or(true).alias(name), F.bool_or(true & urgent).alias(f"{name}_urgent"), F.max(F.when(true, rank).otherwise(0)).alias(f"{name}_best")]
    state = signals.groupBy("hash_id").agg(*facts)
    cases = sorted(scenario.cases, key=lambda c: (-c.rank, c.name)) if scenario.strategy == "highest_priority" else list(scenario.cases)
    if scenario.strategy == "all_matching":
        deciding = [(c, c.holds()) for c in cases]
        made = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(h, F.lit(c.outcome)) for c, h in deciding)))))
        outcomes = F.when(F.size(made) > 0, made).otherwise(F.array(F.lit(scenario.default)))
    else:
        deciding, taken = [], F.lit(False)
        for c in cases:
            deciding.append((c, ~taken & c.holds()))
            taken = taken | c.holds()
        outcomes = F.array(reduce(lambda out, x: F.when(x[1], F.lit(x[0].outcome)).otherwise(out), reversed(deciding), F.lit(scenario.default)))
    asked = [(h, [F.col(f"{n}_urgent") for n in (*c.all_of, *c.any_of)], [F.col(f"{n}_best") for n in (*c.all_of, *c.any_of)]) for c, h in deciding if c.all_of or c.any_of]
    high = reduce(lambda out, x: out | (x[0] & reduce(lambda a, b: a | b, x[1])), asked, F.lit(False))
    medium = reduce(lambda out, x: out | (x[0] & reduce(lambda a, b: a | b, [y >= 2 for y in x[2]])), asked, F.lit(False))
    matched = F.array_compact(F.array(*(F.when(c.holds(), F.lit(c.name)) for c in scenario.cases)))
    return state.select("hash_id", outcomes.alias("outcomes"), matched.alias("matched_cases"), F.when(high, "high").when(medium, "medium").otherwise("low").alias("priority"))


def record(decided: DataFrame, current: DataFrame, default: str, notify: list[str], baseline: bool, cap: int = CAP) -> DataFrame:
    """The rows that an evaluation appends to the history; ``current``: what was recorded last.

    ``decided`` should be cheap to read again. Only the first ``cap`` contents are ranked.
    """
    none = F.array(F.lit(default))
    both = decided.join(current.select("hash_id", F.col("outcomes").alias("previous_outcomes")), "hash_id", "left")
    changed = both.where(F.col("outcomes") != F.coalesce("previous_outcomes", none))
    entered = F.array_except(F.array_intersect("outcomes", F.array(*map(F.lit, notify))), F.coalesce("previous_outcomes", none))
    changed = changed.withColumn("_enters", F.size(entered) > 0)
    entering = changed.where("_enters")
    level = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    first = entering.orderBy(level.desc(), "hash_id").limit(cap - 1).select("hash_id", F.lit(True).alias("_first"))
    size = entering.agg((F.count("*") <= cap).alias("_all_told"))
    told = changed.join(F.broadcast(first), "hash_id", "left").crossJoin(F.broadcast(size))  # cap rows; one row
    how = F.when(F.lit(baseline), "baseline").when(~F.col("_enters"), "recorded").when(F.col("_all_told") | F.col("_first").isNotNull(), "notified").otherwise("overflow")
    told = told.withColumn("delivery", how).withColumn("priority", F.when(F.col("delivery").isin("notified", "overflow"), F.col("priority"))).withColumn("left_population", F.lit(False))
    gone = current.where(F.col("outcomes") != none).join(decided.select("hash_id"), "hash_id", "left_anti")
    left = gone.select(
        "hash_id", none.alias("outcomes"), F.array().cast("array<string>").alias("matched_cases"), F.col("outcomes").alias("previous_outcomes"),
        F.lit("baseline" if baseline else "recorded").alias("delivery"), F.lit(None).cast("string").alias("priority"), F.lit(True).alias("left_population"),
    )
    return told.select(*RECORD).unionByName(left)


class History:
    """The records of a scenario below ``path``, and what is current."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._current = Snapshots(spark, f"{self.path}/current")

    def evaluations(self) -> int:
        """How many evaluations are complete."""
        return len(self._current.versions())

    def current(self) -> DataFrame:
        """The outcomes of each content as recorded last."""
        known = self._current.read()
        return self.spark.createDataFrame([], CURRENT) if known is None else known

    def records(self) -> DataFrame:
        """All records of complete evaluations, with ``evaluation``, from 1."""
        done = self.evaluations()
        return self.spark.read.parquet(f"{self.path}/records").where(F.col("evaluation") <= done)

    def evaluate(self, scenario: Scenario, signals: DataFrame, as_of: Column, now: Column, notify: list[str], notify_existing: bool = False, cap: int = CAP) -> DataFrame:
        """Evaluates the scenario and appends what has changed; returns those records.

        Complete only when the current outcomes are committed: before that the records of
        this evaluation aren't seen, and another try writes over them.
        """
        number = self.evaluations() + 1
        folder = f"{self.path}/records/evaluation={number}"
        decided = staged(decide(scenario, signals, as_of))
        rows = record(decided, self.current(), scenario.default, notify, number == 1 and not notify_existing, cap)
        rows.withColumn("recorded_at", now).write.mode("overwrite").parquet(folder)
        made = self.spark.read.parquet(folder)
        changed = made.select("hash_id", "outcomes")
        if number == 1:
            self._current.replace(changed, ["hash_id"], note="evaluation 1")
        else:
            self._current.upsert(changed, note=f"evaluation {number}", always=True)
        return made

    def changes(self, old: int, new: int) -> DataFrame:
        """Contents whose current outcomes differ after two evaluations; other buckets aren't read."""
        return self._current.changes(old, new)


# --- queries: three evaluations over a moving window of signals, and the same in SQL

_CONDITIONS = {"bought": "signal_type = 'purchase'", "joined": "signal_type = 'signup'", "sure": "confidence = 'high'", "erred": "signal_type = 'error'"}
_CASES = (
    Case("a", "customer", 1, all_of=("bought", "sure"), none_of=("erred",)),
    Case("b", "troubled", 3, all_of=("erred",), any_of=("bought", "joined")),
    Case("c", "member", 2, any_of=("joined",)),
)
_SCENARIO = Scenario(_CONDITIONS, _CASES, strategy="all_matching")
_NOTIFY = ["customer", "troubled"]
#: The days of the test evaluations, and how many days of signals each looks at.
_DAYS, _SPAN = ("2024-01-06", "2024-01-12", "2024-01-20"), 1
#: Few, so that the test tables have an overflow.
_CAP = 10


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all evaluations."""
    out, current = None, spark.createDataFrame([], CURRENT)
    for number, day in enumerate(_DAYS, 1):
        end = F.lit(day).cast("timestamp")
        s = corpus.signals(spark, sf_dir).where((F.col("ts") < end) & (F.col("ts") >= end - F.make_dt_interval(F.lit(_SPAN))))
        rows = staged(record(staged(decide(_SCENARIO, s, end.cast("date"))), current, _SCENARIO.default, _NOTIFY, number == 1, _CAP))
        latest = rows.select("hash_id", "outcomes")
        current = current.join(latest.select("hash_id"), "hash_id", "left_anti").unionByName(latest)
        rows = rows.withColumn("evaluation", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
    return out


def _decided_sql(number: int) -> str:
    day, end = f"DATE '{_DAYS[number - 1]}'", f"TIMESTAMP '{_DAYS[number - 1]}'"
    urgent = f"confidence = 'high' AND date_from IS NOT NULL AND coalesce(date_to, date_from) >= {day} AND date_from < {day} + 7"
    rank = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
    facts = ", ".join(
        f"coalesce(bool_or({p}), false) AS {n}, coalesce(bool_or({p} AND {urgent}), false) AS {n}_urgent, max(CASE WHEN {p} THEN {rank} ELSE 0 END) AS {n}_best" for n, p in _CONDITIONS.items()
    )
    holds = {c.name: " AND ".join([*c.all_of, *(["(" + " OR ".join(c.any_of) + ")"] if c.any_of else []), *(f"NOT {n}" for n in c.none_of)]) for c in _CASES}
    some = lambda test: " OR ".join(f"(({holds[c.name]}) AND (" + " OR ".join(test.format(n) for n in (*c.all_of, *c.any_of)) + "))" for c in _CASES)
    made = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {holds[c.name]} THEN '{c.outcome}' END" for c in _CASES) + "], lambda x: x IS NOT NULL)))"
    cases = "list_filter([" + ", ".join(f"CASE WHEN {holds[c.name]} THEN '{c.name}' END" for c in _CASES) + "], lambda x: x IS NOT NULL)"
    before = "(SELECT CAST(NULL AS BIGINT) AS hash_id, CAST(NULL AS VARCHAR[]) AS outcomes WHERE false)" if number == 1 else f"cur_{number - 1}"
    notify = ", ".join(f"'{n}'" for n in _NOTIFY)
    delivery = "'baseline'" if number == 1 else f"CASE WHEN NOT enters THEN 'recorded' WHEN n_enter <= {_CAP} OR rn < {_CAP} THEN 'notified' ELSE 'overflow' END"
    return f"""
, facts_{number} AS (SELECT hash_id, {facts} FROM sig WHERE ts < {end} AND ts >= {end} - INTERVAL {_SPAN} DAY GROUP BY hash_id
), dec_{number} AS (
  SELECT hash_id, CASE WHEN len({made}) > 0 THEN {made} ELSE ['none'] END AS outcomes, {cases} AS matched_cases, CASE WHEN {some("{0}_urgent")} THEN 'high' WHEN {some("{0}_best >= 2")} THEN 'medium' ELSE 'low' END AS priority FROM facts_{number}
), cand_{number} AS (
  SELECT d.*, p.outcomes AS previous_outcomes, len(list_filter(list_intersect(d.outcomes, [{notify}]), lambda x: NOT list_contains(coalesce(p.outcomes, ['none']), x))) > 0 AS enters
  FROM dec_{number} d LEFT JOIN {before} p ON p.hash_id = d.hash_id WHERE d.outcomes <> coalesce(p.outcomes, ['none'])
), rank_{number} AS (
  SELECT *, row_number() OVER (PARTITION BY enters ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, hash_id) AS rn, count(*) FILTER (WHERE enters) OVER () AS n_enter FROM cand_{number}
), rec_{number} AS (
  SELECT {number} AS evaluation, hash_id, outcomes, matched_cases, previous_outcomes, delivery, CASE WHEN delivery IN ('notified', 'overflow') THEN priority END AS priority, false AS left_population FROM (SELECT *, {delivery} AS delivery FROM rank_{number})
  UNION ALL SELECT {number}, hash_id, ['none'], CAST([] AS VARCHAR[]), outcomes, '{"baseline" if number == 1 else "recorded"}', NULL, true FROM {before} p WHERE outcomes <> ['none'] AND hash_id NOT IN (SELECT hash_id FROM dec_{number})
), cur_{number} AS (SELECT hash_id, outcomes FROM rec_{number} UNION ALL SELECT hash_id, outcomes FROM {before} p WHERE hash_id NOT IN (SELECT hash_id FROM rec_{number}))"""


_RECORDS_SQL = f"WITH {corpus.SQL}, {corpus.SIGNALS_SQL}" + "".join(_decided_sql(i + 1) for i in range(len(_DAYS))) + ", rec AS (" + " UNION ALL ".join(f"SELECT * FROM rec_{i + 1}" for i in range(len(_DAYS))) + ")"


@query(
    _RECORDS_SQL + ", named AS (SELECT hash_id, min_by(file_name, path_id) AS file_name FROM occ GROUP BY hash_id) "
    "SELECT evaluation, hash_id, file_name, array_to_string(outcomes, ',') AS outcomes, array_to_string(matched_cases, ',') AS matched_cases, array_to_string(previous_outcomes, ',') AS previous_outcomes, delivery, priority "
    "FROM rec LEFT JOIN named USING (hash_id) ORDER BY evaluation DESC, left_population DESC, hash_id DESC LIMIT 5000"
)
def scenario_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded outcomes, the newest first, at most 5 000, with the name of each content's first
    occurrence; a content without any has no name."""
    rows = _evaluated(spark, sf_dir).orderBy(F.desc("evaluation"), F.desc("left_population"), F.desc("hash_id")).limit(5000)
    named = corpus.occurrences(spark, sf_dir).groupBy("hash_id").agg(F.min_by("file_name", "path_id").alias("file_name"))
    joined = [F.array_join(c, ",").alias(c) for c in ("outcomes", "matched_cases", "previous_outcomes")]
    return rows.join(named, "hash_id", "left").select("evaluation", "hash_id", "file_name", *joined, "delivery", "priority")


@query(_RECORDS_SQL + " SELECT evaluation, delivery, priority, left_population, count(*) AS contents FROM rec GROUP BY ALL")
def scenario_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each evaluation by how they are told."""
    return _evaluated(spark, sf_dir).groupBy("evaluation", "delivery", "priority", "left_population").agg(F.count("*").alias("contents"))


@query(_RECORDS_SQL + f" SELECT hash_id, array_to_string(outcomes, ',') AS outcomes FROM cur_{len(_DAYS)}")
def scenario_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of each content as recorded last."""
    latest = _evaluated(spark, sf_dir).groupBy("hash_id").agg(F.max_by("outcomes", "evaluation").alias("outcomes"))
    return latest.select("hash_id", F.array_join("outcomes", ",").alias("outcomes"))
