"""Monitoring rules with a ledger, expiry, holds and delivery, run after run or on a stream.

Every subject of a rule enters its ledger once. A run matches all rules at once, takes the
subjects that are new, and marks them ``baseline`` on a rule's first run, ``suppressed`` while
the rule is muted, else ``pending``. Pending subjects older than the rule's window expire.
Then each rule is either held, for the first reason that applies, or tells all its pending
subjects: a digest as one alert; else an alert a group, first matched first, where of more
groups than ``CAP`` all after the first ``CAP`` - 1 share one overflow alert. Nothing is lost:
what is held stays pending.

Matches are aggregated by group before anything is ranked, and only a rule's first ``CAP``
groups are; the rest is summed. A stream keeps the known subjects in its state, so no run
reads the ledger again: what it reads is the pending subjects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.functions.dates import imminent
from docquarry.plans.registry import query
from docquarry.sources import corpus
from docquarry.sources.shared import staged
from docquarry.streaming.monitoring import confidence_rank

#: Alerts of one rule in one run.
CAP = 50
#: Why pending subjects aren't told yet, in the order in which it is asked.
HOLDS = ("suppressed", "threshold", "cooldown", "digest_interval")

RULES = (
    "rule_id int, signal_type string, least_confidence string, unit string, group_by string, delivery string, threshold int, window_hours int, cooldown_minutes int, "
    "digest_hours int, suppressed_until timestamp, notify_existing boolean"
)
#: What a rule has been through: whether it had its first run, and when it last told something.
STATUS = "rule_id int, last_notified_at timestamp, last_digest_at timestamp"
SUBJECT = ("rule_id", "subject_key", "group_key", "hash_id", "confidence", "date_from", "date_to", "first_matched_at")


def candidates(rules: DataFrame, signals: DataFrame) -> DataFrame:
    """Matching signals of all rules as subjects, not yet made distinct.

    A rule of unit ``signal`` has a subject for each distinct signal of a content, one of unit
    ``content`` one for the content. Subjects are told together by content, by the value
    that was found, or alone.
    """
    own = signals.join(rules, "signal_type").where(confidence_rank(F.col("confidence")) >= confidence_rank(F.col("least_confidence")))
    signal = F.concat(F.lit("signal:"), F.md5(F.concat_ws("|", "hash_id", "detector", "signal_type", "surface", F.col("date_from").cast("string"))))
    content = F.concat(F.lit("content:"), F.col("hash_id").cast("string"))
    value = F.concat(F.lit("value:"), F.md5(F.concat(F.col("signal_type"), F.lit(":"), F.col("surface"))))
    subject = F.when(F.col("unit") == "content", content).otherwise(signal)
    group = F.when((F.col("group_by") == "content") | (F.col("unit") == "content"), content).when(F.col("group_by") == "value", value).otherwise(signal)
    return own.withColumn("subject_key", subject).withColumn("group_key", group)


def best(found: DataFrame) -> DataFrame:
    """One row a subject: its most confident signal, of those the earliest, of those the least."""
    order = F.struct(-confidence_rank(F.col("confidence")), F.col("date_from").isNull(), F.col("date_from"), F.col("signal_id"))
    told = F.min_by(F.struct("group_key", "hash_id", "confidence", "date_from", "date_to"), order).alias("b")
    return found.groupBy("rule_id", "subject_key").agg(told, F.min("seen_at").alias("first_matched_at")).select("rule_id", "subject_key", "b.*", "first_matched_at")


def entered(new: DataFrame, rules: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """The state in which new subjects enter the ledger; ``status`` as it was before this run."""
    first = status.select("rule_id", F.lit(True).alias("_ran"))
    muted = F.coalesce(F.col("suppressed_until") > now, F.lit(False))
    state = F.when(F.col("_ran").isNull() & ~F.col("notify_existing"), "baseline").when(muted, "suppressed").otherwise("pending")
    return new.join(rules.select("rule_id", "suppressed_until", "notify_existing"), "rule_id").join(first, "rule_id", "left").select(*SUBJECT, state.alias("state"))


def expired(pending: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """``pending`` with state ``expired`` where a rule's window has left a subject behind."""
    old = F.col("first_matched_at") < now - F.make_dt_interval(hours=F.col("window_hours"))
    return pending.join(rules.select("rule_id", "window_hours"), "rule_id").select(*SUBJECT, F.when(old, "expired").otherwise("pending").alias("state"))


def holds(pending: DataFrame, rules: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """rule_id, waiting and held_by (null: told now) of every rule; held only if something waits."""
    waiting = pending.groupBy("rule_id").agg(F.count("*").alias("waiting"))
    at = rules.join(waiting, "rule_id", "left").join(status, "rule_id", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)))
    since = lambda last, **span: F.coalesce(now < F.col(last) + F.make_dt_interval(**span), F.lit(False))
    reason = (
        F.when(F.coalesce(F.col("suppressed_until") > now, F.lit(False)), HOLDS[0]).when(F.col("waiting") < F.col("threshold"), HOLDS[1])
        .when((F.col("cooldown_minutes") > 0) & since("last_notified_at", mins=F.col("cooldown_minutes")), HOLDS[2])
        .when((F.col("delivery") == "digest") & since("last_digest_at", hours=F.col("digest_hours")), HOLDS[3])
    )
    return at.select("rule_id", "waiting", F.when(F.col("waiting") > 0, reason).alias("held_by"), "delivery")


def _summary(now_day: Column) -> list[Column]:
    rank = confidence_rank(F.col("confidence"))
    return [
        F.count("*").alias("subjects"), F.min("first_matched_at").alias("first_at"), F.max(rank).alias("best"),
        F.bool_or((rank == 3) & imminent(F.col("date_from"), F.col("date_to"), now_day)).alias("urgent"), F.min("date_from").alias("earliest"),
    ]


def _again() -> list[Column]:
    """The same summary over summaries of groups."""
    return [F.sum("subjects").alias("subjects"), F.min("first_at").alias("first_at"), F.max("best").alias("best"), F.bool_or("urgent").alias("urgent"), F.min("earliest").alias("earliest"), F.count("*").alias("groups")]


def alerts(pending: DataFrame, told: DataFrame, now_day: Column, cap: int = CAP) -> DataFrame:
    """rule_id, kind, group_key, subjects, groups, priority and earliest of what is told now.

    ``told``: (rule_id, delivery) of the rules that aren't held. ``kind``: immediate, digest or
    overflow; the last two stand for many groups and name none.
    """
    groups = pending.join(told.where("delivery <> 'digest'").select("rule_id"), "rule_id").groupBy("rule_id", "group_key").agg(*_summary(now_day))
    sizes = groups.groupBy("rule_id").agg(F.count("*").alias("all_groups"))
    order = Window.partitionBy("rule_id").orderBy("first_at", "group_key")
    first = groups.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).join(sizes, "rule_id")
    single = first.where(F.col("place") <= F.when(F.col("all_groups") > cap, cap - 1).otherwise(cap))
    alone = single.select("rule_id", F.lit("immediate").alias("kind"), "group_key", "subjects", F.lit(1).cast("long").alias("groups"), "best", "urgent", "earliest")
    rest = groups.join(single.select("rule_id", "group_key"), ["rule_id", "group_key"], "left_anti").groupBy("rule_id").agg(*_again())
    digest = pending.join(told.where("delivery = 'digest'").select("rule_id"), "rule_id").groupBy("rule_id", "group_key").agg(*_summary(now_day)).groupBy("rule_id").agg(*_again())
    many = [x.select("rule_id", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("group_key"), "subjects", "groups", "best", "urgent", "earliest") for x, kind in ((rest, "overflow"), (digest, "digest"))]
    level = F.when(F.col("urgent"), "high").when(F.col("best") >= 2, "medium").otherwise("low")
    return alone.unionByName(many[0]).unionByName(many[1]).select("rule_id", "kind", "group_key", "subjects", "groups", level.alias("priority"), "earliest")


@dataclass(frozen=True)
class Run:
    """What a run of all rules leaves: ``states`` (subjects with the state they are in now, of
    those that were new or pending), ``alerts``, ``held`` and the rules' ``status``."""

    states: DataFrame
    alerts: DataFrame
    held: DataFrame
    status: DataFrame


def run(new: DataFrame, pending: DataFrame, rules: DataFrame, status: DataFrame, now: Column, cap: int = CAP) -> Run:
    """A run at the time ``now``: ``new`` are subjects that no earlier run has seen, ``pending``
    those that earlier runs have left pending. Both should be cheap to read again."""
    own = entered(new, rules, status, now)
    waiting = expired(pending.select(*SUBJECT).unionByName(own.where("state = 'pending'").select(*SUBJECT)), rules, now)
    live = waiting.where("state = 'pending'")
    held = holds(live, rules, status, now)
    told = held.where("waiting > 0 and held_by is null").select("rule_id", "delivery")
    after = live.join(told.select("rule_id", F.lit(True).alias("_told")), "rule_id", "left").select(*SUBJECT, F.when(F.col("_told"), "notified").otherwise("pending").alias("state"))
    states = own.where("state <> 'pending'").unionByName(waiting.where("state = 'expired'")).unionByName(after)
    at = rules.select("rule_id").join(status, "rule_id", "left").join(told.withColumnRenamed("delivery", "_how"), "rule_id", "left")
    moved = at.select(
        "rule_id", F.when(F.col("_how").isNotNull(), now).otherwise(F.col("last_notified_at")).alias("last_notified_at"),
        F.when(F.col("_how") == "digest", now).otherwise(F.col("last_digest_at")).alias("last_digest_at"),
    )
    return Run(states, alerts(live, told, now.cast("date"), cap), held.select("rule_id", "waiting", "held_by"), moved)


_SUBJECT_TYPES = "rule_id int, subject_key string, group_key string, hash_id long, confidence string, date_from date, date_to date, first_matched_at timestamp"
_RANKS = {"high": 3, "medium": 2, "low": 1}


def _first_time(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The best signal of a subject in the batch that brings it; nothing in later ones."""
    if state.exists:
        return
    state.update((True,))
    rows = [r for batch in batches for r in batch.itertuples(index=False)]
    top = min(rows, key=lambda r: (-_RANKS.get(r.confidence, 0), r.date_from is None, r.date_from or date.max, r.signal_id))
    yield pd.DataFrame([(*(getattr(top, c) for c in SUBJECT[:-1]), min(r.seen_at for r in rows))], columns=list(SUBJECT))


def rule_stream(signals: DataFrame, rules: DataFrame, path: str, checkpoint: str, cap: int = CAP):
    """A stream of signals (with ``seen_at``, a timestamp) into ledger, alerts and status below ``path``.

    Each subject passes once: its key is kept in the state of the stream, in the checkpoint.
    A batch reads what the batch before left pending, never the ledger, and writes a folder
    of its own in each table. A batch that is run again finds the same input and writes the
    same rows over its own. The time of a run is the latest ``seen_at`` so far.
    """
    found = candidates(rules, signals).select(*SUBJECT[:-1], "signal_id", "seen_at")
    kept = found.groupBy("rule_id", "subject_key").applyInPandasWithState(_first_time, _SUBJECT_TYPES, "known boolean", "append", GroupStateTimeout.NoTimeout)

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}/batch={number - 1}") if number else spark.createDataFrame([], schema)
        new, columns = staged(batch), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema.fields)
        clock = table("clock", "now timestamp").unionByName(new.select(F.col("first_matched_at").alias("now"))).agg(F.max("now").alias("now"))
        now = F.lit(clock.first()["now"])
        done = run(new, table("pending", columns), rules, table("status", STATUS), now, cap)
        states = staged(done.states)
        for name, frame in (
            ("alerts", done.alerts), ("held", done.held), ("status", done.status), ("ledger", states.where("state <> 'pending'").withColumn("changed_at", now)),
            ("pending", states.where("state = 'pending'").drop("state")), ("clock", clock),
        ):
            frame.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return kept.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


# --- queries: three runs over the signals, and the same in SQL

#: The rules of the test queries and the times of their runs.
_RULES = [
    (1, "purchase", "medium", "signal", "content", "immediate", 1, None, 90, 0, None, False),
    (2, "signup", "low", "content", "none", "digest", 1, None, 0, 12, None, True),
    (3, "click", "low", "signal", "value", "immediate", 1, None, 0, 0, None, False),
    (4, "error", "low", "signal", "content", "immediate", 40, 48, 0, 0, None, False),
    (5, "view", "low", "signal", "content", "immediate", 1, None, 0, 0, "2024-01-20 06:00:00", False),
    (6, "purchase", "high", "signal", "none", "immediate", 1_000_000, None, 0, 0, None, True),
    (7, "view", "high", "signal", "none", "digest", 1, None, 60, 12, None, False),
    (8, "error", "high", "signal", "value", "immediate", 1, None, 0, 0, "2024-01-20 06:00:00", True),
]
TIMES = ("2024-01-10 00:00:00", "2024-01-20 00:00:00", "2024-01-20 01:00:00", "2024-01-20 12:30:00")


def _runs(spark: SparkSession, sf_dir: str) -> list[Run]:
    rows = [(*r[:10], r[10], r[11]) for r in _RULES]
    rules = spark.createDataFrame(rows, RULES.replace("suppressed_until timestamp", "suppressed_until string")).withColumn("suppressed_until", F.col("suppressed_until").cast("timestamp"))
    signals = corpus.signals(spark, sf_dir).withColumn("seen_at", F.col("ts").cast("timestamp"))
    subjects = staged(best(candidates(rules, signals)))
    status, pending, done, since = spark.createDataFrame([], STATUS), spark.createDataFrame([], subjects.schema).select(*SUBJECT), [], None
    for time in TIMES:
        now = F.lit(time).cast("timestamp")
        new = subjects.where(F.col("first_matched_at") <= now)
        if since is not None:
            new = new.where(F.col("first_matched_at") > since)
        one = run(new.select(*SUBJECT), pending, rules, status, now)
        states, status = staged(one.states), staged(one.status)
        done.append(Run(states, one.alerts, one.held, status))
        pending, since = states.where("state = 'pending'").select(*SUBJECT), now
    return done


def _of_all(done: list[Run], part: str) -> DataFrame:
    frames = [getattr(r, part).withColumn("run", F.lit(i)) for i, r in enumerate(done)]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _value(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"


_RANK = "CASE {0} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_SUBJECTS_SQL = (
    f"WITH {corpus.SIGNALS_SQL}, rules AS (SELECT * REPLACE (CAST(suppressed_until AS TIMESTAMP) AS suppressed_until) FROM (VALUES "
    + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in _RULES)
    + ") AS r(" + ", ".join(c.split()[0] for c in RULES.split(", ")) + "))"
    + f""", cand AS (
  SELECT rule_id, sig.*, 'content:' || hash_id AS ck, 'value:' || md5(sig.signal_type || ':' || surface) AS vk, unit, group_by,
         'signal:' || md5(hash_id || '|' || detector || '|' || sig.signal_type || '|' || surface || coalesce('|' || CAST(date_from AS VARCHAR), '')) AS sk
  FROM sig JOIN rules ON rules.signal_type = sig.signal_type WHERE {_RANK.format("confidence")} >= {_RANK.format("least_confidence")}
), keyed AS (
  SELECT *, CASE WHEN unit = 'content' THEN ck ELSE sk END AS subject_key, CASE WHEN group_by = 'content' OR unit = 'content' THEN ck WHEN group_by = 'value' THEN vk ELSE sk END AS group_key FROM cand
), subj AS (
  SELECT rule_id, subject_key, group_key, confidence, date_from, date_to, min(ts) OVER (PARTITION BY rule_id, subject_key) AS seen FROM keyed
  QUALIFY row_number() OVER (PARTITION BY rule_id, subject_key ORDER BY {_RANK.format("confidence")} DESC, date_from IS NULL, date_from, signal_id) = 1
)"""
)


def _run_sql(i: int) -> str:
    now, day = f"TIMESTAMP '{TIMES[i]}'", f"DATE '{TIMES[i][:10]}'"
    since = f" AND seen > TIMESTAMP '{TIMES[i - 1]}'" if i else ""
    before = f" UNION ALL SELECT * FROM left_{i - 1}" if i else ""
    last = f"LEFT JOIN status_{i - 1} st USING (rule_id)" if i else "LEFT JOIN (SELECT NULL AS rule_id, NULL AS ln, NULL AS ld) st ON st.rule_id = r.rule_id"
    summary = f"count(*) AS n, min(seen) AS first_at, max({_RANK.format('confidence')}) AS best, coalesce(bool_or(confidence = 'high' AND date_from IS NOT NULL AND coalesce(date_to, date_from) >= {day} AND date_from < {day} + 7), false) AS urgent, min(date_from) AS earliest"
    again = "CAST(sum(n) AS BIGINT) AS n, max(best) AS best, bool_or(urgent) AS urgent, min(earliest) AS earliest, count(*) AS groups"
    return f"""
, new_{i} AS (SELECT s.*, CASE WHEN {"true" if i == 0 else "false"} AND NOT notify_existing THEN 'baseline' WHEN suppressed_until > {now} THEN 'suppressed' ELSE 'pending' END AS state FROM subj s JOIN rules USING (rule_id) WHERE seen <= {now}{since}
), wait_{i} AS (SELECT w.*, CASE WHEN window_hours IS NOT NULL AND seen < {now} - to_hours(window_hours) THEN 'expired' ELSE 'pending' END AS state FROM (SELECT * EXCLUDE (state) FROM new_{i} WHERE state = 'pending'{before}) w JOIN rules USING (rule_id)
), live_{i} AS (SELECT * EXCLUDE (state) FROM wait_{i} WHERE state = 'pending'
), held_{i} AS (
  SELECT r.rule_id, coalesce(n, 0) AS waiting, delivery, CASE WHEN coalesce(n, 0) = 0 THEN NULL WHEN suppressed_until > {now} THEN 'suppressed' WHEN n < threshold THEN 'threshold'
         WHEN cooldown_minutes > 0 AND {now} < CAST(ln AS TIMESTAMP) + to_minutes(cooldown_minutes) THEN 'cooldown' WHEN delivery = 'digest' AND {now} < CAST(ld AS TIMESTAMP) + to_hours(digest_hours) THEN 'digest_interval' END AS held_by
  FROM rules r LEFT JOIN (SELECT rule_id, count(*) AS n FROM live_{i} GROUP BY rule_id) c ON c.rule_id = r.rule_id {last.replace("USING (rule_id)", "ON st.rule_id = r.rule_id")}
), told_{i} AS (SELECT rule_id, delivery FROM held_{i} WHERE waiting > 0 AND held_by IS NULL
), status_{i} AS (SELECT r.rule_id, CASE WHEN t.rule_id IS NOT NULL THEN {now} ELSE CAST(ln AS TIMESTAMP) END AS ln, CASE WHEN t.delivery = 'digest' THEN {now} ELSE CAST(ld AS TIMESTAMP) END AS ld FROM rules r LEFT JOIN told_{i} t ON t.rule_id = r.rule_id {last.replace("USING (rule_id)", "ON st.rule_id = r.rule_id")}
), left_{i} AS (SELECT * FROM live_{i} WHERE rule_id NOT IN (SELECT rule_id FROM told_{i})
), grp_{i} AS (SELECT rule_id, delivery, group_key, {summary} FROM live_{i} JOIN told_{i} USING (rule_id) GROUP BY rule_id, delivery, group_key
), rank_{i} AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY rule_id) AS g FROM grp_{i} WHERE delivery <> 'digest' WINDOW w AS (PARTITION BY rule_id ORDER BY first_at, group_key)
), alert_{i} AS (
  SELECT rule_id, 'immediate' AS kind, group_key, n, CAST(1 AS BIGINT) AS groups, best, urgent, earliest FROM rank_{i} WHERE k <= CASE WHEN g > {CAP} THEN {CAP - 1} ELSE {CAP} END
  UNION ALL SELECT rule_id, 'overflow', NULL, n, groups, best, urgent, earliest FROM (SELECT rule_id, {again} FROM rank_{i} WHERE g > {CAP} AND k >= {CAP} GROUP BY rule_id)
  UNION ALL SELECT rule_id, 'digest', NULL, n, groups, best, urgent, earliest FROM (SELECT rule_id, {again} FROM grp_{i} WHERE delivery = 'digest' GROUP BY rule_id)
)"""


_RUNS_SQL = _SUBJECTS_SQL + "".join(_run_sql(i) for i in range(len(TIMES)))
_EACH = lambda text: " UNION ALL ".join(text.format(i=i) for i in range(len(TIMES)))


@query(f"{_RUNS_SQL} {_EACH('SELECT {i} AS run, rule_id, waiting, held_by FROM held_{i}')}")
def rule_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for each rule in each of four runs, and why it isn't told."""
    return _of_all(_runs(spark, sf_dir), "held")


@query(
    _RUNS_SQL + " SELECT * EXCLUDE (best, urgent), CASE WHEN urgent THEN 'high' WHEN best >= 2 THEN 'medium' ELSE 'low' END AS priority FROM ("
    + _EACH("SELECT {i} AS run, rule_id, kind, group_key, n AS subjects, groups, best, urgent, earliest FROM alert_{i}") + ")"
)
def rule_alerts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts of the four runs."""
    return _of_all(_runs(spark, sf_dir), "alerts")


@query(
    f"{_RUNS_SQL}, st AS (" + _EACH("SELECT {i} AS run, rule_id, state FROM new_{i} WHERE state <> 'pending' UNION ALL SELECT {i}, rule_id, state FROM wait_{i} WHERE state = 'expired' UNION ALL SELECT {i}, rule_id, 'pending' FROM left_{i} UNION ALL SELECT {i}, rule_id, 'notified' FROM live_{i} WHERE rule_id IN (SELECT rule_id FROM told_{i})")
    + ") SELECT run, rule_id, state, count(*) AS subjects FROM st GROUP BY ALL"
)
def rule_ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of each rule by the state in which each run leaves them."""
    return _of_all(_runs(spark, sf_dir), "states").groupBy("run", "rule_id", "state").agg(F.count("*").alias("subjects"))


_NOW = "2024-01-20 00:00:00"


@query(
    f"WITH {corpus.SIGNALS_SQL}, pend AS (SELECT hash_id, ts AS matched_at FROM sig WHERE signal_type = 'purchase' AND ts <= TIMESTAMP '{_NOW}') "
    f"SELECT CASE WHEN matched_at < TIMESTAMP '{_NOW}' - INTERVAL 240 HOUR THEN 'expired' ELSE 'pending' END AS state, count(*) AS matches, count(DISTINCT hash_id) AS contents FROM pend GROUP BY 1"
)
def rule_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that a rule's window of 240 hours has left behind."""
    now = F.lit(_NOW).cast("timestamp")
    rule = spark.createDataFrame([(1, "purchase", "low", 240)], "rule_id int, signal_type string, least_confidence string, window_hours int")
    own = corpus.signals(spark, sf_dir).join(rule.select("rule_id", "signal_type"), "signal_type").withColumn("first_matched_at", F.col("ts").cast("timestamp")).where(F.col("first_matched_at") <= now)
    pending = own.withColumn("subject_key", F.col("signal_id").cast("string")).withColumn("group_key", F.col("signal_type"))
    return expired(pending, rule, now).groupBy("state").agg(F.count("*").alias("matches"), F.countDistinct("hash_id").alias("contents"))
