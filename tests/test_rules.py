"""Runs of monitoring rules: holds, expiry, alerts, and a stream that is replayed."""

import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from docquarry.streaming import rules as R

AT = lambda text: datetime.datetime.fromisoformat(text)
SIGNALS = "signal_id long, hash_id long, signal_type string, detector string, surface string, confidence string, date_from date, date_to date, seen_at timestamp"


def rule(spark, rule_id=1, kind="a", least="low", unit="signal", group="content", delivery="immediate", threshold=1, window=None, cooldown=0, digest=0, muted=None, existing=True):
    return spark.createDataFrame([(rule_id, kind, least, unit, group, delivery, threshold, window, cooldown, digest, muted and AT(muted), existing)], R.RULES)


def subjects(spark, rows):
    """(subject, group, matched_at) rows of rule 1."""
    made = [(1, s, g, 1, "high", None, None, AT(t)) for s, g, t in rows]
    return spark.createDataFrame(made, "rule_id int, subject_key string, group_key string, hash_id long, confidence string, date_from date, date_to date, first_matched_at timestamp")


def go(spark, rules, new, pending=(), status=(), now="2024-01-02 00:00:00", cap=50):
    known = spark.createDataFrame([(1, x and AT(x), y and AT(y)) for x, y in status], R.STATUS)
    return R.run(subjects(spark, new), subjects(spark, pending), rules, known, F.lit(now).cast("timestamp"), cap)


def states(done):
    return {r.subject_key: r.state for r in done.states.collect()}


NEW = [("s1", "g1", "2024-01-01 01:00:00"), ("s2", "g2", "2024-01-01 02:00:00")]


def test_a_first_run_is_a_baseline(spark):
    done = go(spark, rule(spark, existing=False), NEW)
    assert set(states(done).values()) == {"baseline"} and done.alerts.count() == 0
    assert [(r.waiting, r.held_by) for r in done.held.collect()] == [(0, None)]
    assert set(states(go(spark, rule(spark, existing=False), NEW, status=[(None, None)])).values()) == {"notified"}


@pytest.mark.parametrize(
    "how, status, reason",
    [
        ({"muted": "2024-01-03"}, (None, None), "suppressed"), ({"threshold": 3}, (None, None), "threshold"), ({"cooldown": 90}, ("2024-01-01 23:00:00", None), "cooldown"),
        ({"cooldown": 30}, ("2024-01-01 23:00:00", None), None), ({"delivery": "digest", "digest": 12}, ("2024-01-01 20:00:00", "2024-01-01 20:00:00"), "digest_interval"),
        ({"digest": 12}, ("2024-01-01 20:00:00", "2024-01-01 20:00:00"), None), ({"threshold": 3, "muted": "2024-01-03"}, (None, None), "suppressed"),
    ],
)
def test_holds_are_the_rules(spark, how, status, reason):
    """All that waits for a rule is counted, whatever its group; an interval holds digests only."""
    done = go(spark, rule(spark, **how), [], NEW, [status])
    assert [(r.waiting, r.held_by) for r in done.held.collect()] == [(2, reason)]
    assert set(states(done).values()) == {"pending" if reason else "notified"}
    moved = done.status.first()
    assert (moved.last_notified_at == AT("2024-01-02 00:00:00")) == (reason is None)


def test_new_subjects_of_a_muted_rule_are_never_told(spark):
    done = go(spark, rule(spark, muted="2024-01-03"), NEW, [("s3", "g1", "2024-01-01 00:00:00")], [(None, None)])
    assert states(done) == {"s1": "suppressed", "s2": "suppressed", "s3": "pending"}


def test_expiry(spark):
    done = go(spark, rule(spark, window=23, threshold=5), NEW, [("s3", "g1", "2024-01-01 00:30:00")], [(None, None)])
    assert states(done) == {"s1": "pending", "s2": "pending", "s3": "expired"}  # 23 hours before now is no longer


def test_more_groups_than_alerts(spark):
    new = [(f"s{i}", f"g{i // 2:02d}", f"2024-01-01 00:{i:02d}:00") for i in range(12)]
    done = go(spark, rule(spark), new, cap=4)
    got = sorted((r.kind, r.group_key or "", r.subjects, r.groups) for r in done.alerts.collect())
    assert got == [("immediate", "g00", 2, 1), ("immediate", "g01", 2, 1), ("immediate", "g02", 2, 1), ("overflow", "", 6, 3)]
    assert set(states(done).values()) == {"notified"}
    assert go(spark, rule(spark), new, cap=6).alerts.count() == 6  # as many as may be: no overflow
    digest = go(spark, rule(spark, delivery="digest"), new, cap=4).alerts.collect()
    assert [(r.kind, r.group_key, r.subjects, r.groups) for r in digest] == [("digest", None, 12, 6)]


def test_the_stream_agrees_with_runs_and_replays(spark, tmp_path):
    all_rules = rule(spark, threshold=3, unit="content").unionByName(rule(spark, 2, "b", group="value", existing=False)).unionByName(rule(spark, 3, "a", "high", group="none", window=1, threshold=100))
    parts = [
        [(1, 1, "a", "d", "x", "high", None, None, AT("2024-01-01 01:00:00")), (2, 1, "a", "d", "y", "low", None, None, AT("2024-01-01 01:10:00")), (3, 2, "b", "d", "v", "low", None, None, AT("2024-01-01 01:20:00"))],
        [(4, 2, "a", "d", "x", "low", None, None, AT("2024-01-01 05:00:00")), (5, 1, "a", "d", "x", "high", None, None, AT("2024-01-01 05:10:00")), (6, 3, "b", "d", "w", "low", None, None, AT("2024-01-01 05:20:00"))],
        [(7, 3, "a", "d", "x", "high", None, None, AT("2024-01-01 09:00:00")), (8, 3, "b", "d", "w", "low", None, None, AT("2024-01-01 09:30:00"))],
    ]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def stream():
        R.rule_stream(spark.readStream.schema(SIGNALS).parquet(source), all_rules, out, checkpoint).trigger(availableNow=True).start().awaitTermination()

    def told():
        tables = {n: spark.read.parquet(f"{out}/{n}") for n in ("alerts", "held", "ledger", "pending")}
        return {n: sorted((tuple(r) for r in t.collect()), key=repr) for n, t in tables.items()}

    for i, part in enumerate(parts):
        spark.createDataFrame(part, SIGNALS).coalesce(1).write.mode("append").parquet(source)
        stream()
        if i == 1:
            shutil.copytree(checkpoint, f"{checkpoint}-old")
    done = told()
    # the same runs as a batch
    status, pending = spark.createDataFrame([], R.STATUS), None
    subject = R.best(R.candidates(all_rules, spark.createDataFrame([r for p in parts for r in p], SIGNALS)))
    for i, now in enumerate(("2024-01-01 01:20:00", "2024-01-01 05:20:00", "2024-01-01 09:30:00")):
        new = subject.where((F.col("first_matched_at") <= F.lit(now).cast("timestamp")) & (F.col("first_matched_at") > F.lit(parts[i - 1][-1][-1] if i else AT("2000-01-01"))))
        one = R.run(new, new.limit(0) if pending is None else pending, all_rules, status, F.lit(now).cast("timestamp"))
        left = one.states.where("state = 'pending'").drop("state")
        pending, status = spark.createDataFrame(left.collect(), left.schema), spark.createDataFrame(one.status.collect(), R.STATUS)
        assert sorted(((*tuple(r), i) for r in one.held.collect()), key=repr) == [h for h in done["held"] if h[-1] == i]
        assert sorted(((*tuple(r), i) for r in one.alerts.collect()), key=repr) == [a for a in done["alerts"] if a[-1] == i]
        assert sorted((r.rule_id, r.subject_key, r.state) for r in one.states.where("state <> 'pending'").collect()) == sorted((x[0], x[1], x[8]) for x in done["ledger"] if x[-1] == i)
    # the last batch is run again, as after a crash between its writes and its commit
    shutil.rmtree(checkpoint)
    shutil.move(f"{checkpoint}-old", checkpoint)
    stream()
    assert told() == done
