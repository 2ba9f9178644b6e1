"""Outcome history: what is recorded, told and counted; crashes and repetitions."""

import pytest
from pyspark.sql import functions as F

from docquarry.streaming import outcomes as O  # noqa: E741
from docquarry.streaming.monitoring import Case, Scenario

SIGNALS = "signal_id long, hash_id long, signal_type string, confidence string, date_from date, date_to date"
SCENARIO = Scenario({"a": "signal_type = 'a'", "b": "signal_type = 'b'"}, (Case("x", "red", 1, all_of=("a",)), Case("y", "blue", 2, all_of=("b",))), strategy="all_matching")


def signals(spark, rows):
    return spark.createDataFrame([(i, h, t, c, None, None) for i, (h, t, c) in enumerate(rows)], SIGNALS)


def told(frame):
    return sorted((r.hash_id, ",".join(r.outcomes), ",".join(r.matched_cases), r.previous_outcomes and ",".join(r.previous_outcomes), r.delivery, r.priority, r.left_population) for r in frame.collect())


@pytest.fixture
def history(spark, tmp_path):
    return O.History(spark, str(tmp_path / "h"))


def go(history, rows, **how):
    day = F.lit("2024-01-01").cast("date")
    return told(history.evaluate(SCENARIO, signals(history.spark, rows), day, F.lit("2024-01-01 12:00:00").cast("timestamp"), ["red"], **how))


def test_versions(spark, history):
    first = [(1, "a", "high"), (2, "b", "low"), (3, "c", "low")]
    assert go(history, first) == [(1, "red", "x", None, "baseline", None, False), (2, "blue", "y", None, "baseline", None, False)]
    assert go(history, first) == []  # nothing has changed
    later = [(2, "b", "low"), (2, "a", "medium"), (4, "a", "low"), (5, "b", "high"), (3, "c", "low")]
    assert go(history, later) == [
        (1, "none", "", "red", "recorded", None, True), (2, "blue,red", "x,y", "blue", "notified", "medium", False), (4, "red", "x", None, "notified", "low", False), (5, "blue", "y", None, "recorded", None, False),
    ]
    assert sorted((r.hash_id, ",".join(r.outcomes)) for r in history.current().collect()) == [(1, "none"), (2, "blue,red"), (4, "red"), (5, "blue")]
    assert sorted(r.evaluation for r in history.records().select("evaluation").collect()) == [1, 1, 3, 3, 3, 3]
    assert sorted((r.hash_id, r.change) for r in history.changes(2, 3).collect()) == [(1, "modified"), (2, "modified"), (4, "added"), (5, "added")]
    assert go(history, later) == [] and history.evaluations() == 4  # who has left stays as he is


def test_overflow_goes_by_priority(history):
    go(history, [])
    rows = [(i, "a", "high" if i == 9 else "medium" if i == 8 else "low") for i in range(1, 10)]
    got = {r[0]: r[4] for r in go(history, rows, cap=5)}
    assert {k for k, v in got.items() if v == "notified"} == {1, 2, 8, 9} and set(got.values()) == {"notified", "overflow"}


def test_as_many_as_may_be_told_all_are(history):
    go(history, [])
    assert {r[4] for r in go(history, [(i, "a", "low") for i in range(5)], cap=5)} == {"notified"}


def test_a_crash_before_the_commit_is_not_seen(history, monkeypatch):
    go(history, [(1, "a", "low")])

    def crash(*rows, **how):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(history._current, "upsert", crash)
        go(history, [(2, "a", "low")])
    assert history.evaluations() == 1 and [r.hash_id for r in history.records().collect()] == [1]
    assert go(history, [(3, "a", "low")]) == [(1, "none", "", "red", "recorded", None, True), (3, "red", "x", None, "notified", "low", False)]
    assert sorted(r.hash_id for r in history.records().where("evaluation = 2").collect()) == [1, 3]
