"""Versions of a table: crashes, races, upserts, clean-up."""

import pytest
from pyspark.sql import functions as F

from docquarry.sources.snapshots import ConflictError, Snapshots


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    made = Snapshots(spark, str(tmp_path / "t"))
    made.replace(spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")), ["k"], buckets=8)
    return made


def test_versions_stay_readable(spark, table):
    assert table.read().count() == 1000 and table.versions() == [1]
    table.upsert(spark.createDataFrame([(5, 100), (2000, 1)], "k long, v long"), spark.createDataFrame([(7,), (9999,)], "k long"))
    assert table.read().count() == 1000 and table.read(1).count() == 1000
    assert rows(table.read().where("k in (5, 7, 2000)")) == [(2000, 1), (5, 100)] and rows(table.read(1).where("k in (5, 7, 2000)")) == [(5, 5), (7, 0)]
    assert rows(table.changes(1, 2)) == [(2000, 1, "added"), (5, 100, "modified"), (7, 0, "removed")]


def test_only_touched_buckets_are_written(spark, table):
    before = table.manifest().folders
    after = table.upsert(spark.createDataFrame([(5, 100)], "k long, v long")).folders
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    assert table.upsert(spark.createDataFrame([], "k long, v long")).version == 2  # nothing to do: no version


def test_a_crash_before_the_commit_changes_nothing(spark, table, monkeypatch):
    def crash(manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(table, "_commit", crash)
        table.upsert(spark.createDataFrame([(5, 100)], "k long, v long"))
    again = Snapshots(spark, table.path)  # as another application would see it
    assert again.versions() == [1] and rows(again.read().where("k = 5")) == [(5, 5)]
    assert again.vacuum() == []  # the folder may belong to a writer that is still at work
    dropped = again.vacuum(unfinished_ms=0)
    assert len(dropped) == 1 and again.read().count() == 1000


def test_a_crash_between_draft_and_rename_changes_nothing(spark, table):
    table._fs.create(table._path("versions", "draft-x"), False).close()
    assert table.versions() == [1] and table.read().count() == 1000


def test_the_second_writer_of_a_version_fails(spark, table, monkeypatch):
    other, old = Snapshots(spark, table.path), table.manifest()
    table.upsert(spark.createDataFrame([(1, 1)], "k long, v long"))
    monkeypatch.setattr(other, "manifest", lambda version=None: old)
    with pytest.raises(ConflictError):
        other.upsert(spark.createDataFrame([(2, 2)], "k long, v long"))
    assert table.versions() == [1, 2] and rows(table.read().where("k = 2")) == [(2, 2)]


def test_orphans_compaction_and_vacuum(spark, table):
    table.remove_orphans(spark.range(10).select(F.col("id").alias("k")), ["k"])
    assert table.read().count() == 10
    table.compact()
    assert rows(table.read()) == [(i, i % 7) for i in range(10)] and table.manifest().version == 3
    assert table.vacuum(keep=1, unfinished_ms=0) and table.versions() == [3] and table.read().count() == 10


def test_null_keys_and_empty_tables(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "n"))
    assert table.read() is None and table.manifest() is None
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(1, "a")], "k long, v string"))
    table.replace(spark.createDataFrame([], "k long, v string"), ["k"])
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(None, "a"), (1, None)], "k long, v string"))
    table.upsert(spark.createDataFrame([(None, "b")], "k long, v string"))
    assert rows(table.read()) == [(1, None), (None, "b")] and rows(table.changes(2, 3)) == [(None, "b", "modified")] and rows(table.changes(3, 3)) == []
