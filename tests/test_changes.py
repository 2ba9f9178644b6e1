"""Changes since a watermark, detectors side by side, keywords as ids: small cases by hand."""

import datetime

from docquarry.operators import changes, keywords

AT = lambda text: datetime.datetime.fromisoformat(text)


def marks(spark, *rows):
    return spark.createDataFrame([(r, v, AT(t)) for r, v, t in rows], "reader int, view string, last_seen_at timestamp")


def paths(spark):
    rows = [(i, i, f"f{i}", "t", 1, "s", "x", datetime.date(2024, 1, i)) for i in range(1, 5)]
    return spark.createDataFrame(rows, "path_id long, hash_id long, file_name string, file_type string, file_size long, source string, side string, file_date date")


def test_additions_of_the_day_show_again(spark):
    own = marks(spark, (1, "v", "2024-01-03 23:00:00"), (1, "v", "2024-01-02 00:00:00"), (1, "w", "2024-01-04 00:00:00"))
    got = lambda reader, view: [r.path_id for r in changes.added(paths(spark), own, reader, view).collect()]
    assert got(1, "v") == [4, 3] and got(1, "w") == [4] and got(2, "v") == [4, 3, 2, 1]


def test_every_revision_shows(spark):
    """Equal values too; what a revision doesn't name is null; at the watermark itself nothing."""
    log = [
        (1, 1, "modified", AT("2024-01-01 10:00:00"), '{"file_name": "a"}', '{"file_name": "a"}'), (2, 1, "modified", AT("2024-01-01 10:00:01"), "{}", '{"file_name": ""}'),
        (3, 2, "removed", AT("2024-01-02 10:00:00"), '{"file_name": "b"}', None), (4, 9, "modified", AT("2024-01-02 10:00:00"), "{}", "{}"), (5, 3, "modified", AT("2024-01-01 10:00:01"), None, "{}"),
    ]
    frame = spark.createDataFrame(log, "revision_id long, path_id long, change_kind string, changed_at timestamp, old_values string, new_values string")
    got = lambda kind, *m: [(r.revision_id, r.previous_value, r.current_value) for r in changes.revised(paths(spark), frame, kind, marks(spark, *m), 1, "v").collect()]
    assert got("modified", (2, "v", "2024-01-09 00:00:00")) == [(5, None, None), (2, None, ""), (1, "a", "a")]
    assert got("modified", (1, "v", "2024-01-01 10:00:00")) == [(5, None, None), (2, None, "")]
    assert got("removed", (1, "w", "2024-01-09 00:00:00")) == [(3, "b", None)]


def test_detectors(spark):
    runs = [
        (1, "a", "v2", "failed"), (1, "a", "v2", "complete"), (1, "b", "v1", "complete"), (2, "a", "v2", "failed"), (2, "a", "v1", "complete"), (3, "a", "v1", "failed"), (4, "a", "v2", "no_text"), (4, "b", "v1", "empty"),
        (9, "a", "v2", "complete"),
    ]
    frame = spark.createDataFrame(runs, "hash_id long, detector string, version string, status string")
    contents = spark.createDataFrame([(i,) for i in range(1, 6)], "hash_id long")
    versions = {"a": "v2", "b": "v1"}
    got = {r.detector: (r.contents, r.all_current, r.current, r.failed, r.stale, r.never) for r in changes.coverage(contents, frame, versions).collect()}
    assert got == {"a": (5, 2, 2, 1, 1, 1), "b": (5, 2, 2, 0, 0, 3)}
    assert [r.hash_id for r in changes.to_measure(contents, frame, versions, 1, 2).collect()] == [2, 3]
    none = {r.detector: r.never for r in changes.coverage(contents.limit(0), frame, versions).collect()}
    assert none == {"a": 0, "b": 0}


def test_keywords(spark):
    words = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "word string, word_id long")
    phrases = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c"]), (3, ["a", "zz"]), (4, [])], "keyword_id int, words array<string>")
    coded = keywords.encode(phrases, words)
    assert {r.keyword_id: r.word_ids for r in coded.collect()} == {1: [20, 10, 20], 2: [30], 3: [10, None]}
    stored = spark.createDataFrame([(1, [20, 10, 20]), (2, [30]), (3, [10, None]), (4, []), (5, None), (6, [99])], "keyword_id int, word_ids array<long>")
    assert {r.keyword_id: r.label for r in keywords.decode(stored, words).collect()} == {1: "b a b", 2: "c", 3: "a ?", 4: "", 5: "", 6: "?"}
    index = spark.createDataFrame([(1, i, t) for i, t in enumerate("b a b a b c".split())] + [(2, 0, "c")], "hash_id long, position int, token string")
    assert sorted(tuple(r) for r in keywords.hits(stored, words, index).select("keyword_id", "hash_id", "n").collect()) == [(1, 1, 2), (2, 1, 1), (2, 2, 1)]
