"""Kept tables: found again by later applications, built anew when their input changes."""

import os

from docquarry.sources import corpus, shared


def test_a_kept_table_outlives_its_application(spark, tmp_path):
    folder, built = str(tmp_path), []
    write = lambda n: spark.range(n).write.mode("overwrite").parquet(f"{folder}/documents.parquet")

    def table():
        return shared.kept(spark, folder, "numbers", lambda: (built.append(1), spark.range(5))[1])

    write(3)
    assert table().count() == 5 and table().count() == 5 and len(built) == 1
    shared._KEPT.clear()  # as another application starts
    assert table().count() == 5 and len(built) == 1
    write(4)
    shared.forget(folder)
    assert table().count() == 5 and len(built) == 2


def test_what_a_crash_leaves_is_not_read(spark, tmp_path, monkeypatch):
    folder, seen = str(tmp_path), []
    spark.range(3).write.parquet(f"{folder}/documents.parquet")

    def stopped(path, build):
        build().write.parquet(path)
        seen.append(path)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(shared, "_written", stopped)
        try:
            shared.kept(spark, folder, "numbers", lambda: spark.range(5))
        except KeyboardInterrupt:
            pass
    assert os.path.exists(seen[0].removeprefix("file:")) and shared.kept(spark, folder, "numbers", lambda: spark.range(7)).count() == 7


def test_word_counts_and_hot_words(spark, tmp_path):
    """A word of every content is cut over several files; counts are right for repeats and empty texts."""
    rows = [(i, f"hot {'b ' * (i % 3)} w{i}") for i in range(2000)] + [(5000, ""), (5001, None), (5002, "  ,")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS source", "'en' AS lang", "1L AS n_chars")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one file again
    words = corpus.words(spark, str(tmp_path))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.hash_id, r.word): r.n for r in words.where("hash_id < 6 and word <> 'hot'").collect()} == {(0, "w0"): 1, (1, "b"): 1, (1, "w1"): 1, (2, "b"): 2, (2, "w2"): 1, (3, "w3"): 1, (4, "b"): 1, (4, "w4"): 1, (5, "b"): 2, (5, "w5"): 1}
    files = words.where("word = 'hot'").selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 2000
