from docquarry.streaming.monitoring import Rule, changes, evaluate, ledger_stream, windowed_counts

SCHEMA = "signal_id long, hash_id long, signal_type string, date_from date, confidence string"


def _signals(spark, rows):
    return spark.createDataFrame(rows, "signal_id long, hash_id long, signal_type string, confidence string").selectExpr("signal_id", "hash_id", "signal_type", "DATE'2024-01-02' AS date_from", "confidence")


def test_ledger_takes_each_subject_once(spark):
    rule = Rule(("a",), "medium")
    first = evaluate(rule, _signals(spark, [(1, 1, "a", "low"), (2, 1, "a", "high"), (3, 2, "b", "high")]), None)
    assert [(r.hash_id, r.signal_id, r.state) for r in first.collect()] == [(1, 2, "baseline")]
    later = evaluate(rule, _signals(spark, [(4, 1, "a", "high"), (5, 3, "a", "medium")]), first)
    assert [(r.hash_id, r.state) for r in later.collect()] == [(3, "pending")]


def test_changes(spark):
    s = "hash_id long, outcomes string"
    got = changes(spark.createDataFrame([(1, "x"), (2, "y")], s), spark.createDataFrame([(1, "x"), (3, "z")], s))
    assert sorted((r.hash_id, r.previous, r.outcomes) for r in got.collect()) == [(2, "y", "none"), (3, None, "z")]


def test_streams(spark, tmp_path):
    source, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    _signals(spark, [(1, 1, "a", "high"), (2, 1, "a", "high")]).write.parquet(source)
    stream = lambda: ledger_stream(Rule(("a",)), spark.readStream.schema(SCHEMA).parquet(source), ledger, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    stream()
    _signals(spark, [(3, 1, "a", "high"), (4, 2, "a", "high")]).write.mode("append").parquet(source)
    stream()
    assert sorted((r.hash_id, r.state) for r in spark.read.parquet(ledger).collect()) == [(1, "baseline"), (2, "pending")]
    ledger_stream(Rule(("a",)), spark.readStream.schema(SCHEMA).parquet(source), ledger, str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
    again = sorted((r.hash_id, r.state) for r in spark.read.parquet(ledger).where("batch = 0").collect())
    assert again == [(1, "baseline"), (2, "baseline")]  # all that is there now comes in one first batch
    events = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "event_type string, value double").selectExpr("TIMESTAMP'2024-01-01 00:10:00' AS ts", "*")
    events.write.parquet(str(tmp_path / "ev"))
    counted = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    counted.writeStream.format("memory").queryName("docquarry_w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [r["n"] for r in spark.table("docquarry_w").collect()] == [2]
