from lexigrid.streaming.events import append_new, sessions, windowed_counts


def test_append_new_resumes_without_repeats(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:01:00"), (1, "2024-01-01 00:00:00")], "k long, t string").selectExpr("k", "cast(t as timestamp) as ts")
    rows.write.mode("append").parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        append_new(stream, "k", "1 hour", "ts", out, state).awaitTermination()
        rows.where("k = 2").write.mode("append").parquet(source)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]


def test_windows_and_sessions_on_a_table(spark):
    rows = spark.createDataFrame(
        [("a", 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 00:10:00"), ("b", 1, "2024-01-01 01:10:00")], "event_type string, user_id long, t string"
    ).selectExpr("event_type", "user_id", "cast(t as timestamp) as ts")
    assert sorted((r.event_type, r.n) for r in windowed_counts(rows, "1 hour").collect()) == [("a", 2), ("b", 1)]
    assert sorted(r.n for r in sessions(rows, "30 minutes").collect()) == [1, 2]
