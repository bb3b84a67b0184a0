import datetime as dt

from tracemill.operators.facts import cross_session_recovery_links
from tracemill.streaming import streams

DAY = dt.datetime(2024, 1, 1)


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def source(spark, tmp_path, rows, schema, parts=3):
    folder = str(tmp_path / "rows")
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] if parts > 1 else rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_dedupe(spark, tmp_path):
    rows = [(f"r{i % 5}", DAY + dt.timedelta(minutes=i)) for i in range(20)]
    got = run(streams.dedupe_revisions(source(spark, tmp_path, rows, "revision_id string, ts timestamp")), "dedupe", "append")
    assert sorted(r.revision_id for r in got.collect()) == [f"r{i}" for i in range(5)]


def test_session_usage(spark, tmp_path):
    schema = "session_id string, ordinal long, model string, input_tokens long, output_tokens long, total_tokens long, cumulative_total long"
    folder = str(tmp_path / "rows")
    batches = [[("s", 1, "m1", None, None, None, None), ("s", 2, None, 10, 5, 15, 15)], [("s", 3, None, None, None, 7, 15), ("s", 4, "m2", 1, 1, 2, 17)], [("s", 2, None, 10, 5, 15, 15), ("s", 5, None, 2, 2, 4, None)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    got = {r.model: (r.total_tokens, r.heartbeats, r.late) for r in run(streams.stream_session_usage(stream), "usage_now", "update").collect()}
    # one micro-batch: by ordinal, so the repeated row is late
    assert got == {"m1": (15, 1, 1), "m2": (6, 1, 1)}


def test_recovery_equals_batch(spark, tmp_path):
    schema = "project_id string, provider string, session_id string, kind string, operation string, component string, sequence long, ts timestamp, revision_id string, outcome string"
    rows = [("p", "a", f"s{i * 7 % 3}", "verification", "run", f"c{i % 2}", i, DAY + dt.timedelta(minutes=i), f"r{i}", ["failed", "passed", "error", "", "failed"][i * 3 % 5]) for i in range(40)]
    folder = str(tmp_path / "rows")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    got = run(streams.stream_recovery_links(spark.readStream.schema(schema).parquet(folder)), "links_now", "append")
    want = cross_session_recovery_links(spark.read.parquet(folder))
    assert {(r.failure, r.recovered_by) for r in got.collect()} == {(r.revision_id, r.recovered_by) for r in want.collect()} != set()


def test_pairs(spark, tmp_path):
    c = source(spark, tmp_path / "c", [("s", "a", DAY), ("s", "b", DAY), ("s", "z", DAY + dt.timedelta(days=2))], "session_id string, call_id string, call_ts timestamp", 1)
    o = source(spark, tmp_path / "o", [("s", "a", DAY + dt.timedelta(minutes=5), "x"), ("s", "b", DAY + dt.timedelta(hours=5), "late"), ("s", "q", DAY + dt.timedelta(days=3), "y")], "session_id string, call_id string, out_ts timestamp, output string", 1)
    got = {(r.call_id, r.output) for r in run(streams.stream_pairs(c, o), "pairs_now", "append").collect()}
    assert ("a", "x") in got and ("b", "late") not in got


def test_windows_and_debounce(spark, tmp_path):
    rows = spark.createDataFrame([("e", DAY + dt.timedelta(milliseconds=m), h) for m, h in ((0, "a"), (500, "b"), (1100, "c"), (5000, "d"))], "entity string, ts timestamp, hash string")
    got = streams.debounce(rows).orderBy("last_at").collect()
    assert [(r.hash, r.events) for r in got] == [("c", 3), ("d", 1)]
    assert [r.hash for r in streams.without_echo(streams.debounce(rows), spark.createDataFrame([("e", "c")], "entity string, hash string")).collect()] == ["d"]
    use = spark.createDataFrame([("m", DAY + dt.timedelta(hours=h), 5) for h in (1, 23, 25)], "model string, ts timestamp, total_tokens long")
    assert [r.total_tokens for r in streams.usage_by_window(use).orderBy("window_start").collect()] == [10, 5]
    assert sum(r.rows for r in streams.usage_by_window(use, slide="12 hours").collect()) == 6


def test_raw_records_and_batches(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text("{}\n\n{}\n")
    got = run(streams.stream_raw_records(spark, str(tmp_path / "logs")), "lines_now", "append")
    assert sorted(r.ordinal for r in got.collect()) == [1, 3]
    seen = {}
    handler = streams.for_each_relation(lambda: None, {"initial": lambda d: seen.update(initial=d.count()), "append": lambda d: seen.update(append=d.count())})
    handler(spark.createDataFrame([("a", "1", 5, "h", "u", "h")], "provider string, session_id string, lines long, prefix_hash string, usage_digest string, hash_at_previous string"), 0)
    assert seen == {"initial": 1}
    sink = streams.publish_batches(str(tmp_path / "gen"))
    frame = spark.createDataFrame([("p", 1)], "project_id string, v int")
    sink(frame, 0), sink(frame, 1)
    assert spark.read.parquet(str(tmp_path / "gen" / "_log")).count() == 1
