import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators.accounting import session_usage
from tracemill.sources import catalog, generations, transcripts


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def a_line(kind, payload, ts="2024-01-01T00:00:00Z"):
    return json.dumps({"timestamp": ts, "type": kind, "payload": payload})


def test_lines(spark, tmp_path):
    write(tmp_path / "x.jsonl", "aé\r\n\n  b \nc\n")
    got = transcripts.read_session_lines(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.byte_offset, r.line) for r in got] == [(1, 0, "aé"), (3, 6, "  b "), (4, 11, "c")]
    assert got[1].source_hash == hashlib.sha256(b"b").hexdigest()
    b = transcripts.frozen_boundary(transcripts.read_session_lines(spark, str(tmp_path))).first()
    assert (b.lines, b.last_offset) == (4, 11)


def test_lines_of_splits(spark, tmp_path):
    texts = {"a.jsonl": "".join(f"{'é' * (i % 7)}{i}\n" + "\n" * (i % 3 == 0) for i in range(3000)), "b.jsonl": "one\r\n\ntwo", "c.jsonl": ""}
    for name, text in texts.items():
        write(tmp_path / name, text)
    want = set()
    for name, text in texts.items():
        at = 0
        for i, line in enumerate(text.encode().split(b"\n")):
            if line.strip():
                want.add((name, i + 1, at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        split = transcripts.read_session_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.read.text(str(tmp_path), wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    for rows in (split, transcripts.lines_of(whole).collect()):
        got = [(r.file.rsplit("/", 1)[1], r.ordinal, r.byte_offset, r.line) for r in rows]
        assert len(got) == len(want) and set(got) == want


def test_provider_a(spark, tmp_path):
    usage = {"input_tokens": 10, "cached_input_tokens": 0, "cache_write_input_tokens": 0, "output_tokens": 5, "reasoning_output_tokens": 0, "total_tokens": 15}
    lines = [
        a_line("session_meta", {"id": "s1", "cwd": "/w"}), a_line("turn_context", {"model": "m"}), a_line("response_item", {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}),
        "not json", a_line("response_item", {"type": "reasoning"}), a_line("response_item", {"type": "function_call", "call_id": "c", "name": "shell", "arguments": "{}"}), a_line("response_item", {"type": "function_call_output", "call_id": "c", "output": "ok"}),
        a_line("event_msg", {"type": "token_count", "info": {"last_token_usage": usage, "total_token_usage": usage}}), a_line("mystery", {}),
    ]
    write(tmp_path / "a.jsonl", "\n".join(lines) + "\n")
    write(tmp_path / "bad.jsonl", "{}\n")
    all_lines = transcripts.read_session_lines(spark, str(tmp_path))
    good, bad = transcripts.split_malformed(all_lines, max_bytes=10_000)
    assert [(r.ordinal, r.reason) for r in bad.collect()] == [(4, "not_json")]
    got = [r.kind for r in transcripts.decode_a(good).where("file like '%/a.jsonl'").orderBy("ordinal").collect()]
    assert got == ["session_meta", "turn_context", "message", "tool_call", "tool_output", "usage", "unsupported"]
    found, issues = transcripts.discover_sessions(good)
    assert [(r.session_id, r.cwd, r.n_lines) for r in found.collect()] == [("s1", "/w", 9)] and [r.issue for r in issues.collect()] == ["no_session_meta"]
    used = session_usage(transcripts.decode_a(good).withColumn("session_id", F.lit("s1"))).collect()
    assert [(r.model, r.total_tokens) for r in used] == [("m", 15)]
    union, missing = transcripts.union_providers(spark, {"a": transcripts.decode_a(good), "b": None})
    assert union.select("provider").distinct().count() == 1 and [r.provider for r in missing.collect()] == ["b"]


def test_segments(spark):
    lines = spark.createDataFrame([("f1", 1, "a"), ("f1", 3, "b"), ("f2", 1, "c"), ("f3", 1, "d"), ("f4", 1, "e")], "file string, ordinal long, line string")
    day = lambda n: dt.datetime(2024, 1, n)
    seg = spark.createDataFrame([("f1", "s", "p", day(1), 3), ("f2", "s", "p", day(2), 1), ("f3", "t", "p", day(1), 1), ("f4", "t", "p", day(1), 1)], "file string, session_id string, project_id string, started_at timestamp, n_lines long")
    rows, bad = transcripts.concat_segments(lines, seg)
    assert [(r.session_id, r.ordinal, r.line) for r in rows.orderBy("ordinal").collect()] == [("s", 1, "a"), ("s", 3, "b"), ("s", 4, "c")]
    assert {(r.file, r.reason) for r in bad.collect()} == {("f3", "equal_start"), ("f4", "equal_start")}


def test_provider_b(spark):
    b = lambda kind, session, content, ts="2024-01-01T00:00:00Z", **m: json.dumps({"type": kind, "sessionId": session, "timestamp": ts, "message": {"role": kind, "content": content, **m}})
    rows = [("s", 1, json.dumps({"type": "summary"})), ("s", 2, b("user", "s", "hello")), ("s", 3, b("assistant", "s", json.dumps([{"type": "text", "text": "x"}, {"type": "tool_use", "id": "t", "name": "n"}]), id="m1", usage={"input_tokens": 1, "output_tokens": 2})), ("s", 4, b("user", "other", "q")), ("s", 5, b("user", "s", "q", ts="bad")), ("s", 6, json.dumps({"type": "weird"}))]
    got = transcripts.decode_b(spark.createDataFrame(rows, "session_id string, ordinal long, line string")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.diagnostic, r.session_started) for r in got] == [(2, None, True), (3, None, False), (4, "session_mismatch", False), (5, "bad_timestamp", False), (6, "unsupported", False)]
    assert got[0].content[0].text == "hello" and got[1].content[0].text == "x" and got[1].tool_uses[0].name == "n" and got[1].usage.output_tokens == 2


def test_provider_c(spark):
    session = spark.createDataFrame([("s", "/d", 0)], "id string, directory string, time_created long")
    m = lambda i, role, at, done=None: (i, "s", at, json.dumps({"role": role, "modelID": "m", "time": {"created": at, "completed": done}}))
    message = spark.createDataFrame([m("1", "user", 1), m("2", "assistant", 2, 3), m("3", "user", 4), m("4", "assistant", 5, 6), m("5", "user", 7), m("6", "assistant", 8, 9)], "id string, session_id string, time_created long, data string")
    part = spark.createDataFrame([("p1", "1", "s", json.dumps({"type": "text", "text": "q"})), ("p2", "4", "s", json.dumps({"type": "tool", "state": {"status": "running"}}))], "id string, message_id string, session_id string, data string")
    got = transcripts.decode_c(session, message, part).orderBy("ordinal").collect()
    assert [(r.message_id, r.role) for r in got] == [("1", "user"), ("2", "assistant")] and got[0].content[0].text == "q"


def test_catalog(spark, tmp_path):
    one = {"id": "l", "provider": "p", "model": "m", "input_per_mtok": 1.0, "output_per_mtok": None, "promo": True, "status": "active"}
    past = {"l": {"model": "m", "provider": "p", "history": [{"date": "2024-01-01", "input_per_mtok": -1.0, "event": "initial"}]}, "z": {"model": "m", "provider": "p", "history": [{"date": "2024-01-01", "event": "initial"}]}}
    rows, history, bad = catalog.read_price_catalog(spark, write(tmp_path / "m.json", json.dumps([one])), write(tmp_path / "h.json", json.dumps(past)))
    assert rows.first().output_per_mtok is None and history.count() == 2
    assert {(r.listing_id, r.violation) for r in bad.collect()} == {("l", "promo_without_end"), ("l", "negative_rate"), ("z", "history_without_listing")}


def test_generations(spark, tmp_path):
    frame = lambda v: spark.createDataFrame([("p", "a", v), ("p", "b", 1), ("q", "c", 1)], "project_id string, k string, v int")
    table = str(tmp_path / "t")
    assert generations.write_generation(frame(1), table, "g1").count() == 2
    assert generations.write_generation(frame(1).repartition(3), table, "g2").count() == 0
    assert [r.project_id for r in generations.write_generation(frame(2), table, "g3").collect()] == ["p"]
    now = {(r.project_id, r.k, r.v, r.generation_id) for r in generations.read_generation(spark, table).collect()}
    assert now == {("p", "a", 2, "g3"), ("p", "b", 1, "g3"), ("q", "c", 1, "g1")}
    assert {r.v for r in generations.read_generation(spark, table, "p", "g1").collect()} == {1}
    # as if a run had ended after its data and before its log: the next one writes over it
    frame(7).withColumn("generation_id", F.lit("g4")).write.mode("append").partitionBy("project_id", "generation_id").parquet(table + "/data")
    assert [r.project_id for r in generations.write_generation(frame(3), table, "g4").collect()] == ["p"]
    assert generations.write_generation(frame(3), table, "g4").count() == 0
    assert sorted((r.k, r.v) for r in generations.read_generation(spark, table, "p").collect()) == [("a", 3), ("b", 1)]
    with pytest.raises(ValueError, match="other content"):
        generations.write_generation(frame(4), table, "g4")
    a, b = (generations.report_json(frame(1).select(*c)).first() for c in (("k", "v"), ("v", "k")))
    assert a == b and json.loads(a.json)["zz_digest"] == a.digest
