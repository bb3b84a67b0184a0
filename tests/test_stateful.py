"""State machines on streams equal the batch operators however the rows are cut into batches."""

import datetime as dt
import random
import time

import pytest

from tracemill.operators.accounting import session_usage
from tracemill.operators.facts import cross_session_recovery_links
from tracemill.streaming import streams

CLASSES = "struct<input_tokens: long, cached_input_tokens: long, cache_write_input_tokens: long, output_tokens: long, reasoning_output_tokens: long, total_tokens: long>"
RAW = f"session_id string, ordinal long, ts timestamp, model string, last {CLASSES}, cumulative {CLASSES}"
DAY = dt.datetime(2024, 1, 1)


def batches(spark, folder, cuts, schema):
    for part in cuts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)  # files are read in order of their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, tmp_path, mode):
    rows = []
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).outputMode(mode).foreachBatch(lambda d, e: rows.extend(d.collect())).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return rows


def raw_rows(seed):
    rng, rows = random.Random(seed), []
    for s in "ab":
        total = [0] * 6
        for i in range(1, 40):
            last = cumulative = None
            kind = rng.randrange(6)
            if kind < 3:
                a, c, o = rng.randrange(50), 0, rng.randrange(9)
                last = (a, min(a, 3), c, o, 0, a + o)
                total = [x + y for x, y in zip(total, last)]
                cumulative = tuple(total) if rng.random() < 0.8 else None
            elif kind == 3:
                last, cumulative = (0, 0, 0, 0, 0, 7), tuple(total) if rng.random() < 0.7 else (1,) * 6
            elif kind == 4:
                last = rng.choice([(5, 9, 0, 1, 0, 6), (5, 0, 0, 1, 0, 99), (-1, 0, 0, 1, 0, 0), (None, 0, 0, 1, 0, 1)])
            rows.append((s, i, DAY + dt.timedelta(minutes=i), rng.choice([None, "", " ", "m1", "m2"]), last, cumulative))
    return rows


@pytest.mark.parametrize("seed, held", [(1, 256), (2, 12)])
def test_usage_for_any_cut(spark, tmp_path, seed, held):
    rows = raw_rows(seed)
    want = session_usage(spark.createDataFrame(rows, RAW)).collect()
    rng = random.Random(seed)
    mixed = sorted(rows, key=lambda r: r[1] + rng.random() * 5)  # late by less than what is held
    cuts = [mixed[i : i + 13] for i in range(0, len(mixed), 13)]
    last = {}
    for r in run(streams.stream_session_usage(batches(spark, str(tmp_path / "rows"), cuts, RAW), held), tmp_path, "update"):
        last[r.session_id, r.model] = r
    names = [f.split(":")[0].strip() for f in CLASSES[7:-1].split(",")]
    assert {k: tuple(r[c] for c in names) for k, r in last.items() if r.total_tokens} == {(r.session_id, r.model): tuple(r[c] for c in names) for r in want if r.total_tokens}
    for s in "ab":
        assert {r.heartbeats for k, r in last.items() if k[0] == s} == {sum(r.heartbeats for r in want if r.session_id == s)}
        assert {r.invalid_rows for k, r in last.items() if k[0] == s} == {sum(r.invalid_rows for r in want if r.session_id == s)}
        assert {(r.late, r.late_tokens) for k, r in last.items() if k[0] == s} == {(0, 0)}


def test_too_late_rows_are_reported(spark, tmp_path):
    use = lambda i, n: ("s", i, DAY, "m", (n, 0, 0, 0, 0, n), None)
    cuts = [[use(i, 1) for i in range(10, 20)], [use(1, 500), use(15, 1), use(30, 2)]]
    got = run(streams.stream_session_usage(batches(spark, str(tmp_path / "rows"), cuts, RAW), held=4), tmp_path, "update")
    assert (got[-1].total_tokens, got[-1].late, got[-1].late_tokens) == (12, 2, 501)


LINKS = "project_id string, provider string, session_id string, kind string, operation string, component string, sequence long, ts timestamp, revision_id string, outcome string"


@pytest.mark.parametrize("seed", [1, 2])
def test_links_for_any_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("pq"), "a", f"s{rng.randrange(3)}", "verification", "run", rng.choice("xy"), i, DAY + dt.timedelta(minutes=i // 2), f"r{i:03}", rng.choice(["failed", "passed", "error", ""])) for i in range(120)]
    want = {(r.revision_id, r.recovered_by) for r in cross_session_recovery_links(spark.createDataFrame(rows, LINKS)).collect()}
    mixed = sorted(rows, key=lambda r: (r[7] - DAY).total_seconds() + rng.random() * 300)
    cuts = [mixed[i : i + 25] for i in range(0, len(mixed), 25)]
    found = []
    stream = streams.stream_recovery_links(batches(spark, str(tmp_path / "rows"), cuts, LINKS), delay="10 minutes", idle_ms=1500)
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda d, e: found.extend(d.collect())).start()
    until = time.time() + 60
    while time.time() < until and {(r.failure, r.recovered_by) for r in found} != want:
        time.sleep(0.5)  # the last rows are taken by the timer, without further input
    q.stop()
    assert {(r.failure, r.recovered_by) for r in found} == want != set() and {r.state for r in found} == {"linked"}


def test_late_and_dropped_failures_are_reported(spark, tmp_path):
    row = lambda i, o, s="s": ("p", "a", s, "v", "run", "x", i, DAY + dt.timedelta(minutes=i), f"r{i}", o)
    cuts = [[row(1, "failed"), row(2, "failed"), row(5, "failed")], [row(3, "failed"), row(9, "passed", "t")]]
    got = run(streams.stream_recovery_links(batches(spark, str(tmp_path / "rows"), cuts, LINKS), max_open=2), tmp_path, "append")
    assert {(r.failure, r.recovered_by, r.state) for r in got} == {("r1", None, "unlinked"), ("r3", None, "late"), ("r2", "r9", "linked"), ("r5", "r9", "linked")}


def test_debounce_fires_without_a_further_event(spark, tmp_path):
    now = dt.datetime.now()
    at = lambda ms: now + dt.timedelta(milliseconds=ms)
    rows = [("e", "own", at(-100), True), ("e", "a", at(0), False), ("e", "own", at(100), False), ("e", "b", at(500), False), ("f", "c", at(0), False), ("g", "own2", at(0), True), ("g", "own2", at(10), False)]
    stream = batches(spark, str(tmp_path / "rows"), [rows[:3], rows[3:]], "entity string, hash string, ts timestamp, written boolean")
    found = []
    q = streams.debounce(stream, gap="1500 milliseconds").writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda d, e: found.extend(d.collect())).start()
    until = time.time() + 60
    while time.time() < until and len(found) < 2:
        time.sleep(0.3)
    time.sleep(2)
    q.stop()
    assert sorted((r.entity, r.hash, r.events) for r in found) == [("e", "b", 2), ("f", "c", 1)]
    assert all((r.ready_at - r.last_at) >= dt.timedelta(milliseconds=1499) for r in found)
