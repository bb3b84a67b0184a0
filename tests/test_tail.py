"""The tailing source: append, rewrite, shrink, unfinished lines, restart from the checkpoint, splits."""

import hashlib
import os
import time

import pytest

from tracemill.streaming.streams import stream_raw_records


class Tail:
    def __init__(self, spark, tmp_path, **options):
        self.spark, self.folder, self.state, self.options = spark, tmp_path / "logs", str(tmp_path / "state"), options
        self.folder.mkdir()
        self.batches = []

    def write(self, name, text, mode="a"):
        with open(self.folder / name, mode) as f:
            f.write(text)
        os.utime(self.folder / name, ns=(time.time_ns(), time.time_ns()))

    def start(self):
        """A query on the same checkpoint, as after a restart."""
        self.query = stream_raw_records(self.spark, str(self.folder), **self.options).writeStream.option("checkpointLocation", self.state).foreachBatch(self.take).start()

    def take(self, batch, epoch):
        self.batches.append([(os.path.basename(r.file), r.relation, r.ordinal, r.byte_offset, r.line, r.source_hash) for r in batch.collect()])

    def rows(self):
        self.query.processAllAvailable()
        got, self.batches = [r for b in self.batches for r in b], []
        return sorted(r[:5] for r in got)


@pytest.mark.parametrize("options", [{}, {"probe": "prefix", "splitBytes": "7"}])
def test_append_rewrite_shrink(spark, tmp_path, options):
    t = Tail(spark, tmp_path, **options)
    t.write("a.jsonl", '{"a":1}\n\n{"a":2}\n{"unfin')
    t.write("skipped.txt", "no\n")
    t.start()
    assert t.rows() == [("a.jsonl", "initial", 1, 0, '{"a":1}'), ("a.jsonl", "initial", 3, 9, '{"a":2}')]
    assert t.rows() == []
    t.write("a.jsonl", "ished\": é}\r\n")
    t.write("b.jsonl", "{}\n")
    assert t.rows() == [("a.jsonl", "append", 4, 17, '{"unfinished": é}'), ("b.jsonl", "initial", 1, 0, "{}")]
    t.write("a.jsonl", '{"a":9}\n', "w")  # shrunk
    assert t.rows() == [("a.jsonl", "replacement", 1, 0, '{"a":9}')]
    t.write("a.jsonl", '{"a":8}\n{"a":7}\n', "w")  # grown, but the consumed bytes changed
    assert t.rows() == [("a.jsonl", "replacement", 1, 0, '{"a":8}'), ("a.jsonl", "replacement", 2, 8, '{"a":7}')]
    t.write("b.jsonl", "", "w")
    assert t.rows() == []
    t.write("b.jsonl", "[]\n")
    assert t.rows() == [("b.jsonl", "initial", 1, 0, "[]")]
    t.query.stop()


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    t = Tail(spark, tmp_path)
    want, at = [], 0
    for round_ in range(4):
        t.start()
        for k in range(3):
            line = f"line {round_} {k} " + "x" * 300
            t.write("a.jsonl", line + "\n")
            want.append((len(want) + 1, at, line))
            at += len(line) + 1
            if k == 1:
                t.query.processAllAvailable()
        t.query.processAllAvailable()
        t.query.stop()
        t.write("a.jsonl", "between\n")  # while no query runs
        want.append((len(want) + 1, at, "between"))
        at += 8
    t.start()
    got = t.rows()
    t.query.stop()
    assert sorted(r[2:] for r in got) == want
    assert {r[1] for r in got} == {"initial", "append"}


def test_failed_batch_is_read_again(spark, tmp_path):
    t = Tail(spark, tmp_path)
    t.write("a.jsonl", "one\ntwo\n")
    take, t.take = t.take, lambda batch, epoch: 1 / 0
    t.start()
    with pytest.raises(Exception):
        t.query.processAllAvailable()
    t.write("a.jsonl", "three\n")
    t.take = take
    t.start()
    assert sorted(r[2:] for r in t.rows()) == [(1, 0, "one"), (2, 4, "two"), (3, 8, "three")]
    t.query.stop()


def test_splits_and_hashes(spark, tmp_path):
    lines = [("é" * (i % 5) + "y" * (i * 7 % 11)) for i in range(200)]
    for size in (16, 10_000):
        (tmp_path / str(size)).mkdir()
        t = Tail(spark, tmp_path / str(size), splitBytes=str(size))
        t.write("a.jsonl", "\n".join(lines) + "\n")
        t.start()
        t.query.processAllAvailable()
        t.query.stop()
        rows = sorted((r for b in t.batches for r in b), key=lambda r: r[2])
        assert [(r[2], r[4]) for r in rows] == [(i, x) for i, x in enumerate(lines, 1) if x]
        assert all(r[5] == hashlib.sha256(r[4].encode()).hexdigest() for r in rows)


def test_bad_option(spark, tmp_path):
    with pytest.raises(Exception):
        stream_raw_records(spark, str(tmp_path), probe="none").writeStream.format("noop").start().processAllAvailable()
