import random
import re

import pytest

from pyspark.sql import functions as F

from tracemill.llm.common import join_hot, only_wanted
from tracemill.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - length + 1):
            if d is not None:
                key = tuple(w[i : i + length])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [4, 7, 50])
def test_brute_force(spark, length):
    rng = random.Random(length)
    fresh = lambda n: [f"w{rng.randrange(10**6)}é" for _ in range(n)]
    common = [fresh(length * 3) for _ in range(4)]
    rows = []
    for d in range(80):
        w = fresh(rng.randrange(length * 2))
        for _ in range(rng.randrange(4)):
            p = rng.choice(common)
            a = rng.randrange(len(p) - 1)
            piece = p[a : a + rng.randrange(length * 2)]
            if rng.random() < 0.3 and piece:
                piece = [*piece]
                piece[rng.randrange(len(piece))] = "edit"
            w += piece + fresh(rng.randrange(3))
        rows.append((d * 7 % 80, rng.choice([" ", "\n", " x ", "  "]).join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (201, rows[3][1]), (201, rows[5][1]), (None, rows[3][1]), (202, None), (203, ""), (204, "a " * length * 5), (205, "a " * length)]
    got = remove_repeats(spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, text string, kept string, rid int").repartition(5), length=length).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute(rows, length)
    assert all(r.n_removed == sum(s.stop - s.start for s in r.spans) and all(s.stop - s.start >= length for s in r.spans) for r in got)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_join(spark):
    rows = spark.createDataFrame([(i % 1500 if i % 3 else 7, i) for i in range(6000)] + [(None, 9)], "k long, v long")
    small = rows.where("k % 2 = 1").groupBy("k").agg(F.min("v").alias("least"), F.count("*").alias("m"))
    got = sorted(map(tuple, join_hot(rows, small, ["k"]).collect()))
    assert got == sorted(map(tuple, rows.join(small.drop("m"), "k").collect())) and len(got) > 2000


def test_bitmap_loses_no_wanted_row(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(-500, 500)] + [(None, "n")], "k long, v string")
    wanted = rows.where("k % 7 = 3").select("k", F.lit(1).alias("w"))
    for bits in (6, 10, 24):
        passed = only_wanted(rows, wanted, "k", bits)
        assert passed.columns == rows.columns
        assert sorted(map(tuple, passed.join(wanted, "k").collect())) == sorted(map(tuple, rows.join(wanted, "k").collect()))
    assert passed.count() == wanted.count()
    assert only_wanted(rows, wanted.limit(0), "k").count() == 0
