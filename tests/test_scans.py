"""Two-level scans: the same as one window over a group, with one group over many ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import facts, projects, scans


def frame(spark, n, groups, seed=0):
    rng = random.Random(seed)
    rows = [(rng.choice(groups), i, rng.choice([None, None, None, "a", "b", "c"]), rng.choice([None, 0, 1, 5, 9, 100])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, o long, v string, n long").repartition(5)


@pytest.mark.parametrize("groups", [["one"], ["a", "b", None], [f"g{i}" for i in range(60)]])
@pytest.mark.parametrize("later", [False, True])
def test_carried(spark, groups, later):
    df = frame(spark, 400, groups)
    w = Window.partitionBy("g").orderBy(F.desc("o") if later else F.asc("o")).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("x", F.last("v", ignorenulls=True).over(w))
    got = scans.carried(df, ["g"], ["o"], F.col("v"), "x", later, parts=13)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("groups", [["one"], ["a", None, "c"]])
def test_positioned(spark, groups):
    df = frame(spark, 300, groups)
    w = Window.partitionBy("g").orderBy("o")
    want = df.withColumn("position", F.row_number().over(w).cast("long") - 1).withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = scans.positioned(df, ["g"], ["o"], "n", parts=11)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def by_hand(sizes, max_items, max_bytes):
    pages, page, items, used = [], 0, 0, 0
    for s in sizes:
        s = s or 0
        if items and (items >= max_items or used + s > max_bytes):
            page, items, used = page + 1, 0, 0
        items, used = items + 1, used + s
        pages.append(page)
    return pages


@pytest.mark.parametrize("max_items, max_bytes, block", [(3, 12, 10), (1, 50, 7), (7, 3, 1), (50, 120, 20), (1000, 10**9, 100)])
def test_paged(spark, max_items, max_bytes, block):
    df = frame(spark, 400, ["big", "big", "big", "b", None], seed=max_items)
    got = {(r.g, r.o): r.page for r in scans.paged(df, ["g"], "o", "n", max_items, max_bytes, block, parts=9).collect()}
    rows = sorted(map(tuple, df.collect()), key=lambda r: r[1])
    for g in ("big", "b", None):
        mine = [r for r in rows if r[0] == g]
        assert [got[g, r[1]] for r in mine] == by_hand([r[3] for r in mine], max_items, max_bytes)
    assert len(got) == len(rows)


def test_one_session_of_a_million_rows(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), F.col("id").alias("o"), (F.pmod(F.xxhash64("id"), F.lit(300))).alias("n"))
    got = scans.paged(df, ["g"], "o", "n", 20, 2000, block=100_000, parts=16)
    sizes = [r.n for r in df.orderBy("o").collect()]
    want = by_hand(sizes, 20, 2000)
    assert [r.page for r in got.orderBy("o").select("page").collect()] == want


def test_project_scans_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [("p", "a", f"s{rng.randrange(9)}", rng.choice(["verification", "version"]), "run", rng.choice("xy"), i, i // 3 * 86400 * rng.choice([1, 1, 20]), f"r{i:04}", rng.choice(["failed", "passed", None]), {"version": rng.choice(["1", "2", ""])}) for i in range(300)]
    obs = spark.createDataFrame(rows, "project_id string, provider string, session_id string, kind string, operation string, component string, sequence long, t long, revision_id string, outcome string, fields map<string, string>")
    obs = obs.withColumn("ts", F.timestamp_seconds("t")).drop("t").repartition(7)
    order = sorted(obs.collect(), key=lambda r: (r.ts, r.provider, r.session_id, r.sequence))
    links, open_ = set(), {}
    for r in order:
        key = r.kind, r.component
        if r.outcome == "failed":
            open_.setdefault(key, []).append(r)
        elif r.outcome == "passed":
            links |= {(f.revision_id, r.revision_id) for f in open_.pop(key, []) if f.session_id != r.session_id}
    assert {(r.revision_id, r.recovered_by) for r in facts.cross_session_recovery_links(obs).collect()} == links != set()
    late = {b.revision_id for a, b in zip(order, order[1:]) if (b.ts - a.ts).total_seconds() > 720 * 3600}
    assert {r.revision_id for r in projects.gap_phases(obs).collect()} == late != set()
    seen, last = set(), None
    for r in order:
        if r.kind == "version" and r.fields["version"]:
            if r.fields["version"] != last:
                seen.add((r.revision_id, r.fields["version"], last))
            last = r.fields["version"]
    assert {(r.revision_id, r.value, r.previous_value) for r in projects.structural_phases(obs).collect()} == seen
