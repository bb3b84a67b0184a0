"""Orders, paths, containment and sketches against plain restatements on random input."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions.scalars import normalize_identity
from tracemill.operators import problems, projects, scans
from tracemill.operators.graphs import connected_components
from tracemill.sources import transcripts


def heap_order(waits):
    waits, out = {d: set(s) for d, s in waits.items()}, {}
    free = [d for d, s in waits.items() if not s]
    heapq.heapify(free)
    while free:
        d = heapq.heappop(free)
        out[d] = len(out)
        for e, s in waits.items():
            if d in s:
                s.discard(d)
                if not s:
                    heapq.heappush(free, e)
    return out


def test_supersession_equals_heap(spark):
    rng = random.Random(9)
    projects_, rows = {}, []
    for p in ("p", "q", None, "r"):
        ids = [f"d{i:03}" for i in rng.sample(range(999), 60)]
        chance = {"p": 0.02, "q": 0.05, None: 0.0, "r": 0.015}[p]
        waits = {d: [e for e in ids if e != d and rng.random() < chance] for d in ids}
        waits[ids[0]] = [ids[0]]
        waits[ids[1]] = ["missing"]
        projects_[p] = waits
        rows += [(p, d, s or rng.choice([None, []])) for d, s in waits.items()]
    rows.append(rows[2])  # a repeated row
    df = spark.createDataFrame(rows, "project_id string, decision_id string, supersedes array<string>").repartition(5)
    want = {p: heap_order(w) for p, w in projects_.items()}
    got = problems.order_by_supersession(df).collect()
    assert len(got) == len(rows)
    assert all(r.position == want[r.project_id].get(r.decision_id) for r in got)
    assert sum(r.position is None for r in got) > 8


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1200)]
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in least.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_paths_of_a_chain_of_a_thousand(spark):
    rows = [("p", i, i - 1 if i else None) for i in range(1000)] + [("p", 2000, 2001), ("p", 2001, 2000), ("p", 2002, 2001), ("p", 2003, 3000), (None, 5, None), (None, 6, 5)]
    got = {(r.p, r.node): (r.depth, r.path) for r in problems.tree_paths(spark.createDataFrame(rows, "p string, node_id long, parent_id long"), ["p"]).collect()}
    assert len(got) == 1002
    assert got["p", "999"] == (999, [str(i) for i in range(1000)]) and got[None, "6"] == (1, ["5", "6"])


def test_chain_behind_a_missing_session_is_not_reached(spark):
    r = [("p", "a", None, "b"), ("p", "b", "a", None), ("p", "c", "gone", None), ("p", "d", "c", None), ("q", "x", "y", "y"), ("q", "y", "x", "x")]
    got = {x.project_id: (x.reached, x.valid) for x in problems.validate_session_chain(spark.createDataFrame(r, "project_id string, session_id string, previous_id string, next_id string")).collect()}
    assert got == {"p": (2, False), "q": (0, False)}


@pytest.mark.parametrize("size", [3, 6])
def test_contained_texts(spark, size):
    rng = random.Random(size)
    text = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    q = [(rng.choice(["p", "q", None]), i, text(rng.randrange(40))) for i in range(80)]
    n = [(rng.choice(["p", "q"]), f"n{i}", text(rng.randrange(9))) for i in range(60)] + [("p", "whole", q[0][2]), ("p", "none", None)]
    qs, ns = spark.createDataFrame(q, "project_id string, question_id long, q string"), spark.createDataFrame(n, "project_id string, node_id string, n string")
    got = {(r.question_id, r.node_id) for r in problems.contained_texts(qs, ns, size=size).collect()}
    assert got == {(i, k) for p, i, t in q for o, k, u in n if p == o and u and u in t} != set()


def test_few_candidates_are_compared(spark):
    """The rarest gram is the key: 400 questions of a template and 40 nodes that share its words meet in the questions that hold the node, not in all."""
    q = spark.createDataFrame([("p", i, f"please look at the failing test number {i:04} in the suite") for i in range(400)], "project_id string, question_id long, q string")
    n = spark.createDataFrame([("p", f"n{i}", f"failing test number {i:04}") for i in range(40)], "project_id string, node_id string, n string")
    plan = problems.contained_texts(q, n)
    assert {(r.question_id, r.node_id) for r in plan.collect()} == {(i, f"n{i}") for i in range(40)}
    held, wanted = problems._grams(q, ["question_id"], "q", 6), problems._grams(n, ["node_id"], "n", 6)
    many = held.groupBy("gram").count()
    rarest = wanted.join(many, "gram").groupBy("node_id").agg(F.min("count").alias("c")).agg(F.sum("c")).first()[0]
    assert rarest <= 3 * 40


@pytest.mark.parametrize("few", [0, 200_000])
def test_grams_are_not_broadcast(spark, few, monkeypatch):
    """The grams of all questions are never sent to the driver, whatever the planner takes for their size: only counted rows are."""
    monkeypatch.setattr(scans, "FEW", few)
    q = spark.createDataFrame([("p", i, f"text {i} of many words") for i in range(30)], "project_id string, question_id long, q string")
    n = spark.createDataFrame([("p", f"n{i}", f"text {i}") for i in range(9)] + [("p", "of", "of")], "project_id string, node_id string, n string")
    found = problems.contained_texts(problems.materialize(q), problems.materialize(n))
    plan = found._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in plan.split("BroadcastExchange")[1:] if "Generate explode" in x.split("FileScan")[0]]
    assert not sent
    assert ("Join [project_id" in plan) and found.count() == 30 + sum(1 for i in range(9) for k in range(30) if str(k).startswith(str(i)))


def test_placement_of_equal_texts(spark):
    """Nodes of one text count as several, equal questions are placed alike, and a node that repeats its id in another text counts once."""
    q = spark.createDataFrame([("p", 1, "say abc"), ("p", 2, "Say  abc"), ("p", 3, "xy"), ("r", 4, "say abc"), ("s", 5, "ab cdefgh")], "project_id string, question_id long, question string")
    n = spark.createDataFrame([("p", "a", 1, "abc"), ("p", "b", 2, "ABC"), ("p", "c", 9, "xy"), ("p", "d", 3, "XY"), ("r", "e", 1, "abc"), ("s", "f", 1, "ab"), ("s", "f", 1, "cdefgh")], "project_id string, node_id string, node_order int, question string")
    got = {r.question_id: (r.action, r.target) for r in problems.recommend_placement(q, n).collect()}
    assert got == {1: ("keep_pending", None), 2: ("keep_pending", None), 3: ("merge", "d"), 4: ("child", "e"), 5: ("child", "f")}


def test_long_texts_give_all_grams(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(200))
    for size in (1, 6):
        for n in (size, 63, 64, 65, 64 + size - 1, 64 + size, 200):
            d = spark.createDataFrame([(1, text[:n])], "i int, t string")
            assert {r.gram for r in problems._grams(d, ["i"], "t", size).collect()} == {text[k : k + size] for k in range(n - size + 1)}


def test_sketch_bounds(spark):
    rng = random.Random(5)
    rows = [("p", f"m{int(rng.paretovariate(0.7)) % 3000}") for _ in range(20_000)] + [("q", f"m{i % 7}") for i in range(100)] + [("p", None)]
    df = spark.createDataFrame(rows, "project_id string, path string").repartition(6)
    true = {(r.project_id, r.path): r["count"] for r in df.groupBy("project_id", "path").count().collect()}
    parts = projects.module_sketches(df.withColumn("part", F.spark_partition_id()), ["project_id", "part"], tracked=256)
    merged = projects.sketched_modules(projects.merge_sketches(parts, tracked=256), 50).collect()
    alone = projects.hot_modules_approx(df, 50, tracked=256).collect()
    for got in (merged, alone):
        assert {r.project_id for r in got} == {"p", "q"} and any(r.error for r in got)
        assert all(r.estimate - r.error <= true[r.project_id, r.path] <= r.estimate for r in got)
        assert ("p", "m1") in {(r.project_id, r.path) for r in got}


def test_boundary_of_parts(spark):
    rng = random.Random(3)
    lines = spark.createDataFrame([("f", i, 10 * i, f"{rng.getrandbits(256):064x}") for i in range(1, 90)] + [("g", 1, 0, "00" * 32)], "file string, ordinal long, byte_offset long, source_hash string")
    whole = {r.file: tuple(r) for r in transcripts.frozen_boundary(lines).collect()}
    for cut in (2, 7):
        parts = transcripts.boundary_parts(lines.withColumn("part", F.floor(F.col("ordinal") / cut)), ("file", "part"))
        assert {r.file: tuple(r) for r in transcripts.merge_boundaries(parts).collect()} == whole
    assert whole["f"][1:3] == (89, 890)
    swapped = lines.withColumn("ordinal", F.when(F.col("ordinal") == 3, 4).when(F.col("ordinal") == 4, 3).otherwise(F.col("ordinal")))
    assert transcripts.frozen_boundary(swapped).where("file = 'f'").first().prefix_hash != whole["f"][3]
    assert transcripts.frozen_boundary(lines, F.lit(40)).where("file = 'f'").first().lines == 40


def test_normalized_placement_ignores_null_projects(spark):
    q = spark.createDataFrame([(None, 1, "Why X now"), ("p", 2, "why x now")], "project_id string, question_id long, question string")
    n = spark.createDataFrame([("p", "n", 1, " why  X "), (None, "m", 1, "why")], "project_id string, node_id string, node_order int, question string")
    got = {r.question_id: (r.action, r.target) for r in problems.recommend_placement(q, n).collect()}
    assert got == {1: ("keep_pending", None), 2: ("child", "n")}
    assert n.where(normalize_identity("question") == "why x").count() == 1


def test_grams_of_questions_are_not_shuffled(spark, monkeypatch):
    """However many the nodes are, of the grams of all questions only those pass to a shuffle that a node may want."""
    monkeypatch.setattr(scans, "FEW", 0)
    rng, context = random.Random(8), spark.sparkContext
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    asked = [("p", i, text(1500)) for i in range(100)]
    q = problems.materialize(spark.createDataFrame(asked, "project_id string, question_id long, q string"))
    n = problems.materialize(spark.createDataFrame([("p", f"n{i}", asked[i][2][40:60]) for i in range(30)], "project_id string, node_id string, n string"))

    def shuffled():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    assert {(r.question_id, r.node_id) for r in problems.contained_texts(q, n).collect()} == {(i, f"n{i}") for i in range(30)}
    assert shuffled() - before < 20_000 < problems._grams(q, ["question_id"], "q", 6).count() / 5
