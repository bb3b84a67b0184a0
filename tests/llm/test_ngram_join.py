import random
import re

import pytest

from tracemill.llm.ngram_join import ngram_components


def brute(rows, n, num, den):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [(d, grams(t)) for d, t in rows]
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("n,num,seed", [(4, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_brute_force(spark, n, num, seed):
    rng = random.Random(seed)
    fresh = lambda k: [f"W{rng.randrange(2000)}é" for _ in range(k)]
    passage = fresh(30)
    bases = [fresh(rng.choice([3, 4, 6, 20, 60, 150])) + rng.choice([[], passage]) for _ in range(30)]
    rows = []
    for _ in range(260):
        w = [*rng.choice(bases)]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = fresh(rng.randrange(2))
        rows.append((rng.randrange(10**6) * 300 + len(rows), rng.choice([" ", "\n"]).join(w)))
    long = fresh(200)
    rows += [(10**9 + i, " ".join([*long[:100], f"edit{i}", *long[100:]])) for i in range(60)]
    rows += [(5 * 10**8, None), (5 * 10**8 + 1, ""), (5 * 10**8 + 2, " \n"), (5 * 10**8 + 3, "ONE two"), (5 * 10**8 + 4, "one TWO"), (5 * 10**8 + 5, "x " * 4000)]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, key string").repartition(5)
    # the last case leaves almost everything to families of small blocks
    options = {"rounds": 1, "small": 2, "block": 7} if seed == 2 else {}
    got = sorted(tuple(r) for r in ngram_components(frame, n=n, num=num, **options).collect())
    assert got == brute(rows, n, num, 100)


def test_repeats_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "z"), (None, "a b c d e f"), (7, "A B c d e f")], "doc_id long, text string")
    got = ngram_components(frame).collect()
    assert len(got) == 5 and all(r.component_id == 1 for r in got)
    assert ngram_components(frame.limit(0)).count() == 0


def test_rows_without_ids_bridge(spark):
    """Two documents that are alike only through a row without an id are one component, in both parameters."""
    w = [f"w{i}" for i in range(200)]
    a, b, middle = w[:190] + ["x"] * 0, w[10:], w
    for num in (85, 90):
        rows = [(1, " ".join(a)), (9, " ".join(b)), (None, " ".join(middle)), (None, " ".join(middle)), (None, "quite another text without any partner"), (None, None), (7, "")]
        got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=4, num=num, den=100).collect()
        assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 1), (0, 1), (1, 1), (7, 7), (9, 1)]
    near = [(1, " ".join(w)), (None, " ".join(w[:198]))]
    got = ngram_components(spark.createDataFrame(near, "doc_id long, text string"), n=4, num=85, den=100).collect()
    assert [r.component_id for r in got] == [1, 1]
