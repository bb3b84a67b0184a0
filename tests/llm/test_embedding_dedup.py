import numpy as np
import pytest

from tracemill.llm.common import connected_components
from tracemill.llm.embedding_dedup import _keyed, clumps, near_vectors


def brute(rows, least=0.93):
    ok = [(i, l, np.array(v, float)) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = {i: i for i, *_ in rows if i is not None}
    links = {i: 0 for i in up}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for n, (i, l, x) in enumerate(ok):
        for j, m, y in ok[:n]:
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (links[i], root(i), root(i) == i) for i in up}


def test_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows) * 37 % 1009, (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.2])).tolist(), int(c % 3)))
    big = rng.normal(size=16)
    rows += [(2000 + k, (big + rng.normal(size=16) * 0.03).tolist(), 1) for k in range(700)] + [(3000 + k, (big * 2).tolist(), 1) for k in range(40)]
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 16, 1), (5003, [float("nan")] * 16, 1), (5004, [None] + [1.0] * 15, 1), (5005, big.tolist(), None), (5006, big.tolist()[:8], 1), (5007, big.tolist(), 2)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, cid string").repartition(6)
    got = near_vectors(frame).collect()
    want = brute(rows)
    same = sum((r.n_links, r.component_id, r.kept) == want[r.vec_id] for r in got)
    assert len(got) == len(rows) and same == len(rows), (same, len(rows))


@pytest.mark.parametrize("block", [2048, 300])
def test_exact_in_a_large_label(spark, block):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    centre = unit(rng.normal(size=(2, 64)))
    base = unit(0.85 * centre[np.arange(4000) % 2] + np.sqrt(1 - 0.85**2) * unit(rng.normal(size=(4000, 64))))
    side = rng.normal(size=(600, 64))
    side = unit(side - (side * base[:600]).sum(1, keepdims=True) * base[:600])
    x = np.concatenate([base, 0.931 * base[:600] + np.sqrt(1 - 0.931**2) * side])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int"), block=block).collect()}
    links = unit(x) @ unit(x).T >= 0.93
    np.fill_diagonal(links, False)
    up = list(range(len(x)))
    for a, b in np.argwhere(np.triu(links)).tolist():
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    for i in range(len(x)):
        up[i] = up[up[i]]
    assert links.sum() >= 1200 and got == {i: (int(links[i].sum()), up[i], up[i] == i) for i in range(len(x))}


@pytest.mark.parametrize("passes, window, block", [(1, 1, 40), (3, 8, 150)])
def test_passes_never_change_the_result(spark, passes, window, block):
    """Crowded and empty regions, two lengths, labels above and below a block: the same rows whatever the passes find."""
    rng = np.random.default_rng(11)
    rows = []
    for c in range(40):
        base = rng.normal(size=12 if c % 5 else 20)
        rows += [(len(rows), (base + rng.normal(size=len(base)) * 0.05).tolist(), int(c % 2)) for _ in range(rng.integers(1, 4) if c % 8 else 120)]
    rows += [(len(rows) + k, rng.normal(size=12).tolist(), 7) for k in range(30)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), passes=passes, window=window, block=block).collect()}
    assert got == brute(rows)


def test_clumps_of_the_passes(spark):
    """Passes join only what links join, and find at least 95 of 100 pairs that stand alone."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 32))
    other = base + rng.normal(size=base.shape) * 0.05
    frame = spark.createDataFrame([(i, 1, x.tolist(), 1, 32) for i, x in enumerate(np.concatenate([base, other]))], "cid long, size long, embedding array<double>, label long, dim int")
    got = {r.id: r.component for r in clumps(_keyed(frame.select("label", "dim", "cid", "size", "embedding"), 4), 4, 32, 0.93, 3).collect()}
    assert all(i % 300 == c % 300 for i, c in got.items()) and len(got) >= 0.95 * 600


def test_nulls_and_empty(spark):
    frame = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect())
    assert [g for g in got if g[0] > 0] == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert near_vectors(frame.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [tuple(map(int, rng.integers(1000, 1300, 2))) for _ in range(250)] + [(1, 1), (None, 4), (7, 5), (5, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    root = lambda a: a if up.setdefault(a, a) == a else root(up[a])
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    assert got == {a: root(a) for a in list(up)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_extreme_magnitudes(spark):
    """Squares of the components neither overflow nor vanish."""
    rows = [(1, [1e200, 2e200], 0), (2, [1e200, 2.0001e200], 0), (3, [1e-200, 2e-200], 0), (4, [2e-200, -1e-200], 0), (5, [1.0, 2.0], 0), (6, [2.0, -1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (1, 4), 6: (1, 4)}
