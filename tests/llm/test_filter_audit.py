import random
from itertools import permutations

from tracemill.llm import filter_audit as fa


def by_hand(docs, labels):
    """docs: (id, text, source); labels: id -> (quality, toxic)."""
    import re

    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append((s or "", f, labels.get(i, (0, 0))))
    out = set()
    for part in {p for p, *_ in fails}:
        mine = [(f, l) for p, f, l in fails if p == part]
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order, 1):
                gone, stay = [d for d in left if d[0][x]], [d for d in left if not d[0][x]]
                failing = sum(d[0][x] for d in mine)
                only = sum(d[0][x] and sum(d[0].values()) == 1 for d in mine)
                total[x] += len(gone)
                rows.append((x, (part, "".join(order), k, len(stay), len(gone), failing - len(gone), only, sum(l[0] == 1 for _, l in gone), sum(l[1] == 1 for _, l in gone))))
                left = stay
        out |= {(*r, total[x]) for x, r in rows}
    return out


def texts():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)] + ["BIG", "a#b", "c|", "É", "\xa0x"]
    made = [rng.choice([" ", "\n", "\t "]).join(rng.choices(words[: rng.choice([3, 45])], k=rng.choice([0, 5, 49, 50, 51, 80]))) for _ in range(60)]
    return [None, "", "  ", "a" * 70000, " lead " + "x y " * 30] + made + rng.choices(made, k=40)


def test_same_as_by_hand(spark):
    rng = random.Random(3)
    docs = [(rng.choice([None, *range(80)]), t, rng.choice(["s1", "s2", None])) for t in texts()]
    docs += docs[:9]  # repeated rows
    labels = {i: (rng.randrange(2), rng.randrange(2)) for i in range(0, 80, 2)}
    table = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in docs], "doc_id long, text string, source string, mask int, good int").repartition(5)
    said = [(i, *v) for i, v in labels.items()] + [(None, 1, 1), (4, 0, 0), (200, 1, 1)]
    out = fa.audit_documents(table, spark.createDataFrame(said, "doc_id long, quality int, toxic int").repartition(2)).collect()
    assert len(out) == 3 * 600 and {tuple(r) for r in out} == by_hand(docs, labels)


def test_empty_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit_documents(spark.createDataFrame([], "doc_id long, text string, source string"), none).collect() == []
    one = fa.audit_documents(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"), none).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1}


def test_swaps_visit_all_orders_and_keep_the_function():
    rng = random.Random(1)
    for n in (1, 2, 4, 5):
        weights = {m: (rng.randrange(5), rng.randrange(2), 0) for m in range(1 << n) if rng.random() < 0.7}
        d, seen = fa.Diagram(weights, n), set()
        for level in [None, *fa.neighbour_swaps(n)]:
            if level is not None:
                d.swap(level)
            seen.add(tuple(d.order))
            for mask in range(1 << n):
                node = d.root
                for f in d.order:
                    node = d.child[node][mask >> f & 1]
                assert d.weight[node] == weights.get(mask, (0, 0, 0))
            assert d.weight[d.root][0] == sum(w[0] for w in weights.values())
        assert seen == set(permutations(range(n)))
    shared = fa.Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert [len(k) for k in shared.known] == [1, 1, 1, 1, 1, 1]  # equal subdiagrams are one
