import hashlib
import random
import re

import pytest

from tracemill.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=13):
    out = {}
    its = [(i, words(t)) for i, t in items]
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for i, iw in its:
            size = min(n, len(iw))
            if not size:
                continue
            wins = {tuple(iw[a : a + size]) for a in range(len(iw) - size + 1)}
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in wins:
                    hit |= set(range(a, a + size))
                    names.add(str(i))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_brute_force(spark, limit):
    rng = random.Random(3)
    vocab = ["the", "Éa", "b1", "naïve", "漢字", "x", "yy", "Zed", "w9"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, text(rng.choice([5, 12, 13, 14, 40]))) for i in range(12)] + [(50, None), (51, ""), (52, " -- "), (11, "the b1 x")]
    docs = []
    for d in range(60):
        t = text(rng.randrange(60))
        if d % 3 == 0:
            ws = (items[rng.randrange(12)][1]).split(" ")
            t += " " + " ".join(ws[rng.randrange(3) :]).upper() + " " + text(20)
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, "the " * 3000)]
    got = decontaminate(
        spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, n_hit int").repartition(3),
        spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int"), broadcast_windows=limit,
    ).collect()
    # equal item ids count once, as names
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(docs, items)


@pytest.mark.parametrize("limit", [2_000_000, -1])
def test_empty(spark, limit):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate(docs, none, broadcast_windows=limit).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in rows] == [(3, 0, False)] * 2
    assert decontaminate(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id"), broadcast_windows=limit).count() == 0
