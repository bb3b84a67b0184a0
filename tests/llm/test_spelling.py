import random
import re
import zlib
from collections import Counter

import pytest

from tracemill.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(counts):
    form, out = {}, []
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v)) if close else None
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out.append([w, form[w], None, n, len(close), counts[form[w]] if form[w] else None])
    for r in out:
        r[2] = r[0]
        while form[r[2]]:
            r[2] = form[r[2]]
    return {tuple(r) for r in out}


def counted(docs):
    out = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def tuples(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("seed, letters, sizes", [(1, "ab", (5, 8)), (2, "aé÷z", (5, 7)), (3, "abcdef", (5, 6))])
def test_same_as_by_hand(spark, seed, letters, sizes):
    rng = random.Random(seed)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))): rng.choice([3, 3, 4, 6, 8, 13, 50, 300]) for _ in range(350)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    out = spelling.variants(table)
    assert out.count() == len(counts)
    assert tuples(out) == by_hand(counts)


def test_documents(spark):
    rng = random.Random(7)
    words = ["Étaient", "Étaient", "etaient", "maison", "maisons", "Maison", "maisonx", "small", "smell", "aaaaaa", "aaaaa", "×product", "x" * 3000, "x" * 2999]
    docs = [(rng.choice([None, *range(40)]), " ".join(rng.choices(words, k=rng.randrange(60)))) for _ in range(120)] + [(1, None), (2, ""), (3, "12 Ā --")]
    docs += docs[:3]
    table = spark.createDataFrame([(i, t, "w", 3) for i, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    want = by_hand(counted(docs))
    assert len(want) > 12 and tuples(spelling.spelling_variants(table)) == want
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chains_of_forms(spark):
    counts = {"a" * k: 3 * 2 ** k for k in range(5, 40)}
    assert tuples(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == by_hand(counts)
