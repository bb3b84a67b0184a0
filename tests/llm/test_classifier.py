import random

import numpy as np

from tracemill.llm import classifier


def test_subwords_cover_each_ngram_once():
    buckets, owner, hashes = classifier.subwords(["ab", "", "漢字漢字", "ab"])
    # the word, and 3- to 5-grams of <ab>, <>, <漢字漢字>
    assert [int((owner == i).sum()) for i in range(4)] == [1 + 2 + 1, 1, 1 + 4 + 3 + 2, 1 + 2 + 1]
    assert hashes[0] == hashes[3] != hashes[1] and sorted(buckets[owner == 0]) == sorted(buckets[owner == 3])
    assert len(classifier.features(None)[0]) == 0


def test_held_out_accuracy_and_scorer(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 80)))
    junk = lambda: " ".join(rng.choice(words) + rng.choice(["###", "$$$", ""]) for _ in range(rng.randrange(5, 80)))
    said = lambda: " ".join((rng.choice(words) + " ") * rng.randrange(4, 30) for _ in range(3))
    rows = [(i, rng.choice([junk, said])() if i % 5 == 0 else good(), int(i % 5 != 0), 9.0) for i in range(600)]
    rows += [(1000, None, 1, 0.0), (1001, "", 1, 0.0), (1002, "word " * 50_000, 1, 0.0), (None, "x", 1, 0.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, score double").repartition(4)
    labels = frame.where(~classifier.held_out()).select("doc_id", "quality").unionByName(spark.createDataFrame([(1, None), (None, 1), (3, 7)], "doc_id long, quality int"))
    model = classifier.fit(frame, labels, sample=200)
    got = classifier.score(frame.drop("score"), model, keep=("doc_id", "quality", "text")).withColumn("held_out", classifier.held_out()).collect()
    assert len(got) == len(rows)
    assert all(abs(r.score - model.score(r.text)) < 1e-9 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 80 and np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_single_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in classifier.score(docs, classifier.fit(docs, one)).collect())
    assert {r.score for r in classifier.score(docs, classifier.fit(docs, one.limit(0))).collect()} == {0.5}
    assert classifier.score(docs.limit(0), classifier.fit(docs.limit(0), one)).count() == 0
