import inspect
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracemill.llm import grammar

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip_and_random_access():
    rng = random.Random(1)
    phrase = [rng.randrange(50) for _ in range(40)]
    for n in (1, 2, 30, 3000):
        docs = [[rng.randrange(50) for _ in range(rng.randrange(30))] + phrase * (d % 3) + [7] * (d % 9) + [0] for d in range(n)]
        ids = np.array([x for d in docs for x in d], np.uint32)
        payload = grammar.pack([None, *range(1, n)], np.array([len(d) for d in docs]), ids, 100, 2, 0.0)
        shard = grammar.Shard(payload)
        assert shard.doc_ids == [None, *range(1, n)] and shard.ids().tolist() == ids.tolist()
        for _ in range(60):
            k = rng.randrange(n)
            assert shard.document(k).tolist() == docs[k]
            a, b = sorted(rng.randrange(len(ids) + 1) for _ in range(2))
            assert shard.ids(a, b).tolist() == ids[a:b].tolist()
    assert len(shard.symbols) < len(ids) / 2 and (shard.lengths >= 2).all()
    assert len(grammar.compress(np.full(1000, 5), 100, np.zeros(1000, bool), 2, 0.0)[0]) < 20


def test_production_thresholds():
    given = {k: v.default for k, v in inspect.signature(grammar.write_shards).parameters.items()}
    min_count, min_gain = given["min_count"], given["min_gain"]
    assert (min_count, min_gain) == (16, 0.02)
    rng = random.Random(3)
    phrase = [rng.randrange(50) for _ in range(40)]
    docs = [[rng.randrange(50) for _ in range(rng.randrange(30))] + phrase * 3 + [0] for _ in range(500)]
    ids = np.array([x for d in docs for x in d], np.uint32)
    shard = grammar.Shard(grammar.pack(list(range(500)), np.array([len(d) for d in docs]), ids, 100, min_count, min_gain))
    assert shard.ids().tolist() == ids.tolist() and all(shard.document(k).tolist() == docs[k] for k in range(0, 500, 50))
    assert len(shard.symbols) < len(ids) / 2
    # a pair is a rule from 16 occurrences on
    for n in (15, 16):
        pairs = np.array([x for k in range(n) for x in (1, 2, 10 + k)], np.uint32)
        assert len(grammar.compress(pairs, 100, np.zeros(len(pairs), bool), min_count, min_gain)[1]) == (n == 16)


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    rows = [(d, "".join(rng.choice(["the cat ", "naïve.\n", "a<|endoftext|>", "thnd*** ", "  x"]) for _ in range(rng.randrange(40))), "x") for d in range(200)]
    rows += [(500, None, "a"), (501, "", "b"), (502, "word " * 5000, None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = {r.doc_id: r for r in grammar.encode_documents(frame, PATH, shard_ids=500).collect()}
    start = 0
    for d, t, _ in sorted(rows):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_nulls_repeats_empty(spark):
    frame = spark.createDataFrame([(None, "b"), (3, "a"), (3, "a"), (3, "c")], "doc_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start) for r in grammar.encode_documents(frame, PATH).collect())
    assert got == [(-1, 0), (3, 2), (3, 4), (3, 6)]
    assert grammar.encode_documents(frame.limit(0), PATH).count() == 0


def test_a_word_is_made_once_whatever_follows_it():
    """Words before marks are the same chunk, so the library gets each once; ids stay those of whole texts."""
    table = grammar.library_table(PATH)
    made = []
    make, table.make = table.make, lambda chunks: (made.extend(chunks), make(chunks))[1]
    texts = ["Some plain words", "some. words, plain! words; don't (words) words<|endoftext|>words.", "a.b.c 'tis x-y_z, it's\n- words...\n\nplain", "é. ü, words\u0301. 12.5 a1. b"]
    ids, counts = table.encode(texts)
    assert made.count(" words") == 1 and not [c for c in made if c.startswith(" words") and c[6:7] in tuple(".,;!)")]
    want = [x.ids for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == want[0] and ids.tolist() == sum(want, [])
