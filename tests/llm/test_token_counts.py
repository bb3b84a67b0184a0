import random

import public_tokenizers
from tokenizers import Tokenizer

from tracemill.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
CASES = [
    "", None, "a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>'s", "  two  spaces \n\n x  y", "don't we'll it''s !'s 5's '5 a 's x'é", "a\x1c b!\x1d c", "naïve café, 漢字 🙂🙂", "x" * 3000,
    "   \t a ", "\r\n \r\n1 234  5", "𝔘nicode​ ", "3×4÷5 a×b é÷è Ɂx ɏ9", "é,à;ç1ü", "\x00\x7f a1b2,c!!d", "q" * 16 + " " + "q" * 17, "éa ,é",
]


def texts():
    rng = random.Random(11)
    letters = "ab 'stré \n\t.!×漢1 9\x1c<|́"
    return CASES + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)] + ["the cat's " * 4000]


def test_same_as_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i % 7 if i % 5 else None, t, i, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens_ long, n_bytes string").repartition(3)
    out = tc.token_counts(docs, PATH, keep=("doc_id", "n_tokens_")).collect()
    assert len(out) == len(rows)
    for r in out:
        t = rows[r.n_tokens_][1] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024), t


def test_small_caches_and_empty_tables(spark):
    library = Tokenizer.from_file(PATH)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts()]
    make = tc.load(PATH).make
    for limit in (3, 50, 1 << 12):
        counter = tc.Counter(make, {"<|endoftext|>": 50256}, limit)
        assert counter.count(texts())[1].tolist() == want
        assert counter.count(texts())[1].tolist() == want
    assert counter.asked < 2 * 4000
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_first_tier_answers_most(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat, " * 5) for i in range(50)], "doc_id long, text string").repartition(5)
    table = tc.frequent_pieces(docs, PATH, parts=2)
    assert 0 < table.count <= 8
    counter = tc.Counter(tc.load(PATH).make, {})
    counter.count(["the cat sat on the mat, "], table)
    assert counter.asked == 0  # " mat" and "," and the trailing space are frequent too
