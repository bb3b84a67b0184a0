import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracemill.llm import bpe, grammar

PATH = public_tokenizers.path("byte_bpe_50k.json")
CASES = ["", None, "a<|endoftext|>b <|endoftext|>", "  two  spaces \n\n x  y", "don't we'll", "a\x1c b!\x1d c", "naïve 漢字 🙂🙂", "x" * 3000, "   \t a ", "\r\n \r\n1 234  5", "𝔘nicode​ "]


def texts():
    rng = random.Random(5)
    letters = "ab 'stre \n\t.!é漢1 \x1c<|"
    return CASES + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)] + ["the cat " * 400]


def test_same_as_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t, i) for i, t in enumerate(texts())]
    out = {r.doc_id: r for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").repartition(3), PATH, full=True).collect()}
    assert len(out) == len(rows)
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(out[i].ids) == ids, t
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_forced_cuts_and_small_table():
    model = bpe.ByteBpe(PATH)
    assert model.forced[ord("t"), ord(" ")] and not model.forced[ord("t"), ord("h")]
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts()]
    for make, special in ((model.encode_chunks, model.special), (grammar.library_table(PATH).make, model.special)):
        for limit in (5, 1000):
            table = bpe.ChunkTable(make, special, limit=limit)
            assert [table.encode([t])[0].tolist() for t in texts()] == want
            ids, counts = table.encode(texts())
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_spaces_around_cuts():
    """Every mix of white space, letters and marks, as whole texts and with neighbours: the cuts never change the ids."""
    library = Tokenizer.from_file(PATH)
    blanks = [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\x00", "é", "…", "a", "'s", "<|endoftext|>"]
    cases = [f"x{a}{b}{c}y" for a in blanks for b in blanks for c in (" ", "\n", "z", "\u3000")]
    model = bpe.ByteBpe(PATH)
    table = bpe.ChunkTable(model.encode_chunks, model.special)
    ids, counts = table.encode(cases)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in cases]


def test_very_long_texts():
    """A text of one long fragment and one of a megabyte of words: encoded whole."""
    library = Tokenizer.from_file(PATH)
    model = bpe.ByteBpe(PATH)
    table = bpe.ChunkTable(model.encode_chunks, model.special)
    for t in ("ab" * 40_000, "the cat sat. " * 80_000, "é" * 30_000 + " x"):
        assert table.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
