"""Token counts by a two-tier lookup on the map side (operator 11).

A text is cut where the byte-level pre-tokenizer certainly cuts: before a space or line end that follows something else, and between letters, digits and
marks. The pieces, nearly always one pre-token each, are looked up many at a time with numpy:

1. in a table of frequent pieces and their numbers of tokens, of at most 2 ** 15 entries in 2 ** 16 places (1.2 MB), broadcast to all tasks;
2. in the cache of the worker, which asks the tokenizers library for what neither tier knows.

No piece is shuffled. The first tier is filled from what is frequent in ``sample_parts`` partitions spread over the table (``sample_bytes`` of each);
the sample decides how fast a piece is found and never what is counted.

Edge cases: null and empty texts have 0 bytes and tokens; strings of special tokens inside texts count as the library's default does, one token each;
texts of any length are taken whole; repeated rows and null ids are counted row by row; an empty table gives an empty table; other columns are ignored
unless asked for with ``keep``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.bpe import ByteBpe, ChunkTable
from tracemill.llm.common import mix, slices, with_text

#: Entries of the broadcast table, and of a worker's cache before it is emptied; neither changes a result.
FREQUENT, CACHED = 1 << 15, 1 << 20
_LETTER, _DIGIT, _MARK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = _LETTER  # bytes 0xC3 to 0xC9 begin letters of two bytes
_KIND[range(0x30, 0x3A)] = _DIGIT
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _MARK
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Lengths:
    """Numbers of tokens of pieces of at most 16 bytes: an open hash table of a fixed number of places."""

    def __init__(self, room: int):
        self.bits, self.count = (2 * room - 1).bit_length(), 0
        self.words = np.zeros((2, 1 << self.bits), np.uint64)
        self.sizes, self.tokens = np.zeros(1 << self.bits, np.uint8), np.zeros(1 << self.bits, np.uint8)

    def find(self, words: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of tokens of each piece, 0 where it is not in the table."""
        out = np.zeros(len(hashes), np.uint8)
        left, slot = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            got = self.tokens[slot]
            taken = got > 0
            left, slot, got = left[taken], slot[taken], got[taken]
            same = (self.words[0][slot] == words[0][left]) & (self.words[1][slot] == words[1][left]) & (self.sizes[slot] == sizes[left])
            out[left[same]] = got[same]
            left, slot = left[~same], (slot[~same] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, words: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, tokens: np.ndarray) -> None:
        """Keep pieces that are not in the table and differ from one another; there must be room."""
        left, slot = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.count += len(left)
        while len(left):
            free = self.tokens[slot] == 0
            _, first = np.unique(slot[free], return_index=True)  # one of those that want a place
            won = np.flatnonzero(free)[first]
            at, who = slot[won], left[won]
            self.words[:, at], self.sizes[at], self.tokens[at] = words[:, who], sizes[who], tokens[who]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)


class Pieces:
    """The pieces of some texts put after each other: where they start, their lengths, and, up to 16 bytes, their value in two words."""

    def __init__(self, cutter: ChunkTable, texts: list[str | None]):
        coded = [(t or "").encode() for t in texts]
        self.bytes = np.fromiter(map(len, coded), np.int64, len(coded))
        self.ends, self.data = np.cumsum(self.bytes), b"".join(coded)
        padded = np.frombuffer(self.data + bytes(16), np.uint8)
        text = padded[:-16]
        cut = np.zeros(len(text), bool)
        if len(text):
            cut[cutter.cuts(self.data, text, self.ends)] = True
            cut[1:] |= self._by_kind(cutter, text)
        self.starts = np.flatnonzero(cut)
        self.sizes = np.diff(np.append(self.starts, len(text)))
        eight = np.ndarray((len(self.data) + 8,), "<u8", padded, 0, (1,))
        self.words = np.stack([eight[self.starts] & _MASKS[np.minimum(self.sizes, 8)], eight[np.minimum(self.starts + 8, len(self.data))] & _MASKS[np.clip(self.sizes - 8, 0, 8)]])
        self.hashes = mix(self.words[0] ^ mix(self.words[1] + self.sizes.astype(np.uint64)))

    def _by_kind(self, cutter: ChunkTable, text: np.ndarray) -> np.ndarray:
        """Between which bytes letters, digits and marks change; an apostrophe may belong to the letters after it."""
        kind = _KIND[text]
        two = (text >= 0xC3) & (text <= 0xC9)
        kind[1:][two[:-1]] = _LETTER
        sign = np.flatnonzero((text[:-1] == 0xC3) & ((text[1:] == 0x97) | (text[1:] == 0xB7)))  # the signs of product and quotient
        kind[sign] = kind[sign + 1] = 0
        a, b = kind[:-1], kind[1:]
        cut = (a != b) & (a > 0) & (b > 0) & ~((text[:-1] == 0x27) & (b == _LETTER))
        if cutter._split is not None:
            for m in cutter._split.finditer(self.data):
                cut[m.start() : m.end() - 1] = False
        return cut

    def at(self, which: np.ndarray) -> list[bytes]:
        return [self.data[a : a + n] for a, n in zip(self.starts[which].tolist(), self.sizes[which].tolist())]


class Counter:
    """Numbers of tokens of texts, from the broadcast table, a cache, and ``make``, which counts what neither holds."""

    def __init__(self, make: Callable[[list[str]], list[int]], special: dict[str, int], limit: int = CACHED):
        self.make, self.limit, self.cutter = make, limit, ChunkTable(None, special, limit=1)
        self.cache, self.long = Lengths(limit), {}
        self.asked = 0

    def _made(self, pieces: list[bytes]) -> np.ndarray:
        self.asked += len(pieces)
        return np.array(self.make([p.decode() for p in pieces]), np.int64)

    def count(self, texts: list[str | None], frequent: Lengths | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        p = Pieces(self.cutter, texts)
        tokens = np.zeros(len(p.starts), np.int64)
        short = np.flatnonzero(p.sizes <= 16)
        if frequent is not None:
            tokens[short] = frequent.find(p.words[:, short], p.sizes[short].astype(np.uint8), p.hashes[short])
            short = short[tokens[short] == 0]
        words, sizes, hashes = p.words[:, short], p.sizes[short].astype(np.uint8), p.hashes[short]
        found = self.cache.find(words, sizes, hashes)
        while len(lost := np.flatnonzero(found == 0)):
            new = lost[np.unique(hashes[lost], return_index=True)[1]]  # two pieces of one hash take two turns
            if self.cache.count + len(new) > self.limit:
                self.cache = Lengths(max(self.limit, len(new)))
            made = self._made(p.at(short[new]))
            self.cache.add(words[:, new], sizes[new], hashes[new], made)
            found[lost] = self.cache.find(words[:, lost], sizes[lost], hashes[lost])
            found[new] = made
        tokens[short] = found
        wide = np.flatnonzero(p.sizes > 16)
        pieces = p.at(wide)
        fresh = list(dict.fromkeys(x for x in pieces if x not in self.long))
        if sum(map(len, fresh)) + 64 * (len(self.long) + len(fresh)) > 64 * self.limit:
            self.long, fresh = {}, list(dict.fromkeys(pieces))
        if fresh:
            known = dict(zip(fresh, self._made(fresh).tolist()))
            tokens[wide] = [known[x] if x in known else self.long[x] for x in pieces]
            self.long.update((x, n) for x, n in known.items() if len(x) <= 256)  # a longer one would fill the cache alone
        elif pieces:
            tokens[wide] = [self.long[x] for x in pieces]
        total = np.concatenate([[0], np.cumsum(tokens)])
        return p.bytes, np.diff(total[np.searchsorted(p.starts, np.concatenate([[0], p.ends]))])


_loaded: dict[str, Counter] = {}


def load(path: str) -> Counter:
    """Once a process: the counter of the vocabulary at ``path``."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        special = ByteBpe(path).special
        _loaded[path] = Counter(lambda pieces: list(map(len, library.encode_batch(pieces, add_special_tokens=False))), special)
    return _loaded[path]


def frequent_pieces(docs: DataFrame, path: str, text: str = "text", parts: int = 8, size: int = 4 << 20, room: int = FREQUENT) -> Lengths:
    """The first tier: the ``room`` most frequent pieces of at most ``size`` bytes of each of ``parts`` partitions, which are spread over the table."""
    spark = docs.sparkSession

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen, held = load(path).cutter, 0, {}
        for batch in slices(batches, "__text"):
            if seen > size:
                continue
            p = Pieces(cutter, batch.column("__text").to_pylist())
            seen += len(p.data)
            short = np.flatnonzero(p.sizes <= 16)
            _, first, many = np.unique(p.hashes[short], return_index=True, return_counts=True)
            for piece, n in zip(p.at(short[first]), many.tolist()):
                held[piece] = held.get(piece, 0) + n
        top = sorted(held, key=lambda x: (-held[x], x))[:room]
        yield pa.RecordBatch.from_arrays([pa.array([top], pa.list_(pa.binary())), pa.array([[held[x] for x in top]], pa.list_(pa.int64()))], names=["pieces", "counts"])

    rdd = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")).mapInArrow(tally, "pieces array<binary>, counts array<long>").rdd
    n = rdd.getNumPartitions()
    chosen = sorted({i * n // parts for i in range(parts)}) if n else []
    total: dict[bytes, int] = {}
    for row in spark.sparkContext.runJob(rdd, list, chosen):  # at most parts * room pieces of 16 bytes
        for piece, many in zip(row.pieces, row.counts):
            total[bytes(piece)] = total.get(bytes(piece), 0) + many
    top = sorted(total, key=lambda x: (-total[x], x))[:room]
    table = Lengths(room)
    if top:
        sizes = np.fromiter(map(len, top), np.uint8, len(top))
        words = np.frombuffer(b"".join(x.ljust(16, b"\0") for x in top), "<u8").reshape(-1, 2).T.copy()
        table.add(words, sizes, mix(words[0] ^ mix(words[1] + sizes.astype(np.uint64))), np.array(load(path).make([x.decode() for x in top]), np.int64))
    return table


def token_counts(
    docs: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024, sample_parts: int = 8, sample_bytes: int = 4 << 20
) -> DataFrame:
    """Per row the ``keep`` columns, n_bytes, n_tokens and over_limit (more than ``limit`` tokens), as the tokenizers library counts the whole text.

    ``path`` names a byte-level BPE file that every executor can read. Narrow: nothing is shuffled.
    """
    rows, name = with_text(docs, keep, text)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, text, sample_parts, sample_bytes))
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in slices(batches, name):
            size, tokens = counter.count(batch.column(name).to_pylist(), frequent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=schema.names)

    return rows.mapInArrow(run, schema)
