"""Token ids as Re-Pair grammars (operator 1): encode texts, write compressed shards, read documents back.

A shard is a row of a Parquet table in the shared folder: ``payload`` holds the documents of a stretch of ascending
doc_id in a binary layout of its own. Pairs of ids that are frequent in the shard are replaced by nonterminals, again and
again; the rules (left, right) and their expansion lengths are stored, with the expanded place of every 64th symbol,
so that any range of ids is decoded from the few symbols that cover it.

Layout, little-endian: magic ``RPG1``; 6 x uint64: documents, ids, rules, symbols, first nonterminal, bytes a symbol; then
doc_id int64 x documents, a uint8 x documents for null doc_ids, first id of each document uint64 x (documents + 1), rules
uint32 x 2 x rules, expansion lengths uint64 x rules, places uint64 x ceil(symbols / 64), symbols.

Edge cases: null and empty texts give just the end id; null doc_ids come first; rows that repeat a doc_id are ordered by text
hash and each kept; a text longer than ``shard_ids`` is a shard of its own; an empty table writes no shard and
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.bpe import CACHE_LIMIT, WORD, WORD_CUTS, ChunkTable, byte_letters
from tracemill.llm.common import shared_dir, shuffle_parts, slices

MAGIC, HEAD, EVERY = b"RPG1", struct.Struct("<6Q"), 64
_tables: dict[str, ChunkTable] = {}


def library_table(path: str, limit: int = CACHE_LIMIT) -> ChunkTable:
    """A table of ids, as little-endian uint32, by chunk; new chunks are encoded by the tokenizers library.

    Chunks of a line end, letters and marks have certain pre-tokens: the library's model gets these in its byte letters, many in one text,
    each chunk followed by the letter of byte 255, which no text holds. All other chunks go to the library as they are.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads that wait for work burn it
    library = Tokenizer.from_file(path)
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    words = Tokenizer(library.model)
    words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    library.model._resize_cache(0)  # no word is asked for twice, as the table remembers them
    letters = {b: x for b, x in enumerate(byte_letters()) if b > 1}
    end = letters[255]
    number = library.token_to_id(end)

    def encode_words(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(chunks), 1024):
            # bytes 0 and 1, which such chunks don't hold, stand after chunks and between pre-tokens
            some = WORD_CUTS.sub("\1", "\0".join([*chunks[at : at + 1024], ""])).encode().decode("latin-1").translate(letters)
            text = some.replace("\0", f" {end} ").replace("\1", " ")
            ids = np.array(words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            last = ids == number
            found.append(ids[~last])
            counts.append(np.diff(np.flatnonzero(last), prepend=-1) - 1)
        return np.concatenate(found), np.concatenate(counts)

    def make(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        simple = np.array([number is not None and WORD.fullmatch(c) is not None and c not in special for c in chunks])
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        ids, counts = encode_words([chunks[k] for k in order[: simple.sum()]])
        other = [e.ids for e in library.encode_batch_fast([chunks[k] for k in order[simple.sum() :]], add_special_tokens=False)]
        ids = np.concatenate([ids, *(np.array(x, np.uint32) for x in other)])
        counts = np.concatenate([counts, np.fromiter(map(len, other), np.int64, len(other))])
        starts, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        starts[order], size[order] = np.cumsum(counts) - counts, counts
        return ids[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(len(ids))], size

    return ChunkTable(make, special, limit, fine=True)


def load(path: str) -> ChunkTable:
    """The library's table for the tokenizer file at ``path``, once a process."""
    if path not in _tables:
        _tables[path] = library_table(path)
    return _tables[path]


def compress(ids: np.ndarray, first: int, ends: np.ndarray, min_count: int, min_gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair in rounds: (symbols, rules). Each round replaces every pair that occurs ``min_count`` times or more.

    Where two such pairs overlap, the more frequent one goes first; the other waits for the next round. No pair crosses
    a document's end, at which ``ends`` is true. Rounds end when one shortens the symbols by less than ``min_gain``.
    """
    symbols, fixed = ids.astype(np.uint32), ends.copy()
    rules: list[np.ndarray] = []
    known = 0
    while len(symbols) > 1:
        key = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        bins = 1 << max(10, min(20, len(key).bit_length()))
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - bins.bit_length())).astype(np.int32)
        often = np.bincount(slot, minlength=bins)[slot] >= min_count
        often &= ~fixed[:-1]
        where = np.flatnonzero(often)
        if not len(where):
            break
        pairs, which, counts = np.unique(key[where], return_inverse=True, return_counts=True)
        rank = np.argsort(np.argsort(-counts, kind="stable"), kind="stable").astype(np.int32)
        none = np.int32(len(pairs))
        order = np.full(len(key) + 2, none, np.int32)
        order[where + 1] = np.where(counts >= min_count, rank, none)[which]
        here = order[1:-1]
        # in a run of one pair (aaaa) every second place may go
        place = np.arange(len(here), dtype=np.int32)
        run = np.maximum.accumulate(np.where(here != order[:-2], place, 0))
        pick = np.flatnonzero((here < none) & (here <= order[:-2]) & (here <= order[2:]) & ((place - run) % 2 == 0))
        used = np.bincount(here[pick], minlength=none)
        pick = pick[used[here[pick]] > 1]
        if len(pick) < max(1, min_gain * len(symbols)):
            break
        chosen = np.flatnonzero(used > 1)
        number = np.zeros(none, np.uint32)
        number[chosen] = first + known + np.arange(len(chosen), dtype=np.uint32)
        by_rank = np.argsort(rank)
        new = pairs[by_rank[chosen]]
        rules.append(np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        known += len(chosen)
        symbols[pick] = number[here[pick]]
        fixed[pick] = fixed[pick + 1]
        left = np.ones(len(symbols), bool)
        left[pick + 1] = False
        symbols, fixed = symbols[left], fixed[left]
    return symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, first: int, min_count: int, min_gain: float) -> bytes:
    """The payload of a shard with these documents, whose ids (end ids included) follow each other."""
    starts = np.zeros(len(counts) + 1, np.uint64)
    np.cumsum(counts, out=starts[1:])
    ends = np.zeros(len(ids), bool)
    ends[starts[1:].astype(np.int64) - 1] = True
    symbols, rules = compress(ids, first, ends, min_count, min_gain)
    lengths = np.ones(first + len(rules), np.uint64)
    for i, (a, b) in enumerate(rules.tolist(), first):
        lengths[i] = lengths[a] + lengths[b]
    places = np.zeros(len(symbols), np.uint64)
    np.cumsum(lengths[symbols[:-1]], out=places[1:])
    width = 2 if first + len(rules) <= 1 << 16 else 4
    parts = [
        np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), starts.astype("<u8"), rules.astype("<u4"),
        lengths[first:].astype("<u8"), places[::EVERY].astype("<u8"), symbols.astype(f"<u{width}"),
    ]
    return MAGIC + HEAD.pack(len(doc_ids), len(ids), len(rules), len(symbols), first, width) + b"".join(p.tobytes() for p in parts)


class Shard:
    """A payload, opened: documents and any range of its ids."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        docs, self.size, rules, symbols, self.first, width = HEAD.unpack_from(payload, 4)
        at = 4 + HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, n, at)
            at += got.nbytes
            return got

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null)]
        self.starts = take("<u8", docs + 1).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u8", rules).astype(np.int64)
        self.places = take("<u8", -(-symbols // EVERY)).astype(np.int64)
        self.symbols = take(f"<u{width}", symbols)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.uint32)
        while (deep := symbols >= self.first).any():
            times = 1 + deep
            at = np.cumsum(times) - times
            wide = np.repeat(symbols, times)
            pairs = self.rules[symbols[deep] - self.first]
            wide[at[deep]], wide[at[deep] + 1] = pairs[:, 0], pairs[:, 1]
            symbols = wide
        return symbols

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop, expanding only symbols that cover them."""
        stop = self.size if stop is None else stop
        if start >= stop:
            return np.zeros(0, np.uint32)
        block = int(np.searchsorted(self.places, start, side="right")) - 1
        last = int(np.searchsorted(self.places, stop, side="left"))
        some = self.symbols[block * EVERY : last * EVERY].astype(np.int64)
        deep = some >= self.first
        sizes = np.ones(len(some), np.int64)
        sizes[deep] = self.lengths[some[deep] - self.first]
        ends = int(self.places[block]) + np.cumsum(sizes)
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, stop, side="left")) + 1
        skip = start - int(ends[a] - sizes[a])
        return self._expand(some[a:b])[skip : skip + stop - start]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_shards(
    docs: DataFrame, path: str, folder: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, first: int = 1 << 16,
    shard_ids: int = 1 << 20, min_count: int = 16, min_gain: float = 0.02, parts: int | None = None,
) -> None:
    """Encode texts with the tokenizer file ``path`` and write grammar shards to ``folder`` in ascending doc_id order.

    ``first`` is the number of the first nonterminal; every id must be below it. One shuffle, by ranges of doc_id.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    parts = parts or shuffle_parts(docs.sparkSession)
    order = ["doc_id", F.xxhash64("__text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = load(path), TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = before = shard = 0

        def flush() -> pa.RecordBatch:
            names = [d for h in held for d in h[0]]
            payload = pack(names, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), first, min_count, min_gain)
            row = [part], [shard], [before], [size], [payload]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "shard", "before", "n_ids", "payload"])

        for batch in slices(batches, "__text"):
            ids, counts = table.encode(batch.column("__text").to_pylist())
            closed, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            if closed.max() >= first:
                raise ValueError(f"id {closed.max()} is not below the first nonterminal, {first}")
            if size and size + len(closed) > shard_ids:
                yield flush()
                before, shard, size, held = before + size, shard + 1, 0, []
            held.append((batch.column("doc_id").to_pylist(), counts, closed))
            size += len(closed)
        if size:
            yield flush()

    rows.mapInArrow(run, "part int, shard int, before long, n_ids long, payload binary").write.parquet(folder)


def read_shards(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of written shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids on demand.

    The numbers of ids of the written parts, one row a task of the writer, are summed on the driver; nothing else is.
    """
    schema = "part int, shard int, before long, n_ids long, payload binary"
    shards = spark.read.schema(schema).parquet(folder)
    base, total = {}, 0
    for part, n in sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids")).collect())):
        base[part], total = total, total + n
    sent = spark.sparkContext.broadcast(base)
    out = T.StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    if with_ids:
        out = out.add("ids", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "payload"))):
                shard = Shard(payload)
                ids = shard.ids().astype("<u4")
                starts = shard.starts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                cols = [pa.array(shard.doc_ids, pa.int64()), pa.array(starts[:-1] + (sent.value[part] + before)), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return shards.select("part", "before", "payload").mapInArrow(run, out)


def encode_documents(docs: DataFrame, path: str, **options) -> DataFrame:
    """write_shards to a new shared folder, then read_shards from it."""
    folder = shared_dir(docs.sparkSession)
    write_shards(docs, path, folder, **options)
    return read_shards(docs.sparkSession, folder)
