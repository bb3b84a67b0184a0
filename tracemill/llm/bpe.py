"""BPE encoding and decoding by forced-boundary splitting (operator 9).

A pair of bytes that stands inside no token of the vocabulary can never be merged, so a cut between the two is
certain. Texts are cut twice: first before spaces and line ends that follow other characters (the pre-tokenizer cuts there
too, whatever stands around it), which gives chunks short enough to remember; then, inside a chunk, at every
pre-token and every forbidden byte pair. The fragments are merged independently, many at a time, and their ids concatenated.

Edge cases: a null text counts as empty (no ids, empty text back); strings of special tokens give their ids as the
tokenizers library does; a text that is one long run of one fragment is merged in O(n log n); repeated rows give
repeated results; other columns are carried only where asked for.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import mix, slices

#: Fixed value: the pattern of byte-level pre-tokenizers with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ASCII bytes that some definition takes for white space.
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
#: Bytes that characters of white space outside ASCII may end with: the last one, and the one before.
_LAST, _LAST_BUT_ONE = (np.isin(np.arange(256), x) for x in ([*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], [0x80, 0x81, 0x9A, 0xC2]))
#: A line end, letters and marks: up to three pre-tokens, as the pre-tokenizer cuts between them.
WORD = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
WORD_CUTS = re.compile(r"(?<=\n)|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[!-&(-/:-@\[-`{-~])")
#: Fragments longer than this go to the algorithm that is O(n log n) for one of them.
LONG = 256
CACHE_LIMIT = 1 << 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    spare = (chr(256 + i) for i in range(256))
    return [letters[b] if b in letters else next(spare) for b in range(256)]


class PairRanks:
    """Rank of pairs of ids, ``none`` for pairs without one: hash tables, each holding what found its place taken in the one before."""

    BITS = 18

    def __init__(self, ranks: dict[tuple[int, int], int], none: int):
        self.none, self.tables = none, []
        key = np.array([(a << 32) | b for a, b in ranks], np.uint64)
        value = np.array([*ranks.values()], np.int32)
        while len(key):
            odd = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables))
            slot, first = np.unique(self._slots(key, odd), return_index=True)
            keys, values = np.full(1 << self.BITS, np.iinfo(np.uint64).max, np.uint64), np.full(1 << self.BITS, none, np.int32)
            keys[slot], values[slot] = key[first], value[first]
            self.tables.append((odd, keys, values))
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, value = key[rest], value[rest]

    def _slots(self, key: np.ndarray, odd: np.uint64) -> np.ndarray:
        key = (key ^ (key >> np.uint64(29))) * odd
        return ((key ^ (key >> np.uint64(31))) * odd) >> np.uint64(64 - self.BITS)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(len(key), self.none, np.int32)
        for odd, keys, values in self.tables:
            slot = self._slots(key, odd)
            np.copyto(out, values[slot], where=keys[slot] == key)
        return out


class ByteBpe:
    """A byte-level BPE vocabulary file: encoding with certain cuts, and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        value = {c: b for b, c in enumerate(byte_letters())}
        self.vocab = {bytes(value[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.tokens = [b""] * size
        for token, i in self.vocab.items():
            self.tokens[i] = token
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.joined: list[int] = []
        self.none = len(model["merges"])
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = bytes(value[c] for c in a), bytes(value[c] for c in b)
            self.rank[self.vocab[a], self.vocab[b]] = rank
            self.joined.append(self.vocab[a + b])
        self.byte_id = [self.vocab.get(bytes([b]), -1) for b in range(256)]
        inside = np.zeros((256, 256), bool)
        for token in self.vocab:
            for pair in zip(token, token[1:]):
                inside[pair] = True
        #: forced[a, b]: a cut between byte a and byte b is certain
        self.forced = ~inside
        self._pretokens = regex.compile(PATTERN)
        self._byte_ids = np.array(self.byte_id, np.int32)
        self._joined = np.array([*self.joined, -1], np.int32)
        self._pairs = PairRanks(self.rank, self.none)
        # merging all equal pairs of a fragment at once is the same if what a merge makes is only merged by later ranks
        made = {j: r for r, j in enumerate(self.joined)}
        self._ordered = all(made.get(x, -1) < r for pair, r in self.rank.items() for x in pair)

    def _merge_long(self, fragment: bytes) -> tuple[int, ...]:
        """Ids of one long fragment, always the merge of least rank, the leftmost first: O(n log n), with a heap and a linked list."""
        ids: list[int] = [self.byte_id[b] for b in fragment]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank, joined = self.rank, self.joined
        heap = [(rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            least, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = joined[least], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := (ids[i], ids[k])) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            h = before[i]
            if h >= 0 and (p := (ids[h], ids[i])) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return tuple(x for x in ids if x >= 0)

    def _merge_all(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many fragments that follow each other, and the number of ids of each: a merge of every fragment a round."""
        none, owner = self.none, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.full(len(ids), none, np.int32)
        rank[:-1] = self._pairs(ids[:-1], ids[1:])
        rank[np.cumsum(sizes) - 1] = none
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            ready = least == none
            if ready.any():
                done.append((owner[ready], ids[ready]))
                ids, owner, rank, least = (x[~ready] for x in (ids, owner, rank, least))
                if not len(ids):
                    break
            at = np.flatnonzero(rank == least)
            if (np.diff(at) == 1).any():  # in a run of one pair (aaaa) every second place goes
                first = np.concatenate([[True], np.diff(at) != 1])
                at = at[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            ids[at] = self._joined[rank[at]]
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            ids, owner, rank = ids[left], owner[left], rank[left]
            at = at - np.arange(len(at))
            again = np.concatenate([at, at[at > 0] - 1])
            rank[again] = none
            again = again[again + 1 < len(ids)]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self._pairs(ids[again], ids[again + 1])
        owner, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, which are special tokens or hold none, in one array, and the number of ids of each."""
        if any(c in self.special for c in chunks):
            got = [self.encode_chunks([c])[0] if c not in self.special else np.array([self.special[c]], np.int32) for c in chunks]
            return np.concatenate(got), np.array([len(x) for x in got])
        words: list[bytes] = []
        many = []
        for chunk in chunks:
            if m := WORD.fullmatch(chunk):
                found = [x for x in m.groups() if x]
            else:
                found = self._pretokens.findall(chunk)
            words += [w.encode() for w in found]
            many.append(len(found))
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(chunks), np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        cut = np.zeros(len(data), bool)
        cut[np.cumsum(sizes) - sizes] = True
        # a pre-token's bytes are cut wherever a pair of bytes stands inside no token
        cut[1:] |= self.forced[data[:-1], data[1:]]
        starts = np.flatnonzero(cut)
        length = np.diff(np.append(starts, len(data)))
        owner = np.repeat(np.repeat(np.arange(len(chunks)), many), sizes)[starts]
        ids = self._byte_ids[data]
        if not self._ordered or length.max() > LONG:
            alone = np.flatnonzero(length > (LONG if self._ordered else 0))
            merged = {int(k): self._merge_long(data[starts[k] : starts[k] + length[k]].tobytes()) for k in alone}
            short = np.ones(len(starts), bool)
            short[alone] = False
            got, counts = self._merge_all(ids[np.repeat(short, length)], length[short]) if short.any() else (ids[:0], length[:0])
            parts = iter(np.split(got, np.cumsum(counts)[:-1]))
            listed = [np.array(merged[k], np.int32) if k in merged else next(parts) for k in range(len(starts))]
            ids, counts = np.concatenate(listed), np.array([len(x) for x in listed])
        else:
            ids, counts = self._merge_all(ids, length)
        return ids, np.bincount(owner, counts, len(chunks)).astype(np.int64)

    def decode(self, ids: Iterable[int]) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")


class ChunkTable:
    """Ids of texts by their chunks, the pieces between certain cuts; ``make`` gives those of chunks that are not known.

    A slice of texts is cut, looked up and put together with numpy. Chunks of at most 16 bytes are kept by value in a hash table, longer
    ones in a dictionary. The table is emptied at ``limit`` chunks, so memory is bounded; results don't depend on it.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: dict[str, int], limit: int = CACHE_LIMIT, fine: bool = False):
        self.make, self.special, self.limit, self.fine = make, special, limit, fine
        self._split = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(special, key=len, reverse=True))) if special else None
        self._clear(limit)

    def _clear(self, room: int):
        self.bits = max(4, (2 * room).bit_length())
        self.count = self.used = 0
        self.long: dict[bytes, int] = {}
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.words = np.zeros((2, 1 << 10), np.uint64)
        self.lengths, self.starts, self.sizes = np.zeros(1 << 10, np.uint8), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.flat = np.zeros(1 << 12, np.uint32)

    def cuts(self, data: bytes, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where chunks start: before a space or line end that follows something else, at each text and around special tokens; with ``fine`` also
        before a mark that follows a letter, so that a word is made once, whatever follows it."""
        cut = np.zeros(len(text) + 1, bool)
        cut[1:-1] = ((text[1:] == 32) | (text[1:] == 10)) & ~_BLANK[text[:-1]]
        cut[2:-1] &= ~(_LAST[text[1:-1]] & _LAST_BUT_ONE[text[:-2]])
        if self.fine:
            cut[1:-1] |= _LETTER[text[:-1]] & _MARK[text[1:]]
        cut[0] = True
        cut[ends] = True
        if self._split is not None:
            for m in self._split.finditer(data):
                a, b = m.span()
                if not np.searchsorted(ends, a, "right") < np.searchsorted(ends, b, "left"):  # not across two texts
                    cut[a : b + 1] = False
                    cut[[a, b]] = True
        return np.flatnonzero(cut[:-1])

    def _find(self, words: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The place of each short chunk in the table, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        left, slot = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            place = self.slots[slot]
            taken = place >= 0
            left, slot, place = left[taken], slot[taken], place[taken]
            same = (self.words[0][place] == words[0][left]) & (self.words[1][place] == words[1][left]) & (self.lengths[place] == length[left])
            out[left[same]] = place[same]
            left, slot = left[~same], (slot[~same] + 1) & ((1 << self.bits) - 1)
        return out

    def _add(self, chunks: list[bytes]) -> int:
        """Make and keep the ids of chunks; the place of the first."""
        ids, sizes = self.make([c.decode() for c in chunks])
        first, last, end = self.count, self.count + len(chunks), self.used + len(ids)
        if last > len(self.starts):
            self.starts, self.sizes, self.lengths = (np.resize(x, 2 * last) for x in (self.starts, self.sizes, self.lengths))
            self.words = np.stack([np.resize(x, 2 * last) for x in self.words])
        if end > len(self.flat):
            self.flat = np.resize(self.flat, 2 * end)
        self.flat[self.used : end] = ids
        self.sizes[first:last] = sizes
        self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
        self.count, self.used = last, end
        return first

    def _keep(self, words: np.ndarray, length: np.ndarray, hashes: np.ndarray, chunks: list[bytes]) -> None:
        first = self._add(chunks)
        places = np.arange(first, self.count, dtype=np.int32)
        self.words[:, first : self.count], self.lengths[first : self.count] = words, length
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(places):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = places[free]
            lost = self.slots[slot] != places
            places, slot = places[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the number of ids of each."""
        coded = [(t or "").encode() for t in texts]
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        data = b"".join(coded)
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        padded = np.frombuffer(data + bytes(16), np.uint8)
        starts = self.cuts(data, padded[:-16], ends)
        length = np.diff(np.append(starts, len(data)))
        if self.count + len(starts) > self.limit:
            self._clear(max(self.limit, len(starts)))
        eight = np.ndarray((len(data) + 8,), "<u8", padded, 0, (1,))  # the eight bytes from each place
        words = np.stack([eight[starts] & _MASKS[np.minimum(length, 8)], eight[np.minimum(starts + 8, len(data))] & _MASKS[np.clip(length - 8, 0, 8)]])
        hashes = mix(words[0] ^ mix(words[1] + length.astype(np.uint64)))
        place = np.full(len(starts), -1, np.int32)
        short = np.flatnonzero(length <= 16)
        keys, sizes, hashes = words[:, short], length[short].astype(np.uint8), hashes[short]
        while True:
            got = self._find(keys, sizes, hashes)
            lost = np.flatnonzero(got < 0)
            if not len(lost):
                break
            new = lost[np.unique(hashes[lost], return_index=True)[1]]  # two chunks of one hash take two turns
            a = starts[short[new]].tolist()
            self._keep(keys[:, new], sizes[new], hashes[new], [data[i : i + n] for i, n in zip(a, sizes[new].tolist())])
        place[short] = got
        wide = np.flatnonzero(length > 16)
        found = [data[a : a + n] for a, n in zip(starts[wide].tolist(), length[wide].tolist())]
        fresh = list(dict.fromkeys(c for c in found if c not in self.long))
        if fresh:
            self.long.update(zip(fresh, range(first := self._add(fresh), first + len(fresh))))
        place[wide] = [self.long[c] for c in found]
        size = self.sizes[place]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.starts[place] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, np.concatenate([[0], ends]))])


_LETTER, _MARK = (np.array([bool(re.match(x, chr(b))) and b < 128 for b in range(256)]) for x in ("[A-Za-z]", r"[!-/:-@\[-`{-~]"))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Flat:
    """Byte strings by number, put together for an array of numbers."""

    def __init__(self, items: list[bytes]):
        self.sizes = np.fromiter(map(len, items), np.int64, len(items))
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(items), np.uint8)

    def join(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings after each other, and where each ends, from 0."""
        size = self.sizes[numbers]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.data[np.repeat(self.starts[numbers] - total[:-1], size) + np.arange(total[-1])].tobytes(), total


_loaded: dict[str, tuple[ChunkTable, Flat, Flat]] = {}


def load(path: str) -> tuple[ChunkTable, Flat, Flat]:
    """Once a process: the table of the vocabulary at ``path``, its ids in decimal, each with a comma, and its tokens."""
    if path not in _loaded:
        bpe = ByteBpe(path)
        _loaded[path] = ChunkTable(bpe.encode_chunks, bpe.special), Flat([f"{i},".encode() for i in range(len(bpe.tokens))]), Flat(bpe.tokens)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = False) -> DataFrame:
    """Encode the whole ``text`` of every row and decode the ids again.

    Returns the ``keep`` columns, n_tokens long, ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded text in
    UTF-8) and, with ``full``, ids array<long> and decoded string. Narrow: no shuffle. ``path`` must be readable on every
    executor (it is part of the environment, as the installed library is). An empty table gives an empty table.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = rows.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if full:
        schema = schema.add("ids", T.ArrayType(T.LongType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, digits, tokens = load(path)
        for batch in slices(batches, "__text"):
            ids, counts = table.encode(batch.column("__text").to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)])
            (listed, x), (text, y) = digits.join(ids), tokens.join(ids)
            hashed = [hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(x[ends[:-1]].tolist(), x[ends[1:]].tolist())]
            shown = [text[a:b].decode("utf-8", "replace") for a, b in zip(y[ends[:-1]].tolist(), y[ends[1:]].tolist())]
            decoded = [hashlib.sha256(t.encode()).hexdigest() for t in shown]
            out = [batch.column(c) for c in keep] + [pa.array(counts, pa.int64()), pa.array(hashed), pa.array(decoded)]
            if full:
                out += [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int64))), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(run, schema)
