"""Benchmark decontamination by winnowing (operator 10).

Item and document words are hashed; the least k-gram hash of every sliding window of w k-grams is kept as a
fingerprint. With k + w - 1 = n, two places that share n words share a fingerprint at the same place, so joining the
fingerprints finds every shared span of n words. Each hit is extended over the n-word windows around it, whose 128-bit
hashes must be windows of an item.

While the benchmark's windows number at most ``broadcast_windows`` (counted first), they are sent to every task
and documents are judged where they are read, without a shuffle. Beyond it, fingerprints of both sides are joined by
a shuffle, and windows are written out only around a document's fingerprints that some item has too. They are joined
to the items' windows, each once a document, so neither a document nor an item is paired with others whole.

Edge cases: null or wordless texts have no words, no hits and are not contaminated; a wordless item is no window; an item of
fewer than n words is one window of its own length, found through whole-window hashes of that length (winnowing
guarantees only n words); repeated item texts all count; repeated rows give repeated results; an empty benchmark hits
nothing; columns besides the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Rolling, WordHashes, hash_words, materialize, rehashed, slices, winnow, with_text

#: Byte translation: A-Z to a-z, all ASCII that is neither letter nor digit to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_hashes = WordHashes(), WordHashes(seed=7)
#: A word as a pattern: what ``words_of`` finds, upper case included.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _windows(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every n consecutive words."""
    return Rolling(hash_words(words, _hashes[0])).window(n), Rolling(hash_words(words, _hashes[1])).window(n)


class ItemWindows:
    """The benchmark's windows, sorted for lookup: by full length n, and by each shorter length that occurs."""

    def __init__(self, items: list[tuple[object, str | None]], n: int, k: int):
        self.n, self.k = n, k
        self.names: list[str] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        prints = []
        for item, text in items:
            if not (words := words_of(text)):
                continue
            size = min(n, len(words))
            a, b = _windows(words, size)
            found.setdefault(size, []).append((a, b, np.full(len(a), len(self.names))))
            self.names.append(str(item))
            if size == n:
                grams = Rolling(hash_words(words, _hashes[0])).window(k)
                prints.append(grams[winnow(grams, n - k + 1)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.by_size = {}
        for size, rows in found.items():
            a, b, owner = (np.concatenate(x) for x in zip(*rows))
            order = np.lexsort((owner, b, a))
            self.by_size[size] = a[order], b[order], owner[order]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the numbers of the items with occurring windows."""
        hit, owners = np.zeros(len(words), bool), set()
        if not self.by_size or not words:
            return hit, owners
        rolls = Rolling(hash_words(words, _hashes[0]))
        second = None
        for size, (a, b, owner) in self.by_size.items():
            if size > len(words):
                continue
            if size == self.n:
                grams = rolls.window(self.k)
                picks = winnow(grams, self.n - self.k + 1)
                picks = picks[_in_sorted(grams[picks], self.prints)]
                if not len(picks):
                    continue
                # extend: every window around a common fingerprint
                near = (picks[:, None] + np.arange(self.k - self.n, 1)).ravel()
                at = np.unique(near[(near >= 0) & (near <= len(words) - size)])
                mine = rolls.window(size)[at]
            else:
                mine = rolls.window(size)
                at = np.arange(len(mine))
            some = _in_sorted(mine, a)
            if not some.any():
                continue
            at, mine = at[some], mine[some]
            if second is None:
                second = Rolling(hash_words(words, _hashes[1]))
            other = second.window(size)[at]
            lo, hi = np.searchsorted(a, mine), np.searchsorted(a, mine, side="right")
            for place, x, y, check in zip(at.tolist(), lo.tolist(), hi.tolist(), other.tolist()):
                same = owner[x:y][b[x:y] == np.uint64(check)]
                if len(same):
                    hit[place : place + size] = True
                    owners.update(same.tolist())
        return hit, owners


def _in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _result(words: list[bytes], hit: np.ndarray, names: list[str], per: int) -> tuple:
    n, hits = len(words), int(hit.sum())
    return n, hits, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hits > 0 and per * hits >= n


_tables: dict[str, ItemWindows] = {}


def _judge(docs: DataFrame, text: str, items: list[tuple[object, str | None]], n: int, k: int, per: int, keep: tuple[str, ...]) -> DataFrame:
    """Every document against items small enough to be in every task."""
    tag = hashlib.sha256(repr((items, n, k)).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(items)
    rows, column = with_text(docs, keep, text)
    schema = docs.select(*keep).schema
    for part in SCHEMA.split(", "):
        schema = schema.add(*part.split(" "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _tables:
            _tables.clear()
            _tables[tag] = ItemWindows(sent.value, n, k)
        table = _tables[tag]
        for batch in slices(batches, column):
            judged = []
            for whole in batch.column(column).to_pylist():
                words = words_of(whole)
                hit, owners = table.hits(words)
                judged.append(_result(words, hit, list({table.names[i] for i in owners}), per))
            cols = zip(*judged)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(cols, kinds)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _fingerprints(rows: DataFrame, key: str, n: int, k: int, lengths: list[int] | None = None) -> DataFrame:
    """(print, key, at, size): winnowed fingerprints for windows of n words, and hashes of whole windows for each of ``lengths`` under n.

    Without ``lengths`` a text has its own: n, or all its words if they are fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            prints, owners, places, sizes = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)], []
            for owner, text in zip(batch.column(key).to_pylist(), batch.column("__text").to_pylist()):
                words = words_of(text)
                rolls = Rolling(hash_words(words, _hashes[0]))
                for size in ([min(n, len(words))] if lengths is None else lengths) if words else ():
                    if size > len(words):
                        continue
                    if size == n:
                        grams = rolls.window(k)
                        at = winnow(grams, n - k + 1)
                        got = grams[at]
                    else:
                        got = rolls.window(size) ^ np.uint64(size)
                        at = np.arange(len(got))
                    prints.append(got)
                    places.append(at)
                    owners += [owner] * len(at)
                    sizes += [size] * len(at)
            cols = [pa.array(np.concatenate(prints).view(np.int64)), pa.array(owners, batch.column(key).type), pa.array(np.concatenate(places), pa.int32()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["print", key, "at", "size"])

    return rows.select(key, "__text").mapInArrow(run, f"print long, {key} {rows.schema[key].dataType.simpleString()}, at int, size int")


def _hashed_windows(rows: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """(a, b, size, key, start): both hashes of the windows around the ``places`` (at, size) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            a, b, owners, sizes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [], [], [np.zeros(0, np.int64)]
            for owner, text, places in zip(*(batch.column(c).to_pylist() for c in (key, "__text", "places"))):
                words = words_of(text)
                rolls = [Rolling(hash_words(words, h)) for h in _hashes]
                for size in {p["size"] for p in places}:
                    at = np.array([p["at"] for p in places if p["size"] == size], np.int64)
                    near = np.unique((at[:, None] + np.arange(k - n, 1)).ravel()) if size == n else np.unique(at)
                    near = near[(near >= 0) & (near <= len(words) - size)]
                    a.append(rolls[0].window(size)[near])
                    b.append(rolls[1].window(size)[near])
                    starts.append(near)
                    owners += [owner] * len(near)
                    sizes += [size] * len(near)
            cols = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int32()), pa.array(owners, batch.column(key).type), pa.array(np.concatenate(starts), pa.int32())], names=["a", "b", "size", key, "start"])

    return rows.select(key, "__text", "places").mapInArrow(run, f"a long, b long, size int, {key} {rows.schema[key].dataType.simpleString()}, start int")


def decontaminate(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", n: int = 13, k: int = 7,
    per: int = 20, broadcast_windows: int = 2_000_000, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Words of each document inside windows of ``n`` words that a benchmark item holds too.

    Returns the ``keep`` columns (``doc_id`` by default), n_words, n_hit, n_items, items_sha256 (sorted item ids joined by commas)
    and contaminated: a hit, and ``per`` * n_hit >= n_words.
    """
    keep = keep or (doc_id,)
    rows = docs.select(*{c: None for c in (*keep, doc_id)}, F.col(text).alias("__text"))
    bench = items.select(F.col(item_id).alias("__item"), F.col(text).alias("__text")).where("__text IS NOT NULL")
    size = F.size(F.split("__text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = bench.agg(F.sum(size)).first()[0] or 0
    if total <= broadcast_windows:
        return _judge(docs, text, [tuple(r) for r in bench.collect()], n, k, per, keep)
    return _judge_by_join(rows, bench, doc_id, n, k, per, keep)


def _judge_by_join(rows: DataFrame, bench: DataFrame, doc_id: str, n: int, k: int, per: int, keep: tuple[str, ...]) -> DataFrame:
    """The same for benchmarks of any size: windows of documents meet windows of items."""
    bench = materialize(bench.select(F.monotonically_increasing_id().alias("__n"), F.coalesce(F.col("__item").cast("string"), F.lit("None")).alias("__item"), "__text"))
    gathered = F.collect_list(F.struct("at", "size")).alias("places")
    prints = materialize(_fingerprints(bench, "__n", n, k))
    lengths = sorted(r[0] for r in prints.select("size").distinct().collect())  # n values at most
    placed = bench.join(prints.groupBy("__n").agg(gathered), "__n")
    of_items = _hashed_windows(placed, "__n", n, k).join(bench.select("__n", "__item"), "__n").select("a", "b", "size", "__item").distinct()
    of_items = materialize(of_items)

    rows = rows.withColumn("__row", F.concat_ws("-", F.hex(F.xxhash64(*rows.columns)), F.hex(F.xxhash64(F.lit(n), *rows.columns))))
    texts = rows.select("__row", "__text").dropDuplicates(["__row"])
    known = rehashed(prints.select("print").distinct(), "print")
    seeds = _fingerprints(rows, "__row", n, k, lengths).join(known, "print", "left_semi").select("__row", "at", "size").distinct().groupBy("__row").agg(gathered)
    windows = _hashed_windows(texts.join(seeds, "__row"), "__row", n, k)
    hits = materialize(windows.join(rehashed(of_items.select("a", "b", "size").distinct(), "a"), ["a", "b", "size"], "left_semi"))

    before = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("__row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    stop = F.col("start") + F.col("size")
    covered = hits.select("__row", (stop - F.greatest(F.col("start"), F.least(stop, F.coalesce(before, F.col("start"))))).alias("new")).groupBy("__row").agg(F.sum("new").cast("long").alias("n_hit"))
    names = hits.select("__row", "a", "b", "size").distinct().join(rehashed(of_items, "a"), ["a", "b", "size"]).select("__row", "__item").distinct()
    found = covered.join(names.groupBy("__row").agg(F.array_sort(F.collect_list("__item")).alias("names")), "__row")
    done = rows.withColumn("n_words", F.coalesce(F.regexp_count("__text", F.lit(WORD)), F.lit(0)).cast("long")).drop("__text").join(found, "__row", "left")
    return done.select(
        *keep, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "names"), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") * per >= F.col("n_words"), F.lit(False)).alias("contaminated"),
    )
