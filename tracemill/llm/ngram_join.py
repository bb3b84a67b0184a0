"""Exact n-gram Jaccard join by multiple-global-order filtering (operator 5).

A document's set is its distinct shingles of n words. Equal sets are one class. Two sets of similarity t share all but
x - ceil(t x) of x shingles, so they share early shingles under every global order, and candidates must pass the
filters of several orders:

1. by hash: the prefix of x - ceil(t x) + l shingles holds at least l that the other's prefix holds too, with l a fifth of
   the size. Counts come from shuffling packed prefixes by shingle; a class with too few shared shingles is out.
2. by frequency, then hash, within that prefix: of its rarest shingles, up to the place that still leaves l - 1 behind,
   one must be common. Only these are joined. Shingles of a single class come first and join nothing.
3. by hash from the other end, and by another hash: before a pair is verified, their prefixes of x - ceil(t x) + 1 must meet.

What is left is verified exactly on the whole sets and united by distributed union-find (``linking``).

Shingles frequent in a bounded sample of prefixes are not shuffled but counted as shared wherever they occur, which
only admits more candidates: results do not depend on the sample.

Edge cases: a text of fewer than n words is one shingle, the whole sequence; null, empty and blank texts have the empty set and
link with nothing, not with each other; rows that repeat a doc_id are judged by their own sets; a null doc_id is never
the least of a component unless alone; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Rolling, WordHashes, buckets, dealt, discard, hash_words, materialize, mix, only_wanted, rehashed, slices
from tracemill.llm.linking import link, sketch

_hashes = WordHashes(seed=5)
SKETCH_BITS = 2048
_OTHER = np.uint64(0xA24BAED4963EE407)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z taken as a-z."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    rolls = Rolling(hash_words(words, _hashes))
    if len(words) < n:
        return rolls.ranges(np.array([0]), np.array([len(words)])) ^ np.uint64(len(words))
    return np.unique(rolls.window(n))


class Limits:
    """Integer sizes for similarity ``num`` / ``den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, size: int) -> int:
        """Fewest common shingles with a similar set; a similar set is no smaller either."""
        return -(-self.num * size // self.den)

    def extra(self, size: int) -> int:
        return max(1, size // 5)

    def prefix(self, size: int) -> int:
        return size - self.least(size) + self.extra(size)

    def needed(self, size: int) -> int:
        """Common shingles of two prefixes: what the smaller similar set guarantees."""
        return self.extra(self.least(size))


def _signature(grams: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63)


def _sets(rows: DataFrame, n: int, limits: Limits) -> DataFrame:
    """(doc_id, key, own, n_shingles, c1, c2, prefix): the class of each document's set and its prefix by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            sizes, c1, c2, prefix = [], [], [], []
            for text in batch.column("__text").to_pylist():
                grams = shingles(text, n)
                a, b = _signature(grams)
                sizes.append(len(grams))
                c1.append(a)
                c2.append(b)
                prefix.append(grams[: limits.prefix(len(grams))].tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "key", "own")), pa.array(sizes, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(prefix, pa.binary())],
                names=["doc_id", "key", "own", "n_shingles", "c1", "c2", "prefix"],
            )

    return rows.mapInArrow(run, "doc_id long, key long, own boolean, n_shingles int, c1 long, c2 long, prefix binary")


def _candidates(sets: DataFrame, limits: Limits, hot_sample: int, hot_share: float) -> DataFrame:
    """(key, id, n): the shingles on which classes may be joined, by orders 1 and 2."""
    spark = sets.sparkSession
    # 12 bytes a shingle of a prefix
    parts = buckets(spark, 12 * limits.prefix(sets.agg(F.sum("n_shingles")).first()[0] or 0))
    some = [np.frombuffer(r.prefix, np.uint64) for r in sets.where("n_shingles > 0").select("prefix").limit(hot_sample).collect()]
    grams, counts = np.unique(np.concatenate(some), return_counts=True) if some else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    # each sampled prefix is a bounded share of a text, so this set is too
    hot = spark.sparkContext.broadcast(grams[counts >= max(20, hot_share * len(some))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "prefix"):
            seen: set[int] = set()
            ids, sizes, listed = [], [], []
            for c, size, prefix in zip(*(batch.column(x).to_pylist() for x in ("c1", "n_shingles", "prefix"))):
                if prefix is not None and c not in seen:
                    seen.add(c)
                    ids.append(c)
                    sizes.append(size)
                    listed.append(np.frombuffer(prefix, np.uint64))
            if not ids:
                continue
            grams = np.concatenate(listed)
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in listed])
            ids_, sizes_ = np.array(ids, np.int64), np.array(sizes, np.int32)
            often = np.isin(grams, hot.value)
            bucket = (mix(grams) % np.uint64(parts)).astype(np.int32)
            bucket[often] = (ids_[owner[often]] % parts).astype(np.int32)  # hot ones need no meeting place
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for rows in np.split(order, cuts):
                who, local = np.unique(owner[rows], return_inverse=True)
                for column, value in zip(out, (int(bucket[rows[0]]), grams[rows].tobytes(), (local.astype(np.int32) * 2 + often[rows]).astype(np.int32).tobytes(), ids_[who].tobytes(), sizes_[who].tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "grams", "owners", "ids", "sizes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, owners, ids, sizes, flags = [], [], [], [], []
        first = 0
        for batch in batches:
            for g, o, i, s in zip(*(batch.column(c).to_pylist() for c in ("grams", "owners", "ids", "sizes"))):
                both = np.frombuffer(o, np.int32)
                grams.append(np.frombuffer(g, np.uint64))
                owners.append((both >> 1).astype(np.int64) + first)
                flags.append((both & 1).astype(bool))
                ids.append(np.frombuffer(i, np.int64))
                sizes.append(np.frombuffer(s, np.int32))
                first += len(ids[-1])
        if not grams:
            return
        g, o, i, s, often = map(np.concatenate, (grams, owners, ids, sizes, flags))
        classes, place = np.unique(i, return_inverse=True)
        size = np.zeros(len(classes), np.int32)
        size[place] = s
        own = place[o]
        order = np.lexsort((own, g))
        g, own, often = g[order], own[order], often[order]
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
        g, own, often = g[fresh], own[fresh], often[fresh]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        many = np.diff(np.concatenate([start, [len(g)]]))
        count = np.repeat(many, many)
        count[often] = np.iinfo(np.int32).max
        shared = count > 1
        g, own, count = g[shared], own[shared], count[shared]
        bucket = (classes[own] % parts).astype(np.int32)
        order = np.lexsort((own, bucket))
        g, own, count, bucket = g[order], own[order], count[order], bucket[order]
        for rows in np.split(np.arange(len(g)), np.flatnonzero(np.diff(bucket)) + 1):
            if len(rows):
                cols = [np.array([bucket[rows[0]]], np.int32)], g[rows], classes[own[rows]], size[own[rows]], count[rows].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0][0]), *(pa.array([c.tobytes()], pa.binary()) for c in cols[1:])], names=["bucket", "grams", "ids", "sizes", "counts"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for column, name, kind in zip(held, ("grams", "ids", "sizes", "counts"), (np.uint64, np.int64, np.int32, np.int32)):
                column.extend(np.frombuffer(x, kind) for x in batch.column(name).to_pylist())
        if not held[0]:
            return
        g, ids, n, count = map(np.concatenate, held)
        order = np.lexsort((g, count, ids))
        g, ids, n = g[order], ids[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        shared = np.diff(np.concatenate([start, [len(ids)]]))
        spare = shared - np.array([limits.needed(int(x)) for x in n[start]]) + 1
        keep = np.arange(len(ids)) - np.repeat(start, shared) < np.repeat(spare, shared)
        g, ids, n = g[keep], ids[keep], n[keep]
        for at in range(0, len(g), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (g.view(np.int64), ids, n)], names=["key", "id", "n"])

    packed = sets.select("c1", "n_shingles", "prefix").mapInArrow(pack, "bucket int, grams binary, owners binary, ids binary, sizes binary")
    met = dealt(packed, parts).mapInArrow(meet, "bucket int, grams binary, ids binary, sizes binary, counts binary")
    return dealt(met, parts).mapInArrow(choose, "key long, id long, n int")


def _payload(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, payload, n, sketch): the whole set of each wanted class, from the text of its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            ids, sets, sizes, bits = [], [], [], []
            for c, text in zip(batch.column("id").to_pylist(), batch.column("__text").to_pylist()):
                grams = shingles(text, n)
                if _signature(grams)[0] == c:
                    ids.append(c)
                    sets.append(grams.tobytes())
                    sizes.append(len(grams))
                    bits.append(sketch(grams, SKETCH_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], names=["id", "payload", "n", "sketch"])

    texts = only_wanted(rows.drop("doc_id"), wanted, "key").join(wanted, ["key", "own"]).select("id", "key", "own", "__text", F.xxhash64("__text").alias("h")).dropDuplicates(["key", "own", "id", "h"])
    return texts.select("id", "__text").mapInArrow(run, "id long, payload binary, n int, sketch binary")


def similar(left: list[bytes], right: list[bytes], num: int, den: int) -> list[bool]:
    """Whether sets, as sorted bytes, reach the similarity; the filters of two more orders go first."""
    limits, out = Limits(num, den), []
    for x, y in zip(left, right):
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(a) > len(b):
            a, b = b, a
        if den * len(a) < num * len(b):
            out.append(False)
            continue
        p, q = len(a) - limits.least(len(a)) + 1, len(b) - limits.least(len(b)) + 1
        met = len(np.intersect1d(a[-p:], b[-q:], assume_unique=True)) > 0
        if met:
            first = np.sort(a * _OTHER)[:p], np.sort(b * _OTHER)[:q]
            met = len(np.intersect1d(*first, assume_unique=True)) > 0
        if not met:
            out.append(False)
            continue
        common = len(np.intersect1d(a, b, assume_unique=True))
        out.append(den * common >= num * (len(a) + len(b) - common))
    return out


def ngram_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, hot_sample: int = 2000, hot_share: float = 0.01, **linking
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links of similarity num / den or more).

    Further options go to ``linking.link``.
    """
    limits = Limits(num, den)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    # rows without an id are found again by the hash of their text
    rows = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("__text"))).withColumn("own", F.col("doc_id").isNotNull())
    sets = materialize(_sets(rows, n, limits))
    owners = sets.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.min(F.when(~F.col("own"), F.col("key"))).alias("other"))
    owners = materialize(owners)
    candidates = _candidates(sets, limits, hot_sample, hot_share)
    candidates = materialize(candidates)

    def payload_of(ids: DataFrame) -> DataFrame:
        return _payload(rows, materialize(ids.join(owners.select(F.col("c1").alias("id"), F.coalesce("first", "other").alias("key"), F.col("first").isNotNull().alias("own")), "id")), n)

    linked = link(
        candidates, payload_of, lambda x: np.frombuffer(x, np.uint64), lambda x, y: similar(x, y, num, den), num, den,
        size_filter=lambda a, b: (den * F.col(f"n{a}") >= num * F.col(f"n{b}")) & (den * F.col(f"n{b}") >= num * F.col(f"n{a}")),
        **linking,
    )
    linked = materialize(linked.select(F.col("id").alias("c1"), "component"))
    discard(candidates)
    least = owners.join(linked, "c1").groupBy("component").agg(F.min("first").alias("component_id"))
    known = materialize(
        owners.drop("other").join(linked.join(rehashed(least, "component"), "component"), "c1", "left").select("c1", "c2", F.coalesce("component_id", "first").alias("component_id"))
    )
    return sets.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "c1", "c2").join(known, ["c1", "c2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
