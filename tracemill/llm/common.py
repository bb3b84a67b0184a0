"""Helpers that the operators of this subpackage share.

Intermediate tables and connected components come from the library: ``materialize`` writes under the folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.graphs import connected_components, rehashed
from tracemill.operators.scans import only_wanted
from tracemill.sources.shared import discard, materialize, shared_dir

__all__ = ["connected_components", "discard", "materialize", "only_wanted", "rehashed", "shared_dir"]

#: Text handed to numpy at once: bounds a worker's memory whatever the Arrow batches hold.
SLICE_BYTES = 1 << 20
#: Packed bytes that a task should get of a table dealt by ``buckets``; numpy needs some eight times as much to sort them.
BUCKET_BYTES = 8 << 20
_INVERSE_BASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, by any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_text(docs: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, str]:
    """The ``keep`` columns and the text, which is not sent twice if it is kept, and the name that it has there."""
    return (docs.select(*keep), text) if text in keep else (docs.select(*keep, F.col(text).alias("__text")), "__text")


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession, size: int) -> int:
    """Into how many buckets ``size`` packed bytes are dealt: the session's shuffle partitions, or more if these would be too large for a worker."""
    return max(shuffle_parts(spark), -(-size // BUCKET_BYTES))


def dealt(packed: DataFrame, parts: int) -> DataFrame:
    """Rows of ``packed`` in the partition that their ``bucket`` numbers: hashing the number instead would put several buckets into one task and none into another."""
    return packed.repartitionById(parts, "bucket")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about SLICE_BYTES of ``column``, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64) + 64)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class WordHashes(dict):
    """word -> 64-bit hash, computed once a word; emptied when it reaches ``limit`` entries (a cache, not a cap)."""

    def __init__(self, seed: int = 0, limit: int = 200_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value


def hash_words(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "base" not in _powers or len(_powers["base"]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        with np.errstate(over="ignore"):
            base = np.full(size, 0x9E3779B97F4A7C15, np.uint64)
            inverse = np.full(size, _INVERSE_BASE, np.uint64)
            base[0] = inverse[0] = 1
            np.cumprod(base, out=base)
            np.cumprod(inverse, out=inverse)
        _powers["base"], _powers["inverse"] = base, inverse
    return _powers["base"], _powers["inverse"]


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the ``n`` consecutive values from each position; empty if there are fewer."""
    return Rolling(values).window(n)


class Rolling:
    """Hashes of any range of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        base, inverse = _power_table(len(values) + 1)
        self.base, self.n = base, len(values)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * inverse[: self.n], out=self.sums[1:])

    def window(self, n: int) -> np.ndarray:
        if self.n < n:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[: self.n - n + 1]) * self.base[: self.n - n + 1])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.base[start] + (stop - start).astype(np.uint64))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost least hash of every ``window`` consecutive ones, ascending, each once.

    Equal stretches of ``window`` hashes always select the same place, wherever they stand.
    """
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64)
    if window == 1:
        return np.arange(n)
    # van Herk: least of a window from block-wise running minima of each side
    pad = -n % window
    padded = np.concatenate([hashes, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, window)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - window + 1], ahead[window - 1 : n])
    # a place is selected if it is the last place of its value within a window that has it as least
    order = np.arange(n)
    last = np.full(len(least), -1)
    for step in range(window):  # the rightmost match wins
        at = hashes[step : step + len(least)] == least
        last[at] = order[step : step + len(least)][at]
    keep = np.ones(len(last), bool)
    keep[1:] = last[1:] != last[:-1]
    return last[keep]


def join_hot(rows: DataFrame, small: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """``rows`` joined to ``small``, a row for each of the ``keys`` with its number of rows ``m``, which is dropped: a key of more than a thousandth of all rows never lands in one task.

    There are fewer than ``share`` such keys, so they are broadcast; rows of the others are shuffled. Both inputs are read more than once.
    """
    total = rows.count()
    hot = small.where(F.col("m") * share > total).drop("m")
    same = [F.col(f"r.{k}") == F.col(f"h.{k}") for k in keys]
    extra = [c for c in small.columns if c not in (*keys, "m")]
    columns = [F.col(f"r.{c}") for c in rows.columns]
    often = rows.alias("r").join(F.broadcast(hot).alias("h"), same).select(*columns, *(F.col(f"h.{c}") for c in extra))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return often.unionByName(rest.join(rehashed(small.where(F.col("m") * share <= total).drop("m"), keys[0]), keys).select(*rows.columns, *extra))
