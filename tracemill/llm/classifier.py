"""Quality classifier by supervised subword embeddings (operator 6).

A document is the mean of learned vectors of its hashed features: words, pairs of neighbouring words (one feature for all words said twice) and character 3- to 5-grams of
each word between < and >. A softmax over two classes stands on the mean; vectors and output are trained together by
numpy stochastic gradient descent on the driver, on at most ``sample`` labelled documents a class (those with least
hash of doc_id); class weights restore the shares of all labelled rows. Everything else covers all rows. As the output
is linear in the mean, a fitted model is one number a bucket, 2 MB whatever the data, which is sent to every task.

Edge cases: null and empty texts have no features and get the bias's score; labels that are null or neither 0 nor 1 are
ignored; repeated labels all count; with a single class, or no labels, every score is that class's share (0.5 without any);
repeated documents get equal scores; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import mix, slices, with_text

BITS, SIZES = 18, (3, 4, 5)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, word that each belongs to, hash of each word): the word itself and its character n-grams."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letters = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), length)
    starts = np.cumsum(length) - length
    spread = mix(letters + np.uint64(1))
    weights = mix(np.arange(int(length.max()), dtype=np.uint64) + np.uint64(77))
    whole = mix(np.add.reduceat(spread * weights[np.arange(len(letters)) - np.repeat(starts, length)], starts))
    buckets, owners = [whole], [np.arange(len(words))]
    for n in SIZES:
        if len(letters) >= n:
            gram = spread[: len(letters) - n + 1].copy()
            for i in range(1, n):
                gram = gram * np.uint64(0x9E3779B97F4A7C15) + spread[i : len(letters) - n + 1 + i]
            same = owner[: len(gram)] == owner[n - 1 :]
            buckets.append(mix(gram[same] + np.uint64(n)))
            owners.append(owner[: len(gram)][same])
    return (np.concatenate(buckets) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners), whole


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; a word that repeats the one before is the same feature for all words."""
    left, right = hashes[:-1], hashes[1:]
    return (mix(np.where(left == right, np.uint64(0), left * np.uint64(3) + right)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and how often each occurs."""
    buckets, _, hashes = subwords((text or "").split())
    return np.unique(np.concatenate([buckets, pair_buckets(hashes)]) if len(hashes) > 1 else buckets, return_counts=True)


class Model:
    """What scoring needs: the part of every bucket in the logit of class 1, and the bias."""

    def __init__(self, parts: np.ndarray, bias: float):
        self.parts, self.bias = parts, bias

    def score(self, text: str | None) -> float:
        buckets, counts = features(text)
        mean = float(self.parts[buckets] @ counts) / counts.sum() if len(buckets) else 0.0
        return float(1 / (1 + np.exp(-mean - self.bias)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], weights: tuple[float, float], *, dim: int = 8, epochs: int = 8, rate: float = 80.0, batch: int = 16, seed: int = 1) -> Model:
    """Stochastic gradient descent over (buckets, counts, label) rows; ``weights`` are those of labels 0 and 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    output, bias = rng.normal(0, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, step = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = [rows[i] for i in order[at : at + batch]]
            now = rate * (1 - step / steps)
            step += 1
            ids = np.concatenate([r[0] for r in some])
            own = np.repeat(np.arange(len(some)), [len(r[0]) for r in some])
            share = np.concatenate([r[1] / max(1, r[1].sum()) for r in some]).astype(np.float32)
            mean = np.stack([np.bincount(own, share * vectors[ids, d], len(some)) for d in range(dim)], axis=1).astype(np.float32)
            logits = mean @ output + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            label = np.array([r[2] for r in some])
            p[np.arange(len(some)), label] -= 1
            p *= np.array(weights, np.float32)[label][:, None] / len(some)
            back = p @ output.T
            # vectors learn faster than the output, as every feature is a small share of its document
            output -= 0.02 * now * (mean.T @ p)
            bias -= 0.01 * now * p.sum(0)
            np.subtract.at(vectors, ids, now * share[:, None] * back[own])
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = 1500, **options) -> Model:
    """A model from documents with labels: at most ``sample`` of each class, a bound that doesn't grow with the input."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).where("__id IS NOT NULL AND __label IN (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    picks = [known.where(F.col("__label") == c).orderBy(F.xxhash64("__id"), "__id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))  # 2 * sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            got = [features(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__label"), pa.array([g[0].astype(np.int32).tobytes() for g in got], pa.binary()), pa.array([g[1].astype(np.int32).tobytes() for g in got], pa.binary())],
                names=["id", "label", "buckets", "counts"],
            )

    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(chosen, "__id").select("__id", "__label", "__text")
    found = rows.mapInArrow(run, rows.select(F.col("__id").alias("id"), F.col("__label").alias("label")).schema.add("buckets", "binary").add("counts", "binary")).collect()
    found.sort(key=lambda r: (r.id, r.label, bytes(r.buckets)))
    data = [(np.frombuffer(r.buckets, np.int32).astype(np.int64), np.frombuffer(r.counts, np.int32), r.label) for r in found]
    if not data:
        return Model(np.zeros(1 << BITS), float(np.log(max(counts[1], 1) / max(counts[0], 1))))
    used = [max(1, sum(r[2] == c for r in data)) for c in (0, 1)]
    return train(data, tuple(counts[c] / total / (used[c] / len(data)) for c in (0, 1)), **options)


class Scorer:
    """Scores slices of texts; remembers each word's sum over its subwords."""

    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self):
        self.place: dict[str, int] = {}
        self.sums, self.sizes, self.hashes = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16, np.uint64)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        words, counts = [], []
        for text in texts:
            got = (text or "").split()
            words += got
            counts.append(len(got))
        new = list(set(words).difference(self.place))
        if len(self.place) + len(new) > self.limit:
            self._clear()
            new = list(set(words))
        if new:
            first = len(self.place)
            last = first + len(new)
            if last > len(self.sums):
                for name in ("sums", "sizes", "hashes"):
                    setattr(self, name, np.resize(getattr(self, name), 2 * last))
            buckets, owner, hashes = subwords(new)
            self.sums[first:last] = np.bincount(owner, self.model.parts[buckets], len(new))
            self.sizes[first:last] = np.bincount(owner, minlength=len(new))
            self.hashes[first:last] = hashes
            self.place.update(zip(new, range(first, last)))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        own = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(own, self.sums[at], len(texts))
        size = np.bincount(own, self.sizes[at], len(texts))
        if len(at) > 1:
            same = own[:-1] == own[1:]
            pairs = self.model.parts[pair_buckets(self.hashes[at])]
            total += np.bincount(own[:-1][same], pairs[same], len(texts))
            size += np.bincount(own[:-1][same], minlength=len(texts))
        return 1 / (1 + np.exp(-total / np.maximum(size, 1) - self.model.bias))


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with score double and predicted int (1 where score >= threshold)."""
    keep = tuple(docs.columns) if keep is None else keep
    rows, column = with_text(docs, keep, text)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    sent = docs.sparkSession.sparkContext.broadcast((model.parts, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for batch in slices(batches, column):
            got = scorer(batch.column(column).to_pylist())
            cols = [batch.column(c) for c in keep] + [pa.array(got), pa.array((got >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
