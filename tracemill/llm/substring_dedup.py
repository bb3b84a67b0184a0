"""Removal of passages that earlier documents hold too, by seed and extend (operator 2).

Seeds are winnowed anchors: with k-grams of k words and windows of w k-grams, k + w - 1 = ``length``, two places that share
``length`` words select the same anchor among them. Anchors are joined by hash. Extension never enumerates pairs: an
anchor's context reaches as far as any window of ``length`` words around it can; occurrences with equal contexts are one
class, whose later members repeat its first member over the whole context. Only where an anchor has several contexts
are the windows of each class's first document written out, to find which of them an earlier class has too. Windows that
follow each other merge into maximal repeats.

All groupings are by hash with partial aggregation and joins; no group's members are gathered anywhere, and anchors
and classes of more than a thousandth of all places are joined where these are, without a shuffle. 64-bit hashes
of anchor and context together, or two 64-bit hashes of a window, stand for equality.

Edge cases: null and empty texts have no words; texts under ``length`` words lose nothing; a window that repeats only inside its
own document stays; rows that repeat a doc_id are judged each by its own text, and never against each other; a null
doc_id is neither smaller nor larger than another: such rows stay whole; empty tables give empty tables; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Rolling, WordHashes, hash_words, join_hot, materialize, mix, rehashed, slices, winnow

_hashes = WordHashes(), WordHashes(seed=11)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D."""
    return text.encode().split() if text else []


def _anchors(rows: DataFrame, length: int, k: int) -> DataFrame:
    reach = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            for doc, rid, text in zip(docs, rids, batch.column("__text").to_pylist()):
                words = words_of(text)
                if len(words) < length:
                    continue
                rolls = Rolling(hash_words(words, _hashes[0]))
                grams = rolls.window(k)
                at = winnow(grams, reach + 1)
                start, stop = np.maximum(at - reach, 0), np.minimum(at + length, len(words))
                context = mix(rolls.ranges(start, stop) + (at - start).astype(np.uint64))
                for column, values in zip(out, (grams[at], context, np.full(len(at), doc), np.full(len(at), rid), at, stop)):
                    column.append(values)
            if out[0]:
                flat = [np.concatenate(c) for c in out]
                cols = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, t) for c, t in zip(flat, kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["anchor", "context", "doc_id", "rid", "at", "stop"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return rows.where("doc_id IS NOT NULL").mapInArrow(run, "anchor long, context long, doc_id long, rid long, at int, stop int")


def _windows(rows: DataFrame, places: DataFrame, length: int, k: int) -> DataFrame:
    """(a, b, doc_id, rid, start): both hashes of every window around the given anchors of each text."""
    reach = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            a, b, docs, rids, starts = [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "rid", "__text", "places"))
            for doc, rid, text, places in zip(*columns):
                words = words_of(text)
                at = np.array([p["at"] for p in places], np.int64)
                near = np.unique((at[:, None] - np.arange(reach + 1)).ravel())
                near = near[(near >= 0) & (near <= len(words) - length)]
                for hashes, column in zip(_hashes, (a, b)):
                    column.append(Rolling(hash_words(words, hashes)).window(length)[near])
                starts.append(near)
                docs.append(np.full(len(near), doc))
                rids.append(np.full(len(near), rid))
            cols = [pa.array(np.concatenate(c).view(np.int64)) for c in (a, b, docs, rids)] + [pa.array(np.concatenate(starts), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "doc_id", "rid", "start"])

    wanted = rehashed(places.groupBy("rid").agg(F.collect_list(F.struct("at")).alias("places")), "rid")
    return rows.dropDuplicates(["rid"]).join(wanted, "rid").select("doc_id", "rid", "__text", "places").mapInArrow(run, "a long, b long, doc_id long, rid long, start int")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    return rows.withColumn("rid", F.xxhash64("doc_id", "__text"))


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """(rid, start, stop): stretches of words, of ``length`` at least, that documents of smaller id hold too.

    rid is xxhash64(doc_id, text). The stretches of a document overlap; ``remove_repeats`` merges them.
    """
    k = length // 2 + 1
    reach = length - k
    rows = _rows(docs, doc_id, text)
    anchors = materialize(_anchors(rows, length, k))
    groups = materialize(
        anchors.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("context").alias("c0"), F.max("context").alias("c1"), F.count("*").alias("m"))
        .where("first < last").select("anchor", "first", (F.col("c0") == F.col("c1")).alias("alike"), "m")
    )
    shared = materialize(join_hot(anchors, groups, ["anchor"]))
    start = F.greatest(F.col("at") - reach, F.lit(0)).alias("start")
    whole = shared.where("alike AND doc_id > first").select("rid", start, "stop")
    mixed = shared.where("NOT alike").drop("first", "alike")
    classes = materialize(mixed.groupBy("anchor", "context").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")))
    mixed = materialize(join_hot(mixed, classes, ["anchor", "context"]))
    later = mixed.where("doc_id > first").select("rid", start, "stop")
    windows = materialize(_windows(rows.where("doc_id IS NOT NULL"), mixed.where("doc_id = first"), length, k))
    least = materialize(windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"))
    partly = windows.join(least, ["a", "b"]).where("doc_id > first").select("rid", "start", (F.col("start") + length).alias("stop"))
    return whole.unionByName(later).unionByName(partly)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, spans (maximal removed stretches, array of start and stop), kept text."""
    rows = _rows(docs, doc_id, text)
    spans = repeats(docs, doc_id=doc_id, text=text, length=length).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(rehashed(spans, "rid"), "rid", "left").select("doc_id", "__text", "spans")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start: int, stop: int>>, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            counts, removed, kept, merged = [], [], [], []
            for text, spans in zip(batch.column("__text").to_pylist(), batch.column("spans").to_pylist()):
                words = words_of(text)
                runs: list[dict[str, int]] = []
                for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if runs and a <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(runs[-1]["stop"], b)
                    else:
                        runs.append({"start": a, "stop": b})
                left, at = [], 0
                for r in runs:
                    left += words[at : r["start"]]
                    at = r["stop"]
                left += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
                merged.append(runs)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            cols = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return joined.mapInArrow(run, schema)
