"""Spelling variants by a dictionary of pairs of trie nodes (operator 13).

The words of the corpus are sorted, once as they are and once reversed, and the nodes of the two tries are numbered in that order: a word takes over the
nodes of what it shares with the word before and numbers the rest. Sorted ranges are numbered apart; where a range's first word shares a beginning with the
last word of the range before, its nodes are renamed to those, which takes one row a range on the driver.

A pair (node of a prefix, node of a suffix) names a string exactly. A word gives, at each place, the pair that skips one code point, and at each gap the pair
that makes up the whole word. Words that skip to one pair differ by one replaced code point; a word whose whole pair is another's skipped pair lacks that
code point. A pair has at most one whole word and one skipping word for each letter, so groups are bounded by the alphabet, and each word gets
from a group its number of near words and the best of them: no pairs of words are made.

Edge cases: null and empty texts have no words; a null doc_id counts as the empty string in what is hashed; repeated rows count each; words of any length are
taken whole; ties of n go to the smallest word in code-point order; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import discard, materialize, shuffle_parts, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words that a task counts before it gives them out.
HELD = 1 << 18
WHOLE, SKIP, LAST = 0, 1, 2  # a pair is the whole word; it skips a code point; and that one is the last of a run of equal ones


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 97, shortest: int = 5, fewest: int = 3) -> DataFrame:
    """(word, n): the distinct words of at least ``shortest`` code points and ``fewest`` occurrences. Counted in each task, then by Spark."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches, "__text"):
            for i, t in zip(batch.column("id").to_pylist(), batch.column("__text").to_pylist()):
                start = zlib.crc32(f"{i}:".encode())
                for found, n in Counter(RUN.findall(t.encode().lower().decode()) if t else ()).items():  # bytes.lower changes A-Z alone
                    h = zlib.crc32(found.encode(), start)
                    if h % every == 0:
                        k = h % len(found)
                        found = found[:k] + found[k + 1 :]
                    if len(found) >= shortest:
                        held[found] = held.get(found, 0) + n
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def _numbered(words: DataFrame, by: str, parts: int) -> tuple[DataFrame, dict[int, int]]:
    """``words`` in order of ``by`` with part, place (ascending in that order) and nodes, those of its prefixes of 1, 2, ... code points; and the nodes to rename."""
    schema = T.StructType(list(words.schema)).add("part", "integer").add("place", "long").add("nodes", T.ArrayType(T.LongType()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, stack, made, place = "", [], part << 40, part << 40
        for whole in batches:
            for batch in slices(iter([whole]), by):
                flat, ends = [], [0]
                for word in batch.column(by).to_pylist():
                    k = _shared(last, word)
                    stack = stack[:k] + list(range(made, made + len(word) - k))
                    made += len(word) - k
                    last = word
                    flat += stack
                    ends.append(len(flat))
                n = batch.num_rows
                nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(np.arange(place, place + n)), nodes], names=schema.names)
                place += n

    found = materialize(words.repartitionByRange(parts, by).sortWithinPartitions(by).mapInArrow(scan, schema))
    borders = found.groupBy("part").agg(F.min(by).alias("first"), F.max(by).alias("last"), F.max_by("nodes", by).alias("nodes")).orderBy("part").collect()  # one row a range
    same: dict[int, int] = {}
    for a, b in zip(borders, borders[1:]):
        for k in range(_shared(a["last"], b["first"])):
            node = a["nodes"][k]
            same[(b["part"] << 40) + k] = same.get(node, node)
    return found, same


def _pairs(words: DataFrame, prefixes: dict[int, int], suffixes: dict[int, int]) -> DataFrame:
    """(p, s, id, n, kind): the pairs of each word of (id, word, n, pre, suf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                p, s, kinds, many = [], [], [], []
                for word, pre, suf in zip(*(batch.column(c).to_pylist() for c in ("word", "pre", "suf"))):
                    pre = [-1, *(prefixes.get(x, x) for x in pre)]
                    suf = [*(suffixes.get(x, x) for x in reversed(suf)), -1]
                    p += pre[:-1] + pre
                    s += suf[1:] + suf
                    kinds += [LAST if a != b else SKIP for a, b in zip(word, word[1:])] + [LAST] + [WHOLE] * len(pre)
                    many.append(2 * len(pre) - 1)
                ids, n = (np.repeat(batch.column(c).to_numpy(), many) for c in ("id", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(s, pa.int64()), pa.array(ids), pa.array(n), pa.array(kinds, pa.int8())], names=["p", "s", "id", "n", "kind"])

    return words.select("id", "word", "n", "pre", "suf").mapInArrow(run, "p long, s long, id long, n long, kind byte")


def _shares(p: np.ndarray, s: np.ndarray, ids: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """id, number of near words, n and id of the best: what each word gets from each of its pairs. Rows by pair, then n descending, then id."""
    start = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
    alone = start & np.concatenate([start[1:], [True]])
    ids, n, kind, start = ids[~alone], n[~alone], kind[~alone], np.flatnonzero(start[~alone])
    if not len(ids):
        return ids, ids, ids, ids
    none = len(ids)
    at = np.arange(none)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, none)))
    first = lambda which: np.minimum.reduceat(np.where(which, at, none), start)
    skips, last = kind != WHOLE, kind == LAST
    one = first(skips)
    two = first(skips & (at != one[group]))
    whole, best_last = first(~skips)[group], first(last)[group]
    number = np.add.reduceat(skips.astype(np.int64), start)[group]
    lacking = np.add.reduceat(last.astype(np.int64), start)[group]
    near = np.where(skips, number - 1 + (last & (whole < none)), lacking)
    best = np.where(skips, np.where(at == one[group], two[group], one[group]), best_last)
    best = np.where(last, np.minimum(best, whole), best)  # an earlier place is better
    some = near > 0
    best = best[some]
    return ids[some], near[some], n[best], ids[best]


def _near(pairs: DataFrame, parts: int) -> DataFrame:
    """(id, n_near, best_n, best) of each word with near words."""
    rows = pairs.repartition(parts, "p", "s").sortWithinPartitions("p", "s", F.desc("n"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            if not len(new[0]):
                continue
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cut = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            whole = cut[-1] + 1 if len(cut) else 0  # the last pair may go on
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _shares(*(x[:whole] for x in held))], names=["id", "near", "best_n", "best"])
                held = [x[whole:] for x in held]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _shares(*held)], names=["id", "near", "best_n", "best"])

    got = rows.mapInArrow(run, "id long, near long, best_n long, best long")
    return got.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("b"))).alias("m")).select(
        "id", "n_near", F.col("m.best_n").alias("best_n"), (-F.col("m.b")).alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form), whose n at least doubles at each step: a step of pointer doubling a round, so at most seven."""
    state = materialize(forms.select("id", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = materialize(state.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(state)
        state = moved
        if not state.where("moved").limit(1).count():
            return state.select("id", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """Per word of (word, n): word, form, root, n, n_near, form_n.

    Near words differ by one inserted, deleted or replaced code point. form: the near word of largest n, if that is at least ``times`` n;
    root: where following forms ends.
    """
    parts = shuffle_parts(words.sparkSession)
    ahead, prefixes = _numbered(words.select("word", "n"), "word", parts)
    behind, suffixes = _numbered(ahead.select(F.col("place").alias("id"), F.reverse("word").alias("reversed")), "reversed", parts)
    known = ahead.select(F.col("place").alias("id"), "word", "n", F.col("nodes").alias("pre"))
    near = _near(_pairs(known.join(behind.select("id", F.col("nodes").alias("suf")), "id"), prefixes, suffixes), parts)
    form = F.col("best_n") >= times * F.col("n")
    rows = materialize(known.drop("pre").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")
    ))
    discard(ahead, behind)
    linked = rows.where("form IS NOT NULL")
    roots = _roots(linked)
    names = lambda key, name: rows.select(F.col("id").alias(key), F.col("word").alias(name))
    told = roots.join(names("root", "root_word"), "root").select("id", "root_word")
    out = linked.join(names("form", "form_word"), "form").join(told, "id").select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    free = rows.where("form IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return out.unionByName(free)


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of all words of ``documents``."""
    return variants(word_counts(docs))
