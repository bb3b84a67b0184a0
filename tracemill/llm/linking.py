"""From candidate groups to components, without all pairs of a group.

Candidates are rows (key, id): ids that share a key may be alike. Keys of at most ``small`` ids are compared by their pairs. Of
larger keys, first every component meets, in the key it shares most often, one head that is drawn by hash (a star), and
verified pairs are united, as long as a round joins a tenth of what is open: a group of thousands alike costs a comparison
a member and round. What larger keys then still connect (a family) is compared in blocks of bounded size, a task getting two blocks: members
outside the family's largest component against all. Ids of one component need no comparison, as they are connected
anyway. No link between components is lost.

Pairs are verified in two steps: by sketches of fixed size, which rule out most false candidates and never a link, then by whole
payloads. A sketch is a bitmap of hashed members: a bit set in one alone proves a member that the other lacks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import SLICE_BYTES, connected_components, discard, materialize, mix, rehashed

#: Set members in a block of a family: 8 MB, of which counting takes some ten times as much.
BLOCK_MEMBERS = 1 << 20


def sketch(members: np.ndarray, bits: int) -> bytes:
    """Bitmap of a set of uint64; ``bits`` is a power of two."""
    at = np.zeros(bits, bool)
    at[(mix(members) >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = True
    return np.packbits(at).tobytes()


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes n and m with bitmaps x and y (last axis: uint64 words) can reach the similarity; true for all that do."""
    common = np.minimum(n - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))
    return den * common >= num * (n + m - common)


def _bitmaps(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def _runs(size: np.ndarray, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Places (from, to) of consecutive rows, at most ``rows`` and of ``most`` bytes in all, or a single one: payloads may be long."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        stop = max(at + 1, min(stop, at + rows))
        yield at, stop
        at = stop


def verify(pairs: DataFrame, payload: DataFrame, alike: Callable[[list, list], list[bool]], num: int, den: int) -> DataFrame:
    """The rows of pairs (a, b, ...) whose payloads are alike: each side is joined to the pair, none is broadcast by force."""
    names = pairs.columns

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
                yield batch.select(names).filter(pa.array(possible(_bitmaps(batch.column("s_a")), _bitmaps(batch.column("s_b")), n, m, num, den)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = sum(pc.fill_null(pc.binary_length(whole.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y"))
            for at, stop in _runs(size, 512, SLICE_BYTES):
                batch = whole.slice(at, stop - at)
                same = alike(batch.column("x").to_pylist(), batch.column("y").to_pylist())
                yield batch.select(names).filter(pa.array(same, pa.bool_()))

    brief = [payload.select(F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("sketch").alias(f"s_{i}")) for i in "ab"]
    near = materialize(pairs.join(brief[0], "a").join(brief[1], "b").select(*names, "n_a", "n_b", "s_a", "s_b").mapInArrow(rough, pairs.schema))
    left, right = (payload.select(F.col("id").alias(i), F.col("payload").alias(p)) for i, p in (("a", "x"), ("b", "y")))
    found = materialize(near.join(left, "a").join(right, "b").select(*names, "x", "y").mapInArrow(exact, pairs.schema))
    discard(near)
    return found


def _star(rows: DataFrame, seed: int) -> DataFrame:
    """rows (key, id, component) -> (a, b, u, v): for each component u, its pair with the head, of v, of the key group it shares most often."""
    heads = rows.groupBy("key", "component").agg(F.min("id").alias("id"))
    first = heads.groupBy("key").agg(F.min(F.struct(F.xxhash64("component", F.lit(seed)).alias("h"), "component", "id")).alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    met = heads.join(rehashed(first, "key"), "key").where("component <> f.component").select("component", "id", F.col("f.component").alias("other"), F.col("f.id").alias("head"))
    met = met.groupBy("component", "other").agg(F.count("*").alias("n"), F.min(F.struct("id", "head")).alias("p"))
    best = met.groupBy("component").agg(F.max(F.struct("n", F.col("p.id").alias("a"), F.col("p.head").alias("b"), "other")).alias("m"))
    return best.select("m.a", "m.b", F.col("component").alias("u"), F.col("m.other").alias("v"))


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of ``width`` columns at a time."""
    sets = left + right
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    row, place = row[keep], rank[place[keep]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, (low, low + width))
        here = np.zeros((len(sets), width), np.float32)
        here[row[a:b], place[a:b] - low] = 1
        total += here[: len(left)] @ here[len(left) :].T
    return np.rint(total).astype(np.int64)


def _joining(pairs: list[tuple[int, int]], ids: list[int], components: list[int]) -> list[tuple[int, int]]:
    """Of links between places, those that join components not joined yet."""
    up: dict[int, int] = {}

    def root(a: int) -> int:
        while (b := up.get(a, a)) != a:
            a = b
        return a

    out = []
    for i, j in pairs:
        a, b = sorted((root(components[i]), root(components[j])))
        if a != b:
            up[b] = a
            out.append((ids[i], ids[j]))
    return out


def _blocks(members: DataFrame, payload: DataFrame, block: int, most: int = BLOCK_MEMBERS) -> DataFrame:
    """(family, top, few, many): each family's largest component, and into how many blocks the members outside it and all members are dealt: ``block`` ids or ``most`` set members in one."""
    sizes = members.join(payload.select("id", "n"), "id").groupBy("family", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    largest = sizes.groupBy("family").agg(F.sum("m").alias("all"), F.sum("n").alias("n"), F.max(F.struct("m", "component", "n")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    few, many = (F.greatest(F.ceil(m / block), F.ceil(n / most)).cast("int") for m, n in ((F.col("all") - F.col("top.m"), F.col("n") - F.col("top.n")), (F.col("all"), F.col("n"))))
    return largest.select("family", F.col("top.component").alias("top"), few.alias("few"), many.alias("many"))


def _family_links(members: DataFrame, payload: DataFrame, as_set: Callable[[object], np.ndarray], num: int, den: int, block: int) -> DataFrame:
    """Links (a, b) within families, from members (id, component, family): blocks of members outside the largest component against all."""
    blocks = _blocks(members, payload, block)
    rows = members.join(rehashed(blocks, "family"), "family").withColumn("h", F.xxhash64("id"))
    # i numbers blocks of members outside the largest component, j blocks of all
    one = rows.where("component <> top").select("family", "id", "component", F.pmod("h", "few").alias("i"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("j"), F.lit(True).alias("left"))
    all_ = rows.select("family", "id", "component", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), F.pmod("h", "many").alias("j"), F.lit(False).alias("left"))
    both = one.withColumn("i", F.col("i").cast("int")).unionByName(all_.withColumn("j", F.col("j").cast("int")))

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        left, right = [r for r in rows if r["left"]], [r for r in rows if not r["left"]]
        found: list[tuple[int, int]] = []
        if left and right:
            bits, n, part = [], [], []
            for some in (left, right):
                bits.append(np.frombuffer(b"".join(r["sketch"] for r in some), np.uint64).reshape(len(some), -1))
                n.append(np.array([r["n"] for r in some], np.int64))
                part.append(np.array([r["component"] for r in some], np.int64))
            open_ = np.stack([possible(x, bits[1], k, n[1], num, den) for x, k in zip(bits[0], n[0])]) & (part[0][:, None] != part[1][None, :])
            i, j = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            if len(i):
                common = common_counts([as_set(left[k]["payload"]) for k in i], [as_set(right[k]["payload"]) for k in j])
                alike = open_[np.ix_(i, j)] & (den * common >= num * (n[0][i][:, None] + n[1][j][None, :] - common))
                both = left + right
                found = _joining([(int(i[a]), len(left) + int(j[b])) for a, b in np.argwhere(alike)], [r["id"] for r in both], [r["component"] for r in both])
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return both.join(payload, "id").groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")


def link(
    candidates: DataFrame, payload_of: Callable[[DataFrame], DataFrame], as_set: Callable[[object], np.ndarray], alike: Callable[[list, list], list[bool]], num: int, den: int, *, rounds: int = 4,
    size_filter: Callable[[str, str], Column] | None = None, small: int = 48, block: int = 384,
) -> DataFrame:
    """(id, component) of all ids with a link, from candidates (key long, id long, further columns) and what ``payload_of`` gives for ids: (id, payload, n int, sketch).

    ``as_set`` makes a payload a sorted set of ``n`` uint64, of which ``sketch`` is the bitmap; two ids are linked if their sets' similarity is num / den
    or more, which ``alike`` tells for lists of pairs. ``size_filter`` gives a condition on columns of both sides, named with _a and _b,
    that every link meets. ``rounds``, ``small`` and ``block`` choose how links are found, not which.
    """
    counts = candidates.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("head")).where("m > 1")
    keyed = materialize(candidates.join(rehashed(counts, "key"), "key"))
    payload = materialize(payload_of(keyed.select("id").distinct()))
    large = keyed.where(F.col("m") > small).select("key", "id", "head")
    few = keyed.where(F.col("m") <= small).drop("m", "head")
    edges = []
    if large.isEmpty():
        few = few.withColumn("component", F.col("id"))
    else:
        state = materialize(large.withColumn("component", F.col("id")))
        for seed in range(rounds):
            pairs = materialize(_star(state, seed))
            found = verify(pairs, payload, alike, num, den)
            tried, joined = pairs.count(), found.count()
            discard(pairs)
            if joined:
                edges.append(found.select("a", "b"))
                moved = connected_components(found.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("now"))
                state, old = materialize(state.join(rehashed(moved, "component"), "component", "left").select("key", "id", "head", F.coalesce("now", "component").alias("component"))), state
                discard(old)
            if 10 * joined < tried or not tried:
                break
        components = state.select("id", "component").distinct()
        families = connected_components(state.select(F.col("id").alias("a"), F.col("head").alias("b"))).withColumnRenamed("component", "family")
        members = materialize(components.join(families, "id"))
        edges.append(materialize(_family_links(members, payload, as_set, num, den, block)))
        few = few.join(members, "id", "left").withColumn("component", F.coalesce("component", "id"))
    left, right = (few.select("key", *(F.col(c).alias(f"{c}_{s}") for c in few.columns if c != "key")) for s in "ab")
    # ids of one family have been compared
    apart = F.expr("component_a <> component_b AND id_a < id_b" + (" AND coalesce(family_a <> family_b, true)" if "family" in few.columns else ""))
    pairs = left.join(right, "key").where(apart)
    if size_filter is not None:
        pairs = pairs.where(size_filter("_a", "_b"))
    pairs = materialize(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())
    edges.append(verify(pairs, payload, alike, num, den))
    discard(pairs, keyed, payload)
    return connected_components(reduce(DataFrame.unionByName, edges))
