"""Near-duplicate vectors by sorted projection passes and an exact completion (operator 4).

Each pass gives every vector the concatenated signs of its projections on random directions, sorts the vectors of a label by them, lexicographically, and
compares each with the ``window`` vectors before it in its partition of the sort. Pairs verified in any pass are joined into clumps.

A window holds fewer vectors than a crowded label has near ones, so passes alone cannot count links. The completion lays the vectors of a label out by
clump, the first pass's hashes deciding between clumps, and cuts that order into blocks. A block lies within a cone around its mean direction, narrow where
clumps are large. Two blocks are left open where the triangle inequality of angles allows a link between their cones, and of open blocks only vectors are
sent that the other's cone allows; these are compared, all of them. A label of one block is compared whole. This leaves out no link, so n_links, components
and kept are exact whatever the passes found. Where vectors are so far apart that all cones are wide (independent directions in many dimensions) nothing is
ruled out and the work grows with the square of the label.

Cones are compared in tiles of about 512 blocks, by Spark; nothing is gathered on the driver or sent to all tasks.

Vectors equal in every component, with equal labels, are one class that is compared once and weighs its number of ids.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with null labels or ids,
link with nothing; vectors of unequal length are not compared; rows that repeat an id are one vector where their values
are equal and otherwise share the links of all; a row is returned for every row; empty tables give empty tables; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import connected_components, materialize, rehashed, shuffle_parts

#: Added to angles, beyond their rounding.
SLACK = 1e-5
#: Signs in a pass's key.
BITS = 62
#: Blocks whose cones one task compares with as many others.
TILE = 512


def _units(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x have a cosine of ``least`` or more with which rows of y; single precision rules out most pairs."""
    maybe = x.astype(np.float32) @ y.astype(np.float32).T >= least - 1e-3
    if np.count_nonzero(maybe) * 16 > maybe.size:
        return x @ y.T >= least
    rows, cols = np.nonzero(maybe)
    for at in range(0, len(rows), 65536):
        r, c = rows[at : at + 65536], cols[at : at + 65536]
        maybe[r, c] = np.einsum("ij,ij->i", x[r], y[c]) >= least
    return maybe


def _stars(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids a, b: each row and column that links reach, beside the first row that reaches it."""
    rows, cols = link.any(1), link.any(0)
    a, b = [left[:0]], [left[:0]]
    for seed in np.flatnonzero(rows).tolist():
        if not rows[seed]:
            continue
        rows[seed], fresh = False, np.array([seed])
        while len(fresh):
            to = np.flatnonzero(link[fresh].any(0) & cols)
            cols[to] = False
            fresh = np.flatnonzero(link[:, to].any(1) & rows)
            rows[fresh] = False
            a.append(np.full(len(to) + len(fresh), left[seed]))
            b += [right[to], left[fresh]]
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def _found(parts: list[tuple]) -> pa.Table:
    """parts: ids with their weights, and ids a and b of edges."""
    one = lambda i: np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]).astype(np.int64)
    cid, weight, a, b = map(one, range(4))
    none = lambda n: pa.nulls(n, pa.int64())
    ids, others, weights = [pa.array(cid), pa.array(a)], [none(len(cid)), pa.array(b)], [pa.array(weight), none(len(a))]
    return pa.table({"cid": pa.chunked_array(ids), "other": pa.chunked_array(others), "weight": pa.chunked_array(weights)})


def _within(x: np.ndarray, cid: np.ndarray, size: np.ndarray, least: float) -> tuple:
    link = _linked(x, x, least)
    np.fill_diagonal(link, False)
    weight = link @ size
    np.fill_diagonal(link, weight > 0)  # a row and its column are one vector
    some = weight > 0
    return cid[some], weight[some], *_stars(link, cid, cid)


def _between(x: np.ndarray, y: np.ndarray, cids: tuple, sizes: tuple, least: float) -> tuple:
    link = _linked(x, y, least)
    weights = np.concatenate([link @ sizes[1], sizes[0] @ link])
    some = weights > 0
    return np.concatenate(cids)[some], weights[some], *_stars(link, *cids)


FOUND = "cid long, other long, weight long"


def _small(rows: DataFrame, groups: int, least: float) -> DataFrame:
    """Links of labels that one task compares; a task gets several."""

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        label, dim = table.column("label").to_numpy(), table.column("dim").to_numpy()
        cid, size = table.column("cid").to_numpy(), table.column("size").to_numpy()
        order = np.lexsort((dim, label))
        cuts = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(dim[order]) != 0)) + 1
        parts = []
        for at in np.split(order, cuts):
            if len(at) > 1:
                x = _units(_flat(table.column("embedding").combine_chunks().take(pa.array(at))), int(dim[at[0]]))
                parts.append(_within(x, cid[at], size[at], least))
        return _found(parts)

    return rows.withColumn("g", F.pmod(F.xxhash64("label", "dim"), F.lit(groups))).groupBy("g").applyInArrow(count, FOUND)


def _keyed(rows: DataFrame, passes: int) -> DataFrame:
    """rows with a key for each pass: signs of projections on its random directions, the first in the highest bit."""
    directions: dict[int, np.ndarray] = {}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dim, keys = batch.column("dim").to_numpy(), np.zeros((batch.num_rows, passes), np.int64)
                for d in np.unique(dim).tolist():
                    which = np.flatnonzero(dim == d)
                    if d not in directions:
                        directions[d] = np.random.default_rng((4, d)).standard_normal((d, passes * BITS))
                    signs = _units(_flat(batch.column("embedding").take(pa.array(which))), d) @ directions[d] > 0
                    keys[which] = signs.reshape(-1, passes, BITS) @ place
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(keys[:, k]) for k in range(passes))], names=[*batch.schema.names, *(f"key{k}" for k in range(passes))])

    return rows.mapInArrow(sign, "label long, dim int, cid long, size long, embedding array<double>, " + ", ".join(f"key{k} long" for k in range(passes)))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that edges a-b join each of n positions with."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _sorted_pass(keyed: DataFrame, key: str, window: int, least: float, parts: int) -> DataFrame:
    """Edges that span what one pass verifies. A window ends at its partition's border, which lies elsewhere in every pass."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                table = pa.Table.from_batches([*([last] if last else []), whole.slice(at, 2048)]).combine_chunks()
                dim, label, cid = (table.column(c).to_numpy() for c in ("dim", "label", "cid"))
                left, right = [], []
                cuts = np.flatnonzero(np.diff(dim)) + 1
                for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(dim)]):
                    x = _units(_flat(table.column("embedding").combine_chunks().slice(start, end - start)), int(dim[start]))
                    for d in range(1, min(window, len(x) - 1) + 1):
                        cos = np.einsum("ij,ij->i", x[d:], x[:-d])
                        hit = start + np.flatnonzero((cos >= least) & (label[start + d : end] == label[start : end - d]))
                        left.append(hit)
                        right.append(hit + d)
                if left:
                    root = _roots(len(dim), np.concatenate(left), np.concatenate(right))
                    joined = np.flatnonzero(root != np.arange(len(root)))
                    yield pa.RecordBatch.from_arrays([pa.array(cid[joined]), pa.array(cid[root[joined]])], names=["a", "b"])
                last = table.slice(max(0, len(dim) - window)).combine_chunks().to_batches()[0]

    order = ["label", "dim", key, "cid"]
    rows = keyed.select("label", "dim", key, "cid", "embedding").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(verify, "a long, b long")


def clumps(keyed: DataFrame, passes: int, window: int, least: float, parts: int) -> DataFrame:
    """Rows (id, component): what the verified pairs of all passes join; vectors without any are absent."""
    found = None
    for k in range(passes):
        edges = _sorted_pass(keyed, f"key{k}", window, least, parts)
        found = edges if found is None else found.unionByName(edges)
    return materialize(connected_components(materialize(found.distinct())))


def _laid_out(rows: DataFrame, block: int, parts: int) -> DataFrame:
    """Blocks of at most ``block`` vectors of one label that follow each other in the order of clumps, with their cones."""
    order = ["label", "dim", "anchor", "clump", "key0", "cid"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held = TaskContext.get().partitionId() << 32, None

        def blocks(run: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            for at in range(0, run.num_rows, block):
                part = run.slice(at, block)
                dim = int(part.column("dim")[0].as_py())
                x = _units(_flat(part.column("embedding").combine_chunks()), dim)
                centre = x.sum(0)
                length = np.sqrt(centre @ centre)
                centre = centre / length if length > 1e-9 else x[0]
                radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
                serial += 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([serial], pa.int64()), "label": pa.array([part.column("label")[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()),
                        "n": pa.array([run.column("n")[0].as_py()], pa.int64()), "centre": pa.array([centre.tobytes()]), "radius": pa.array([radius]),
                        "cids": pa.array([part.column("cid").to_numpy().tobytes()]), "sizes": pa.array([part.column("size").to_numpy().tobytes()]), "units": pa.array([x.tobytes()]),
                    }
                )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            label, dim = table.column("label").to_numpy(), table.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(label) != 0) | (np.diff(dim) != 0)) + 1).tolist()]
            for start, end in zip(cuts, cuts[1:]):
                yield from blocks(table.slice(start, end - start))
            run = table.slice(cuts[-1])
            whole = run.num_rows // block * block
            yield from blocks(run.slice(0, whole))
            held = run.slice(whole)
        if held is not None:
            yield from blocks(held)

    rows = rows.select(*order, "size", "n", "embedding").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(rows.mapInArrow(pack, "block long, label long, dim int, n long, centre binary, radius double, cids binary, sizes binary, units binary"))


def _open(packed: DataFrame, block: int, reach: float) -> DataFrame:
    """Per block and tile of others: the blocks whose cones allow a link with it, itself included, and their cones."""
    tiles = F.ceil(F.col("n") / F.lit(block * TILE)).cast("int")
    cones = packed.select("block", "label", "dim", "centre", "radius", F.pmod(F.xxhash64("block"), tiles).cast("int").alias("tile"), tiles.alias("tiles"))
    meets = cones.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    meets = meets.select("block", "label", "dim", "centre", "radius", "tile", F.least("tile", "other").alias("g"), F.greatest("tile", "other").alias("h"))

    def near(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending")]).combine_chunks()
        ids, radius, tile = (table.column(c).to_numpy() for c in ("block", "radius", "tile"))
        centres = np.frombuffer(b"".join(table.column("centre").to_pylist())).reshape(len(ids), -1)
        g, h = int(table.column("g")[0].as_py()), int(table.column("h")[0].as_py())
        out = {"own": [], "others": [], "centres": [], "radii": []}
        for own_tile, other_tile in {(g, h), (h, g)}:
            others = np.flatnonzero(tile == other_tile)
            for k in np.flatnonzero(tile == own_tile).tolist():
                angle = np.arccos(np.clip(centres[others] @ centres[k], -1, 1))
                some = others[(angle <= radius[k] + radius[others] + reach) | (others == k)]
                if len(some):
                    for name, v in zip(out, (int(ids[k]), ids[some].tobytes(), centres[some].tobytes(), radius[some].tobytes())):
                        out[name].append(v)
        return pa.table([pa.array(out["own"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in ("others", "centres", "radii"))], names=list(out))

    return meets.groupBy("label", "dim", "g", "h").applyInArrow(near, "own long, others binary, centres binary, radii binary")


def _large(rows: DataFrame, block: int, least: float, parts: int) -> DataFrame:
    """Links of labels of more than ``block`` vectors: open blocks are compared, by pairs."""
    reach = float(np.arccos(min(1.0, max(-1.0, least)))) + SLACK
    packed = _laid_out(rows, block, parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, dim = batch.column("own")[k].as_py(), batch.column("dim")[k].as_py()
                held = lambda c, t: np.frombuffer(batch.column(c)[k].as_buffer(), t)  # noqa: E731, B023
                cid, size, x, others, radii = held("cids", np.int64), held("sizes", np.int64), held("units", np.float64).reshape(-1, dim), held("others", np.int64), held("radii", np.float64)
                for other, radius, centre in zip(others.tolist(), radii.tolist(), held("centres", np.float64).reshape(-1, dim)):
                    near = (np.arccos(np.clip(x @ centre, -1, 1)) <= radius + reach) | (own == other)
                    if near.any():
                        cols = [pa.array([v], t) for v, t in ((min(own, other), pa.int64()), (max(own, other), pa.int64()), (int(own <= other), pa.int32()), (dim, pa.int32()))]
                        sent = [pa.array([v[near].tobytes()], pa.binary()) for v in (cid, size, x)]
                        yield pa.RecordBatch.from_arrays(cols + sent, names=["i", "j", "side", "dim", "cids", "sizes", "units"])

    def count(table: pa.Table) -> pa.Table:
        sides = []
        for r in table.sort_by([("side", "descending")]).to_pylist():
            sides.append((np.frombuffer(r["units"]).reshape(-1, r["dim"]), np.frombuffer(r["cids"], np.int64), np.frombuffer(r["sizes"], np.int64)))
        if table.column("i")[0].as_py() == table.column("j")[0].as_py():
            return _found([_within(*sides[0], least)])
        if len(sides) < 2:  # nothing of the other block comes near
            return _found([])
        (x, *left), (y, *right) = sides
        return _found([_between(x, y, *zip(left, right), least)])

    sends = _open(packed, block, reach).join(packed.select(F.col("block").alias("own"), "dim", "cids", "sizes", "units"), "own")
    pairs = sends.mapInArrow(send, "i long, j long, side int, dim int, cids binary, sizes binary, units binary")
    return pairs.groupBy("i", "j").applyInArrow(count, FOUND)


def _links(classes: DataFrame, least: float, block: int, passes: int, window: int) -> DataFrame:
    """Rows (cid, weight): ids of other classes that class cid links with, in parts to be added; and edges (cid, other) that join what links join."""
    sizes = materialize(classes.groupBy("label", "dim").agg(F.count("*").alias("n")))
    few, many = (sizes.agg(F.sum(F.when(c, F.col("n")))).first()[0] or 0 for c in (F.col("n") <= block, F.col("n") > block))
    keyed = materialize(_keyed(classes.select("label", "dim", "cid", "size", "embedding"), passes))
    parts = lambda n: max(1, min(4 * shuffle_parts(classes.sparkSession), -(-n // block)))
    joined = clumps(keyed, passes, window, least, parts(few + many))
    rows = keyed.join(sizes, ["label", "dim"])
    found = _small(rows.where(F.col("n") <= block).select("label", "dim", "cid", "size", "embedding"), max(1, 4 * few // block), least)
    if many:
        anchors = keyed.select(F.col("cid").alias("component"), F.col("key0").alias("anchor"))
        placed = rows.where(F.col("n") > block).join(joined.join(anchors, "component").withColumnRenamed("id", "cid"), "cid", "left")
        placed = placed.withColumn("clump", F.coalesce("component", "cid")).withColumn("anchor", F.coalesce("anchor", "key0"))
        found = found.unionByName(_large(placed, block, least, parts(many)))
    return found.unionByName(joined.select(F.col("id").alias("cid"), F.col("component").alias("other"), F.lit(None).cast("long").alias("weight")))


def near_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93, block: int = 2048,
    passes: int = 4, window: int = 32,
) -> DataFrame:
    """Per row: vec_id, n_links (other vectors of its label with a cosine of ``least`` or more), component_id, kept.

    ``passes`` and ``window`` decide how well clumps are found, hence the work, and never the result. A task compares two blocks of at most ``block`` vectors.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    fit = F.coalesce(
        F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"), F.lit(False)
    ) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("h1", F.when(fit, F.xxhash64("label", "embedding"))).withColumn("h2", F.when(fit, F.xxhash64("embedding", F.lit(7))))
    ids = rows.select("vec_id", "h1", "h2")
    keys = ids.where("h1 IS NOT NULL").distinct().groupBy("h1", "h2").agg(F.min("vec_id").alias("cid"), F.count("*").alias("size"))
    keys = materialize(keys)
    classes = materialize(
        rows.where("h1 IS NOT NULL").dropDuplicates(["vec_id", "h1", "h2"]).join(keys, (rows.vec_id == keys.cid) & (rows.h1 == keys.h1) & (rows.h2 == keys.h2))
        .select("cid", "size", "label", F.size("embedding").alias("dim"), "embedding")
    )
    links = materialize(_links(classes, least, block, passes, window))
    components = materialize(connected_components(links.where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b"))))
    counts = materialize(links.where("weight IS NOT NULL").groupBy("cid").agg(F.sum("weight").alias("weight")))
    found = materialize(
        keys.join(rehashed(counts, "cid"), "cid", "left").join(components.select(F.col("id").alias("cid"), "component"), "cid", "left")
        .select("h1", "h2", (F.col("size") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    )
    return ids.join(found, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
