"""How filters interact, by decision diagrams (operator 12).

Each document has a mask of the filters that it fails. Spark counts documents (and those of good quality, and toxic ones) by part and mask: at most
2 ** n rows a part, whatever the input. A task builds of each part a decision diagram: level k asks the k-th filter of the order, equal
subdiagrams are shared, and each node carries the counts of the documents below it. Orders are visited so that each differs from the one before by
two neighbours; a swap rewrites the nodes of those two levels alone. On an order's all-pass path, the failing child of the k-th node holds what the k-th
filter removes, and the passing child what stays.

Edge cases: null texts count as empty, null parts as the empty string; a document without a label is neither good nor toxic, and repeated labels of a
document count as one (good or toxic if any says so); repeated rows count each; a null doc_id is larger than no other and has no label; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import materialize

#: All orders are listed, so their number bounds the filters.
MOST_FILTERS = 7
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


class Diagram:
    """A decision diagram over ``n`` filters, all levels kept, whose nodes weigh (documents, good, toxic)."""

    def __init__(self, weights: dict[int, tuple[int, ...]], n: int):
        self.order = list(range(n))
        self.weight: list[tuple[int, ...]] = []
        self.child: list[tuple[int, int]] = []
        self.known: list[dict] = [{} for _ in range(n + 1)]  # of each level: children or weight -> node
        self.root = self._build(weights, 0, 0)

    def _node(self, level: int, lo: int, hi: int) -> int:
        found = self.known[level].get((lo, hi))
        if found is None:
            found = self.known[level][lo, hi] = len(self.child)
            self.child.append((lo, hi))
            self.weight.append(tuple(a + b for a, b in zip(self.weight[lo], self.weight[hi])))
        return found

    def _build(self, weights: dict[int, tuple[int, ...]], level: int, mask: int) -> int:
        if level < len(self.order):
            return self._node(level, self._build(weights, level + 1, mask), self._build(weights, level + 1, mask | 1 << level))
        w = weights.get(mask, (0, 0, 0))
        if w not in self.known[level]:
            self.known[level][w] = len(self.child)
            self.child.append((-1, -1))
            self.weight.append(w)
        return self.known[level][w]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below; other levels stay as they are."""
        nodes, self.known[level], self.known[level + 1] = [*self.known[level].items()], {}, {}
        for (lo, hi), node in nodes:
            (a, b), (c, d) = self.child[lo], self.child[hi]
            pair = self._node(level + 1, a, c), self._node(level + 1, b, d)
            self.child[node] = pair  # the node keeps its number, so nodes above need no change
            self.known[level][pair] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def path(self) -> Iterator[tuple[int, int, int]]:
        """Of each level on the all-pass path: its filter, the failing child and the passing child."""
        node = self.root
        for f in self.order:
            lo, hi = self.child[node]
            yield f, hi, lo
            node = lo

    def failing(self, f: int) -> int:
        """Documents that fail filter ``f``, on any path."""
        level = self.order.index(f)
        reached = {self.root: 1}
        for _ in range(level):
            below: dict[int, int] = {}
            for node, paths in reached.items():
                for c in self.child[node]:
                    below[c] = below.get(c, 0) + paths
            reached = below
        return sum(paths * self.weight[self.child[node][1]][0] for node, paths in reached.items())

    def failing_only(self, f: int) -> int:
        """Documents that fail filter ``f`` and no other."""
        node = self.root
        for g in self.order:
            node = self.child[node][1 if g == f else 0]
        return self.weight[node][0]


def neighbour_swaps(n: int) -> Iterator[int]:
    """The n! - 1 places of swaps of neighbours that visit all orders of ``n`` once (Johnson and Trotter)."""
    order, way = list(range(n)), [-1] * n
    while True:
        free = [x for i, x in enumerate(order) if 0 <= i + way[x] < n and order[i + way[x]] < x]
        if not free:
            return
        x = max(free)
        i = order.index(x)
        j = i + way[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield min(i, j)


def steps(weights: dict[int, tuple[int, int, int]], names: Sequence[str]) -> list[tuple]:
    """All rows of a part: (filter_order, step, *FIELDS). ``weights``: mask of failures -> documents, good, toxic."""
    n = len(names)
    diagram = Diagram(weights, n)
    failing, alone = [diagram.failing(f) for f in range(n)], [diagram.failing_only(f) for f in range(n)]
    rows, total = [], [0] * n

    def walk() -> None:
        name = "".join(names[f] for f in diagram.order)
        for k, (f, gone, left) in enumerate(diagram.path(), 1):
            removed, good, toxic = diagram.weight[gone]
            total[f] += removed
            rows.append((f, (name, k, diagram.weight[left][0], removed, failing[f] - removed, alone[f], good, toxic)))

    walk()
    for level in neighbour_swaps(n):
        diagram.swap(level)
        walk()
    return [(*row, total[f]) for f, row in rows]


def audit(masks: DataFrame, names: Sequence[str], *, part: str = "part", mask: str = "mask", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part and order of ``names``.

    masks: a row a document with its part, the mask of failed filters (bit k: the k-th name), and whether it is good and toxic (boolean).
    """
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"audit: 1 to {MOST_FILTERS} filters")
    counts = masks.groupBy(F.col(part).alias("part"), F.col(mask).cast("int").alias("mask")).agg(
        F.count("*").alias("n"), F.count_if(good).alias("g"), F.count_if(toxic).alias("t")
    )
    packed = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "g", "t")).alias("counts"))  # at most 2 ** n a part
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, counted in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                rows = steps({c["mask"]: (c["n"], c["g"], c["t"]) for c in counted}, names)
                order, step, *fields = zip(*rows)
                arrays = [pa.array([name] * len(rows), pa.string()), pa.array(order), pa.array(step, pa.int32()), *(pa.array(f, pa.int64()) for f in fields)]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "filter_order", "step", *FIELDS])

    return packed.mapInArrow(run, schema)


def failure_masks(docs: DataFrame, labels: DataFrame, failures: Sequence[Column], *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows (part, mask, good, toxic) of all documents. ``failures`` are conditions over a column ``text`` that is never null; a last filter, which is
    added, fails documents whose text a smaller doc_id has.

    Texts are read once, to hashes of 128 bits. Copies meet by partial aggregation, to the least id of each text, and every document then asks
    whether it is that one, by its id: no group of copies is in one task.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures)), F.lit(0))
    rows = materialize(rows.select("id", "part", mask.alias("mask"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")))
    known = rows.where("id IS NOT NULL")
    first = known.groupBy("h1", "h2").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")
    )
    repeated = F.when(F.col("first").isNull(), 1 << len(failures)).otherwise(0)
    told = known.join(first, ["id", "h1", "h2"], "left").join(said, "id", "left")
    told = told.select("part", (F.col("mask") + repeated).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return told.unionByName(rows.where("id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def text_failures() -> list[Column]:
    """Fewer than 50 words; few distinct words; many capitals; a sign of markup or code. Over a column ``text``."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    return [
        F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.length("text").cast("long"),
        F.rlike("text", F.lit(r"[#$%&*|]")),
    ]


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the four text filters A to D and E, copies of a smaller doc_id, by source."""
    return audit(failure_masks(docs, labels, text_failures()), "ABCDE")
