"""Ordered scans over groups that are larger than a task.

``ranged`` cuts a table into ranges of (group, order) of about equal size, whatever the groups: a large group lies in many ranges, a range holds many small ones.
A scan then works within each range and carries the state of a range's end to the ranges after it. Only groups that lie in several ranges need a carry, and there
are at most two of them at the ends of a range, so the carries are at most two rows a range and are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.sources.shared import materialize


#: Rows that are sent to every task at most, where they are counted first.
FEW = 200_000


def few(df: DataFrame) -> bool:
    return df.count() <= FEW


def join_few(rows: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``other``, which is counted and sent to the tasks only while it has at most FEW rows; otherwise both are shuffled and neither is sent."""
    return rows.join(F.broadcast(other) if few(other) else other.hint("merge"), on, how)


def only_wanted(rows: DataFrame, wanted: DataFrame, key: str | Sequence[str], bits: int = 24) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``, before a join that shuffles them; rows of wanted keys all stay.

    The keys are hashed to a bitmap of 2 ** bits places, at most 2 ** (bits - 6) rows of two numbers, so its broadcast is bounded (10.5 MB when full) whatever
    the input; a fuller bitmap lets more rows pass and changes no result of the join.
    """
    place = F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(1 << bits))
    bitmap = wanted.select(place.alias("__p")).groupBy(F.shiftright("__p", 6).alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__p & 63 AS int))")).alias("__b"))
    return rows.withColumn("__p", place).withColumn("__w", F.shiftright("__p", 6)).join(F.broadcast(bitmap), "__w").where("shiftright(__b, cast(__p & 63 AS int)) & 1 = 1").drop("__p", "__w", "__b")


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` written in ranges of its order, with the number of the range in ``__part``. Rows equal in ``by`` and ``order`` are in one range."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))


def _carry(rows: DataFrame, by: Sequence[str], ends: DataFrame) -> DataFrame:
    """``rows`` beside the columns of ``ends``, which has a row for some pairs of group and range; null groups match each other."""
    names = [*by, "__part"]
    right = ends.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(names)), *(c for c in ends.columns if c not in names))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)]
    return rows.join(F.broadcast(right), on, "left").drop(*(f"__k{i}" for i in range(len(names))))


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, later: bool = False, parts: int | None = None) -> DataFrame:
    """``df`` with the last ``value`` that is not null among the rows before each one in its group, or the first among those after it.

    Groups may be of any size. ``order`` should leave no ties.
    """
    rows = ranged(df.withColumn("__v", value), by, order, parts)
    way = F.desc if later else F.asc
    inside = Window.partitionBy(*by, "__part").orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, -1)
    end = F.min_by if later else F.max_by
    ends = rows.groupBy(*by, "__part").agg(end(F.col("__v"), F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__e"))
    group = Window.partitionBy(*by)
    ends = ends.withColumn("__n", F.count("*").over(group)).where("__n > 1").withColumn(
        "__c", F.last("__e", ignorenulls=True).over(group.orderBy(way("__part")).rowsBetween(Window.unboundedPreceding, -1))
    )
    rows = rows.withColumn("__i", F.last("__v", ignorenulls=True).over(inside))
    return _carry(rows, by, ends.select(*by, "__part", "__c")).withColumn(name, F.coalesce("__i", "__c")).drop("__v", "__i", "__c", "__part")


def positioned(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with position (from 0) in its group and, for a ``size``, the sum of those before it (null counts as 0). Groups may be of any size."""
    rows = ranged(df.withColumn("__s", F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else F.lit(0).cast("long")), by, order, parts)
    w = Window.partitionBy(*by, "__part").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("position", F.row_number().over(w).cast("long") - 1).withColumn("before", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    group = Window.partitionBy(*by)
    ends = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.sum("__s").alias("__b")).withColumn("__m", F.count("*").over(group)).where("__m > 1")
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "__part", F.sum("__n").over(earlier).alias("__cn"), F.sum("__b").over(earlier).alias("__cb"))
    rows = _carry(rows, by, ends)
    rows = rows.withColumn("position", F.col("position") + F.coalesce("__cn", F.lit(0))).withColumn("before", F.col("before") + F.coalesce("__cb", F.lit(0)))
    rows = rows.drop("__s", "__cn", "__cb", "__part")
    return rows if size else rows.drop("before")


def _chain(first: int, following: np.ndarray, entry: int) -> list[int]:
    """Where the pages of a block start, from ``entry`` on; ``following``: of each position of the block, which begins at ``first``, where the next page starts."""
    out = []
    while entry < first + len(following):
        out.append(entry)
        entry = int(following[entry - first])
    return out


def paged(df: DataFrame, by: Sequence[str], order: str, size: str, max_items: int, max_bytes: int, block: int = 100_000, parts: int | None = None) -> DataFrame:
    """Pages filled one after another within a group of any size, by items and bytes: ``by``, ``order``, page (from 0). An item over ``max_bytes`` has a page alone.

    Where a page that starts at an item would end follows from sums alone, for every item, by an as-of scan. Which items do start pages is a chain; groups are cut
    into blocks, and a block answers, for each of the at most ``max_items`` places where a page may enter it, where that chain leaves it. These answers are
    put together by group (a row each) and each block then follows its one chain.
    """
    block = max(block, max_items)
    rows = positioned(df.select(*by, order, F.col(size).alias("__size")), by, [order], "__size", parts).withColumn("__end", F.col("before") + F.coalesce(F.col("__size").cast("long"), F.lit(0)))
    # of each item, the last one that ends at most max_bytes after its start; items stand before questions of an equal place
    items = rows.select(*by, F.col("__end").alias("__at"), F.lit(0).alias("__ask"), "position", F.col("position").alias("__last"), F.lit(None).cast(df.schema[order].dataType).alias(order))
    asks = rows.select(*by, (F.col("before") + max_bytes).alias("__at"), F.lit(1).alias("__ask"), "position", F.lit(None).cast("long").alias("__last"), order)
    found = carried(items.unionByName(asks), by, ["__at", "__ask", "position"], F.col("__last"), "__until", parts=parts).where("__ask = 1")
    until = F.greatest(F.coalesce(F.col("__until"), F.lit(-1)), F.col("position")) + 1
    jumps = materialize(found.select(*by, order, "position", F.least(until, F.col("position") + max_items).alias("following"), F.floor(F.col("position") / block).cast("long").alias("block")))
    keys = jumps.select(*by, "block")
    schema, names = [pa.field(f.name, _arrow(f.dataType)) for f in keys.schema], list(by)

    def answers(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        first, following = key[-1].as_py() * block, table.column("following").to_numpy()
        n = len(following)
        leaves, pages = np.array(following), np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):  # from the end, so that what an item jumps to is known
            to = int(following[i]) - first
            if to < n:
                leaves[i], pages[i] = leaves[to], pages[to] + 1
        m = 1 if first == 0 else min(max_items, n)
        same = [pa.array([k.as_py()] * m, f.type) for k, f in zip(key, schema)]
        return pa.Table.from_arrays([*same, pa.array(np.arange(first, first + m)), pa.array(leaves[:m]), pa.array(pages[:m])], names=[*names, "block", "entry", "leaves", "pages"])

    many = keys.where("block > 0").select(*by).distinct()
    on = [F.col(f"j.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]
    told = jumps.alias("j").join(many.alias("m"), on, "left_semi").groupBy(*by, "block").applyInArrow(answers, T.StructType([*keys.schema]).add("entry", "long").add("leaves", "long").add("pages", "long"))

    def follow(key: tuple, table: pa.Table) -> pa.Table:
        entry, leaves, pages = (table.column(c).to_numpy() for c in ("entry", "leaves", "pages"))
        place = {int(e): i for i, e in enumerate(entry)}
        at, page, out = 0, 0, []
        while at in place:
            i = place[at]
            out.append((at // block, at, page))
            at, page = int(leaves[i]), page + int(pages[i])
        n = len(out)
        same = [pa.array([k.as_py()] * n, f.type) for k, f in zip(key, schema)]
        return pa.Table.from_arrays([*same, *(pa.array([r[i] for r in out], pa.int64()) for i in range(3))], names=[*names, "block", "entry", "first_page"])

    entries = told.groupBy(*by).applyInArrow(follow, T.StructType([*keys.schema]).add("entry", "long").add("first_page", "long"))
    on = [F.col(f"j.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*by, "block")]
    begun = jumps.alias("j").join(entries.alias("e"), on, "left").select("j.*", F.coalesce("e.entry", F.lit(0)).alias("__entry"), F.coalesce("e.first_page", F.lit(0)).alias("__page"))

    def mark(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("position")
        position, entry = table.column("position").to_numpy(), int(table.column("__entry")[0].as_py())
        starts = _chain(int(position[0]), table.column("following").to_numpy(), entry)
        page = int(table.column("__page")[0].as_py()) - 1 + np.searchsorted(np.array(starts), position, side="right")
        return table.select([*names, order]).append_column("page", pa.array(page.astype(np.int32)))

    return begun.groupBy(*by, "block").applyInArrow(mark, T.StructType([*df.select(*by, order).schema]).add("page", "integer"))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
