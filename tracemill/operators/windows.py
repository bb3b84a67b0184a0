"""Building blocks on ordered rows: as-of assignment, first later row, gaps, changes, pages and bounded selections.

Every window is partitioned; none orders a whole table in one task.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import millis
from tracemill.operators.scans import carried, paged


def asof_last(left: DataFrame, right: DataFrame, by: Sequence[str], order: str, value: str, ties_match: bool = True) -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row of its group whose ``order`` is not after its own.

    A tagged union and one window: no range join, whose rows could multiply. ``ties_match`` lets equal orders match.
    """
    tag = F.lit(0 if ties_match else 1)
    cols = [c for c in left.columns if c not in (*by, order)]
    lhs = left.select(*by, order, F.lit(0 if not ties_match else 1).alias("__side"), F.struct(*cols).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    rhs = right.select(*by, F.col(order).cast(left.schema[order].dataType).alias(order), tag.alias("__side"), F.lit(None).cast(lhs.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    w = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = lhs.unionByName(rhs).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.where("__row IS NOT NULL").select(*by, order, "__row.*", F.col("__v").alias(value))


def first_later(df: DataFrame, by: Sequence[str], order: str, when: Column, value: Column, name: str) -> DataFrame:
    """``value`` of the first row of the group with ``when`` true and a strictly greater ``order``."""
    w = Window.partitionBy(*by).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.min(F.when(when, F.struct(F.col(order).alias("o"), value.alias("v")))).over(w)["v"])


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first by ``order``."""
    return top_n(df, keys, order, 1)


def changes(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, first_counts: bool = True) -> DataFrame:
    """Rows whose non-empty ``value`` differs from the last one of the group (W7, W12), with previous_value."""
    rows = df.where(F.col(value).isNotNull() & (F.trim(value) != ""))
    prev = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("previous_value", prev)
    return rows.where((F.col("previous_value") != F.col(value)) | (F.col("previous_value").isNull() & F.lit(first_counts)))


def gaps(df: DataFrame, by: Sequence[str], ts: str, order: Sequence[str], hours: float = 720.0) -> DataFrame:
    """Rows that follow the one before in their group by more than ``hours`` (W6), with gap_ms. A group may be larger than a task."""
    rows = carried(df, by, [ts, *order], F.col(ts), "__before").withColumn("gap_ms", millis(ts) - millis("__before"))
    return rows.drop("__before").where(F.col("gap_ms") > int(hours * 3_600_000))


def bounded_select(df: DataFrame, by: Sequence[str], keys: Sequence[str], order: Sequence[Column], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A bounded selection and its account (A14, T9): rows, and seen / collapsed / emitted / dropped / truncated by group.

    Repeated keys collapse into their first row, and the first ``limit`` are emitted; without a limit all are.
    """
    w = Window.partitionBy(*by, *keys).orderBy(*order)
    unique = df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    ranked = unique.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    rows = ranked if limit is None else ranked.where(F.col("__rn") <= limit)
    seen = df.groupBy(*by).agg(F.count("*").alias("seen"))
    left = unique.groupBy(*by).agg(F.count("*").alias("unique"))
    top = F.col("unique") if limit is None else F.least(F.col("unique"), F.lit(limit))
    account = seen.join(left, list(by)).select(
        *by, "seen", (F.col("seen") - F.col("unique")).alias("collapsed"), top.cast("long").alias("emitted"),
        (F.col("unique") - top).cast("long").alias("dropped"), (F.col("unique") > top).alias("truncated"),
    )
    return rows.drop("__rn"), account


def summary_block(df: DataFrame, by: Sequence[str], order: Sequence[Column], item: Sequence[str], n: int = 32) -> DataFrame:
    """Per group: total, shown, omitted and the first ``n`` items in order (T5). At most ``n`` items are gathered."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__rn", F.row_number().over(w.orderBy(*order)))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("__rn") <= n).alias("shown"), F.count_if(F.col("__rn") > n).alias("omitted"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("__rn") <= n, F.struct("__rn", *item)))), lambda x: F.struct(*(x[c].alias(c) for c in item))).alias("items"),
    )


def cursor(generation: str, digest: str, start: int) -> str:
    """A page's place, bound to what it was read from."""
    return base64.urlsafe_b64encode(json.dumps({"generation": generation, "digest": digest, "start": start}, sort_keys=True).encode()).decode()


def read_cursor(text: str, generation: str, digest: str) -> int:
    """The place of a cursor; an error if it was made for other data."""
    got = json.loads(base64.urlsafe_b64decode(text.encode()))
    if (got["generation"], got["digest"]) != (generation, digest) or got["start"] < 0:
        raise ValueError("the cursor belongs to other data")
    return got["start"]


def page(df: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int, start: int = 0) -> DataFrame:
    """Rows ``start`` .. ``start + limit`` of each group, with position, total and where the next page starts (T4)."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("position", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("total", F.count("*").over(w))
    following = F.when(F.col("total") > start + limit, F.lit(start + limit).cast("long"))
    return rows.where((F.col("position") > start) & (F.col("position") <= start + limit)).withColumn("next_start", following)


def greedy_pages(df: DataFrame, by: Sequence[str], order: str, size: str, max_items: int, max_bytes: int) -> DataFrame:
    """Pages filled one after another within a group, by items and bytes (W14, W15): ``by``, ``order``, page.

    An item over ``max_bytes`` has a page of its own, and null sizes count as 0. A group may be larger than a task (``scans.paged``).
    """
    return paged(df, by, order, size, max_items, max_bytes)


def packet(df: DataFrame, by: Sequence[str], order: Sequence[Column], text: str, max_items: int = 500, max_chars: int = 300_000) -> DataFrame:
    """The prefix of each group within both bounds, with has_more and position."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("position", F.row_number().over(w).cast("long")).withColumn("__chars", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("has_more", F.count("*").over(Window.partitionBy(*by)) > F.count_if((F.col("position") <= max_items) & (F.col("__chars") <= max_chars)).over(Window.partitionBy(*by)))
    return rows.where((F.col("position") <= max_items) & (F.col("__chars") <= max_chars)).drop("__chars")
