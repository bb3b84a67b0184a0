"""Tokens and money: session and project usage, effective-dated prices, totals that keep unknown apart from zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import millis, valid_usage
from tracemill.operators.scans import few

CLASSES = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def usage_is_valid(prefix: str = "") -> Column:
    return valid_usage(*(F.col(prefix + c) for c in CLASSES))


def usage_rows(raw: DataFrame, by: Sequence[str] = ("session_id",), order: str = "ordinal") -> DataFrame:
    """Usage rows with the model active at each and whether it counts.

    ``raw`` has ``by``, ``order``, model (blank or null where unchanged), last (struct of CLASSES, null on other rows) and
    cumulative (the same, or null). state: counted; heartbeat (only a total, the last accepted cumulative again); invalid.
    """
    w = Window.partitionBy(*by).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = raw.withColumn("active_model", F.coalesce(F.last(F.when(F.trim("model") != "", F.col("model")), ignorenulls=True).over(past), F.lit("unknown")))
    rows = rows.where("last IS NOT NULL")
    only_total = (F.col("last.total_tokens") > 0)
    for c in CLASSES[:-1]:
        only_total = only_total & (F.coalesce(F.col(f"last.{c}"), F.lit(0)) == 0)
    rows = rows.withColumn("__beat", F.coalesce(only_total, F.lit(False))).withColumn("__ok", ~F.col("__beat") & usage_is_valid("last."))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__prev", F.last(F.when(F.col("__ok"), F.col("cumulative")), ignorenulls=True).over(before))
    beat = F.col("__beat") & F.col("__prev").isNotNull() & F.col("cumulative").isNotNull() & (F.to_json("cumulative") == F.to_json("__prev"))
    state = F.when(F.col("__ok"), "counted").when(beat, "heartbeat").otherwise("invalid")
    return rows.withColumn("state", state).drop("__beat", "__ok", "__prev")


def session_usage(raw: DataFrame, by: Sequence[str] = ("session_id",), order: str = "ordinal", ts: str = "ts") -> DataFrame:
    """Sums of counted usage by session and model, with time range and diagnostics (A1)."""
    rows = usage_rows(raw, by, order)
    ok = F.col("state") == "counted"
    return rows.groupBy(*by, F.col("active_model").alias("model")).agg(
        *(F.coalesce(F.sum(F.when(ok, F.col(f"last.{c}"))), F.lit(0)).cast("long").alias(c) for c in CLASSES),
        F.min(F.when(ok, F.col(ts))).alias("started_at"), F.max(F.when(ok, F.col(ts))).alias("ended_at"),
        F.count_if(F.col("state") == "heartbeat").alias("heartbeats"), F.count_if(F.col("state") == "invalid").alias("invalid_rows"),
    ).withColumn("duration_ms", millis("ended_at") - millis("started_at"))


def dedupe_usage_by_message(usage: DataFrame, by: Sequence[str], message_id: str, value: Sequence[str]) -> DataFrame:
    """One row a message whose copies agree; messages with conflicting usage keep none and say so (A4)."""
    v = F.struct(*value)
    got = usage.groupBy(*by, message_id).agg(F.min(v).alias("v"), (F.min(v) == F.max(v)).alias("agree"), F.count("*").alias("copies"))
    return got.select(*by, message_id, *(F.when(F.col("agree"), F.col(f"v.{c}")).alias(c) for c in value), "copies", F.when(F.col("agree"), "counted").otherwise("conflicting_usage").alias("diagnostic"))


def relational_usage(messages: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Usage of the relational provider: input with both cache classes, output with reasoning (A5)."""
    t = "tokens."
    cached, written, reasoning = F.col(t + "cache.read"), F.col(t + "cache.write"), F.col(t + "reasoning")
    rows = messages.select(
        *by, F.coalesce("model", F.lit("unknown")).alias("model"), (F.col(t + "input") + cached + written).alias("input_tokens"), cached.alias("cached_input_tokens"),
        written.alias("cache_write_input_tokens"), (F.col(t + "output") + reasoning).alias("output_tokens"), reasoning.alias("reasoning_output_tokens"),
    ).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return rows.where(usage_is_valid()).groupBy(*by, "model").agg(*(F.sum(c).alias(c) for c in CLASSES))


def reconcile_totals(usage: DataFrame, totals: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per session whether summed usage equals the source's own totals, null-safe in both directions (A5)."""
    got = usage.groupBy(*by).agg(*(F.sum(c).alias(c) for c in CLASSES))
    said = totals.select(*by, *(F.col(c).alias(f"said_{c}") for c in CLASSES))
    same = F.lit(True)
    for c in CLASSES:
        same = same & F.col(c).eqNullSafe(F.col(f"said_{c}"))
    return got.join(said, list(by), "full_outer").withColumn("reconciled", same)


def project_usage(usage: DataFrame, by: Sequence[str] = ("project_id",), model: str = "model", cost: str | None = None) -> DataFrame:
    """Totals by model with shares of the group's tokens and, where every row is priced, of its cost (A2)."""
    aggs = [F.sum(c).cast("long").alias(c) for c in CLASSES if c in usage.columns]
    if cost:
        aggs += [F.sum(cost).alias("cost"), F.bool_and(F.col(cost).isNotNull()).alias("priced")]
    rows = usage.groupBy(*by, model).agg(*aggs)
    w = Window.partitionBy(*by)
    total = F.sum("total_tokens").over(w)
    rows = rows.withColumn("token_share", F.when(total > 0, 100.0 * F.col("total_tokens") / total))
    if cost:
        money = F.sum("cost").over(w)
        rows = rows.withColumn("cost_share", F.when(F.bool_and("priced").over(w) & (money > 0), 100.0 * F.col("cost") / money))
    return rows


def pricing_complete(rows: DataFrame, by: Sequence[str], cost: str = "cost") -> DataFrame:
    """Whether every row of a group is priced; a price of zero is a price (A3)."""
    return rows.groupBy(*by).agg(F.bool_and(F.col(cost).isNotNull()).alias("complete"), F.count_if(F.col(cost).isNull()).alias("unpriced"))


def usage_rollup(usage: DataFrame, dims: Sequence[str], kind: str = "rollup", value: str = "total_tokens") -> DataFrame:
    """Totals over rollup, cube or the single grouping of dimensions, with the grouping's number."""
    grouped = {"rollup": usage.rollup, "cube": usage.cube, "group": usage.groupBy}[kind](*dims)
    aggs = [F.sum(value).cast("long").alias(value), F.count("*").alias("rows")]
    return grouped.agg(*aggs, *([F.grouping_id().cast("long").alias("grouping")] if kind != "group" else []))


def validate_summary(summary: DataFrame, detail: DataFrame, by: Sequence[str], exact: Sequence[str], usd: Sequence[str] = (), percent: Sequence[str] = ()) -> DataFrame:
    """Recompute and compare: whole numbers exactly, USD within 1e-9, percentages within 1e-6."""
    left, right = (d.select(*by, *(F.col(c).alias(f"{s}_{c}") for c in (*exact, *usd, *percent))) for d, s in ((summary, "said"), (detail, "got")))
    joined = left.join(right, list(by), "full_outer")
    checks = [(c, F.col(f"said_{c}").eqNullSafe(F.col(f"got_{c}"))) for c in exact]
    checks += [(c, F.coalesce(F.abs(F.col(f"said_{c}") - F.col(f"got_{c}")) <= tol, F.col(f"said_{c}").isNull() & F.col(f"got_{c}").isNull())) for cs, tol in ((usd, 1e-9), (percent, 1e-6)) for c in cs]
    bad = F.array_compact(F.array(*(F.when(~ok, F.lit(c)) for c, ok in checks)))
    return joined.select(*by, bad.alias("mismatches")).where(F.size("mismatches") > 0)


def price_intervals(history: DataFrame, listing: str = "listing_id", date: str = "date") -> DataFrame:
    """Each price with the date at which the next one starts."""
    return history.withColumn("until", F.lead(date).over(Window.partitionBy(listing).orderBy(date)))


def price_asof(usage: DataFrame, history: DataFrame, listing: str = "listing_id", at: str = "priced_at", date: str = "date") -> DataFrame:
    """The price in force at midnight UTC of ``at`` (J4): joined by listing and interval, at most one row a usage.

    review: true where the price is a correction or backfill. Usage before any price keeps null rates. A history of at most ``scans.FEW`` rows is sent to the
    tasks; with a longer one usage is dealt by listing and day, as a listing's usage may be larger than a task.
    """
    h = price_intervals(history, listing, date).withColumnRenamed(listing, "__listing")
    u = usage.withColumn("__day", F.to_date(F.col(at)))
    within = (F.col("__day") >= F.col(date)) & (F.col("until").isNull() | (F.col("__day") < F.col("until")))
    if few(history):
        priced = u.join(F.broadcast(h), (F.col(listing) == F.col("__listing")) & within, "left").drop("__listing")
    else:
        days = u.select(F.col(listing).alias("__listing"), F.col("__day")).distinct().join(h, "__listing").where(within).withColumnRenamed("__day", "__at")
        priced = u.join(days, (F.col(listing) == F.col("__listing")) & (F.col("__day") == F.col("__at")), "left").drop("__listing", "__at")
    return priced.drop("until", "__day").withColumn("review", F.coalesce(F.col("event").isin("correction", "backfill"), F.lit(False)))


def price_period_check(sessions: DataFrame, history: DataFrame, rates: Sequence[str], listing: str = "listing_id", start: str = "started_at", end: str = "ended_at") -> DataFrame:
    """Sessions with ambiguous: a boundary to different rates in (start, end] (J5). Equal or equally unknown rates are no boundary."""
    w = Window.partitionBy(listing).orderBy("date")
    now, before = F.struct(*rates), F.lag(F.struct(*rates)).over(w)
    # null-safe by text, as null rates are unknown alike
    bounds = history.withColumn("__differs", before.isNotNull() & (F.to_json(now, {"ignoreNullFields": "false"}) != F.to_json(before, {"ignoreNullFields": "false"})))
    bounds = bounds.where("__differs").select(F.col(listing).alias("__listing"), F.col("date").cast("timestamp").alias("__at"))
    keys = sessions.withColumn("__key", F.xxhash64(listing, start, end))
    bounds = F.broadcast(bounds) if few(history) else bounds  # else a listing's periods would meet in one task
    hit = keys.select("__key", listing, start, end).distinct().join(bounds, (F.col(listing) == F.col("__listing")) & (F.col("__at") > F.col(start)) & (F.col("__at") <= F.col(end)), "left_semi")
    return keys.join(hit.select("__key", F.lit(True).alias("ambiguous")), "__key", "left").drop("__key").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def match_listing(routes: DataFrame, aliases: DataFrame, listings: DataFrame, at: str = "at") -> DataFrame:
    """The listing of each (host, model_id, mode, region), null-safe in all four.

    status: matched, ambiguous (aliases disagree), inactive, expired_promotion (a promotion lasts through its last day),
    unlisted.
    """
    keys = ["host", "model_id", "mode", "region"]
    grouped = aliases.groupBy(*keys).agg(F.min("listing_id").alias("listing_id"), F.max("listing_id").alias("__other"))
    a, b = routes.alias("r"), grouped.alias("a")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    rows = a.join(b, on, "left").select("r.*", "a.listing_id", "a.__other")
    listed = listings.select(F.col("listing_id").alias("__l"), F.col("status").alias("__status"), F.col("promo").alias("__promo"), F.col("promo_until").alias("__until"))
    rows = rows.join(listed, F.col("listing_id") == F.col("__l"), "left")
    status = (
        F.when(F.col("listing_id").isNull(), "unlisted").when(F.col("listing_id") != F.col("__other"), "ambiguous").when(F.col("__l").isNull(), "unlisted")
        .when(F.col("__status") != "active", "inactive").when(F.col("__promo") & (F.to_date(at) > F.col("__until")), "expired_promotion").otherwise("matched")
    )
    return rows.withColumn("match_status", status).drop("__l", "__other", "__status", "__promo", "__until")


def current_price_leaves(snapshots: DataFrame) -> DataFrame:
    """Snapshots that none supersedes, with unique: whether their identity has just one."""
    replaced = snapshots.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("snapshot_id")).distinct()
    leaves = snapshots.join(replaced, "snapshot_id", "left_anti")
    return leaves.withColumn("unique", F.count("*").over(Window.partitionBy("identity")) == 1)


def usage_to_price_requests(index: DataFrame, usage: DataFrame) -> DataFrame:
    """One request for each session, usage digest and model, with the session's time range."""
    return index.select("session_id", "usage_digest", "started_at", "ended_at").join(usage.select("session_id", "model", "total_tokens"), "session_id").distinct()


def apply_supplement(requests: DataFrame, supplements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manual prices that cover the whole of a session (J22): identity exact, from <= start and end before until if any."""
    s = supplements.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("from").alias("__from"), F.col("until").alias("__until"), *(c for c in supplements.columns if c not in (*keys, "from", "until")))
    on = (F.col("__from") <= F.col("started_at")) & (F.col("__until").isNull() | (F.col("ended_at") <= F.col("__until")))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return requests.join(s, on, "left").drop("__from", "__until", *(f"__{k}" for k in keys))


def price_totals(rows: DataFrame, by: Sequence[str], cost: str = "cost") -> DataFrame:
    """The known subtotal always, the total only where every row is priced."""
    return rows.groupBy(*by).agg(
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("known_subtotal"), F.bool_and(F.col(cost).isNotNull()).alias("complete"), F.count("*").alias("rows"),
        F.when(F.bool_and(F.col(cost).isNotNull()), F.sum(cost)).alias("total"),
    )


def review_run_usage(runs: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Usage of analysis runs, apart from that of sources; unpriced if any model's price is unknown."""
    return price_totals(runs, by).join(runs.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in CLASSES if c in runs.columns)), list(by))
