"""Session states, counts, the session index, its filters and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import duration_ms, fact_text, millis, public_event_kind
from tracemill.operators.facts import field, session_recovery_links, typed_outcome
from tracemill.operators.windows import summary_block


def terminal_state(malformed: Column, undecodable: Column, source: Column) -> Column:
    """unreadable where anything could not be read, else missing or ambiguous as the source is, else indexed (P10)."""
    return F.when((malformed > 0) | (undecodable > 0), "unreadable").when(source.isin("missing", "ambiguous", "unsupported"), source).otherwise("indexed")


def processing_state(state: Column, diagnostics: Column, truncated: Column) -> Column:
    """error unless indexed; partial with diagnostics or truncation; else complete."""
    return F.when(state != "indexed", "error").when((F.size(diagnostics) > 0) | truncated, "partial").otherwise("complete")


def reason_codes(*codes: Column) -> Column:
    """Sorted distinct reasons, nulls left out."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*codes))))


def fact_counts(obs: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Files, commands, verifications, errors and artifacts of each session."""
    kind = F.col("kind")
    return obs.groupBy(*by).agg(
        F.count_if(kind == "file").alias("files"), F.count_if(kind == "command").alias("commands"), F.count_if(kind.isin("test", "build", "lint", "verification")).alias("verifications"),
        F.count_if((kind == "error") | (F.col("outcome").isin("failure", "failed"))).alias("errors"), F.count_if(kind == "artifact").alias("artifacts"),
    )


def measure_sources(rows: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Records by what became of each, and whether the account adds up (A9). ``fate`` names it."""
    fates = ("indexed", "collapsed", "unprojected", "undecodable", "truncated")
    got = rows.groupBy(*by).agg(F.count("*").alias("seen"), *(F.count_if(F.col("fate") == f).alias(f) for f in fates))
    return got.withColumn("reconciled", F.col("seen") == sum((F.col(f) for f in fates), F.lit(0)))


def shared_sessions(sources: DataFrame) -> DataFrame:
    """Sessions that belong to more than one project."""
    return sources.where(F.size(F.array_distinct("project_ids")) > 1)


def progress_counters(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sources, those with a terminal state, indexed ones and those with issues."""
    state = F.col("terminal_state")
    return sessions.groupBy(*by).agg(F.count("*").alias("sources"), F.count(state).alias("terminal"), F.count_if(state == "indexed").alias("indexed"), F.count_if(state.isNotNull() & (state != "indexed")).alias("issues"))


def session_index(sessions: DataFrame, obs: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """An entry a session (R3): state, reasons, duration, fact counts. sessions: provider, session_id, project_id, started_at, ended_at, terminal_state, availability."""
    rows = sessions.join(fact_counts(obs, ("provider", "session_id")), ["provider", "session_id"], "left")
    if diagnostics is not None:
        found = diagnostics.groupBy("provider", "session_id").agg(F.array_sort(F.collect_set("code")).alias("reasons"))  # codes are a fixed list
        rows = rows.join(found, ["provider", "session_id"], "left")
    else:
        rows = rows.withColumn("reasons", F.lit(None).cast("array<string>"))
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "commands", "verifications", "errors", "artifacts")]
    return rows.select(
        *sessions.columns, reasons.alias("reasons"), processing_state(F.col("terminal_state"), reasons, F.lit(False)).alias("processing_state"),
        duration_ms("started_at", "ended_at").alias("duration_ms"), *counts,
    )


INDEX_ORDER = ("started_at", "provider", "session_id")


def index_order() -> list[Column]:
    """Newest first, unknown times last, then provider and session."""
    return [F.desc_nulls_last("started_at"), F.asc("provider"), F.asc("session_id")]


def event_order() -> list[Column]:
    """(T2)"""
    return [F.asc("ts"), F.asc("sequence"), F.asc("revision_id")]


def last_activity_order() -> list[Column]:
    """(T10)"""
    return [F.desc_nulls_last(F.coalesce("ended_at", "started_at")), F.asc("session_id")]


def index_coverage(index: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals by state, availability and known times."""
    p = F.col("processing_state")
    return index.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(p == "complete").alias("complete"), F.count_if(p == "partial").alias("partial"), F.count_if(p == "error").alias("errors"),
        F.count_if(F.col("availability") == "available").alias("available"), F.count_if(F.col("availability") != "available").alias("unavailable"),
        F.count_if(F.col("started_at").isNotNull() & F.col("ended_at").isNotNull()).alias("timed"),
    )


def filter_sessions(
    index: DataFrame, provider: str | None = None, state: str | None = None, availability: str | None = None, query: str | None = None,
    date_from: str | None = None, date_to: str | None = None, unknown_only: bool = False, tz: str = "UTC",
) -> DataFrame:
    """Sessions that meet all given conditions (P3). Dates are days of ``tz``; the query is a case-insensitive part of provider and session."""
    rows = index
    for name, value in (("provider", provider), ("processing_state", state), ("availability", availability)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if query:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "provider", "session_id")), F.lit(query.lower())))
    day = F.to_date(F.from_utc_timestamp("started_at", tz))
    if date_from:
        rows = rows.where(day >= F.lit(date_from).cast("date"))
    if date_to:
        rows = rows.where(day <= F.lit(date_to).cast("date"))
    return rows.where("started_at IS NULL") if unknown_only else rows


def carry_forward_index(previous: DataFrame, current: DataFrame, keys: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """The current index with vanished sessions kept as unavailable, and old facts where the source is unavailable now.

    Both have keys, availability, digest and facts. Rows say where their facts come from.
    """
    names = ("availability", "digest", *facts)
    p, c = (d.select(*keys, F.lit(True).alias(f"{s}__here"), *(F.col(x).alias(f"{s}_{x}") for x in names)) for d, s in ((previous, "p"), (current, "c")))
    both = p.join(c, list(keys), "full_outer")
    gone, here = F.col("c__here").isNull(), F.col("p__here").isNotNull()
    old = gone | ((F.col("c_availability") == "unavailable") & here)
    return both.select(
        *keys, F.when(gone, "unavailable").otherwise(F.col("c_availability")).alias("availability"), F.when(gone, F.col("p_digest")).otherwise(F.col("c_digest")).alias("digest"),
        *(F.when(old, F.col(f"p_{x}")).otherwise(F.col(f"c_{x}")).alias(x) for x in facts), F.when(old, "carried").otherwise("current").alias("facts_from"),
    )


def session_events(obs: DataFrame) -> DataFrame:
    """Public events: kind, excerpt, revision, sequence, time."""
    return obs.withColumn("public_kind", public_event_kind("kind")).where("public_kind IS NOT NULL").select("session_id", "public_kind", "excerpt", "revision_id", "sequence", "ts")


def session_summary(obs: DataFrame, n: int = 32) -> DataFrame:
    """Blocks of key operations, verifications, errors and unresolved failures of each session."""
    label = F.initcap(F.regexp_replace("kind", "_", " "))
    rows = obs.withColumn("typed", typed_outcome()).withColumn("line", fact_text(label, F.col("typed"), field("exit_code"), F.col("excerpt")))
    order = [F.asc("sequence"), F.asc("revision_id")]
    kind = F.col("kind")
    blocks = (
        F.when(kind.isin("file", "commit", "release", "artifact", "deployment", "command"), "operations"), F.when(kind.isin("verification", "test", "build", "lint"), "verifications"),
        F.when((kind == "error") | (F.col("typed") == "failure"), "errors"),
    )
    item = ("session_id", "sequence", "revision_id", "line", "block")
    rows = rows.withColumn("block", F.explode(F.array_compact(F.array(*blocks)))).select(*item)
    line = fact_text(label, F.lit("failure"), field("exit_code"), F.col("excerpt"))
    unresolved = session_recovery_links(obs).where("NOT recovered").withColumn("line", line).withColumn("block", F.lit("unresolved")).select(*item)
    return summary_block(rows.unionByName(unresolved), ("session_id", "block"), order, ("revision_id", "line"), n)


def latest_session(candidates: DataFrame, now: Column, window_minutes: float = 5.0) -> DataFrame:
    """The latest candidate of each project by file time (S8): ambiguous if the next is closer than the window; times in the future by more than 5 minutes are refused."""
    rows = candidates.where(millis("modified_at") <= millis(now) + 300_000)
    w = Window.partitionBy("project_id").orderBy(F.desc("modified_at"), F.asc("session_id"))
    rows = rows.withColumn("__rn", F.row_number().over(w)).withColumn("__next", F.lead("modified_at").over(w)).where("__rn = 1")
    return rows.withColumn("ambiguous", F.coalesce(millis("modified_at") - millis("__next") < int(window_minutes * 60_000), F.lit(False))).drop("__rn", "__next")
