"""Structured Streaming forms of the operators. Sessions are keyed state; order is the record's ordinal, not the clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.scalars import normalized_outcome
from tracemill.sources.tail import TranscriptTail
from tracemill.sources.transcripts import line_columns
from tracemill.streaming.stateful import CLASSES, Debouncer, RecoveryLinker, UsageMeter, keyed


def stream_raw_records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of growing transcript files as they are appended (ST1): file, relation (initial, append, replacement), ordinal, byte_offset, line, source_hash.

    The checkpoint holds how far each file was read and a probe of what was read; see ``sources.tail`` for the options.
    """
    spark.dataSource.register(TranscriptTail)
    return line_columns(spark.readStream.format(TranscriptTail.name()).options(**options).load(path))


def dedupe_revisions(stream: DataFrame, ts: str = "ts", delay: str = "1 day", key: str = "revision_id") -> DataFrame:
    """Each revision once within the watermark (ST4)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def usage_by_window(stream: DataFrame, ts: str = "ts", size: str = "1 day", slide: str | None = None, delay: str = "1 day", keys: tuple[str, ...] = ("model",), value: str = "total_tokens") -> DataFrame:
    """Tokens by tumbling or sliding window (ST8); also for batch tables."""
    rows = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w.alias("w"), *keys).agg(F.sum(value).cast("long").alias(value), F.count("*").alias("rows")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, value, "rows")


def stream_pairs(calls: DataFrame, outputs: DataFrame, bound: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Calls joined to outputs within ``bound`` after them, and calls without one once the watermark has passed (ST7)."""
    c = calls.withWatermark("call_ts", delay)
    o = outputs.select(F.col("session_id").alias("o_session"), F.col("call_id").alias("o_call"), "out_ts", "output").withWatermark("out_ts", delay)
    on = F.expr(f"session_id = o_session AND call_id = o_call AND out_ts >= call_ts AND out_ts <= call_ts + interval {bound}")
    return c.join(o, on, "leftOuter").drop("o_session", "o_call")


def stream_session_usage(stream: DataFrame, held: int = 256, ttl_ms: int | None = None) -> DataFrame:
    """Running usage of each session and model (ST2), in update mode: the totals of a session are given anew with each batch that has rows of it.

    stream: session_id, ordinal, model, last and cumulative (structs of token classes, or null), as ``accounting.usage_rows`` takes them; or input_tokens,
    output_tokens, total_tokens and cumulative_total. Rows count in the order of their ordinals, however batches are cut: the ``held`` highest of a session stay in state and
    are counted anew when a row comes before them. Rows before those, and rows that repeat an ordinal, are not counted but reported: late (rows) and late_tokens (of those
    that repeat nothing held). State of a session is forgotten after ``ttl_ms`` without rows, if set.
    """
    if "last" not in stream.columns:
        i, o, t = (F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "total_tokens"))
        zero = F.lit(0).cast("long")
        kinds = lambda *x: F.struct(*(v.cast("long").alias(c) for c, v in zip(CLASSES, x)))
        stream = stream.withColumn("last", F.when(F.col("total_tokens").isNotNull(), kinds(i, zero, zero, o, zero, t)))
        stream = stream.withColumn("cumulative", F.when(F.col("cumulative_total").isNotNull(), kinds(zero, zero, zero, zero, zero, F.col("cumulative_total"))))
    out = "session_id string, model string, " + ", ".join(f"{c} long" for c in CLASSES) + ", heartbeats long, invalid_rows long, late long, late_tokens long"
    classes = [F.col(f"{x}.{c}").cast("long").alias(f"{p}_{c}") for x, p in (("last", "u"), ("cumulative", "c")) for c in CLASSES]
    rows = stream.select(F.col("session_id").cast("string").alias("session_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("model").cast("string").alias("model"), F.col("last").isNotNull().alias("used"), F.col("cumulative").isNotNull().alias("known"), *classes)
    return keyed(rows, ["session_id"], UsageMeter(held, ttl_ms), out, "update", "ProcessingTime" if ttl_ms else "None")


def stream_recovery_links(stream: DataFrame, max_open: int | None = 4096, delay: str = "0 seconds", idle_ms: int = 60_000, ttl_ms: int | None = None) -> DataFrame:
    """Failures linked to the next success of their project and key (ST3), in append mode: project_id, failure, recovered_by, recovered_session, state.

    stream: project_id, session_id, kind, operation, component, sequence, ts, revision_id, outcome, and provider if there are several. Links within a session are kept
    silent, as the batch form does. A row waits until one of its key is newer by ``delay``, or none came for ``idle_ms``, and rows are then taken in the
    project's order: the links are those of the batch form as long as rows are late by less. Later ones are given out with state late. At most ``max_open``
    failures of a key wait; the oldest beyond it are given out with state unlinked, so none is lost.
    """
    rows = stream.withColumn("result", normalized_outcome("outcome")).where("result <> ''").withColumn("__key", F.concat_ws(":", "kind", "operation", "component"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    provider = text("provider") if "provider" in stream.columns else F.lit("").alias("provider")
    rows = rows.select(text("project_id"), "__key", provider, text("session_id"), F.coalesce("sequence", F.lit(0)).cast("long").alias("sequence"), F.unix_micros("ts").alias("at"), text("revision_id"), "result").where("at IS NOT NULL")
    micros = stream.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {delay}) AS d").first()["d"]
    return keyed(rows, ["project_id", "__key"], RecoveryLinker(micros, idle_ms, max_open, ttl_ms), "project_id string, failure string, recovered_by string, recovered_session string, state string", "append", "ProcessingTime" if micros or ttl_ms else "None")


def debounce(stream: DataFrame, entity: str = "entity", ts: str = "ts", gap: str = "750 milliseconds") -> DataFrame:
    """The last event of each burst of an entity (ST5): entity, hash, last_at, events, ready_at. Each event pushes the end of its burst by ``gap``.

    On a stream a timer ends the burst, without a further event. A boolean column ``written`` may mark rows that tell what was written here:
    events with the hash last written are ignored. On a table, bursts are session windows.
    """
    if not stream.isStreaming:
        rows = stream.groupBy(entity, F.session_window(ts, gap).alias("w")).agg(F.max_by("hash", ts).alias("hash"), F.max(ts).alias("last_at"), F.count("*").alias("events"))
        return rows.select(entity, "hash", "last_at", "events", F.col("w.end").alias("ready_at"))
    written = F.coalesce("written", F.lit(False)) if "written" in stream.columns else F.lit(False)
    millis = stream.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {gap}) AS d").first()["d"]
    rows = stream.select(F.col(entity).cast("string").alias("entity"), "hash", F.unix_micros(ts).alias("at"), written.alias("written"))
    found = keyed(rows, ["entity"], Debouncer(millis), "entity string, hash string, at long, events long, deadline long", "append", "ProcessingTime")
    return found.select(F.col("entity").alias(entity), "hash", F.timestamp_micros("at").alias("last_at"), "events", F.timestamp_millis("deadline").alias("ready_at"))


def without_echo(events: DataFrame, written: DataFrame, entity: str = "entity") -> DataFrame:
    """Events that are not our own writes (ST5)."""
    return events.join(written.select(entity, "hash"), [entity, "hash"], "left_anti")


def for_each_relation(previous: Callable[[], DataFrame | None], apply: dict[str, Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends sources to the handler of how they moved on (ST6): initial, append, replacement, usage_refresh."""
    from tracemill.operators.lineage import boundary_relation

    def run(batch: DataFrame, epoch: int) -> None:
        before = previous()
        if before is None:
            before = batch.limit(0)
        rows = boundary_relation(before, batch).persist()
        for relation, handler in apply.items():
            part = rows.where(F.col("relation") == relation)
            if not part.isEmpty():
                handler(part)
        rows.unpersist()

    return run


def publish_batches(table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds a generation a batch, and none where nothing changed (ST9)."""
    from tracemill.sources.generations import write_generation

    return lambda batch, epoch: write_generation(batch, table, f"{epoch:012d}") and None
