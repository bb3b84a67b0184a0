"""Session transcripts as tables: lines with ordinals and offsets, segments, and the three providers' records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTENT = "array<struct<type: string, text: string>>"
USAGE = "input_tokens long, cached_input_tokens long, cache_write_input_tokens long, output_tokens long, reasoning_output_tokens long, total_tokens long"
# Record types of provider b that only keep books.
BOOKKEEPING = ("summary", "file-history-snapshot", "queue-operation", "progress", "system", "last-prompt", "ai-title", "mode", "permission-mode", "attachment")


def line_columns(rows: DataFrame) -> DataFrame:
    """Lines without carriage returns and blank ones, with the SHA-256 of the trimmed line."""
    line = F.regexp_replace("line", r"\r$", "")
    return rows.withColumn("line", line).where(F.trim("line") != "").withColumn("source_hash", F.sha2(F.trim("line"), 256))


def lines_of(texts: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """Lines of whole files with ordinal from 1, byte offset and SHA-256 of the trimmed line (S1). Blank lines use up an ordinal and give no row.

    For small files, as a file is one row; ``read_session_lines`` splits files.
    """
    kept = [c for c in texts.columns if c != value]
    schema = T.StructType([*(texts.schema[c] for c in kept), T.StructField("ordinal", T.IntegerType()), T.StructField("byte_offset", T.LongType()), T.StructField("line", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(value).to_pylist()):
                if text is None:
                    continue
                lines = text.split(b"\n")
                ends = np.cumsum([len(x) + 1 for x in lines])
                same = [pa.concat_arrays([batch.column(c).slice(i, 1)] * len(lines)) for c in kept]
                own = [pa.array(np.arange(1, len(lines) + 1, dtype=np.int32)), pa.array(np.concatenate([[0], ends[:-1]])), pa.array([x.decode(errors="replace") for x in lines])]
                yield pa.RecordBatch.from_arrays(same + own, names=schema.names)

    return line_columns(texts.withColumn(value, F.col(value).cast("binary")).mapInArrow(run, schema))


def read_session_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all transcript files under ``path``, with file and its modification time.

    Files are read in splits of bounded size: lines are numbered and offsets summed within a split, and splits, one row each, within
    a file; no task or row holds a whole file.
    """
    at = "_metadata.file_block_start"
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified_at"), F.col(at).alias("__split"), F.monotonically_increasing_id().alias("__row"), (F.octet_length("value") + 1).cast("long").alias("__bytes")
    )
    before = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "__split").agg(F.count("*").alias("n"), F.sum("__bytes").alias("b"))
    splits = splits.select("file", "__split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("__b"))
    inside = Window.partitionBy("file", "__split").orderBy("__row")
    rows = rows.withColumn("__i", F.row_number().over(inside)).withColumn("__o", F.sum("__bytes").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(splits, ["file", "__split"]).select("file", "modified_at", (F.col("__n") + F.col("__i")).cast("int").alias("ordinal"), (F.col("__b") + F.coalesce("__o", F.lit(0))).alias("byte_offset"), "line")
    return line_columns(rows)


def split_malformed(lines: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines that are JSON within the size limit, and the others with the reason (S3)."""
    big = F.lit(False) if max_bytes is None else F.octet_length("line") > max_bytes
    rows = lines.withColumn("reason", F.when(big, "too_large").when(F.try_parse_json("line").isNull(), "not_json"))
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def concat_segments(lines: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions split over files joined into one run of ordinals, and files that conflict.

    segments: file, session_id, project_id, started_at, n_lines (all ordinals of the file). Segments are ordered by start; equal starts
    or several projects in a session conflict.
    """
    w = Window.partitionBy("session_id")
    seg = segments.withColumn("__same", F.count("*").over(Window.partitionBy("session_id", "started_at"))).withColumn("__lo", F.min("project_id").over(w)).withColumn("__hi", F.max("project_id").over(w))
    reason = F.when(F.max("__same").over(w) > 1, "equal_start").when(~F.col("__lo").eqNullSafe(F.col("__hi")), "several_projects")
    seg = seg.withColumn("reason", reason)
    before = F.coalesce(F.sum("n_lines").over(w.orderBy("started_at", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    good = seg.where("reason IS NULL").select("file", "session_id", before.alias("__before"))
    return lines.join(good, "file").withColumn("ordinal", (F.col("ordinal") + F.col("__before")).cast("long")).drop("__before"), seg.where("reason IS NOT NULL").select(*segments.columns, "reason")


def discover_sessions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first session_meta of each file of provider a, and files without one."""
    meta = F.from_json("line", "type string, timestamp string, payload struct<id: string, cwd: string>")
    rows = lines.withColumn("m", meta)
    got = rows.groupBy("file").agg(F.min_by("m", F.when(F.col("m.type") == "session_meta", F.col("ordinal"))).alias("m"), F.max("ordinal").alias("n_lines"), F.min_by(F.col("m.timestamp"), "ordinal").alias("first_ts"))
    found = got.select("file", F.col("m.payload.id").alias("session_id"), F.col("m.payload.cwd").alias("cwd"), F.try_to_timestamp(F.coalesce("m.timestamp", "first_ts")).alias("started_at"), "n_lines")
    return found.where("session_id IS NOT NULL"), found.where("session_id IS NULL").select("file", F.lit("no_session_meta").alias("issue"))


def decode_a(lines: DataFrame) -> DataFrame:
    """Records of provider a (S4): kind, role, phase, content, call_id, name, input, output, model, cwd, last and cumulative usage.

    Reasoning is dropped; types that are not known get kind unsupported.
    """
    r = F.from_json(
        "line",
        "timestamp string, type string, payload struct<id: string, type: string, role: string, phase: string, channel: string, call_id: string, name: string, input: string, arguments: string, output: string, "
        f"model: string, cwd: string, content: {CONTENT}, info: struct<last_token_usage: struct<{USAGE}>, total_token_usage: struct<{USAGE}>>>",
    )
    rows = lines.withColumn("r", r).withColumn("p", F.col("r.payload"))
    kind = (
        F.when(F.col("r.type").isin("session_meta", "turn_context"), F.col("r.type"))
        .when((F.col("r.type") == "response_item") & (F.col("p.type") == "message"), "message")
        .when((F.col("r.type") == "response_item") & F.col("p.type").isin("custom_tool_call", "function_call"), "tool_call")
        .when((F.col("r.type") == "response_item") & F.col("p.type").isin("custom_tool_call_output", "function_call_output"), "tool_output")
        .when((F.col("r.type") == "response_item") & (F.col("p.type") == "reasoning"), "reasoning")
        .when((F.col("r.type") == "event_msg") & F.col("p.info.last_token_usage").isNotNull(), "usage").when(F.col("r.type") == "event_msg", "event").otherwise("unsupported")
    )
    rows = rows.withColumn("kind", kind).where("kind <> 'reasoning'")
    return rows.select(
        *lines.columns, "kind", F.try_to_timestamp("r.timestamp").alias("ts"), F.col("r.timestamp").alias("ts_raw"), F.col("p.id").alias("record_id"), F.col("p.role").alias("role"), F.col("p.phase").alias("phase"),
        F.col("p.channel").alias("channel"), F.col("p.content").alias("content"), F.col("p.call_id").alias("call_id"), F.col("p.name").alias("name"), F.coalesce("p.input", "p.arguments").alias("input"),
        F.col("p.output").alias("output"), F.col("p.model").alias("model"), F.col("p.cwd").alias("cwd"), F.col("p.info.last_token_usage").alias("last"), F.col("p.info.total_token_usage").alias("cumulative"),
    ).drop("line")


def decode_b(lines: DataFrame, session_of_file: str = "session_id") -> DataFrame:
    """Records of provider b (S5). diagnostic: session_mismatch, bad_timestamp, unsupported, or null; bookkeeping rows are dropped.

    session_started marks the first line of a conversation in each session.
    """
    r = F.from_json(
        "line",
        "type string, sessionId string, cwd string, uuid string, timestamp string, message struct<id: string, role: string, model: string, content: string, "
        "usage: struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>>",
    )
    rows = lines.withColumn("r", r).where(~F.coalesce(F.col("r.type").isin(*BOOKKEEPING), F.lit(False)))
    talk = F.col("r.type").isin("user", "assistant")
    ts = F.try_to_timestamp("r.timestamp")
    why = F.when(~F.coalesce(talk, F.lit(False)), "unsupported").when(F.col("r.sessionId") != F.col(session_of_file), "session_mismatch").when(ts.isNull(), "bad_timestamp")
    parts = F.from_json("r.message.content", "array<struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string, content: string>>")
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("r.message.content").alias("text")))
    content = F.when(F.startswith(F.ltrim("r.message.content"), F.lit("[")), F.transform(parts, lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text")))).otherwise(plain)
    rows = rows.withColumn("diagnostic", why).withColumn("__first", F.min(F.when(F.col("diagnostic").isNull(), F.col("ordinal"))).over(Window.partitionBy(session_of_file)))
    return rows.select(
        *lines.columns, F.col("r.type").alias("kind"), ts.alias("ts"), F.col("r.timestamp").alias("ts_raw"), F.col("r.message.id").alias("message_id"), F.col("r.message.role").alias("role"),
        F.col("r.message.model").alias("model"), F.col("r.cwd").alias("cwd"), content.alias("content"), F.filter(parts, lambda x: x["type"] == "tool_use").alias("tool_uses"),
        F.filter(parts, lambda x: x["type"] == "tool_result").alias("tool_results"), F.col("r.message.usage").alias("usage"), "diagnostic", (F.col("ordinal") == F.col("__first")).alias("session_started"),
    ).drop("line")


def decode_c(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """Records of the relational provider c, of finalized turns only.

    A turn starts at a user message. It is final when all its assistants are completed and no tool waits; turns after the first
    that is not final are held back.
    """
    data = "role string, finish string, modelID string, providerID string, time struct<created: long, completed: long>, tokens struct<input: long, output: long, reasoning: long, total: long, cache: struct<read: long, write: long>>"
    m = message.select("id", "session_id", F.timestamp_millis("time_created").alias("ts"), F.from_json("data", data).alias("d"))
    p = part.select("message_id", F.from_json("data", "type string, text string, synthetic boolean, ignored boolean, callID string, tool string, state struct<status: string, input: string, output: string, error: string>").alias("d"))
    waits = p.groupBy("message_id").agg(F.bool_or((F.col("d.type") == "tool") & ~F.coalesce(F.col("d.state.status").isin("completed", "error"), F.lit(False))).alias("waits"))
    rows = m.join(session.select(F.col("id").alias("session_id"), F.col("directory").alias("cwd")), "session_id").join(waits, m.id == waits.message_id, "left")
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    rows = rows.where(F.col("d.role").isin("user", "assistant")).withColumn("ordinal", F.row_number().over(w).cast("long")).withColumn("turn_no", F.count_if(F.col("d.role") == "user").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bad = ((F.col("d.role") == "assistant") & F.col("d.time.completed").isNull()) | F.coalesce("waits", F.lit(False))
    turns = rows.groupBy("session_id", "turn_no").agg(F.bool_or(bad).alias("bad"), F.bool_or(F.col("d.role") == "assistant").alias("answered"))
    cut = turns.where("bad OR NOT answered").groupBy("session_id").agg(F.min("turn_no").alias("cut"))
    final = rows.join(cut, "session_id", "left").where("cut IS NULL OR turn_no < cut")
    texts = p.where("d.type = 'text' AND NOT coalesce(d.synthetic, false) AND NOT coalesce(d.ignored, false)").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct(F.lit("text").alias("type"), F.col("d.text").alias("text")))).alias("content"))
    return final.join(texts.withColumnRenamed("message_id", "__m"), F.col("id") == F.col("__m"), "left").select(
        "session_id", "ordinal", F.col("id").alias("message_id"), "ts", "cwd", F.col("d.role").alias("role"), F.col("d.modelID").alias("model"), F.col("d.tokens").alias("tokens"), "content", "turn_no"
    )


#: Decoders by provider: a user registers further ones under a name of their own.
DECODERS: dict[str, Callable[[DataFrame], DataFrame]] = {"a": decode_a, "b": decode_b}


def register_decoder(name: str, decoder: Callable[[DataFrame], DataFrame]) -> None:
    DECODERS[name] = decoder


def union_providers(spark: SparkSession, frames: dict[str, DataFrame | None], required: tuple[str, ...] = ()) -> tuple[DataFrame | None, DataFrame]:
    """All providers' rows with the provider's name, and diagnostics of missing ones; a missing required one is an error."""
    lacking = [n for n in required if frames.get(n) is None]
    if lacking:
        raise ValueError(f"required providers are missing: {', '.join(lacking)}")
    out = None
    for name, frame in frames.items():
        if frame is not None:
            rows = frame.withColumn("provider", F.lit(name))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    missing = [(n, "provider_missing") for n, f in frames.items() if f is None]
    return out, spark.createDataFrame(missing, "provider string, diagnostic string")


def frozen_boundary(lines: DataFrame, at: Column | None = None) -> DataFrame:
    """How far each file may be read: lines, the offset of the last one, and a hash of all line hashes with their ordinals up to there.

    The hash is made of sums over lines, so parts of a file are hashed apart, in any order and number, and added (``boundary_parts``).
    """
    return merge_boundaries(boundary_parts(lines if at is None else lines.where(F.col("ordinal") <= at)))


def boundary_parts(lines: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Sums that stand for the lines of a part of a file: eight numbers of 32 bits of SHA-256(ordinal:source_hash), each added up. Good for 2 ** 31 lines."""
    rows = lines.withColumn("__h", F.sha2(F.concat_ws(":", "ordinal", "source_hash"), 256))
    lanes = [F.sum(F.conv(F.substring("__h", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"lane{k}") for k in range(8)]
    return rows.groupBy(*by).agg(F.max("ordinal").alias("lines"), F.max("byte_offset").alias("last_offset"), *lanes)


def merge_boundaries(parts: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Boundaries of whole files from those of their parts, which share no line."""
    lanes = [F.sum(f"lane{k}") for k in range(8)]
    return parts.groupBy(*by).agg(F.max("lines").alias("lines"), F.max("last_offset").alias("last_offset"), F.sha2(F.concat_ws(":", *(x.cast("string") for x in lanes)), 256).alias("prefix_hash"))
