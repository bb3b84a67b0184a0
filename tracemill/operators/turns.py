"""Question and answer turns of a conversation, and the facts that belong to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.commands import strip_ambient
from tracemill.functions.scalars import turn_unit_id
from tracemill.operators.windows import asof_last

# What is kept of an observed fact, by (kind, operation): public kind, whether it is an action, and its fields in order.
RETAINED = {
    ("tool", "tool_call"): ("tool_call", True, ("tool_id", "tool_name")),
    ("tool", "tool_result"): ("tool_result", False, ("tool_id", "tool_name", "status")),
    ("command", "command_started"): ("command_started", True, ("command_signature", "tool_id")),
    ("command", "command_finished"): ("command_finished", False, ("command_signature", "exit_code", "tool_id")),
    ("verification", "verification"): ("verification", False, ("component", "status", "exit_code", "passed", "failed", "tool_id")),
    ("file", "file_change"): ("file_change", True, ("path", "file_hash", "failed", "tool_id")),
    ("commit", "commit"): ("commit", False, ("git_head",)),
    ("commit", "commit_created"): ("commit_created", False, ("git_head",)),
    ("release", "release"): ("release", False, ("release_id", "tag", "version", "status", "target")),
    ("release", "release_created"): ("release_created", False, ("release_id", "tag", "version", "status", "target")),
    ("release", "release_published"): ("release_published", False, ("release_id", "tag", "version", "status", "target")),
    ("deployment", "deployment"): ("deployment", False, ("release_id", "version", "status", "target", "component")),
    ("version", "version"): ("version", False, ("version", "component")),
    ("branch", "branch"): ("branch", False, ("branch", "git_head", "remote_hash")),
    ("branch", "git_observation"): ("git_observation", False, ("branch", "git_head", "remote_hash")),
    ("git_status", "git_observation"): ("git_observation", False, ("branch", "status", "git_head", "tag", "tool_id")),
}


def visible_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visible user and assistant text of decoded messages, and the quarantined rest.

    ``raw``: session_id, ordinal, provider, role, ts, phase, channel, content (array<struct<type, text>>). Text parts are joined by a
    line feed, others dropped; phase comes from phase, else from the older channel; provider b's assistants always give
    final answers. Rows without a timestamp or with a text part without text are quarantined.
    """
    texts = F.filter("content", lambda p: p["type"].isin("text", "input_text", "output_text"))
    channel = F.when(F.col("channel") == "commentary", "commentary").when(F.col("channel") == "final", "final_answer")
    phase = F.when(F.col("role") != "assistant", None).when(F.col("provider") == "b", "final_answer").otherwise(F.coalesce("phase", channel))
    rows = raw.where(F.col("role").isin("user", "assistant")).withColumn("__bad", F.col("ts").isNull() | F.coalesce(F.exists(texts, lambda p: p["text"].isNull()), F.lit(False)))
    good = rows.where("NOT __bad").withColumn("text", F.array_join(F.transform(texts, lambda p: p["text"]), "\n")).withColumn("phase", phase)
    return good.where("text <> ''").drop("__bad", "content", "channel"), rows.where("__bad").drop("__bad").withColumn("reason", F.when(F.col("ts").isNull(), "bad_timestamp").otherwise("invalid_part"))


def turn_rows(messages: DataFrame, by: Sequence[str] = ("session_id",), order: str = "ordinal", strip: bool = False) -> DataFrame:
    """Messages with turn_no: the number of user messages up to each (W3); 0 before the first (orphans).

    With ``strip``, machine envelopes are taken off user texts, and users with nothing left are context that splits no turn.
    """
    rows = messages
    if strip:
        rows = rows.withColumn("text", F.when(F.col("role") == "user", strip_ambient("text")).otherwise(F.col("text")))
        rows = rows.withColumn("role", F.when((F.col("role") == "user") & (F.trim("text") == ""), "context").otherwise(F.col("role")))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("turn_no", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).cast("long"))


def turn_units(messages: DataFrame, by: Sequence[str] = ("session_id",), order: str = "ordinal", ts: str | None = None, source_complete: bool = True, strip: bool = False) -> DataFrame:
    """One row a turn: its question, when it ends (the next one's start), its messages and its answer's state.

    answer_state: none without an assistant's message; answered if the source is complete, the last phase is absent or
    final_answer and the last text is not blank; else unanswered.
    """
    rows = turn_rows(messages, by, order, strip).where("turn_no > 0")
    said = F.col("role") == "assistant"
    has_phase = "phase" in messages.columns
    aggs = [
        F.min(order).alias("start_ordinal"), F.max(order).alias("last_ordinal"), F.min_by("text", order).alias("question"), F.count_if(said).alias("answers"),
        F.max_by(F.when(said, F.col("text")), F.when(said, F.col(order))).alias("answer"),
    ]
    if has_phase:
        aggs.append(F.max_by("phase", F.when(said & F.col("phase").isNotNull(), F.col(order))).alias("phase"))
    if ts:
        aggs.append(F.min_by(ts, order).alias("started_at"))
    turns = rows.groupBy(*by, "turn_no").agg(*aggs)
    w = Window.partitionBy(*by).orderBy("turn_no")
    turns = turns.withColumn("next_ordinal", F.lead("start_ordinal").over(w))
    if ts:
        turns = turns.withColumn("ended_at", F.lead("started_at").over(w))
    final = (F.col("phase").isNull() | F.col("phase").isin("", "final_answer")) if has_phase else F.lit(True)
    state = F.when(F.col("answers") == 0, "none").when(F.lit(source_complete) & final & (F.trim(F.coalesce("answer", F.lit(""))) != ""), "answered").otherwise("unanswered")
    return turns.withColumn("answer_state", state).withColumn("turn_unit_id", turn_unit_id(F.concat_ws("/", *(F.col(c).cast("string") for c in by)), F.col("start_ordinal")))


def answer_parts(messages: DataFrame, by: Sequence[str] = ("session_id",), order: str = "ordinal") -> DataFrame:
    """Assistant messages with their place and number within their turn."""
    rows = turn_rows(messages, by, order).where((F.col("role") == "assistant") & (F.col("turn_no") > 0))
    w = Window.partitionBy(*by, "turn_no")
    return rows.withColumn("part_index", F.row_number().over(w.orderBy(order)).cast("long")).withColumn("part_count", F.count("*").over(w))


def chain_coverage(messages: DataFrame, by: Sequence[str] = ("session_id",), order: str = "ordinal", max_chars: int | None = None) -> DataFrame:
    """Per conversation: messages, turns, answered, unanswered, orphans, truncated."""
    turns = turn_units(messages, by, order).groupBy(*by).agg(
        F.count("*").alias("turns"), F.count_if(F.col("answer_state") == "answered").alias("answered"), F.count_if(F.col("answer_state") != "answered").alias("unanswered")
    )
    long = F.length("text") > max_chars if max_chars is not None else F.lit(False)
    rows = turn_rows(messages, by, order).groupBy(*by).agg(
        F.count("*").alias("messages"), F.count_if((F.col("role") == "assistant") & (F.col("turn_no") == 0)).alias("orphans"), F.count_if(long).alias("truncated")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(turns, list(by), "left").select(*by, "messages", zero("turns"), zero("answered"), zero("unanswered"), "orphans", "truncated")


def assign_facts(facts: DataFrame, turns: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Facts with the turn whose question is the last not after them (J2); null before the first turn."""
    return asof_last(facts, turns.select(*by, F.col("start_ordinal").alias("ordinal"), "turn_unit_id"), by, "ordinal", "turn_unit_id")


def retained_facts(observations: DataFrame) -> DataFrame:
    """Observations that are kept as actions or results, with kind, state and excerpt of allowed fields in order (P5)."""
    spark = observations.sparkSession
    rows = [(k, o, p, a, list(f)) for (k, o), (p, a, f) in RETAINED.items()]
    policy = spark.createDataFrame(rows, "kind string, operation string, public_kind string, action boolean, allowed array<string>")
    joined = observations.join(F.broadcast(policy), ["kind", "operation"])  # 16 rows
    f = lambda name: F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))
    tool_ok = (F.col("kind") != "tool") | ((f("tool_id") != "") & (f("tool_name") != "") & ((F.col("operation") == "tool_call") | f("status").isin("completed", "error")))
    file_ok = (F.col("kind") != "file") | F.col("outcome").isin("success", "failure")
    outcome = F.when(F.col("outcome").isin("passed", "success"), "passed").when(F.col("outcome").isin("failed", "failure"), "failed").otherwise("unknown")
    action = F.when((F.col("kind") == "file") & (F.col("outcome") == "failure"), False).otherwise(F.col("action"))
    state = F.when(action, None).when((F.col("kind") == "file"), "failed").when(F.col("public_kind").isin("command_finished", "verification"), outcome).otherwise("unknown")
    parts = F.filter(F.transform("allowed", lambda k: F.concat(k, F.lit("="), F.try_element_at("fields", k))), lambda x: x.isNotNull())
    return joined.where(tool_ok & file_ok).withColumn("state", state).withColumn("action", action).withColumn("excerpt", F.array_join(parts, "; ")).drop("allowed")


def recent_requests(messages: DataFrame, by: Sequence[str], order: Sequence, n: int = 20) -> DataFrame:
    """The newest ``n`` user messages that are no machine envelopes."""
    from tracemill.operators.windows import top_n

    words = strip_ambient("text")
    return top_n(messages.where(F.col("role") == "user").withColumn("text", words).where("trim(text) <> ''"), by, order, n)
