"""Observations: filters, outcomes, calls joined to outputs, and the project each belongs to.

The observation columns used here: provider, session_id, source_identity, sequence, project_id, kind, subject, revision_id, ts, operation, object,
outcome, fields (map<string,string>), excerpt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import FAILED, PASSED, normalize_identity, normalized_outcome
from tracemill.operators.scans import carried

# Kinds that are observed directly, field names that are structured, and kinds that carry meaning instead.
DIRECT_KINDS = (
    "artifact", "branch", "build", "command", "commit", "deployment", "error", "file", "git_status", "lint", "release", "request", "sync", "tag", "test",
    "tool", "verification", "version",
)
FIELD_NAMES = (
    "artifact_id", "branch", "command_signature", "component", "duration_ms", "error_signature", "exit_code", "failed", "file_hash", "git_head", "model", "passed",
    "path", "remote_hash", "release_id", "skipped", "status", "tag", "target", "tool_id", "tool_name", "version",
)
SEMANTIC_KINDS = ("analysis", "decision", "intent", "rationale", "recommendation", "semantic", "summary")
# Milestone priorities by (kind, operation).
MILESTONES = {
    ("verification", "verification"): 10, ("commit", "commit"): 20, ("commit", "commit_created"): 20, ("version", "version"): 30, ("deployment", "deployment"): 40,
    ("release", "release"): 50, ("release", "release_created"): 50, ("release", "release_published"): 50,
}
# Operations of each kind whose outcome is understood.
KNOWN_OPERATIONS = {
    "file": ("file_change",), "verification": ("verification", "test", "build", "lint"), "test": ("test",), "build": ("build",), "lint": ("lint",),
    "artifact": ("artifact_created",), "commit": ("commit", "commit_created"), "release": ("release", "release_created", "release_published"),
    "error": ("error", "error_observed"), "command": ("command_finished",),
}


def field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def filter_direct(obs: DataFrame) -> DataFrame:
    """Observations of direct kinds whose fields are all structured ones."""
    names = F.array(*map(F.lit, FIELD_NAMES))
    return obs.where(F.col("kind").isin(*DIRECT_KINDS) & F.coalesce(F.forall(F.map_keys("fields"), lambda k: F.array_contains(names, k)), F.lit(True)))


def canonical_int(c: Column) -> Column:
    """The integer that a string spells in its only canonical form, else null."""
    n = c.try_cast("long")
    return F.when(n.cast("string") == c, n)


def typed_outcome() -> Column:
    """success, failure, unrecorded, unknown or conflict: an outcome that the exit code contradicts."""
    started = (F.col("kind") == "command") & (F.col("operation") == "command_started")
    known = F.lit(False)
    for kind, ops in KNOWN_OPERATIONS.items():
        known = known | ((F.col("kind") == kind) & F.col("operation").isin(*ops))
    word = normalize_identity(F.coalesce("outcome", F.lit("")))
    out = F.when(word.isin(*PASSED), "success").when(word.isin(*FAILED), "failure").when(word == "", "unrecorded").otherwise("unknown")
    code = canonical_int(field("exit_code"))
    clash = ((out == "success") & (code != 0)) | ((out == "failure") & (code == 0))
    return F.when(started, "unrecorded").when(~known, "unknown").when(F.coalesce(clash, F.lit(False)), "conflict").otherwise(out)


def verification_passed() -> Column:
    word = F.lower(F.trim(F.coalesce("outcome", F.lit(""))))
    code, failed, passed = field("exit_code"), field("failed"), field("passed")
    good = word.isin(*PASSED) & (code.isNull() | F.coalesce(canonical_int(code) == 0, F.lit(False))) & (failed.isNull() | failed.isin("0", "false"))
    return good & (passed.isNull() | (passed == "true") | F.coalesce(canonical_int(passed) > 0, F.lit(False)))


def verification_state() -> Column:
    """passed, failed, conflict or unknown, as milestones show it."""
    word = F.lower(F.trim(F.coalesce("outcome", F.lit(""))))
    clash = F.coalesce((field("exit_code") == "0") | field("failed").isin("0", "false"), F.lit(False))
    return F.when(verification_passed(), "passed").when(word.isin(*PASSED), "conflict").when(word.isin(*FAILED) & clash, "conflict").when(word.isin(*FAILED), "failed").otherwise("unknown")


def qualify_milestones(obs: DataFrame) -> DataFrame:
    """Facts that can make a milestone, with category and priority; failed ones cannot."""
    priority = F.lit(None).cast("int")
    for (kind, op), n in MILESTONES.items():
        priority = F.when((F.col("kind") == kind) & (F.col("operation") == op), n).otherwise(priority)
    rows = obs.withColumn("priority", priority).where(F.col("priority").isNotNull() & ~F.lower(F.trim(F.coalesce("outcome", F.lit("")))).isin(*FAILED))
    return rows.where((F.col("kind") != "verification") | verification_passed()).withColumn("category", F.col("kind"))


def strongest_facts(facts: DataFrame, by: Sequence[str] = ("turn_unit_id",)) -> DataFrame:
    """One fact a turn: the highest priority, then the latest."""
    w = Window.partitionBy(*by).orderBy(F.desc("priority"), F.desc("ts"), F.desc("sequence"), F.desc("revision_id"))
    return facts.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def join_tool_calls(calls: DataFrame, outputs: DataFrame, by: Sequence[str] = ("session_id",)) -> tuple[DataFrame, DataFrame]:
    """Calls with the first output after them, and diagnostics.

    A call id that occurs twice invalidates all its results; an output without a call is unsupported; a call without one stays
    started. ``calls`` and ``outputs``: by, call_id, ordinal and further columns.
    """
    keys = [*by, "call_id"]
    c = calls.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    o = outputs.select(*keys, F.col("ordinal").alias("output_ordinal"), *(F.col(x).alias(f"output_{x}") for x in outputs.columns if x not in (*keys, "ordinal")))
    joined = c.join(o, keys, "left").withColumn("__after", (F.col("__n") == 1) & F.col("output_ordinal").isNotNull() & (F.col("output_ordinal") > F.col("ordinal")))
    w = Window.partitionBy(*keys, "ordinal").orderBy(F.desc("__after"), F.col("output_ordinal").asc_nulls_last())
    first = joined.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    out = [x for x in o.columns if x not in keys]
    state = F.when(F.col("__n") > 1, "duplicate_call").when(F.col("__after"), "finished").otherwise("started")
    rows = first.select(*calls.columns, *(F.when(F.col("__after"), F.col(x)).alias(x) for x in out), state.alias("call_state"))
    lost = outputs.join(calls.select(*keys).distinct(), keys, "left_anti").select(*keys, "ordinal", F.lit("output_without_call").alias("diagnostic"))
    twice = c.where("__n > 1").select(*keys, "ordinal", F.lit("duplicate_call").alias("diagnostic"))
    return rows, lost.unionByName(twice)


def attribute_projects(obs: DataFrame, roots: DataFrame, path: str = "path", broadcast_roots: int = 10_000) -> DataFrame:
    """The project whose root holds a path: project_id where one does, owner in (owner, ambiguous, foreign).

    Distinct paths are spread to their ancestors and joined by equality, which costs the depth of a path and not the number of roots;
    rows find their owner by their path, so nothing depends on how they are distributed.
    """
    parts = F.split(F.regexp_replace(F.col(path), "/+$", ""), "/")
    depth = F.when(F.startswith(F.col(path), F.lit("/")), F.size(parts)).otherwise(F.lit(0))
    up = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    known = roots.select("project_id", F.when(F.col("root") == "/", "/").otherwise(F.regexp_replace("root", "/+$", "")).alias("__root")).distinct()
    met = obs.select(path).where(F.col(path).isNotNull()).distinct().select(F.col(path).alias("__path"), F.explode(up).alias("__root"))
    met = met.join(known, "__root").groupBy("__path").agg(F.countDistinct("project_id").alias("__n"), F.min("project_id").alias("__p"))
    rows = obs.drop("project_id").join(met, F.col(path) == F.col("__path"), "left").drop("__path")
    owner = F.when(F.col("__n") == 1, "owner").when(F.col("__n") > 1, "ambiguous").otherwise("foreign")
    return rows.withColumn("owner", owner).withColumn("project_id", F.when(F.col("__n") == 1, F.col("__p"))).drop("__n", "__p")


def quarantine(attributed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with exactly one project, and the others with the reason."""
    return attributed.where("owner = 'owner'").drop("owner"), attributed.where("owner <> 'owner'").withColumnRenamed("owner", "reason")


def session_recovery_links(obs: DataFrame, by: Sequence[str] = ("session_id",), key: Sequence[str] = ("kind", "operation", "component"), order: str = "sequence", value: str = "revision_id") -> DataFrame:
    """Failures with the first success of the same key strictly later in the session, null if none."""
    rows = obs.withColumn("__o", normalized_outcome("outcome")).where("__o <> ''")
    # backwards, so that each frame adds a row to the one before: linear in the size of a key
    w = Window.partitionBy(*by, *key).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__s", F.min(F.when(F.col("__o") == "success", F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).over(w))
    return rows.where("__o = 'failure'").withColumn("recovered_at", F.col("__s.o")).withColumn("recovered_by", F.col("__s.v")).withColumn("recovered", F.col("__s").isNotNull()).drop("__o", "__s")


def cross_session_recovery_links(obs: DataFrame, by: Sequence[str] = ("project_id",), key: Sequence[str] = ("kind", "operation", "component"), order: Sequence[str] = ("ts", "provider", "session_id", "sequence", "revision_id")) -> DataFrame:
    """Failures whose next success of the key, in the project's order, is in another session.

    A success of the same session ends the failure without a link, so sessions are compared after the success is found. A key may be larger than a task.
    """
    rows = obs.withColumn("__o", normalized_outcome("outcome")).where("__o <> ''")
    found = F.when(F.col("__o") == "success", F.struct("session_id", "revision_id"))
    rows = carried(rows, [*by, *key], order, found, "__s", later=True)
    return rows.where("__o = 'failure' AND __s IS NOT NULL AND __s.session_id <> session_id").withColumn("recovered_session", F.col("__s.session_id")).withColumn("recovered_by", F.col("__s.revision_id")).drop("__o", "__s")
