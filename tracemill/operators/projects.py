"""Views over all sessions of a project: latest state, phases, modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import derived_id, normalize_path, recency_bucket
from tracemill.operators.facts import cross_session_recovery_links, field, session_recovery_links
from tracemill.operators.scans import carried
from tracemill.operators.windows import gaps

PROJECT_ORDER = ("ts", "provider", "session_id", "sequence", "revision_id")


def witnessed_state(obs: DataFrame, by: Sequence[str] = ("project_id",), order: Sequence[str] = PROJECT_ORDER) -> DataFrame:
    """The newest value of each state key: branch, git_status, head, version, verification:component."""
    pairs = F.array_compact(F.array(
        F.when(F.col("kind").isin("branch", "git_status"), F.struct(F.lit("branch").alias("k"), field("branch").alias("v"))),
        F.when(F.col("kind") == "git_status", F.struct(F.lit("git_status").alias("k"), field("status").alias("v"))),
        F.when(F.col("kind").isin("branch", "git_status", "commit"), F.struct(F.lit("head").alias("k"), field("git_head").alias("v"))),
        F.when(F.col("kind") == "version", F.struct(F.lit("version").alias("k"), field("version").alias("v"))),
        F.when(F.col("kind") == "verification", F.struct(F.concat(F.lit("verification:"), field("component")).alias("k"), F.col("outcome").alias("v"))),
    ))
    rows = obs.withColumn("kv", F.explode(pairs)).where("kv.k IS NOT NULL AND kv.v IS NOT NULL AND trim(kv.v) <> ''")
    return rows.groupBy(*by, F.col("kv.k").alias("state_key")).agg(F.max_by(F.struct(F.col("kv.v").alias("v"), "revision_id", "ts"), F.struct(*order)).alias("m")).select(
        *by, "state_key", F.col("m.v").alias("value"), F.col("m.revision_id").alias("revision_id"), F.col("m.ts").alias("ts")
    )


def structural_phases(obs: DataFrame, by: Sequence[str] = ("project_id",), order: Sequence[str] = PROJECT_ORDER) -> DataFrame:
    """Changes of branch, version, tag and release (W7). The first branch is where a project starts; the first of the others counts.

    A project may be larger than a task.
    """
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (
        ("branch", F.when(F.col("kind").isin("branch", "git_status"), field("branch"))), ("version", F.when(F.col("kind").isin("version", "git_status", "release"), field("version"))),
        ("tag", F.when(F.col("kind").isin("tag", "git_status", "release"), field("tag"))), ("release", F.when(F.col("kind").isin("release", "git_status"), field("release_id"))),
    )))
    rows = obs.withColumn("kv", F.explode(kinds)).where("kv.v IS NOT NULL AND trim(kv.v) <> ''")
    rows = rows.select(*by, *order, F.col("kv.k").alias("phase_kind"), F.col("kv.v").alias("value"))
    rows = carried(rows, [*by, "phase_kind"], order, F.col("value"), "previous_value")
    return rows.where((F.col("previous_value") != F.col("value")) | (F.col("previous_value").isNull() & (F.col("phase_kind") != "branch")))


def gap_phases(obs: DataFrame, by: Sequence[str] = ("project_id",), hours: float = 720.0) -> DataFrame:
    """Events after a pause of more than ``hours``."""
    return gaps(obs, by, "ts", PROJECT_ORDER[1:], hours)


def module_ranking(obs: DataFrame, reference: Column, by: Sequence[str] = ("project_id",), path: str = "path", session: str = "session_id") -> DataFrame:
    """Modules with at least one file fact, by score = 4 sessions + 2 verifications + successful changes + recency.

    Verifications count sessions too. Sessions are counted exactly, through one row a module and session.
    """
    is_file, is_check = F.col("kind") == "file", F.col("kind") == "verification"
    rows = obs.where(is_file | is_check).withColumn(path, normalize_path(path)).where(F.col(path) != "")
    per = rows.groupBy(*by, path, session).agg(
        F.count_if(is_file).alias("files"), F.count_if(is_check).alias("checks"), F.count_if(is_file & (F.col("outcome") == "success")).alias("done"), F.max("ts").alias("latest")
    )
    mods = per.groupBy(*by, path).agg(F.count("*").alias("sessions"), F.sum("checks").alias("verifications"), F.sum("done").alias("changes"), F.max("latest").alias("latest"), F.sum("files").alias("files"))
    mods = mods.where("files > 0").withColumn("recency", recency_bucket(reference, F.col("latest")).cast("long"))
    mods = mods.withColumn("score", 4 * F.col("sessions") + 2 * F.col("verifications") + F.col("changes") + F.col("recency"))
    return mods.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(path))).cast("long"))


def module_sketches(obs: DataFrame, by: Sequence[str] = ("project_id",), path: str = "path", tracked: int = 10_000) -> DataFrame:
    """A bounded sketch of the most frequent modules of each group, to be stored and merged later (A12): by, sketch, rows, tracked."""
    rows = obs.where(F.col(path).isNotNull()).groupBy(*by).agg(F.expr(f"approx_top_k_accumulate({path}, {tracked})").alias("sketch"), F.count("*").alias("rows"))
    return rows.withColumn("tracked", F.lit(tracked))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("project_id",), tracked: int = 10_000) -> DataFrame:
    """Sketches of parts of the data put together by group, as if made of all rows; all were made with ``tracked``."""
    return sketches.groupBy(*by).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"), F.sum("rows").alias("rows"), F.min("tracked").alias("tracked"))


def sketched_modules(sketches: DataFrame, k: int = 20, by: Sequence[str] = ("project_id",), path: str = "path") -> DataFrame:
    """The ``k`` most frequent modules of each sketch: estimate and error, with estimate - error <= true count <= estimate.

    A sketch of m places for counts is off by at most 3.5 rows / m (Misra and Gries as refined by Anderson and others), and has places for at least tracked / 0.75.
    """
    rows = sketches.select(*by, "rows", "tracked", F.explode(F.expr(f"approx_top_k_estimate(sketch, {k})")).alias("m"))
    return rows.select(*by, F.col("m.item").alias(path), F.col("m.count").alias("estimate"), F.floor(3.5 * 0.75 * F.col("rows") / F.col("tracked")).cast("long").alias("error"))


def hot_modules_approx(obs: DataFrame, k: int = 20, by: Sequence[str] = ("project_id",), path: str = "path", tracked: int = 10_000) -> DataFrame:
    """The most frequent modules of each group by a bounded sketch, with the bound of its error."""
    return sketched_modules(module_sketches(obs, by, path, tracked), k, by, path)


def distinct_sessions_per_path(obs: DataFrame, by: Sequence[str] = ("project_id",), path: str = "path", session: str = "session_id", approximate: bool = False) -> DataFrame:
    """Sessions that touch each path, exactly or by a HyperLogLog sketch."""
    n = F.hll_sketch_estimate(F.hll_sketch_agg(session)) if approximate else F.countDistinct(session)
    return obs.groupBy(*by, path).agg(n.alias("sessions"))


def project_time_range(views: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """First start and last end by instant, as they were written (A10)."""
    return views.groupBy(*by).agg(F.min_by("started_raw", "started_at").alias("started_raw"), F.max_by("ended_raw", "ended_at").alias("ended_raw"))


def terminal_counts(views: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Sessions of each terminal state."""
    states = ("indexed", "unsupported", "missing", "unreadable", "ambiguous")
    return views.groupBy(*by).agg(*(F.count_if(F.col("terminal_state") == s).alias(s) for s in states))


def project_view(obs: DataFrame, reference: Column, by: Sequence[str] = ("project_id",), gap_hours: float = 720.0) -> DataFrame:
    """Derived records of a project (R2): kind, subject, dependencies and id, for states, links, phases and modules."""
    def record(df: DataFrame, kind: str, subject: Column, *dependencies: Column) -> DataFrame:
        deps = F.array_sort(F.array_compact(F.array(*dependencies)))
        return df.select(*by, F.lit(kind).alias("kind"), subject.alias("subject"), deps.alias("dependencies"), derived_id(F.lit(kind), subject, deps).alias("id"))

    rev = F.col("revision_id")
    links = session_recovery_links(obs, (*by, "session_id")).where("recovered")
    far = cross_session_recovery_links(obs, by)
    return (
        record(witnessed_state(obs, by), "witnessed_state", F.col("state_key"), rev)
        .unionByName(record(links, "recovery_link", F.concat_ws(":", "kind", "operation", "component"), rev, F.col("recovered_by")))
        .unionByName(record(far, "recovery_link", F.concat_ws(":", "kind", "operation", "component"), rev, F.col("recovered_by")))
        .unionByName(record(structural_phases(obs, by), "phase_boundary", F.col("phase_kind"), rev))
        .unionByName(record(gap_phases(obs, by, gap_hours), "phase_boundary", F.lit("time_gap"), rev))
        .unionByName(record(module_ranking(obs, reference, by), "module_rank", F.col("path"), F.lit(None).cast("string")))
    )
