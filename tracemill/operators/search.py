"""Search, milestones, and the cards and histories that people read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import milestone_id, normalize_identity
from tracemill.operators.accounting import price_totals, project_usage
from tracemill.operators.facts import field, qualify_milestones, strongest_facts, verification_state
from tracemill.operators.problems import order_by_supersession, themes, validate_session_chain
from tracemill.operators.turns import assign_facts
from tracemill.operators.windows import top_n


def search_sessions(obs: DataFrame, kind: str, query: str) -> DataFrame:
    """Sessions with a branch, file or error that holds the normalized query (R4): session columns and hits."""
    text = {"branch": F.when(F.col("kind").isin("branch", "git_status"), field("branch")), "file": F.when(F.col("kind") == "file", field("path")), "error": F.when(F.col("kind") == "error", F.coalesce(field("error_signature"), F.col("excerpt")))}[kind]
    needle = " ".join(query.lower().split())
    if not needle:
        raise ValueError("an empty query")
    return obs.where(F.contains(normalize_identity(text), F.lit(needle))).groupBy("provider", "session_id").agg(F.count("*").alias("hits"))


def conversation_page(messages: DataFrame, session: str, limit: int, start: int = 0) -> DataFrame:
    """A page of one conversation's messages (R5); the filter reaches the scan."""
    from tracemill.operators.windows import page

    return page(messages.where(F.col("session_id") == session), ("session_id",), [F.asc("ordinal")], limit, start)


def milestones(obs: DataFrame, turns: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """One milestone a turn with a qualifying fact (R6): question, conclusion, fact, verification.

    obs has ordinal besides the observation columns; turns come from turn_units.
    """
    facts = assign_facts(qualify_milestones(obs), turns, by).where("turn_unit_id IS NOT NULL")
    best = strongest_facts(facts)
    checks = assign_facts(obs.where("kind = 'verification'").withColumn("__state", verification_state()), turns, by)
    checks = checks.groupBy("turn_unit_id").agg(F.max_by("__state", F.struct("sequence", "revision_id")).alias("verification"))
    rows = best.join(turns.select("turn_unit_id", "question", "answer", "answer_state"), "turn_unit_id").join(checks, "turn_unit_id", "left")
    return rows.select(
        milestone_id(F.col("turn_unit_id"), F.col("revision_id")).alias("milestone_id"), *by, "turn_unit_id", "category", "priority", "revision_id", "ts", "question",
        F.when(F.col("answer_state") == "answered", F.col("answer")).alias("conclusion"), F.coalesce("verification", F.lit("none")).alias("verification"),
    )


def milestone_order(df: DataFrame, when: str = "occurred_at", key: str = "milestone_id") -> DataFrame:
    """Dates that cannot be read first, then by instant and id."""
    return df.orderBy(F.try_to_timestamp(F.col(when)).asc_nulls_first(), F.col(key))


def newest(df: DataFrame, by: Sequence[str], when: str, key: str, n: int = 3) -> DataFrame:
    """The newest ``n`` entries of a timeline."""
    return top_n(df, by, [F.desc_nulls_last(when), F.asc(key)], n)


def usage_report(usage: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Usage by model with shares and costs, and whether the group's total is known."""
    return project_usage(usage, by, cost="cost").join(price_totals(usage, by).select(*by, "known_subtotal", F.col("total").alias("group_total")), list(by))


def project_history(decisions: DataFrame, loops: DataFrame, reports: DataFrame) -> dict[str, DataFrame]:
    """Ordered decisions, themes and the check of the session chain."""
    return {"decisions": order_by_supersession(decisions), "themes": themes(decisions, loops), "chain": validate_session_chain(reports)}


def resume_card(reports: DataFrame, usage: DataFrame, decisions: DataFrame, loops: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """A row a project (R7): last session, decisions in force, open loops, tokens. reports: by, session_id, previous_id, next_id."""
    last = reports.where("next_id IS NULL").groupBy(*by).agg(F.max("session_id").alias("last_session"), F.count("*").alias("tails"))
    replaced = decisions.select(*by, F.explode("supersedes").alias("id")).distinct()
    force = decisions.select(*by, F.col("decision_id").alias("id")).join(replaced, [*by, "id"], "left_anti").groupBy(*by).agg(F.count("*").alias("decisions_in_force"))
    open_ = loops.where("NOT resolved").groupBy(*by).agg(F.count("*").alias("open_loops"))
    tokens = usage.groupBy(*by).agg(F.sum("total_tokens").cast("long").alias("total_tokens"))
    out = last
    for part in (force, open_, tokens):
        out = out.join(part, list(by), "left")
    return out.fillna(0, ["decisions_in_force", "open_loops", "total_tokens"])


def problem_candidates(turns: DataFrame, nodes: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """Candidates of turns that no node holds yet, carried on from the ones before."""
    from tracemill.operators.problems import discover_candidates, reconcile_candidates, unplaced_turns

    return reconcile_candidates(previous, discover_candidates(unplaced_turns(turns, nodes)), now)


def undrained(extracted: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dependencies already extracted that are no longer current."""
    return extracted.select(*keys).distinct().join(current.select(*keys).distinct(), list(keys), "left_anti")


def selected_revisions(records: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Every revision that a derived record depends on, once, with the first record that does."""
    rows = records.select(*by, "id", F.posexplode("dependencies").alias("__at", "revision_id"))
    w = Window.partitionBy(*by, "revision_id").orderBy("id", "__at")
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*by, "revision_id", F.col("id").alias("first_record"))
