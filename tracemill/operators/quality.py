"""Rules over rows and references: each check gives a table of violations, never an exception for the whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status moves that reviewers may make.
TRANSITIONS = (("pending", "accepted"), ("pending", "rejected"), ("pending", "stale"), ("stale", "pending"), ("stale", "rejected"), ("accepted", "superseded"))


def quality_rules(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks (V5): keys, rule. A condition that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(*keys, F.explode(broken).alias("rule"))


def observation_rules() -> dict[str, Column]:
    """Rules of observations: bounds, enumerations, digests and times."""
    from tracemill.operators.facts import DIRECT_KINDS, FIELD_NAMES

    names = F.array(*map(F.lit, FIELD_NAMES))
    return {
        "sequence": (F.col("sequence") >= 0) & (F.col("sequence") <= 2**53 - 1), "kind": F.col("kind").isin(*DIRECT_KINDS), "subject": (F.trim("subject") != "") & (F.octet_length("subject") <= 256),
        "source_hash": F.rlike("source_hash", F.lit("^[0-9a-f]{64}$")), "ts": F.col("ts").isNotNull(), "fields": F.forall(F.map_keys("fields"), lambda k: F.array_contains(names, k)),
    }


def check_references(child: DataFrame, parent: DataFrame, keys: Sequence[str], low: str | None = None, high: str | None = None, at: str | None = None) -> DataFrame:
    """Children whose parent is missing, is not the only one, or whose place is out of the parent's range (J20): child columns and violation."""
    p = parent.groupBy(*keys).agg(F.count("*").alias("__n"), *((F.min(low).alias("__lo"), F.max(high).alias("__hi")) if at else ()))
    rows = child.join(p, list(keys), "left")
    why = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "not_unique")
    if at:
        why = why.when(~F.coalesce((F.col(at) >= F.col("__lo")) & (F.col(at) <= F.col("__hi")), F.lit(False)), "out_of_range")
    return rows.withColumn("violation", why).where("violation IS NOT NULL").select(*child.columns, "violation")


def audit_transitions(previous: DataFrame, following: DataFrame, key: str, immutable: Sequence[str], status: str = "status", revision: str = "revision", allowed: Sequence[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """Illegal moves between two versions (V2): vanished, immutable_changed, bad_revision, illegal_status. A change adds exactly 1 to the revision."""
    cols = [status, revision, *immutable]
    p, n = (d.select(key, F.lit(True).alias(f"{s}__here"), *(F.col(c).alias(f"{s}_{c}") for c in cols)) for s, d in (("p", previous), ("n", following)))
    rows = p.join(n, key, "full_outer")
    both = F.col("p__here") & F.col("n__here")
    moved = ~F.col(f"p_{status}").eqNullSafe(F.col(f"n_{status}"))
    legal = F.lit(False)
    for a, b in allowed:
        legal = legal | ((F.col(f"p_{status}") == a) & (F.col(f"n_{status}") == b))
    fixed = F.lit(False)
    for c in immutable:
        fixed = fixed | ~F.col(f"p_{c}").eqNullSafe(F.col(f"n_{c}"))
    step = F.col(f"n_{revision}") - F.col(f"p_{revision}")
    bad = F.array_compact(F.array(
        F.when(F.col("n__here").isNull(), F.lit("vanished")), F.when(both & fixed, F.lit("immutable_changed")), F.when(both & moved & ~legal, F.lit("illegal_status")),
        F.when(both & ((moved & ~step.eqNullSafe(F.lit(1))) | (~moved & ~step.isin(0, 1))), F.lit("bad_revision")),
        F.when(F.col("p__here").isNull() & (F.col(f"n_{revision}") != 1), F.lit("bad_revision")),
    ))
    return rows.select(key, F.explode(bad).alias("violation"))


def check_report_effects(report: DataFrame, before: DataFrame, after: DataFrame, key: str, value: str, closed: Column) -> DataFrame:
    """Declared effects that differ from the actual ones (V4): effect, id, side (declared or actual only).

    report: effect in (added, revised, created, closed), id. ``closed`` is a condition on ``after`` and ``before`` rows.
    """
    b = before.select(F.col(key).alias("id"), F.to_json(F.struct(value)).alias("__v"), closed.alias("__c"))
    a = after.select(F.col(key).alias("id"), F.to_json(F.struct(value)).alias("__w"), closed.alias("__d"))
    rows = a.join(b, "id", "left")
    effect = F.when(F.col("__v").isNull(), "added").when(F.col("__d") & ~F.col("__c"), "closed").when(F.col("__v") != F.col("__w"), "revised")
    actual = rows.select(effect.alias("effect"), "id").where("effect IS NOT NULL")
    said = report.select("effect", "id").distinct()
    return said.exceptAll(actual).withColumn("side", F.lit("declared")).unionByName(actual.exceptAll(said).withColumn("side", F.lit("actual")))
