"""What changed between two versions of a table: lineage, carried state, three-way merges, patches, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import millis


def _sides(frames: dict[str, DataFrame], keys: Sequence[str], values: Sequence[str]) -> list[DataFrame]:
    return [d.select(*keys, F.lit(True).alias(f"{s}__here"), *(F.col(v).alias(f"{s}_{v}") for v in values)) for s, d in frames.items()]


def _struct(side: str, values: Sequence[str]) -> Column:
    """A side's values as text, null where the row is absent, so that null-safe comparison sees nulls and absence."""
    return F.when(F.col(f"{side}__here"), F.to_json(F.struct(*(F.col(f"{side}_{v}").alias(v) for v in values)), {"ignoreNullFields": "false"}))


def diff_lineage(previous: DataFrame, current: DataFrame, keys: Sequence[str], revision: str = "revision_id", unavailable: DataFrame | None = None) -> DataFrame:
    """Per stable key unchanged, superseded (old to new), withdrawn or added (J10). Sources listed in ``unavailable`` keep what they had."""
    p, c = _sides({"p": previous, "c": current}, keys, [revision])
    rows = p.join(c, list(keys), "full_outer")
    if unavailable is not None:
        on = [k for k in unavailable.columns if k in keys]
        rows = rows.join(unavailable.select(*on, F.lit(True).alias("__away")).distinct(), on, "left")
    else:
        rows = rows.withColumn("__away", F.lit(None).cast("boolean"))
    old, new = F.col(f"p_{revision}"), F.col(f"c_{revision}")
    change = (
        F.when(F.col("p__here").isNull(), "added").when(F.col("c__here").isNull() & F.col("__away"), "unchanged").when(F.col("c__here").isNull(), "withdrawn")
        .when(old.eqNullSafe(new), "unchanged").otherwise("superseded")
    )
    return rows.select(*keys, change.alias("change"), old.alias("old_revision"), F.when(F.col("c__here").isNull() & F.col("__away"), old).otherwise(new).alias("new_revision"))


def new_observations(current: DataFrame, stored: DataFrame, key: str = "revision_id") -> DataFrame:
    """Rows whose revision is not stored yet."""
    return current.join(stored.select(key), key, "left_anti")


def same_digests(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as often as it lacks them; none if the sets are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def key_union(*frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of several versions (U4)."""
    out = frames[0].select(*keys)
    for f in frames[1:]:
        out = out.unionByName(f.select(*keys))
    return out.distinct()


def merge_all(base: DataFrame | None, left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], normalize_lines: bool = False) -> DataFrame:
    """Every key of a three-way merge with its verdict and merged values.

    A change on one side wins, equal changes win, different ones conflict; a deletion is a change like others. Without a
    base, whatever differs conflicts. verdict: unchanged, left, right, both, conflict; present: whether the merged row exists.
    """
    frames = {"b": base if base is not None else left.limit(0), "l": left, "r": right}
    if normalize_lines:
        frames = {s: d.withColumns({v: F.replace(F.col(v), F.lit("\r\n"), F.lit("\n")) for v in values if dict(d.dtypes)[v] == "string"}) for s, d in frames.items()}
    b, l, r = _sides(frames, keys, values)
    rows = b.join(l, list(keys), "full_outer").join(r, list(keys), "full_outer")
    vb, vl, vr = (_struct(s, values) for s in "blr")
    verdict = F.when(vl.eqNullSafe(vr), F.when(vl.eqNullSafe(vb), "unchanged").otherwise("both"))
    if base is not None:
        verdict = verdict.when(vl.eqNullSafe(vb), "right").when(vr.eqNullSafe(vb), "left")
    verdict = verdict.otherwise("conflict")
    rows = rows.withColumn("verdict", verdict)
    from_left = F.col("verdict").isin("unchanged", "both", "left")
    return rows.select(
        *keys, "verdict", F.when(F.col("verdict") == "conflict", None).otherwise(F.coalesce(F.when(from_left, F.col("l__here")).otherwise(F.col("r__here")), F.lit(False))).alias("present"),
        *(F.when(F.col("verdict") == "conflict", None).when(from_left, F.col(f"l_{v}")).otherwise(F.col(f"r_{v}")).alias(v) for v in values),
    )


def three_way_merge(base: DataFrame | None, left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], normalize_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged rows, conflicting keys)."""
    rows = merge_all(base, left, right, keys, values, normalize_lines)
    return rows.where("present").select(*keys, *values), rows.where("verdict = 'conflict'").select(*keys)


PATCH_KEY = ("entity_id", "field")


def rebase_patches(patches: DataFrame, baselines: DataFrame) -> DataFrame:
    """Patches with status active, orphan (no baseline) or underlay_changed (J14). patches: PATCH_KEY, base_hash; baselines: PATCH_KEY, hash."""
    rows = patches.join(baselines.select(*PATCH_KEY, F.col("hash").alias("__hash"), F.lit(True).alias("__here")), list(PATCH_KEY), "left")
    status = F.when(F.col("__here").isNull(), "orphan").when(F.col("__hash").eqNullSafe(F.col("base_hash")), "active").otherwise("underlay_changed")
    return rows.withColumn("status", status).drop("__hash", "__here")


def capture_patches(fields: DataFrame, baselines: DataFrame, previous: DataFrame) -> DataFrame:
    """Edits read from observed values (J15): set, suppress (value gone) or restore_default; nothing where the generated value stands.

    fields: PATCH_KEY, value (null: removed); baselines: PATCH_KEY, value; previous: PATCH_KEY of earlier patches.
    """
    b = baselines.select(*PATCH_KEY, F.col("value").alias("generated"), F.lit(True).alias("__b"))
    p = previous.select(*PATCH_KEY, F.lit(True).alias("__p")).distinct()
    rows = fields.join(b, list(PATCH_KEY), "left").join(p, list(PATCH_KEY), "left")
    same = F.col("value").eqNullSafe(F.col("generated")) & F.col("__b").isNotNull()
    action = F.when(same & F.col("__p"), "restore_default").when(same, None).when(F.col("value").isNull() & F.col("__b").isNotNull(), "suppress").when(F.col("value").isNotNull(), "set")
    return rows.withColumn("action", action).where("action IS NOT NULL").drop("__b", "__p")


def apply_patches(patches: DataFrame, baselines: DataFrame) -> DataFrame:
    """Baseline values with people's edits on top (J16): set replaces, suppress removes, restore_default leaves the baseline."""
    p = patches.select(*PATCH_KEY, F.col("value").alias("__value"), "action")
    rows = baselines.join(p, list(PATCH_KEY), "left")
    value = F.when(F.col("action") == "set", F.col("__value")).when(F.col("action") == "suppress", None).otherwise(F.col("value"))
    return rows.withColumn("value", value).withColumn("edited", F.coalesce(F.col("action").isin("set", "suppress"), F.lit(False))).drop("__value", "action")


def merge_sources(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = ("provider", "session_id")) -> DataFrame:
    """Sources of both (V3): the later boundary wins, equal boundaries must agree, identity must not change; projects are united.

    Columns: key, source_identity, boundary, digest, project_ids. conflict: identity_changed, boundary_disagrees or null.
    """
    e, i = _sides({"e": existing, "i": incoming}, key, ["source_identity", "boundary", "digest", "project_ids"])
    rows = e.join(i, list(key), "full_outer")
    both = F.col("e__here") & F.col("i__here")
    conflict = F.when(both & ~F.col("e_source_identity").eqNullSafe(F.col("i_source_identity")), "identity_changed").when(
        both & F.col("e_boundary").eqNullSafe(F.col("i_boundary")) & ~F.col("e_digest").eqNullSafe(F.col("i_digest")), "boundary_disagrees"
    )
    new = F.col("e__here").isNull() | (F.col("i__here").isNotNull() & (F.col("i_boundary") > F.col("e_boundary")))
    pick = lambda c: F.when(new, F.col(f"i_{c}")).otherwise(F.col(f"e_{c}")).alias(c)
    none = F.array().cast("array<string>")
    return rows.select(
        *key, F.coalesce("e_source_identity", "i_source_identity").alias("source_identity"), pick("boundary"), pick("digest"),
        F.array_sort(F.array_union(F.coalesce("e_project_ids", none), F.coalesce("i_project_ids", none))).alias("project_ids"), conflict.alias("conflict"),
    )


def boundary_relation(previous: DataFrame, current: DataFrame, key: Sequence[str] = ("provider", "session_id")) -> DataFrame:
    """How a source moved on (ST6): initial, unchanged, usage_refresh, append or replacement.

    Both have key, lines, prefix_hash (of the lines read), usage_digest; ``current`` also has hash_at_previous, the hash of as many lines as
    were read before.
    """
    p = previous.select(*key, F.col("lines").alias("p_lines"), F.col("prefix_hash").alias("p_hash"), F.col("usage_digest").alias("p_usage"))
    rows = current.join(p, list(key), "left")
    relation = (
        F.when(F.col("p_hash").isNull(), "initial").when((F.col("lines") < F.col("p_lines")) | ~F.col("hash_at_previous").eqNullSafe(F.col("p_hash")), "replacement")
        .when(F.col("lines") > F.col("p_lines"), "append").when(F.col("usage_digest").eqNullSafe(F.col("p_usage")), "unchanged").otherwise("usage_refresh")
    )
    return rows.withColumn("relation", relation).drop("p_lines", "p_hash", "p_usage")


def retention_report(objects: DataFrame, manifests: DataFrame, pins: DataFrame, now: Column, days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Objects and bytes that manifests or pins reach, that are kept although unreached, and that may go after ``days``."""
    refs = manifests.select(F.explode("refs").alias("digest")).unionByName(pins.select("digest")).distinct()
    rows = objects.join(refs.withColumn("__r", F.lit(True)), "digest", "left")
    fate = F.when(F.col("__r"), "reachable").when(millis(now) - millis("written_at") < days * 86_400_000, "retained").otherwise("cleanup")
    return rows.withColumn("fate", fate).groupBy(*by, "fate").agg(F.count("*").alias("objects"), F.sum("bytes").alias("bytes"))
