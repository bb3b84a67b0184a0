"""Registered queries of eligibility, outcomes that contradict their exit codes, references between turns, keys and relational usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import accounting, facts, lineage, problems
from tracemill.plans import fixtures as fx
from tracemill.plans.reports import query

ASKED = """asked AS (SELECT session_id, ordinal, CASE ordinal % 6 WHEN 0 THEN CAST(length(text) AS VARCHAR) WHEN 2 THEN '<turn_aborted>' || text || '</turn_aborted>' WHEN 3 THEN ' ' || chr(10) ELSE text END AS question FROM messages)"""


def _asked(spark, sf):
    """Messages as questions; by their ordinal some become numbers, machine envelopes or blank."""
    m, k = fx.messages(spark, sf), F.col("ordinal") % 6
    changed = F.when(k == 0, F.length("text").cast("string")).when(k == 2, F.concat(F.lit("<turn_aborted>"), "text", F.lit("</turn_aborted>"))).when(k == 3, " \n").otherwise(F.col("text"))
    return m.select("session_id", "ordinal", changed.alias("question"))


@query("SELECT session_id, ordinal, ordinal % 6 NOT IN (0, 2, 3) AND trim(question) <> '' AS eligible FROM asked", fx.MESSAGES, ASKED)
def eligible_questions(spark, sf):
    return _asked(spark, sf).select("session_id", "ordinal", problems.candidate_eligible().alias("eligible"))


CHECKED = """checked AS (SELECT revision_id, kind, CASE event_id % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'odd' END AS outcome, CASE WHEN event_id % 5 < 3 THEN CAST(floor(value) AS BIGINT) % 2 END AS code
 FROM (SELECT revision_id, sequence AS event_id, kind, value FROM obs WHERE kind = 'verification') o)"""


def _checked(spark, sf):
    """Verifications whose outcome and exit code come from their number and value, so that they agree, contradict or lack each other."""
    i = F.col("sequence")
    word = F.when(i % 4 == 0, "passed").when(i % 4 == 1, "failed").when(i % 4 == 2, "odd")
    code = F.when(i % 5 < 3, (F.floor("value").cast("long") % 2).cast("string"))
    o = fx.obs(spark, sf).where("kind = 'verification'").withColumn("outcome", word).withColumn("operation", F.lit("verification"))
    return o.withColumn("fields", F.when(code.isNotNull(), F.create_map(F.lit("exit_code"), code)).otherwise(F.create_map().cast("map<string,string>")))


@query("""SELECT revision_id, CASE WHEN outcome IS NULL THEN 'unrecorded' WHEN outcome = 'odd' THEN 'unknown' WHEN (outcome = 'passed' AND code <> 0) OR (outcome = 'failed' AND code = 0) THEN 'conflict'
 WHEN outcome = 'passed' THEN 'success' ELSE 'failure' END AS typed, CASE WHEN outcome IS NULL OR outcome = 'odd' THEN 'unknown' WHEN (outcome = 'passed' AND code <> 0) OR (outcome = 'failed' AND code = 0) THEN 'conflict'
 ELSE outcome END AS state FROM checked""", fx.OBS, CHECKED)
def contradicted_outcomes(spark, sf):
    return _checked(spark, sf).select("revision_id", facts.typed_outcome().alias("typed"), facts.verification_state().alias("state"))


@query("""SELECT kind, count(*) AS rows FROM (SELECT CASE WHEN sequence % 7 = 0 THEN 'intent' ELSE kind END AS kind, sequence FROM obs) o WHERE kind <> 'intent' AND sequence % 5 <> 0 GROUP BY 1""", fx.OBS)
def direct_facts(spark, sf):
    """Observations of which every seventh is semantic and every fifth carries a field of raw text."""
    i = F.col("sequence")
    o = fx.obs(spark, sf).withColumn("kind", F.when(i % 7 == 0, "intent").otherwise(F.col("kind")))
    o = o.withColumn("fields", F.when(i % 5 == 0, F.map_concat("fields", F.create_map(F.lit("prompt"), "path"))).otherwise(F.col("fields")))
    return facts.filter_direct(o).groupBy("kind").agg(F.count("*").alias("rows"))


@query("SELECT session_id, ordinal FROM messages m WHERE NOT (session_id % 3 = 0 AND role = 'user')", fx.MESSAGES)
def unplaced_messages(spark, sf):
    """Messages that no node refers to; the nodes are a third of the sessions, with what users say there."""
    m = fx.messages(spark, sf).select("session_id", "ordinal", "role")
    nodes = m.where("session_id % 3 = 0 AND role = 'user'").groupBy("session_id").agg(F.collect_list(F.struct("session_id", "ordinal")).alias("source_turns"))
    return problems.unplaced_turns(m, nodes, ("session_id", "ordinal")).select("session_id", "ordinal")


@query("""SELECT DISTINCT m.session_id * 10 + m.ordinal % 2 AS milestone_id, n.session_id * 10 + n.ordinal % 3 AS node_id FROM messages m JOIN messages n ON n.session_id = m.session_id AND n.ordinal = m.ordinal""", fx.MESSAGES)
def related_milestones(spark, sf):
    """Milestones of a session's even and odd turns, nodes of every third turn, related where they share one."""
    m = fx.messages(spark, sf)
    turns = F.collect_list(F.struct("session_id", "ordinal")).alias("source_turns")
    a = m.groupBy((F.col("session_id") * 10 + F.col("ordinal") % 2).alias("milestone_id")).agg(turns)
    b = m.groupBy((F.col("session_id") * 10 + F.col("ordinal") % 3).alias("node_id")).agg(turns)
    return problems.related_problems(a, b, ("session_id", "ordinal"))


@query("SELECT key FROM base UNION SELECT key FROM lft UNION SELECT key FROM rgt", fx.VERSIONS)
def version_keys(spark, sf):
    return lineage.key_union(*fx.versions(spark, sf), keys=["key"])


@query("""SELECT session_id, model, sum(i + c + w) AS input_tokens, sum(c) AS cached_input_tokens, sum(w) AS cache_write_input_tokens, sum(o + r) AS output_tokens, sum(r) AS reasoning_output_tokens, sum(i + c + w + o + r) AS total_tokens
FROM (SELECT session_id, CASE WHEN model = 0 THEN 'unknown' ELSE 'm' || CAST(model AS VARCHAR) END AS model, input_tokens AS i, cached_input_tokens AS c, ordinal AS w, output_tokens AS o, model AS r FROM usage WHERE ordinal <> 6) u GROUP BY 1, 2""", fx.USAGE)
def relational_tokens(spark, sf):
    """Usage in the relational provider's classes; every sixth line's is negative and does not count."""
    u = fx.usage(spark, sf)
    cache = F.struct(F.col("cached_input_tokens").alias("read"), F.col("ordinal").alias("write"))
    output = F.when(F.col("ordinal") == 6, -1_000_000).otherwise(F.col("output_tokens"))
    tokens = F.struct(F.col("input_tokens").alias("input"), output.alias("output"), F.col("model").alias("reasoning"), cache.alias("cache"))
    m = u.select("session_id", F.when(F.col("model") != 0, F.concat(F.lit("m"), F.col("model"))).alias("model"), tokens.alias("tokens"))
    return accounting.relational_usage(m)
