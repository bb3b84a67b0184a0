"""Registered queries: each operator over the given tables (``fixtures``), and the same in SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.scalars import normalize_identity, public_event_kind, recency_bucket, shannon_entropy, truncate_chars
from tracemill.functions.redaction import redaction_findings
from tracemill.operators import accounting, facts, lineage, problems, projects, quality, search, sessions, turns, windows
from tracemill.plans import fixtures as fx
from tracemill.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Register a query under its function's name, with its SQL over the given mappings."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = ("WITH " + ",\n ".join(ctes) + "\n" if ctes else "") + sql
        return f
    return add


TURNS = """numbered AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS turn_no FROM messages),
 units AS (SELECT session_id, CAST(turn_no AS BIGINT) AS turn_no, min(ordinal) AS start_ordinal, max(ordinal) AS last_ordinal, arg_min(text, ordinal) AS question,
  count(*) FILTER (WHERE role = 'assistant') AS answers, arg_max(text, ordinal) FILTER (WHERE role = 'assistant') AS answer FROM numbered WHERE turn_no > 0 GROUP BY 1, 2),
 turns AS (SELECT *, lead(start_ordinal) OVER (PARTITION BY session_id ORDER BY turn_no) AS next_ordinal,
  CASE WHEN answers = 0 THEN 'none' WHEN trim(coalesce(answer, '')) <> '' THEN 'answered' ELSE 'unanswered' END AS answer_state FROM units)"""


@query("SELECT session_id, turn_no, start_ordinal, last_ordinal, next_ordinal, answers, answer_state, md5(question) AS question_md5 FROM turns", fx.MESSAGES, TURNS)
def turn_units(spark, sf):
    t = turns.turn_units(fx.messages(spark, sf))
    return t.select("session_id", "turn_no", "start_ordinal", "last_ordinal", "next_ordinal", "answers", "answer_state", F.md5("question").alias("question_md5"))


@query(
    """SELECT m.session_id, m.messages, coalesce(t.turns, 0) AS turns, coalesce(t.answered, 0) AS answered, coalesce(t.turns - t.answered, 0) AS unanswered, m.orphans
FROM (SELECT session_id, count(*) AS messages, count(*) FILTER (WHERE role = 'assistant' AND turn_no = 0) AS orphans FROM numbered GROUP BY 1) m
LEFT JOIN (SELECT session_id, count(*) AS turns, count(*) FILTER (WHERE answer_state = 'answered') AS answered FROM turns GROUP BY 1) t USING (session_id)""", fx.MESSAGES, TURNS)
def chain_coverage(spark, sf):
    return turns.chain_coverage(fx.messages(spark, sf)).drop("truncated")


@query("""SELECT session_id, ordinal, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY ordinal) AS part_index, count(*) OVER (PARTITION BY session_id, turn_no) AS part_count
FROM numbered WHERE role = 'assistant' AND turn_no > 0""", fx.MESSAGES, TURNS)
def answer_parts(spark, sf):
    return turns.answer_parts(fx.messages(spark, sf)).select("session_id", "ordinal", "part_index", "part_count")


@query("""SELECT f.session_id, f.ordinal, max(t.start_ordinal) AS turn_start FROM messages f LEFT JOIN turns t ON t.session_id = f.session_id AND t.start_ordinal <= f.ordinal
WHERE f.role <> 'user' GROUP BY 1, 2""", fx.MESSAGES, TURNS)
def assign_facts(spark, sf):
    m = fx.messages(spark, sf)
    starts = turns.turn_units(m).select("session_id", F.col("start_ordinal").alias("ordinal"), F.col("start_ordinal").alias("turn_start"))
    return windows.asof_last(m.where("role <> 'user'").select("session_id", "ordinal", "role"), starts, ["session_id"], "ordinal", "turn_start").drop("role")


@query("SELECT session_id, ordinal, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal DESC) AS rn FROM messages WHERE role = 'user' AND trim(text) <> '') q WHERE rn <= 2", fx.MESSAGES)
def recent_requests(spark, sf):
    return turns.recent_requests(fx.messages(spark, sf), ["session_id"], [F.desc("ordinal")], 2).select("session_id", "ordinal", F.md5("text").alias("text_md5"))


@query("""SELECT normalized AS normalized_question, count(*) AS n_turns FROM (SELECT lower(trim(regexp_replace(question, '[\\s]+', ' ', 'g'))) AS normalized FROM turns) q WHERE normalized <> '' GROUP BY 1""", fx.MESSAGES, TURNS)
def candidate_groups(spark, sf):
    t = turns.turn_units(fx.messages(spark, sf)).withColumn("project_id", F.lit(1))
    return problems.discover_candidates(t).groupBy(F.col("normalized").alias("normalized_question")).agg(F.sum("n_turns").alias("n_turns"))


@query("""SELECT session_id, count(*) FILTER (WHERE kind = 'file') AS files, count(*) FILTER (WHERE kind = 'command') AS commands, count(*) FILTER (WHERE kind = 'verification') AS verifications,
 count(*) FILTER (WHERE outcome = 'failure') AS errors, count(*) FILTER (WHERE kind = 'artifact') AS artifacts FROM obs GROUP BY 1""", fx.OBS)
def fact_counts(spark, sf):
    return sessions.fact_counts(fx.obs(spark, sf))


@query("""SELECT project_id, state_key, value, revision_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, state_key ORDER BY ts DESC, session_id DESC, sequence DESC) AS rn FROM (
 SELECT project_id, ts, session_id, sequence, revision_id, 'verification:' || CAST(component AS VARCHAR) AS state_key, outcome AS value FROM obs WHERE kind = 'verification' AND outcome IS NOT NULL
 UNION ALL SELECT project_id, ts, session_id, sequence, revision_id, 'version', CAST(version AS VARCHAR) FROM obs WHERE kind = 'version') k) r WHERE rn = 1""", fx.OBS)
def witnessed_state(spark, sf):
    return projects.witnessed_state(fx.obs(spark, sf)).select("project_id", "state_key", "value", "revision_id")


@query("""SELECT f.revision_id, min(s.sequence) AS recovered_at FROM obs f LEFT JOIN obs s ON s.session_id = f.session_id AND s.component = f.component AND s.kind = f.kind AND s.outcome = 'success' AND s.sequence > f.sequence
WHERE f.outcome = 'failure' GROUP BY 1""", fx.OBS)
def session_recovery(spark, sf):
    return facts.session_recovery_links(fx.obs(spark, sf)).select("revision_id", "recovered_at")


@query("""SELECT f.revision_id, s.revision_id AS recovered_by FROM (SELECT *, row_number() OVER w AS n FROM obs WHERE outcome IS NOT NULL WINDOW w AS (PARTITION BY project_id, kind, component ORDER BY ts, session_id, sequence)) f
JOIN (SELECT *, row_number() OVER w AS n FROM obs WHERE outcome IS NOT NULL WINDOW w AS (PARTITION BY project_id, kind, component ORDER BY ts, session_id, sequence)) s
 ON s.project_id = f.project_id AND s.kind = f.kind AND s.component = f.component AND s.n > f.n AND s.outcome = 'success'
WHERE f.outcome = 'failure' AND s.session_id <> f.session_id AND s.n = (SELECT min(x.n) FROM (SELECT *, row_number() OVER w AS n FROM obs WHERE outcome IS NOT NULL WINDOW w AS (PARTITION BY project_id, kind, component ORDER BY ts, session_id, sequence)) x
 WHERE x.project_id = f.project_id AND x.kind = f.kind AND x.component = f.component AND x.n > f.n AND x.outcome = 'success')""", fx.OBS)
def cross_session_recovery(spark, sf):
    return facts.cross_session_recovery_links(fx.obs(spark, sf)).select("revision_id", "recovered_by")


@query("""SELECT session_id, revision_id, gap_ms FROM (SELECT *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY session_id ORDER BY ts, sequence) AS gap_ms FROM obs) g WHERE gap_ms > 172800000""", fx.OBS)
def phase_gaps(spark, sf):
    return windows.gaps(fx.obs(spark, sf), ["session_id"], "ts", ["sequence"], 48.0).select("session_id", "revision_id", "gap_ms")


@query("""SELECT project_id, revision_id, version AS value, previous_value FROM (SELECT *, lag(version) OVER (PARTITION BY project_id ORDER BY ts, session_id, sequence) AS previous_value FROM obs WHERE kind = 'version') v
WHERE previous_value IS NULL OR previous_value <> version""", fx.OBS)
def version_phases(spark, sf):
    return projects.structural_phases(fx.obs(spark, sf)).select("project_id", "revision_id", F.col("value").cast("long").alias("value"), F.col("previous_value").cast("long").alias("previous_value"))


REFERENCE = "2024-01-31 00:00:00"


@query(f"""SELECT project_id, path, sessions, verifications, changes, score, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, path) AS rank FROM (
 SELECT *, 4 * sessions + 2 * verifications + changes + CASE WHEN age <= 604800000000 THEN 3 WHEN age <= 2592000000000 THEN 2 WHEN age <= 7776000000000 THEN 1 ELSE 0 END AS score FROM (
 SELECT project_id, path, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE kind = 'verification') AS verifications, count(*) FILTER (WHERE kind = 'file' AND outcome = 'success') AS changes,
 count(*) FILTER (WHERE kind = 'file') AS files, epoch_us(TIMESTAMP '{REFERENCE}') - epoch_us(max(ts)) AS age FROM obs WHERE kind IN ('file', 'verification') GROUP BY 1, 2) m WHERE files > 0) s""", fx.OBS)
def module_ranking(spark, sf):
    return projects.module_ranking(fx.obs(spark, sf), F.lit(REFERENCE).cast("timestamp")).select("project_id", "path", "sessions", "verifications", "changes", "score", "rank")


@query("SELECT project_id, path, count(DISTINCT session_id) AS sessions FROM obs GROUP BY 1, 2", fx.OBS)
def distinct_sessions(spark, sf):
    return projects.distinct_sessions_per_path(fx.obs(spark, sf))


@query("""SELECT session_id, revision_id, position, total, CASE WHEN total > 30 THEN CAST(30 AS BIGINT) END AS next_start FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, sequence) AS position,
 count(*) OVER (PARTITION BY session_id) AS total FROM obs) p WHERE position > 10 AND position <= 30""", fx.OBS)
def event_page(spark, sf):
    return windows.page(fx.obs(spark, sf), ["session_id"], [F.asc("ts"), F.asc("sequence")], 20, 10).select("session_id", "revision_id", "position", "total", "next_start")


@query("""SELECT session_id, count(*) AS total, count(*) FILTER (WHERE rn <= 5) AS shown, count(*) FILTER (WHERE rn > 5) AS omitted, string_agg(CAST(revision_id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS items
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence) AS rn FROM obs WHERE kind = 'verification') b GROUP BY 1""", fx.OBS)
def summary_top_n(spark, sf):
    b = windows.summary_block(fx.obs(spark, sf).where("kind = 'verification'"), ["session_id"], [F.asc("sequence")], ["revision_id"], 5)
    return b.withColumn("items", F.array_join(F.transform("items", lambda x: x["revision_id"].cast("string")), ","))


@query("""SELECT session_id, count(*) AS seen, count(*) - count(DISTINCT path) AS collapsed, least(count(DISTINCT path), 8) AS emitted, count(DISTINCT path) - least(count(DISTINCT path), 8) AS dropped,
 count(DISTINCT path) > 8 AS truncated FROM obs GROUP BY 1""", fx.OBS)
def channel_coverage(spark, sf):
    return windows.bounded_select(fx.obs(spark, sf), ["session_id"], ["path"], [F.asc("sequence")], 8)[1]


@query("SELECT session_id, path, min(sequence) AS sequence FROM obs GROUP BY 1, 2", fx.OBS)
def first_seen(spark, sf):
    return windows.first_seen(fx.obs(spark, sf), ["session_id", "path"], [F.asc("sequence")]).select("session_id", "path", "sequence")


@query("""SELECT CASE kind WHEN 'file' THEN 'file_change' WHEN 'command' THEN 'command' WHEN 'verification' THEN 'verification' WHEN 'version' THEN 'artifact' END AS public_kind, count(*) AS events FROM obs GROUP BY 1""", fx.OBS)
def public_events(spark, sf):
    return fx.obs(spark, sf).groupBy(public_event_kind("kind").alias("public_kind")).agg(F.count("*").alias("events"))


@query("SELECT 'a' AS provider, session_id, count(*) AS hits FROM obs WHERE kind = 'file' AND contains(path, 'm1') GROUP BY 2", fx.OBS)
def search_files(spark, sf):
    return search.search_sessions(fx.obs(spark, sf), "file", " M1 ")


@query("""SELECT revision_id, CASE WHEN outcome = 'success' THEN 'success' WHEN outcome = 'failure' THEN 'failure' END AS typed FROM obs WHERE kind = 'verification'""", fx.OBS)
def typed_outcomes(spark, sf):
    o = fx.obs(spark, sf).where("kind = 'verification'").withColumn("operation", F.lit("verification"))
    return o.select("revision_id", facts.typed_outcome().alias("typed"))


@query("""SELECT revision_id, priority FROM (SELECT revision_id, session_id, component, CASE kind WHEN 'verification' THEN 10 ELSE 30 END AS priority,
 row_number() OVER (PARTITION BY session_id, component ORDER BY CASE kind WHEN 'verification' THEN 10 ELSE 30 END DESC, ts DESC, sequence DESC) AS rn FROM obs WHERE (kind = 'verification' AND outcome = 'success') OR kind = 'version') q WHERE rn = 1""", fx.OBS)
def strongest_facts(spark, sf):
    o = fx.obs(spark, sf).withColumn("operation", F.col("kind")).withColumn("fields", F.map_filter("fields", lambda k, v: k != "version"))
    return facts.strongest_facts(facts.qualify_milestones(o), ["session_id", "component"]).select("revision_id", "priority")


CALLS = """calls AS (SELECT session_id, component * 10 + CAST(floor(value) AS BIGINT) % 10 AS call_id, sequence AS ordinal FROM obs WHERE kind = 'command'),
 outputs AS (SELECT session_id, component * 10 + CAST(floor(value) AS BIGINT) % 10 AS call_id, sequence AS ordinal FROM obs WHERE kind = 'verification')"""


@query("""SELECT c.session_id, c.call_id, c.ordinal, CASE WHEN n = 1 THEN o.first END AS output_ordinal, CASE WHEN n > 1 THEN 'duplicate_call' WHEN o.first IS NOT NULL THEN 'finished' ELSE 'started' END AS call_state
FROM (SELECT *, count(*) OVER (PARTITION BY session_id, call_id) AS n FROM calls) c
LEFT JOIN (SELECT c.session_id, c.call_id, c.ordinal, min(o.ordinal) AS first FROM calls c JOIN outputs o ON o.session_id = c.session_id AND o.call_id = c.call_id AND o.ordinal > c.ordinal GROUP BY 1, 2, 3) o
 ON o.session_id = c.session_id AND o.call_id = c.call_id AND o.ordinal = c.ordinal""", fx.OBS, CALLS)
def tool_calls(spark, sf):
    o = fx.obs(spark, sf).withColumn("call_id", F.col("component") * 10 + F.floor("value").cast("long") % 10).withColumnRenamed("sequence", "ordinal")
    calls, outs = (o.where(F.col("kind") == k).select("session_id", "call_id", "ordinal") for k in ("command", "verification"))
    return facts.join_tool_calls(calls, outs)[0]


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'owner' ELSE 'foreign' END AS owner, CASE lang WHEN 'en' THEN 'p-en' WHEN 'de' THEN 'p-de' END AS project_id FROM documents""")
def project_owners(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/srv/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc")).alias("path"))
    roots = spark.createDataFrame([("p-en", "/srv/en"), ("p-de", "/srv/de/"), ("p-x", "/srv/e")], "project_id string, root string")
    return facts.attribute_projects(d, roots).select("doc_id", "owner", "project_id")


@query("""SELECT session_id, model, sum(input_tokens) AS input_tokens, sum(cached_input_tokens) AS cached_input_tokens, sum(output_tokens) AS output_tokens, sum(total_tokens) AS total_tokens,
 min(ts) AS started_at, max(ts) AS ended_at FROM usage GROUP BY 1, 2""", fx.USAGE)
def session_usage(spark, sf):
    u = fx.usage(spark, sf).withColumn("last", F.struct(*accounting.CLASSES)).withColumn("cumulative", F.lit(None).cast(f"struct<{', '.join(f'{c}: long' for c in accounting.CLASSES)}>"))
    got = accounting.session_usage(u.withColumn("model", F.col("model").cast("string")))
    return got.select("session_id", F.col("model").cast("long").alias("model"), "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens", "started_at", "ended_at")


@query("""SELECT project_id, model, total_tokens, round(100.0 * total_tokens / sum(total_tokens) OVER (PARTITION BY project_id), 6) AS token_share FROM (SELECT project_id, model, sum(total_tokens) AS total_tokens FROM usage GROUP BY 1, 2) u""", fx.USAGE)
def project_usage(spark, sf):
    return accounting.project_usage(fx.usage(spark, sf)).select("project_id", "model", "total_tokens", F.round("token_share", 6).alias("token_share"))


@query("""SELECT project_id, model, sum(total_tokens) AS total_tokens, count(*) AS rows FROM usage GROUP BY ROLLUP (project_id, model)""", fx.USAGE)
def usage_rollup(spark, sf):
    return accounting.usage_rollup(fx.usage(spark, sf), ["project_id", "model"]).drop("grouping")


@query("""SELECT project_id, model, sum(total_tokens) AS total_tokens, count(*) AS rows FROM usage GROUP BY CUBE (project_id, model)""", fx.USAGE)
def usage_cube(spark, sf):
    return accounting.usage_rollup(fx.usage(spark, sf), ["project_id", "model"], "cube").drop("grouping")


@query("""SELECT date_trunc('month', ts) AS window_start, model, sum(total_tokens) AS total_tokens, count(*) AS rows FROM usage GROUP BY 1, 2""", fx.USAGE)
def usage_by_month(spark, sf):
    u = fx.usage(spark, sf).withColumn("ts", F.date_trunc("month", "ts"))
    return streams.usage_by_window(u).select("window_start", "model", "total_tokens", "rows")


INTERVALS = "intervals AS (SELECT *, lead(date) OVER (PARTITION BY model ORDER BY date) AS until FROM prices)"
PRICED = """priced AS (SELECT u.session_id, u.ordinal, u.project_id, u.model, p.input_rate, p.output_rate, coalesce(p.event = 'correction', false) AS review,
 ((u.input_tokens - u.cached_input_tokens) * p.input_rate + u.output_tokens * p.output_rate) / 1000000 AS cost
 FROM usage u LEFT JOIN intervals p ON p.model = u.model AND CAST(u.ts AS DATE) >= p.date AND (p.until IS NULL OR CAST(u.ts AS DATE) < p.until))"""


def _priced(spark, sf):
    p = accounting.price_asof(fx.usage(spark, sf), fx.prices(spark), "model", "ts")
    return p.withColumn("cost", ((F.col("input_tokens") - F.col("cached_input_tokens")) * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate")) / 1_000_000)


@query("SELECT session_id, ordinal, model, input_rate, output_rate, review, round(cost, 6) AS cost FROM priced", fx.USAGE, fx.PRICES_SQL, INTERVALS, PRICED)
def price_asof(spark, sf):
    return _priced(spark, sf).select("session_id", "ordinal", "model", "input_rate", "output_rate", "review", F.round("cost", 6).alias("cost"))


@query("""SELECT project_id, model, round(coalesce(sum(cost), 0), 4) AS known_subtotal, bool_and(cost IS NOT NULL) AS complete, count(*) AS rows, CASE WHEN bool_and(cost IS NOT NULL) THEN round(sum(cost), 4) END AS total
FROM priced GROUP BY 1, 2""", fx.USAGE, fx.PRICES_SQL, INTERVALS, PRICED)
def price_totals(spark, sf):
    t = accounting.price_totals(_priced(spark, sf), ["project_id", "model"])
    return t.withColumn("known_subtotal", F.round("known_subtotal", 4)).withColumn("total", F.round("total", 4))


@query("""SELECT s.session_id, s.model, count(b.model) > 0 AS ambiguous FROM (SELECT session_id, model, min(ts) AS started_at, max(ts) AS ended_at FROM usage GROUP BY 1, 2) s
LEFT JOIN (SELECT model, CAST(date AS TIMESTAMP) AS at FROM (SELECT *, lag(input_rate) OVER w AS i, lag(output_rate) OVER w AS o, row_number() OVER w AS n FROM prices WINDOW w AS (PARTITION BY model ORDER BY date)) h
 WHERE n > 1 AND (i IS DISTINCT FROM input_rate OR o IS DISTINCT FROM output_rate)) b ON b.model = s.model AND b.at > s.started_at AND b.at <= s.ended_at GROUP BY 1, 2""", fx.USAGE, fx.PRICES_SQL)
def price_period(spark, sf):
    s = fx.usage(spark, sf).groupBy("session_id", "model").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    return accounting.price_period_check(s, fx.prices(spark), ["input_rate", "output_rate"], "model").select("session_id", "model", "ambiguous")


@query("""SELECT session_id, model, CASE WHEN min(input_tokens) = max(input_tokens) THEN min(input_tokens) END AS input_tokens, count(*) AS copies,
 CASE WHEN min(input_tokens) = max(input_tokens) THEN 'counted' ELSE 'conflicting_usage' END AS diagnostic FROM usage GROUP BY 1, 2""", fx.USAGE)
def usage_by_message(spark, sf):
    return accounting.dedupe_usage_by_message(fx.usage(spark, sf), ["session_id"], "model", ["input_tokens"])


MERGED = """merged AS (SELECT key, b.key IS NOT NULL AS hb, l.key IS NOT NULL AS hl, r.key IS NOT NULL AS hr, l.segment AS ls, l.nation AS ln, r.segment AS rs, r.nation AS rn,
 (l.key IS NOT NULL) = (r.key IS NOT NULL) AND l.nation IS NOT DISTINCT FROM r.nation AND l.segment IS NOT DISTINCT FROM r.segment AS lr,
 (l.key IS NOT NULL) = (b.key IS NOT NULL) AND l.nation IS NOT DISTINCT FROM b.nation AND l.segment IS NOT DISTINCT FROM b.segment AS lb,
 (r.key IS NOT NULL) = (b.key IS NOT NULL) AND r.nation IS NOT DISTINCT FROM b.nation AND r.segment IS NOT DISTINCT FROM b.segment AS rb
 FROM base b FULL JOIN lft l USING (key) FULL JOIN rgt r USING (key)),
 verdicts AS (SELECT *, CASE WHEN lr AND lb THEN 'unchanged' WHEN lr THEN 'both' WHEN lb THEN 'right' WHEN rb THEN 'left' ELSE 'conflict' END AS verdict FROM merged)"""


@query("""SELECT key, verdict, CASE WHEN verdict = 'conflict' THEN NULL WHEN verdict = 'right' THEN hr ELSE hl END AS present, CASE WHEN verdict = 'conflict' THEN NULL WHEN verdict = 'right' THEN rn ELSE ln END AS nation FROM verdicts""", fx.VERSIONS, MERGED)
def three_way_merge(spark, sf):
    return lineage.merge_all(*fx.versions(spark, sf), ["key"], ["segment", "nation"]).select("key", "verdict", "present", "nation")


@query("""SELECT key, CASE WHEN b.nation IS NULL THEN 'added' WHEN l.nation IS NULL THEN 'withdrawn' WHEN b.nation = l.nation THEN 'unchanged' ELSE 'superseded' END AS change, b.nation AS old_revision, l.nation AS new_revision
FROM base b FULL JOIN lft l USING (key)""", fx.VERSIONS)
def lineage_diff(spark, sf):
    base, left, _ = fx.versions(spark, sf)
    return lineage.diff_lineage(base, left, ["key"], "nation")


@query("SELECT l.* FROM lft l WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.key = l.key)", fx.VERSIONS)
def new_rows(spark, sf):
    base, left, _ = fx.versions(spark, sf)
    return lineage.new_observations(left, base, "key")


@query("""SELECT key, CASE WHEN l.key IS NULL THEN 'unavailable' WHEN key % 3 = 0 THEN 'unavailable' ELSE 'available' END AS availability,
 CASE WHEN l.key IS NULL OR (key % 3 = 0 AND b.key IS NOT NULL) THEN b.nation ELSE l.nation END AS nation, CASE WHEN l.key IS NULL OR (key % 3 = 0 AND b.key IS NOT NULL) THEN 'carried' ELSE 'current' END AS facts_from
FROM base b FULL JOIN lft l USING (key)""", fx.VERSIONS)
def index_carry_forward(spark, sf):
    base, left, _ = fx.versions(spark, sf)
    shape = lambda d, a: d.select("key", a.alias("availability"), F.col("segment").alias("digest"), "nation")
    got = lineage_index(shape(base, F.lit("available")), shape(left, F.when(F.col("key") % 3 == 0, "unavailable").otherwise("available")))
    return got.select("key", "availability", "nation", "facts_from")


def lineage_index(previous, current):
    return sessions.carry_forward_index(previous, current, ["key"], ["nation"])


@query("""SELECT * FROM (SELECT *, 'left' AS side FROM (SELECT * FROM lft EXCEPT ALL SELECT * FROM rgt) a UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM rgt EXCEPT ALL SELECT * FROM lft) b) c""", fx.VERSIONS)
def digest_differences(spark, sf):
    _, left, right = fx.versions(spark, sf)
    return lineage.same_digests(left, right)


@query("""SELECT key, violation FROM (SELECT b.key, CASE WHEN l.key IS NULL THEN 'vanished' WHEN b.segment <> l.segment THEN 'immutable_changed' END AS violation FROM base b LEFT JOIN lft l USING (key)) v WHERE violation IS NOT NULL
UNION ALL SELECT l.key, 'bad_revision' FROM lft l LEFT JOIN base b USING (key) WHERE b.key IS NOT NULL AND l.nation <> b.nation UNION ALL SELECT l.key, 'bad_revision' FROM lft l LEFT JOIN base b USING (key) WHERE b.key IS NULL AND l.nation <> 1""", fx.VERSIONS)
def transition_audit(spark, sf):
    base, left, _ = fx.versions(spark, sf)
    shape = lambda d: d.select("key", F.lit("pending").alias("status"), F.col("nation").alias("revision"), "segment")
    return quality.audit_transitions(shape(base), shape(left), "key", ["segment"])


@query("""SELECT event_id, rule FROM (SELECT event_id, 'value' AS rule FROM events WHERE NOT coalesce(value BETWEEN 1 AND 90, false) UNION ALL SELECT event_id, 'type' FROM events WHERE event_type NOT IN ('view', 'click')) r""")
def quality_rules(spark, sf):
    e = fx.table(spark, sf, "events")
    return quality.quality_rules(e, ["event_id"], {"value": (F.col("value") >= 1) & (F.col("value") <= 90), "type": F.col("event_type").isin("view", "click")})


@query("""SELECT version, o_orderkey, 'missing' AS violation FROM (SELECT 0 AS version, o_orderkey, o_custkey FROM orders
 UNION ALL SELECT 1, o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""")
def reference_check(spark, sf):
    """All orders as they are, and a second version of them of which every 17th key refers to no customer."""
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    o = fx.table(spark, sf, "orders").select(F.lit(0).alias("version"), "o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"))
    second = o.select(F.lit(1).alias("version"), "o_orderkey", F.when(F.col("o_orderkey") % 17 == 0, F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return quality.check_references(o.unionByName(second), c, ["o_custkey"]).select("version", "o_orderkey", "violation")


TREE = """tree AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS node_id, CAST(NULL AS VARCHAR) AS parent_id FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation
 UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer)"""


def _tree(spark, sf):
    part = lambda t, k, prefix, p, up: fx.table(spark, sf, t).select(F.concat(F.lit(prefix), F.col(k)).alias("node_id"), (F.concat(F.lit(up), F.col(p)) if p else F.lit(None).cast("string")).alias("parent_id"))
    return part("region", "r_regionkey", "r", None, "").unionByName(part("nation", "n_nationkey", "n", "n_regionkey", "r")).unionByName(part("customer", "c_custkey", "c", "c_nationkey", "n"))


@query("""SELECT c.node_id AS node, CAST(CASE WHEN c.parent_id IS NULL THEN 0 WHEN p.parent_id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS depth,
 concat_ws('/', p.parent_id, c.parent_id, c.node_id) AS path FROM tree c LEFT JOIN tree p ON p.node_id = c.parent_id""", TREE)
def tree_paths(spark, sf):
    return problems.tree_paths(_tree(spark, sf)).select("node", "depth", F.array_join("path", "/").alias("path"))


DECISIONS = """decisions AS (SELECT c_custkey % 3 AS project_id, CAST(c_custkey AS BIGINT) AS id, (c_custkey // 3) % 7 AS chain, c_custkey // 21 // 5 AS part FROM customer),
 placed AS (SELECT *, max(id) OVER (PARTITION BY project_id, chain, part) AS top, bool_or(id % 50 = 0) OVER (PARTITION BY project_id, chain, part ORDER BY id DESC) AS lost FROM decisions)"""


@query("SELECT project_id, id, CASE WHEN NOT lost THEN row_number() OVER (PARTITION BY project_id, lost ORDER BY top, id DESC) - 1 END AS position FROM placed", DECISIONS)
def supersession_order(spark, sf):
    """Customers as decisions: each supersedes the next of its chain, chains end after five, and every 50th waits for a decision that is missing."""
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    part = F.floor(F.col("id") / 105)
    name = lambda i: F.format_string("d%012d", i)
    known = c.select(F.col("id").alias("other"))
    c = c.join(known, F.col("other") == F.col("id") + 21, "left")
    following = F.when(F.floor(F.col("other") / 105) == part, name(F.col("other")))
    d = c.select((F.col("id") % 3).alias("project_id"), name(F.col("id")).alias("decision_id"), F.array_compact(F.array(following, F.when(F.col("id") % 50 == 0, "gone"))).alias("supersedes"))
    return problems.order_by_supersession(d).select("project_id", F.substring("decision_id", 2, 12).cast("long").alias("id"), "position")


PLACED = r"""q AS (SELECT session_id * 1000 + ordinal AS question_id, session_id % 4 AS project_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM messages),
 n AS (SELECT session_id * 1000 + ordinal AS node_id, session_id % 4 AS project_id, lower(trim(regexp_replace(split_part(text, '.', 1), '\s+', ' ', 'g'))) AS n FROM messages WHERE role = 'user' AND session_id % 3 <> 1),
 same AS (SELECT question_id, min(node_id) AS node FROM q JOIN n ON q.project_id = n.project_id AND q.q = n.n WHERE n.n <> '' GROUP BY 1),
 inside AS (SELECT question_id, count(DISTINCT node_id) AS held, min(node_id) AS node FROM q JOIN n ON q.project_id = n.project_id AND contains(q.q, n.n) WHERE n.n <> '' GROUP BY 1)"""


@query("""SELECT question_id, CASE WHEN same.node IS NOT NULL THEN 'merge' WHEN held = 1 THEN 'child' ELSE 'keep_pending' END AS action, coalesce(same.node, CASE WHEN held = 1 THEN inside.node END) AS target
FROM q LEFT JOIN same USING (question_id) LEFT JOIN inside USING (question_id)""", fx.MESSAGES, PLACED)
def placements(spark, sf):
    """All messages as questions, and the first sentences of what users say in two thirds of the sessions as nodes."""
    m = fx.messages(spark, sf).withColumn("project_id", F.col("session_id") % 4).withColumn("id", F.col("session_id") * 1000 + F.col("ordinal"))
    nodes = m.where("role = 'user' AND session_id % 3 <> 1").select("project_id", F.col("id").alias("node_id"), F.col("id").alias("node_order"), F.substring_index("text", ".", 1).alias("question"))
    return problems.recommend_placement(m.select("project_id", F.col("id").alias("question_id"), F.col("text").alias("question")), nodes).select("question_id", "action", "target")


@query("SELECT CAST(s.s_suppkey AS BIGINT) AS snapshot_id, count(*) OVER (PARTITION BY s_nationkey) = 1 AS is_unique FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM supplier n WHERE n.s_suppkey = s.s_suppkey + 25)")
def price_leaves(spark, sf):
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("snapshot_id"), F.col("s_nationkey").alias("identity"), F.when(F.col("s_suppkey") >= 25, F.col("s_suppkey") - 25).alias("supersedes"))
    return accounting.current_price_leaves(s).select("snapshot_id", F.col("unique").alias("is_unique"))


@query()
def document_tokens(spark, sf):
    d = fx.table(spark, sf, "documents")
    found = redaction_findings(d, keys=("lang",)).where("rule = 'high_entropy_token'")
    docs = d.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("docs"))
    return found.join(docs, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "rule", "findings", "docs")


@query("""SELECT n_name, length(n_name) AS n, CASE WHEN length(n_name) > 5 THEN left(n_name, 4) || '…' ELSE n_name END AS short, lower(n_name) AS name FROM nation""")
def short_names(spark, sf):
    n = fx.table(spark, sf, "nation")
    return n.select("n_name", F.length("n_name").cast("long").alias("n"), truncate_chars("n_name", 5).alias("short"), normalize_identity("n_name").alias("name"))


@query()
def redaction_counts(spark, sf):
    return redaction_findings(fx.table(spark, sf, "documents"), keys=("source",))


@query("""SELECT p_partkey, round(-sum(share * log2(share)), 6) AS bits FROM (SELECT p_partkey, count(*) / any_value(length(p_name)) AS share FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, '')) AS x FROM part) c WHERE x <> '' GROUP BY p_partkey, x) s GROUP BY 1""")
def name_entropy(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", F.round(shannon_entropy("p_name"), 6).alias("bits"))


@query("SELECT project_id, path, count(*) AS n, true AS within FROM obs GROUP BY 1, 2", fx.OBS)
def hot_modules(spark, sf):
    """Every module with its count, and whether the sketch, merged from one a session, is within its error."""
    o = fx.obs(spark, sf)
    sketched = projects.sketched_modules(projects.merge_sketches(projects.module_sketches(o, ["project_id", "session_id"])), 1000)
    true = o.groupBy("project_id", "path").agg(F.count("*").alias("n"))
    return true.join(sketched, ["project_id", "path"]).select("project_id", "path", "n", ((F.col("estimate") - F.col("error") <= F.col("n")) & (F.col("n") <= F.col("estimate"))).alias("within"))


PAGES = """sized AS (SELECT session_id, ordinal, row_number() OVER w - 1 AS pos, coalesce(sum(octet_length(encode(text))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, octet_length(encode(text)) AS size FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY ordinal)),
 jumps AS (SELECT i.session_id, i.pos, least(coalesce(max(j.pos), i.pos) + 1, i.pos + 3) AS following FROM sized i LEFT JOIN sized j ON j.session_id = i.session_id AND j.pos >= i.pos AND j.pos < i.pos + 3 AND j.before + j.size <= i.before + 4000 GROUP BY 1, 2),
 starts(session_id, pos, page) AS (SELECT session_id, CAST(0 AS BIGINT), 0 FROM sized WHERE pos = 0 UNION ALL SELECT s.session_id, j.following, s.page + 1 FROM starts s JOIN jumps j ON j.session_id = s.session_id AND j.pos = s.pos JOIN sized x ON x.session_id = s.session_id AND x.pos = j.following)"""


@query("SELECT s.session_id, s.ordinal, CAST(max(t.page) AS INTEGER) AS page FROM sized s JOIN starts t ON t.session_id = s.session_id AND t.pos <= s.pos GROUP BY 1, 2", "RECURSIVE " + fx.MESSAGES, PAGES)
def conversation_pages(spark, sf):
    m = fx.messages(spark, sf).withColumn("bytes", F.octet_length("text"))
    return windows.greedy_pages(m, ["session_id"], "ordinal", "bytes", 3, 4000)


@query("""SELECT session_id, ordinal FROM (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER (PARTITION BY session_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS chars FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY ordinal)) p
WHERE n <= 4 AND chars <= 3000""", fx.MESSAGES)
def evidence_packets(spark, sf):
    return windows.packet(fx.messages(spark, sf), ["session_id"], [F.asc("ordinal")], "text", 4, 3000).select("session_id", "ordinal")


@query("""SELECT project_id, kind, count(*) AS records FROM (
 SELECT DISTINCT project_id, 'witnessed_state' AS kind, 'verification:' || CAST(component AS VARCHAR) AS subject FROM obs WHERE kind = 'verification' AND outcome IS NOT NULL
 UNION ALL SELECT DISTINCT project_id, 'witnessed_state', 'version' FROM obs WHERE kind = 'version' AND version IS NOT NULL
 UNION ALL SELECT f.project_id, 'recovery_link', NULL FROM obs f WHERE f.outcome = 'failure'
  AND EXISTS (SELECT 1 FROM obs s WHERE s.session_id = f.session_id AND s.project_id = f.project_id AND s.component = f.component AND s.kind = f.kind AND s.outcome = 'success' AND s.sequence > f.sequence)
 UNION ALL SELECT project_id, 'recovery_link', NULL FROM (SELECT project_id, session_id, outcome, first_value(CASE WHEN outcome = 'success' THEN session_id END IGNORE NULLS)
  OVER (PARTITION BY project_id, kind, component ORDER BY ts, session_id, sequence ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS recovered FROM obs WHERE outcome IS NOT NULL) l
  WHERE outcome = 'failure' AND recovered <> session_id
 UNION ALL SELECT project_id, 'phase_boundary', NULL FROM (SELECT project_id, version, lag(version) OVER (PARTITION BY project_id ORDER BY ts, session_id, sequence) AS before FROM obs WHERE kind = 'version' AND version IS NOT NULL) v
  WHERE before IS NULL OR before <> version
 UNION ALL SELECT project_id, 'phase_boundary', NULL FROM (SELECT project_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY project_id ORDER BY ts, session_id, sequence) AS gap_ms FROM obs) g WHERE gap_ms > 2592000000
 UNION ALL SELECT project_id, 'module_rank', NULL FROM (SELECT project_id, path FROM obs WHERE kind = 'file' GROUP BY 1, 2) m) r GROUP BY 1, 2""", fx.OBS)
def project_modules(spark, sf):
    v = projects.project_view(fx.obs(spark, sf), F.lit(REFERENCE).cast("timestamp"))
    return v.groupBy("project_id", "kind").agg(F.count("*").alias("records"))


@query("""SELECT CASE WHEN age <= 604800000000 THEN 3 WHEN age <= 2592000000000 THEN 2 WHEN age <= 7776000000000 THEN 1 ELSE 0 END AS bucket, count(*) AS events FROM (SELECT 1706659200000000 - epoch_us(ts) AS age FROM events) e GROUP BY 1""")
def event_recency(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.groupBy(recency_bucket(F.lit(REFERENCE).cast("timestamp"), F.col("ts")).alias("bucket")).agg(F.count("*").alias("events"))


from tracemill.plans import placements, texts, views  # noqa: E402, F401  register their queries here, too
