"""More registered queries: the session index, accounting, patches, prices, histories and scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import scalars
from tracemill.operators import accounting, facts, lineage, problems, projects, search, sessions, windows
from tracemill.plans import fixtures as fx
from tracemill.plans.reports import INTERVALS, PRICED, _priced, _tree, query
from tracemill.streaming import streams

SESS = """sess AS (SELECT 'a' AS provider, session_id, min(project_id) AS project_id, min(ts) AS started_at, max(ts) AS ended_at,
 CASE WHEN session_id % 11 = 0 THEN 'unreadable' WHEN session_id % 7 = 0 THEN 'missing' ELSE 'indexed' END AS terminal_state, CASE WHEN session_id % 3 = 0 THEN 'unavailable' ELSE 'available' END AS availability FROM obs GROUP BY session_id),
 entries AS (SELECT s.*, c.files, c.commands, c.verifications, c.errors, c.artifacts, reasons, CASE WHEN terminal_state <> 'indexed' THEN 'error' WHEN reasons <> '' THEN 'partial' ELSE 'complete' END AS processing_state,
  epoch_us(ended_at) // 1000 - epoch_us(started_at) // 1000 AS duration_ms FROM (SELECT *, CASE WHEN session_id % 12 = 0 THEN 'gap,late' WHEN session_id % 4 = 0 THEN 'late' WHEN session_id % 6 = 0 THEN 'gap' ELSE '' END AS reasons FROM sess) s
  JOIN (SELECT session_id, count(*) FILTER (WHERE kind = 'file') AS files, count(*) FILTER (WHERE kind = 'command') AS commands, count(*) FILTER (WHERE kind = 'verification') AS verifications,
   count(*) FILTER (WHERE outcome = 'failure') AS errors, count(*) FILTER (WHERE kind = 'artifact') AS artifacts FROM obs GROUP BY 1) c USING (session_id))"""


def _sessions(spark, sf):
    s = F.col("session_id")
    state = sessions.terminal_state(F.when(s % 11 == 0, 1).otherwise(0), F.lit(0), F.when(s % 7 == 0, "missing").otherwise("present"))
    return fx.obs(spark, sf).groupBy("provider", "session_id").agg(F.min("project_id").alias("project_id"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).withColumn(
        "terminal_state", state).withColumn("availability", F.when(s % 3 == 0, "unavailable").otherwise("available"))


def _index(spark, sf):
    s = _sessions(spark, sf)
    codes = s.where("session_id % 4 = 0").select("provider", "session_id", F.lit("late").alias("code")).unionByName(s.where("session_id % 6 = 0").select("provider", "session_id", F.lit("gap").alias("code")))
    return sessions.session_index(s, fx.obs(spark, sf), codes.unionByName(codes))


@query("SELECT session_id, project_id, terminal_state, availability, reasons, processing_state, duration_ms, files, commands, verifications, errors, artifacts FROM entries", fx.OBS, SESS)
def session_entries(spark, sf):
    got = _index(spark, sf).withColumn("reasons", F.array_join("reasons", ","))
    return got.select("session_id", "project_id", "terminal_state", "availability", "reasons", "processing_state", "duration_ms", "files", "commands", "verifications", "errors", "artifacts")


@query("""SELECT project_id, count(*) AS total, count(*) FILTER (WHERE processing_state = 'complete') AS complete, count(*) FILTER (WHERE processing_state = 'partial') AS partial, count(*) FILTER (WHERE processing_state = 'error') AS errors,
 count(*) FILTER (WHERE availability = 'available') AS available, count(*) FILTER (WHERE availability <> 'available') AS unavailable, count(*) AS timed FROM entries GROUP BY 1""", fx.OBS, SESS)
def index_totals(spark, sf):
    return sessions.index_coverage(_index(spark, sf), ["project_id"])


@query("""SELECT project_id, count(*) AS sources, count(*) FILTER (WHERE session_id % 13 <> 0) AS terminal, count(*) FILTER (WHERE session_id % 13 <> 0 AND terminal_state = 'indexed') AS indexed,
 count(*) FILTER (WHERE session_id % 13 <> 0 AND terminal_state <> 'indexed') AS issues FROM sess GROUP BY 1""", fx.OBS, SESS)
def session_progress(spark, sf):
    s = _sessions(spark, sf).withColumn("terminal_state", F.when(F.col("session_id") % 13 != 0, F.col("terminal_state")))
    return sessions.progress_counters(s, ["project_id"])


@query("""SELECT project_id, count(*) FILTER (WHERE terminal_state = 'indexed') AS indexed, CAST(0 AS BIGINT) AS unsupported, count(*) FILTER (WHERE terminal_state = 'missing') AS missing,
 count(*) FILTER (WHERE terminal_state = 'unreadable') AS unreadable, CAST(0 AS BIGINT) AS ambiguous FROM sess GROUP BY 1""", fx.OBS, SESS)
def terminal_states(spark, sf):
    return projects.terminal_counts(_sessions(spark, sf))


@query("""SELECT project_id, count(*) FILTER (WHERE state = 'indexed') AS indexed, count(*) FILTER (WHERE state = 'unsupported') AS unsupported, count(*) FILTER (WHERE state = 'missing') AS missing,
 count(*) FILTER (WHERE state = 'unreadable') AS unreadable, count(*) FILTER (WHERE state = 'ambiguous') AS ambiguous
FROM (SELECT project_id, CASE WHEN failures > 0 AND session_id % 3 = 0 THEN 'unreadable' WHEN session_id % 4 = 1 THEN 'missing' WHEN session_id % 4 = 2 THEN 'ambiguous' WHEN session_id % 4 = 3 THEN 'unsupported' ELSE 'indexed' END AS state
 FROM (SELECT session_id, min(project_id) AS project_id, count(*) FILTER (WHERE outcome = 'failure') AS failures FROM obs GROUP BY 1) o) s GROUP BY 1""", fx.OBS)
def source_states(spark, sf):
    failures = F.count_if(F.coalesce(F.col("outcome") == "failure", F.lit(False)))
    s = fx.obs(spark, sf).groupBy("session_id").agg(F.min("project_id").alias("project_id"), failures.alias("failures"))
    k = F.col("session_id") % 4
    source = F.when(k == 1, "missing").when(k == 2, "ambiguous").when(k == 3, "unsupported").otherwise("present")
    state = sessions.terminal_state(F.when(F.col("session_id") % 3 == 0, F.col("failures")).otherwise(0), F.lit(0), source)
    return projects.terminal_counts(s.withColumn("terminal_state", state))


@query("""SELECT start - to_hours(back) AS window_start, start - to_hours(back) + INTERVAL 6 HOUR AS window_end, kind, CAST(sum(version) AS BIGINT) AS version, count(*) AS rows
FROM (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS start, kind, version, unnest([0, 2, 4]) AS back FROM obs) o GROUP BY 1, 2, 3""", fx.OBS)
def sliding_hours(spark, sf):
    return streams.usage_by_window(fx.obs(spark, sf), "ts", "6 hours", "2 hours", keys=("kind",), value="version")


@query("SELECT project_id, CAST(min(started_at) AS VARCHAR)[1:10] AS started_raw, CAST(max(ended_at) AS VARCHAR)[1:10] AS ended_raw FROM sess GROUP BY 1", fx.OBS, SESS)
def project_spans(spark, sf):
    s = _sessions(spark, sf).withColumn("started_raw", F.date_format("started_at", "yyyy-MM-dd")).withColumn("ended_raw", F.date_format("ended_at", "yyyy-MM-dd"))
    return projects.project_time_range(s)


@query("""SELECT session_id, processing_state FROM entries WHERE processing_state = 'complete' AND availability = 'available' AND contains('a ' || CAST(session_id AS VARCHAR), 'a 1')
 AND CAST(started_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'""", fx.OBS, SESS)
def sessions_found(spark, sf):
    return sessions.filter_sessions(_index(spark, sf), "a", "complete", "available", "A 1", "2024-01-01", "2024-01-20").select("session_id", "processing_state")


@query("SELECT project_id, session_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, session_id) AS rn FROM sess) s WHERE rn <= 5", fx.OBS, SESS)
def newest_sessions(spark, sf):
    got = windows.page(_sessions(spark, sf), ["project_id"], sessions.index_order(), 5)
    return got.select("project_id", "session_id", F.col("position").alias("rn"))


@query("SELECT project_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ended_at DESC, session_id) AS rn FROM sess) s WHERE rn <= 3", fx.OBS, SESS)
def last_active(spark, sf):
    return windows.top_n(_sessions(spark, sf), ["project_id"], sessions.last_activity_order(), 3).select("project_id", "session_id")


@query("SELECT session_id, revision_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, sequence, revision_id) AS rn FROM obs) s WHERE rn <= 3", fx.OBS)
def first_events(spark, sf):
    return windows.top_n(fx.obs(spark, sf), ["session_id"], sessions.event_order(), 3).select("session_id", "revision_id")


@query("""SELECT project_id, session_id, coalesce(epoch_us(ended_at) // 1000 - epoch_us(nxt) // 1000 < 36000000, false) AS ambiguous FROM (SELECT *, row_number() OVER w AS rn, lead(ended_at) OVER w AS nxt
 FROM sess WINDOW w AS (PARTITION BY project_id ORDER BY ended_at DESC, session_id)) s WHERE rn = 1""", fx.OBS, SESS)
def latest_sources(spark, sf):
    s = _sessions(spark, sf).withColumn("modified_at", F.col("ended_at"))
    return sessions.latest_session(s, F.lit("2030-01-01 00:00:00").cast("timestamp"), 600).select("project_id", "session_id", "ambiguous")


@query("""SELECT session_id, count(*) AS seen, count(*) FILTER (WHERE kind = 'file') AS indexed, count(*) FILTER (WHERE kind = 'command') AS collapsed, count(*) FILTER (WHERE kind = 'version') AS unprojected,
 count(*) FILTER (WHERE kind = 'verification' AND outcome = 'failure') AS undecodable, CAST(0 AS BIGINT) AS truncated, count(*) FILTER (WHERE kind = 'verification' AND outcome = 'success') = 0 AS reconciled FROM obs GROUP BY 1""", fx.OBS)
def source_accounts(spark, sf):
    fate = F.when(F.col("kind") == "file", "indexed").when(F.col("kind") == "command", "collapsed").when(F.col("kind") == "version", "unprojected").when(F.col("outcome") == "failure", "undecodable").otherwise("lost")
    return sessions.measure_sources(fx.obs(spark, sf).withColumn("fate", fate))


@query("SELECT session_id, count(DISTINCT model) AS projects FROM usage GROUP BY 1 HAVING count(DISTINCT model) > 1", fx.USAGE)
def multi_project_sessions(spark, sf):
    s = fx.usage(spark, sf).groupBy("session_id").agg(F.collect_set(F.col("model").cast("string")).alias("project_ids"))  # five models
    return sessions.shared_sessions(s).select("session_id", F.size("project_ids").cast("long").alias("projects"))


BLOCKS = """parts AS (SELECT session_id, sequence, revision_id, 'operations' AS block FROM obs WHERE kind IN ('file', 'command') UNION ALL SELECT session_id, sequence, revision_id, 'verifications' FROM obs WHERE kind = 'verification'
 UNION ALL SELECT session_id, sequence, revision_id, 'errors' FROM obs WHERE kind = 'verification' AND outcome = 'failure'
 UNION ALL SELECT session_id, sequence, revision_id, 'unresolved' FROM obs f WHERE outcome = 'failure' AND NOT EXISTS (SELECT 1 FROM obs s WHERE s.session_id = f.session_id AND s.kind = f.kind AND s.component = f.component AND s.outcome = 'success' AND s.sequence > f.sequence))"""


@query("""SELECT session_id, block, count(*) AS total, count(*) FILTER (WHERE rn <= 4) AS shown, count(*) FILTER (WHERE rn > 4) AS omitted, string_agg(CAST(revision_id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 4) AS items
FROM (SELECT *, row_number() OVER (PARTITION BY session_id, block ORDER BY sequence, revision_id) AS rn FROM parts) p GROUP BY 1, 2""", fx.OBS, BLOCKS)
def session_blocks(spark, sf):
    o = fx.obs(spark, sf).withColumn("operation", F.when(F.col("kind") == "verification", "verification").otherwise(F.col("operation"))).withColumn("excerpt", F.col("path"))
    return sessions.session_summary(o, 4).select("session_id", "block", "total", "shown", "omitted", F.array_join(F.transform("items", lambda x: x["revision_id"].cast("string")), ",").alias("items"))


@query("SELECT project_id, model, bool_and(cost IS NOT NULL) AS complete, count(*) FILTER (WHERE cost IS NULL) AS unpriced FROM priced GROUP BY 1, 2", fx.USAGE, fx.PRICES_SQL, INTERVALS, PRICED)
def pricing_state(spark, sf):
    return accounting.pricing_complete(_priced(spark, sf), ["project_id", "model"])


@query("""SELECT project_id, model, total_tokens, round(cost, 4) AS cost, round(group_known, 4) AS known_subtotal, CASE WHEN whole THEN round(group_known, 4) END AS group_total FROM (
 SELECT *, sum(cost) OVER (PARTITION BY project_id) AS group_known, bool_and(priced) OVER (PARTITION BY project_id) AS whole FROM (
 SELECT project_id, model, sum(total_tokens) AS total_tokens, sum(cost) AS cost, bool_and(cost IS NOT NULL) AS priced FROM priced GROUP BY 1, 2) g) h""",
       fx.USAGE, fx.PRICES_SQL, INTERVALS, PRICED.replace("u.ordinal,", "u.ordinal, u.total_tokens,"))
def usage_costs(spark, sf):
    got = search.usage_report(_priced(spark, sf))
    return got.select("project_id", "model", "total_tokens", *(F.round(c, 4).alias(c) for c in ("cost", "known_subtotal", "group_total")))


@query("""SELECT project_id, model, CASE WHEN (project_id + model) % 3 = 0 AND model = 4 THEN 'total_tokens,output_tokens' WHEN (project_id + model) % 3 = 0 THEN 'total_tokens' ELSE 'output_tokens' END AS mismatches
FROM (SELECT DISTINCT project_id, model FROM usage) u WHERE (project_id + model) % 3 = 0 OR model = 4""", fx.USAGE)
def summary_mismatches(spark, sf):
    got = fx.usage(spark, sf).groupBy("project_id", "model").agg(F.sum("total_tokens").alias("total_tokens"), F.sum("output_tokens").cast("double").alias("output_tokens"))
    said = got.withColumn("total_tokens", F.col("total_tokens") + F.when((F.col("project_id") + F.col("model")) % 3 == 0, 1).otherwise(0)).withColumn("output_tokens", F.col("output_tokens") + F.when(F.col("model") == 4, 0.001).otherwise(1e-12))
    return accounting.validate_summary(said, got, ["project_id", "model"], ["total_tokens"], ["output_tokens"]).withColumn("mismatches", F.array_join("mismatches", ","))


STATES = """raw AS (SELECT session_id, ordinal, CASE WHEN ordinal % 2 = 1 THEN CAST(max(model) AS VARCHAR) END AS said, ordinal % 3 = 0 AS beat FROM usage GROUP BY session_id, ordinal),
 states AS (SELECT session_id, ordinal, coalesce(last_value(said IGNORE NULLS) OVER w, 'unknown') AS active_model,
  CASE WHEN NOT beat THEN 'counted' WHEN count(*) FILTER (WHERE NOT beat) OVER w > 0 THEN 'heartbeat' ELSE 'invalid' END AS state FROM raw WINDOW w AS (PARTITION BY session_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING))"""


@query("SELECT session_id, ordinal, active_model, state FROM states", fx.USAGE, STATES)
def usage_states(spark, sf):
    """Every third row of a session is a heartbeat: only a total, and the cumulative usage of the row before."""
    c, beat = accounting.CLASSES, F.col("ordinal") % 3 == 0
    last = F.struct(*(F.when(beat & F.lit(x != "total_tokens"), 0).otherwise(F.col(x)).cast("long").alias(x) for x in c))
    unique = fx.usage(spark, sf).groupBy("session_id", "ordinal").agg(*(F.max(x).alias(x) for x in ("model", *c)))
    rows = unique.withColumn("last", last).withColumn("cumulative", F.struct(*(F.col("session_id").alias(x) for x in c)))
    return accounting.usage_rows(rows.withColumn("model", F.when(F.col("ordinal") % 2 == 1, F.col("model").cast("string")))).select("session_id", "ordinal", "active_model", "state")


@query("""SELECT session_id, ordinal, ordinal <= 5 AS valid, round(((input_tokens - cached_input_tokens) * 3.0 + cached_input_tokens * 0.5 + output_tokens * 15.0) / 1000000, 9) AS usd FROM usage""", fx.USAGE)
def usage_checked(spark, sf):
    u = fx.usage(spark, sf)
    c = [F.col(x) for x in accounting.CLASSES]
    total = F.when(F.col("ordinal") > 5, F.col("total_tokens") + 1).otherwise(F.col("total_tokens"))
    return u.select("session_id", "ordinal", scalars.valid_usage(*c[:5], total).alias("valid"), F.round(scalars.price_usage(c[0], c[1], c[2], c[3], [F.lit(3.0), F.lit(0.5), F.lit(0.0), F.lit(15.0)]), 9).alias("usd"))


@query("""SELECT session_id, ordinal, model = 3 AND input_tokens > 1000 AS open_, round(CASE WHEN input_tokens > 1000 THEN CASE WHEN model = 3 THEN 0 ELSE (input_tokens - 1000) * 2.0 END ELSE 0 END / 1000000 + output_tokens * 8.0 / 1000000, 9) AS known FROM usage""", fx.USAGE)
def line_cost_check(spark, sf):
    """A rate that is not known matters only where there is a quantity."""
    over = F.greatest(F.col("input_tokens") - 1000, F.lit(0))
    cost = scalars.line_costs(["long", "output"], [over, F.col("output_tokens")], [F.when(F.col("model") != 3, F.lit(2.0)), F.lit(8.0)])
    return fx.usage(spark, sf).withColumn("c", cost).select("session_id", "ordinal", (~F.col("c.complete")).alias("open_"), F.round("c.known_subtotal", 9).alias("known"))


SPANS = "spans AS (SELECT session_id, model, min(ts) AS started_at, max(ts) AS ended_at FROM usage GROUP BY 1, 2)"
SUPPLEMENTS = [(0, "1992-01-01", "1995-01-01", 1.0), (0, "1995-01-01", None, 2.0), (1, "1993-06-01", None, 3.0), (2, "1990-01-01", "1996-01-01", 4.0), (4, "1992-01-01", None, 5.0)]


@query("SELECT session_id, s.model, rate FROM spans s LEFT JOIN (VALUES " + ", ".join(f"(CAST({m} AS BIGINT), TIMESTAMP '{a}', {f"TIMESTAMP '{b}'" if b else 'CAST(NULL AS TIMESTAMP)'}, CAST({r} AS DOUBLE))" for m, a, b, r in SUPPLEMENTS)
       + ") p(model, f, u, rate) ON p.model = s.model AND f <= started_at AND (u IS NULL OR ended_at <= u)", fx.USAGE, SPANS)
def manual_prices(spark, sf):
    s = fx.usage(spark, sf).groupBy("session_id", "model").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    p = spark.createDataFrame(SUPPLEMENTS, "model long, `from` string, until string, rate double").withColumn("from", F.col("from").cast("timestamp")).withColumn("until", F.col("until").cast("timestamp"))
    return accounting.apply_supplement(s, p, ["model"]).select("session_id", "model", "rate")


@query("SELECT DISTINCT session_id, session_id % 4 AS usage_digest, model, total_tokens FROM usage", fx.USAGE)
def price_requests(spark, sf):
    u = fx.usage(spark, sf)
    index = u.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).withColumn("usage_digest", F.col("session_id") % 4)
    return accounting.usage_to_price_requests(index, u).select("session_id", "usage_digest", "model", "total_tokens")


LISTED = """routes AS (SELECT p_partkey, p_brand AS host, p_type AS model_id, CASE WHEN p_size % 2 = 0 THEN 'eu' END AS region, 'l' || CAST(p_size % 5 AS VARCHAR) AS listing, DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) AS day FROM part),
 aliases AS (SELECT host, model_id, region, min(listing) AS lo, max(listing) AS hi FROM routes WHERE p_partkey % 3 <> 0 GROUP BY 1, 2, 3),
 listings(listing_id, status, promo, promo_until) AS (VALUES ('l0', 'active', false, NULL), ('l1', 'inactive', false, NULL), ('l2', 'active', true, DATE '2024-01-10'), ('l3', 'active', true, DATE '2024-12-31'))"""


@query("""SELECT p_partkey, CASE WHEN lo IS NULL THEN 'unlisted' WHEN lo <> hi THEN 'ambiguous' WHEN listing_id IS NULL THEN 'unlisted' WHEN status <> 'active' THEN 'inactive' WHEN promo AND day > promo_until THEN 'expired_promotion' ELSE 'matched' END AS match_status
FROM routes r LEFT JOIN aliases a ON a.host = r.host AND a.model_id = r.model_id AND a.region IS NOT DISTINCT FROM r.region LEFT JOIN listings l ON l.listing_id = a.lo""", LISTED)
def listing_matches(spark, sf):
    p = fx.table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("host"), F.col("p_type").alias("model_id"), F.lit(None).cast("string").alias("mode"), F.when(F.col("p_size") % 2 == 0, "eu").alias("region"),
        F.concat(F.lit("l"), (F.col("p_size") % 5).cast("string")).alias("listing_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 30).cast("int")).alias("at"))
    listed = spark.createDataFrame([("l0", "active", False, None), ("l1", "inactive", False, None), ("l2", "active", True, "2024-01-10"), ("l3", "active", True, "2024-12-31")], "listing_id string, status string, promo boolean, promo_until string")
    aliases = p.where("p_partkey % 3 <> 0").select("host", "model_id", "mode", "region", "listing_id")
    return accounting.match_listing(p.drop("listing_id"), aliases, listed.withColumn("promo_until", F.col("promo_until").cast("date"))).select("p_partkey", "match_status")


@query("""SELECT b.key, CASE WHEN l.key IS NULL THEN 'orphan' WHEN l.nation IS NOT DISTINCT FROM b.nation THEN 'active' ELSE 'underlay_changed' END AS status FROM base b LEFT JOIN lft l ON l.key = b.key WHERE b.nation % 2 = 0""", fx.VERSIONS)
def patches_rebased(spark, sf):
    base, left, _ = fx.versions(spark, sf)
    shape = lambda d, h: d.select(F.col("key").alias("entity_id"), F.lit("nation").alias("field"), F.col("nation").cast("string").alias(h))
    return lineage.rebase_patches(shape(base.where("nation % 2 = 0"), "base_hash"), shape(left, "hash")).select(F.col("entity_id").alias("key"), "status")


@query("""SELECT key, action FROM (SELECT l.key, CASE WHEN v IS NOT DISTINCT FROM b.nation AND b.key IS NOT NULL THEN CASE WHEN p.key IS NOT NULL THEN 'restore_default' END WHEN v IS NULL AND b.key IS NOT NULL THEN 'suppress' WHEN v IS NOT NULL THEN 'set' END AS action
 FROM (SELECT key, CASE WHEN key % 9 <> 0 THEN nation END AS v FROM lft) l LEFT JOIN base b ON b.key = l.key LEFT JOIN (SELECT key FROM rgt WHERE nation > 100) p ON p.key = l.key) a WHERE action IS NOT NULL""", fx.VERSIONS)
def patches_captured(spark, sf):
    base, left, right = fx.versions(spark, sf)
    shape = lambda d, v: d.select(F.col("key").alias("entity_id"), F.lit("nation").alias("field"), v.cast("string").alias("value"))
    seen = shape(left, F.when(F.col("key") % 9 != 0, F.col("nation")))
    return lineage.capture_patches(seen, shape(base, F.col("nation")), shape(right.where("nation > 100"), F.col("nation"))).select(F.col("entity_id").alias("key"), "action")


@query("""SELECT b.key, CASE WHEN l.key IS NULL OR b.key % 4 >= 2 THEN CAST(b.nation AS VARCHAR) WHEN b.key % 4 = 0 THEN CAST(l.nation AS VARCHAR) END AS value, l.key IS NOT NULL AND b.key % 4 < 2 AS edited FROM base b LEFT JOIN lft l ON l.key = b.key""", fx.VERSIONS)
def patches_applied(spark, sf):
    base, left, _ = fx.versions(spark, sf)
    shape = lambda d: d.select(F.col("key").alias("entity_id"), F.lit("nation").alias("field"), F.col("nation").cast("string").alias("value"))
    action = F.when(F.col("entity_id") % 4 == 0, "set").when(F.col("entity_id") % 4 == 1, "suppress").otherwise("restore_default")
    return lineage.apply_patches(shape(left).withColumn("action", action), shape(base)).select(F.col("entity_id").alias("key"), "value", "edited")


@query("""SELECT key, CASE WHEN b.key IS NULL OR coalesce(r.nation > b.nation, false) THEN r.nation ELSE b.nation END AS boundary,
 CASE WHEN b.key IS NOT NULL AND r.key IS NOT NULL THEN CASE WHEN key % 10 = 0 THEN 'identity_changed' WHEN r.nation = b.nation AND key % 6 = 0 THEN 'boundary_disagrees' END END AS conflict,
 CASE WHEN r.key IS NULL THEN 'x' WHEN b.key IS NULL OR key % 2 = 0 THEN CASE WHEN b.key IS NULL THEN 'y' ELSE 'x,y' END ELSE 'x' END AS projects FROM base b FULL JOIN (SELECT * FROM rgt) r USING (key)""", fx.VERSIONS)
def sources_merged(spark, sf):
    base, _, right = fx.versions(spark, sf)
    k = F.col("key")
    shape = lambda d, who, digest, projects: d.select(F.lit("a").alias("provider"), k.alias("session_id"), who.alias("source_identity"), F.col("nation").alias("boundary"), digest.alias("digest"), projects.alias("project_ids"))
    old = shape(base, F.lit("s"), F.lit("d"), F.array(F.lit("x")))
    new = shape(right, F.when(k % 10 == 0, "t").otherwise("s"), F.when(k % 6 == 0, "e").otherwise("d"), F.array(F.when(k % 2 == 0, "y").otherwise("x")))
    return lineage.merge_sources(old, new).select(F.col("session_id").alias("key"), "boundary", "conflict", F.array_join("project_ids", ",").alias("projects"))


@query("""SELECT key, CASE WHEN p.key IS NULL THEN 'initial' WHEN l.nation < p.nation OR key % 9 = 0 THEN 'replacement' WHEN l.nation > p.nation THEN 'append' WHEN key % 4 <> 0 THEN 'unchanged' ELSE 'usage_refresh' END AS relation
FROM lft l LEFT JOIN (SELECT * FROM rgt) p USING (key)""", fx.VERSIONS)
def source_relations(spark, sf):
    _, left, right = fx.versions(spark, sf)
    k = F.col("key")
    shape = lambda d, h, u: d.select(F.lit("a").alias("provider"), k.alias("session_id"), F.col("nation").alias("lines"), F.lit("h").alias("prefix_hash"), h.alias("hash_at_previous"), u.alias("usage_digest"))
    new = shape(left, F.when(k % 9 == 0, "other").otherwise("h"), F.when(k % 4 == 0, "v").otherwise("u"))
    return lineage.boundary_relation(shape(right, F.lit("h"), F.lit("u")), new).select(F.col("session_id").alias("key"), "relation")


@query("""SELECT 'c' || CAST(key AS VARCHAR) AS candidate_id, CASE WHEN p IS NULL THEN 'pending' WHEN human THEN st WHEN d IS NULL AND st = 'pending' THEN 'stale' WHEN d IS NOT NULL AND st = 'stale' THEN 'pending' ELSE st END AS status,
 CAST(CASE WHEN p IS NULL THEN 1 WHEN human THEN 1 WHEN (d IS NULL AND st = 'pending') OR (d IS NOT NULL AND (st = 'stale' OR d <> p)) THEN 2 ELSE 1 END AS BIGINT) AS revision, CASE WHEN p IS NULL THEN d WHEN human OR d IS NULL THEN p ELSE d END AS turn
FROM (SELECT key, CASE WHEN key % 5 = 0 THEN 'stale' ELSE 'pending' END AS st, key % 7 = 0 AS human, CASE WHEN key % 3 <> 0 THEN nation END AS p, CASE WHEN key % 4 <> 0 THEN nation + CASE WHEN key % 6 = 1 THEN 1 ELSE 0 END END AS d FROM base) x WHERE p IS NOT NULL OR d IS NOT NULL""", fx.VERSIONS)
def candidates_carried(spark, sf):
    base, k = fx.versions(spark, sf)[0].withColumn("candidate_id", F.concat(F.lit("c"), F.col("key").cast("string"))), F.col("key")
    old = base.where(k % 3 != 0).select(
        "candidate_id", F.when(k % 5 == 0, "stale").otherwise("pending").alias("status"), F.lit(1).cast("long").alias("revision"), F.when(k % 7 == 0, "human").otherwise("rule").alias("origin"), F.array("nation").alias("turns"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    found = base.where(k % 4 != 0).select("candidate_id", F.array(F.col("nation") + F.when(k % 6 == 1, 1).otherwise(0)).alias("turns"))
    got = problems.reconcile_candidates(old, found, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return got.select("candidate_id", "status", "revision", F.col("turns")[0].alias("turn"))


@query("""SELECT project_id, tag, count(*) FILTER (WHERE n = 'd') AS decisions, count(*) FILTER (WHERE n = 'l') AS open_loops FROM (
 SELECT c_nationkey % 5 AS project_id, c_mktsegment AS tag, 'd' AS n FROM customer UNION ALL SELECT c_nationkey % 5, c_mktsegment, 'l' FROM customer WHERE c_custkey % 4 <> 0) x GROUP BY 1, 2""")
def topic_themes(spark, sf):
    c = fx.table(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("project_id"), F.col("c_custkey").cast("string").alias("id"), F.array("c_mktsegment", "c_mktsegment").alias("tags"), (F.col("c_custkey") % 4 == 0).alias("resolved"))
    return problems.themes(c, c).select("project_id", "tag", F.size("decision_ids").cast("long").alias("decisions"), F.size("open_loop_ids").cast("long").alias("open_loops"))


@query("""SELECT fate, count(*) AS objects, sum(bytes) AS bytes FROM (SELECT CAST(o_totalprice AS BIGINT) AS bytes, CASE WHEN o_custkey % 50 = 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 9 = 0) THEN 'reachable'
 WHEN epoch_us(TIMESTAMP '1998-08-02') // 1000 - epoch_us(o_orderdate) // 1000 < CAST(1000 AS BIGINT) * 86400000 THEN 'retained' ELSE 'cleanup' END AS fate FROM (SELECT o_orderkey, o_custkey, o_orderdate, floor(o_totalprice) AS o_totalprice FROM orders) o) x GROUP BY 1""")
def object_retention(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("digest"), F.floor("o_totalprice").cast("long").alias("bytes"), F.col("o_orderdate").alias("written_at"), "o_custkey")
    manifests = fx.table(spark, sf, "lineitem").where("l_suppkey % 9 = 0").select(F.array("l_orderkey").alias("refs"))
    return lineage.retention_report(o, manifests, o.where("o_custkey % 50 = 0").select("digest"), F.lit("1998-08-02 00:00:00").cast("timestamp"), 1000)


CHAIN = """chain AS (SELECT CAST(s_suppkey AS BIGINT) AS k, s_nationkey AS identity, CAST(CASE s_suppkey % 10 WHEN 0 THEN s_suppkey + 1000000 WHEN 1 THEN CASE WHEN s_suppkey > 25 THEN s_suppkey - 25 END WHEN 2 THEN s_suppkey + 1 WHEN 3 THEN s_suppkey - 1
 WHEN 4 THEN s_suppkey + 1 WHEN 6 THEN s_suppkey - 1 END AS BIGINT) AS up FROM supplier),
 linked AS (SELECT c.*, p.k AS p, p.identity AS pi, count(*) OVER (PARTITION BY c.up) AS n FROM chain c LEFT JOIN chain p ON p.k = c.up)"""


@query("""SELECT k AS snapshot_id, 'missing' AS violation FROM linked WHERE up IS NOT NULL AND p IS NULL UNION ALL SELECT k, 'fork' FROM linked WHERE up IS NOT NULL AND n > 1 UNION ALL SELECT k, 'identity_changed' FROM linked WHERE p IS NOT NULL AND pi <> identity
UNION ALL SELECT k, 'cycle' FROM linked WHERE p IS NOT NULL AND k % 10 IN (2, 3)""", CHAIN)
def price_chain_faults(spark, sf):
    k = F.col("s_suppkey").cast("long")
    up = F.when(k % 10 == 0, k + 1_000_000).when((k % 10 == 1) & (k > 25), k - 25).when((k % 10).isin(2, 4), k + 1).when((k % 10).isin(3, 6), k - 1)
    return problems.validate_price_chain(fx.table(spark, sf, "supplier").select(k.alias("snapshot_id"), F.col("s_nationkey").alias("identity"), up.alias("supersedes")))


@query("""SELECT 'c' || CAST(c_custkey AS VARCHAR) AS node, 'missing_parent' AS violation FROM customer WHERE c_custkey % 20 = 0 UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'unreachable' FROM customer WHERE c_custkey % 20 IN (0, 1)
UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'self_parent' FROM customer WHERE c_custkey % 20 = 1""")
def tree_faults(spark, sf):
    n = F.regexp_extract("node_id", r"^c(\d+)$", 1).try_cast("long") % 20
    t = _tree(spark, sf).withColumn("parent_id", F.when(n == 0, "nowhere").when(n == 1, F.col("node_id")).otherwise(F.col("parent_id"))).withColumn("sibling_order", F.xxhash64("node_id"))
    return problems.validate_tree(t)


@query("""SELECT 'decision' AS from_kind, CAST(o_orderkey AS VARCHAR) AS from_id, 'supersedes' AS relation, CAST(o_orderkey - 1 AS VARCHAR) AS to_id FROM orders
UNION ALL SELECT 'loop', CAST(s_suppkey AS VARCHAR), 'blockers', unnest([CAST(s_nationkey AS VARCHAR), 'x']) FROM supplier""")
def history_edges(spark, sf):
    before = (F.col("o_orderkey") - 1).cast("string")
    d = fx.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.array(before, before).alias("supersedes"))
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.array(F.col("s_nationkey").cast("string"), F.lit("x")).alias("blockers"))
    return problems.edges(decisions=d, loops=s)


@query("""SELECT 'event' AS from_kind, CAST(revision_id AS VARCHAR) AS from_id, 'decisions' AS relation, 'd' || CAST(component AS VARCHAR) AS to_id FROM obs
UNION ALL SELECT 'event', CAST(revision_id AS VARCHAR), 'loops', 'l' || CAST(session_id AS VARCHAR) FROM obs WHERE outcome = 'failure'
UNION ALL SELECT 'session', session_id, 'decisions', 'd' || CAST(component AS VARCHAR) FROM (SELECT DISTINCT CAST(session_id AS VARCHAR) AS session_id, component FROM obs) s
UNION ALL SELECT DISTINCT 'session', CAST(session_id AS VARCHAR), 'loops', 'l' || CAST(session_id AS VARCHAR) FROM obs WHERE outcome = 'failure'""", fx.OBS)
def history_sources(spark, sf):
    """Events without a loop have an empty array, sessions gather what their events name."""
    loop, decision = F.concat(F.lit("l"), F.col("session_id").cast("string")), F.concat(F.lit("d"), F.col("component").cast("string"))
    o = fx.obs(spark, sf).withColumn("decision", decision).withColumn("loop", F.when(F.col("outcome") == "failure", loop))
    events = o.select(F.col("revision_id").cast("string").alias("id"), F.array("decision", "decision").alias("decisions"), F.array_compact(F.array("loop")).alias("loops"))
    held = o.groupBy(F.col("session_id").cast("string").alias("id")).agg(F.collect_set("decision").alias("decisions"), F.collect_set("loop").alias("loops"))  # ten components, one loop
    return problems.edges(events=events, sessions=held)


@query("""SELECT project_id, revision_id, id AS first_record FROM (SELECT *, row_number() OVER (PARTITION BY project_id, revision_id ORDER BY id, pos) AS rn FROM (
 SELECT o_custkey % 5 AS project_id, o_orderkey AS id, unnest([o_custkey, o_custkey + 5, o_custkey]) AS revision_id, unnest([0, 1, 2]) AS pos FROM orders) d) r WHERE rn = 1""")
def record_revisions(spark, sf):
    c = F.col("o_custkey")
    o = fx.table(spark, sf, "orders").select((c % 5).alias("project_id"), F.col("o_orderkey").alias("id"), F.array(c, c + 5, c).alias("dependencies"))
    return search.selected_revisions(o)


@query("SELECT key FROM base EXCEPT SELECT key FROM lft", fx.VERSIONS)
def stale_dependencies(spark, sf):
    base, left, _ = fx.versions(spark, sf)
    return search.undrained(base, left, ["key"])


@query("SELECT session_id, revision_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, revision_id) AS rn FROM obs) o WHERE rn <= 3", fx.OBS)
def newest_entries(spark, sf):
    return search.newest(fx.obs(spark, sf), ["session_id"], "ts", "revision_id").select("session_id", "revision_id")


@query("SELECT session_id, revision_id, path, previous_value FROM (SELECT *, lag(path) OVER (PARTITION BY session_id ORDER BY ts, sequence) AS previous_value FROM obs) o WHERE previous_value <> path", fx.OBS)
def path_changes(spark, sf):
    return windows.changes(fx.obs(spark, sf), ["session_id"], [F.asc("ts"), F.asc("sequence")], "path", False).select("session_id", "revision_id", "path", "previous_value")


@query("SELECT CASE WHEN lang IN ('en', 'de') THEN 'kept' ELSE 'foreign' END AS fate, count(*) AS documents FROM documents GROUP BY 1")
def quarantined_documents(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/srv/"), F.col("lang"), F.lit("/doc")).alias("path"))
    roots = spark.createDataFrame([("p-en", "/srv/en"), ("p-de", "/srv/de/")], "project_id string, root string")
    kept, rest = facts.quarantine(facts.attribute_projects(d, roots))
    return kept.select(F.lit("kept").alias("fate")).unionByName(rest.select(F.col("reason").alias("fate"))).groupBy("fate").agg(F.count("*").alias("documents"))


@query("SELECT p_partkey, '/' || p_brand || '/' || CAST(p_size AS VARCHAR) || '/z' AS path, p_brand || '/z' AS relative FROM part")
def clean_paths(spark, sf):
    b, s = F.col("p_brand"), F.col("p_size").cast("string")
    text = F.concat(F.lit("\\x/..//"), b, F.lit("/./y\\../"), s, F.lit("//z/."))
    return fx.table(spark, sf, "part").select("p_partkey", scalars.normalize_path(text).alias("path"), scalars.normalize_path(F.concat(b, F.lit("/./a/../z/"))).alias("relative"))


@query("""SELECT session_id, CASE WHEN h > 0 THEN CAST(h AS VARCHAR) || 'h ' || lpad(CAST(m AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(r AS VARCHAR), 2, '0') || 's' WHEN m > 0 THEN CAST(m AS VARCHAR) || 'm ' || lpad(CAST(r AS VARCHAR), 2, '0') || 's' ELSE CAST(r AS VARCHAR) || 's' END AS shown,
 CASE WHEN s <> 0 THEN NULL ELSE CAST(0 AS BIGINT) END AS backwards FROM (SELECT session_id, s // 3600 AS h, (s // 60) % 60 AS m, s % 60 AS r, ms AS s_ms, ms AS s FROM (SELECT *, (epoch_us(ended_at) // 1000 - epoch_us(started_at) // 1000) AS ms, (epoch_us(ended_at) // 1000 - epoch_us(started_at) // 1000) // 1000 AS s FROM sess) a) b""", fx.OBS, SESS)
def shown_durations(spark, sf):
    s = _sessions(spark, sf)
    return s.select("session_id", scalars.format_duration_ms(scalars.duration_ms("started_at", "ended_at")).alias("shown"), scalars.duration_ms("ended_at", "started_at").alias("backwards"))


@query("""SELECT CASE WHEN age <= 86400000000 THEN 'current' WHEN age <= 604800000000 THEN 'stale' ELSE 'expired' END AS freshness, count(*) AS events FROM (SELECT 1706659200000000 - epoch_us(ts) AS age FROM events) e GROUP BY 1""")
def event_freshness(spark, sf):
    return fx.table(spark, sf, "events").groupBy(scalars.freshness("ts", F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("freshness")).agg(F.count("*").alias("events"))


@query(r"""SELECT session_id, ordinal, md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g'))) AS line_md5, CASE WHEN trim(text) <> '' THEN 'text' ELSE role END AS source FROM messages""", fx.MESSAGES)
def message_lines(spark, sf):
    m = fx.messages(spark, sf)
    source = scalars.first_non_blank(F.when(F.trim("text") != "", "text"), F.lit(" "), F.col("role"))
    return m.select("session_id", "ordinal", F.md5(scalars.single_line("text")).alias("line_md5"), source.alias("source"))
