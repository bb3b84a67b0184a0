"""Registered queries of what is read from texts: tool calls, commands, envelopes, secrets, paths, digests; and of turns, histories and reports that rest on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import commands, redaction, scalars
from tracemill.operators import accounting, problems, quality, search, tools, turns
from tracemill.plans import fixtures as fx
from tracemill.plans.reports import INTERVALS, PRICED, TURNS, _priced, query

USED = """calls AS (SELECT session_id, 'c' || CAST(component * 10 + CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) AS call_id, sequence AS ordinal, sequence % 8 AS k, path,
  '/w/' || CAST(project_id AS VARCHAR) || CASE WHEN sequence % 3 = 0 AND sequence % 8 <> 4 THEN '/sub' ELSE '' END AS dir FROM obs WHERE kind = 'command'),
 outputs AS (SELECT session_id, 'c' || CAST(component * 10 + CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) AS call_id, sequence AS heard, CASE sequence % 4 WHEN 1 THEN 1 WHEN 3 THEN NULL ELSE 0 END AS code, sequence % 3 AS b, path AS said
  FROM obs WHERE kind = 'verification'),
 met AS (SELECT c.*, o.heard, o.code, o.b, o.said FROM (SELECT *, count(*) OVER (PARTITION BY session_id, call_id) AS n FROM calls) c
  ASOF LEFT JOIN outputs o ON o.session_id = c.session_id AND o.call_id = c.call_id AND c.ordinal < o.heard WHERE n = 1)"""


def _tool_use(spark, sf):
    """Commands of the events as tool calls and verifications as outputs; their number decides what is called and how the output is written."""
    i, p = F.col("sequence"), F.col("path")
    o = fx.obs(spark, sf).withColumn("call_id", F.concat(F.lit("c"), (F.col("component") * 10 + F.floor("value").cast("long") % 10).cast("string")))
    line = (
        F.when(i % 8 == 0, F.concat(F.lit("go test -count=1 ./"), p)).when(i % 8 == 1, "npm test -- --runInBand").when(i % 8 == 2, "git rev-parse HEAD").when(i % 8 == 3, "go build | tee log")
        .when(i % 8 == 5, "git status --branch --porcelain=v1").otherwise("go test -run '^$' -bench=X .")
    )
    patch = F.concat(F.lit("*** Begin Patch\n*** Update File: "), p, F.lit(".py\n*** End Patch"))
    given = F.when(i % 8 == 4, patch).otherwise(F.to_json(F.struct(line.alias("cmd"), F.when(i % 3 == 0, "sub").alias("workdir"))))
    name = F.when(i % 8 == 4, "apply_patch").when(i % 8 == 7, "exec").otherwise("exec_command")
    body = F.when(i % 3 == 0, F.sha2(p, 256)).when(i % 3 == 1, F.concat(F.lit("## feat/"), p, F.lit("...o\n M a"))).otherwise("Done!")
    text = (
        F.when(i % 4 == 0, F.concat(F.lit("Process exited with code 0\nOutput:\n"), body)).when(i % 4 == 1, F.to_json(F.struct(F.lit(1).alias("exit_code"), body.alias("output"))))
        .when(i % 4 == 2, F.concat(F.lit("exit code: 0\n"), body)).otherwise(body)
    )
    ids = [F.col("session_id"), F.col("call_id"), i.alias("ordinal")]
    calls = o.where("kind = 'command'").select(*ids, name.alias("name"), given.alias("input"), F.concat(F.lit("/w/"), F.col("project_id").cast("string")).alias("cwd"))
    return calls, o.where("kind = 'verification'").select(*ids, text.alias("output"))


@query("""SELECT session_id, call_id, ordinal AS sequence, 'command_started' AS operation, dir AS object, NULL AS outcome, CASE WHEN k IN (0, 6) THEN 'go:test' WHEN k = 1 THEN 'npm:test' WHEN k = 2 THEN 'git:head' WHEN k = 5 THEN 'git:status' ELSE 'other' END AS detail FROM met WHERE k NOT IN (4, 7)
UNION ALL SELECT session_id, call_id, heard, 'command_finished', dir, CASE code WHEN 0 THEN 'success' ELSE 'failure' END, CAST(code AS VARCHAR) FROM met WHERE k NOT IN (4, 7) AND code IS NOT NULL
UNION ALL SELECT session_id, call_id, heard, 'verification', CASE k WHEN 0 THEN 'package' ELSE 'npm:test' END, CASE code WHEN 0 THEN 'passed' ELSE 'failed' END, 'test' FROM met WHERE k IN (0, 1) AND code IS NOT NULL
UNION ALL SELECT session_id, call_id, heard, 'git_observation', 'head', 'observed', sha256(said) FROM met WHERE k = 2 AND code = 0 AND b = 0
UNION ALL SELECT session_id, call_id, heard, 'git_observation', 'status', 'observed', 'feat/' || said || ' dirty' FROM met WHERE k = 5 AND code = 0 AND b = 1
UNION ALL SELECT session_id, call_id, heard, 'file_change', dir || '/' || path || '.py', CASE WHEN code = 1 THEN 'failure' ELSE 'success' END, NULL FROM met WHERE k = 4 AND ((b = 2 AND heard IS NOT NULL AND coalesce(code, 0) = 0) OR (b <> 2 AND code = 1))""", fx.OBS, USED)
def tool_use(spark, sf):
    found, _ = tools.tool_observations(*_tool_use(spark, sf))
    f = lambda k: F.try_element_at("fields", F.lit(k))
    detail = F.coalesce(f("git_head"), F.when(f("branch").isNotNull(), F.concat_ws(" ", f("branch"), f("status"))), f("status"), f("exit_code"), f("command_signature"))
    return found.select("session_id", "call_id", "sequence", "operation", "object", "outcome", detail.alias("detail"))


@query("""SELECT signature, component, verification, count(*) AS rows FROM (SELECT CASE WHEN k % 7 = 6 THEN 'other' WHEN k % 7 = 5 THEN 'npm:lint' ELSE 'go:test' END AS signature,
 CASE WHEN k % 7 = 6 THEN NULL WHEN k % 7 = 5 THEN CASE WHEN k % 2 = 0 THEN 'npm:lint' END WHEN n = 0 OR (k % 7 = 4 AND k % 2 = 0) THEN NULL WHEN k % 3 = 0 THEN 'other' ELSE 'package' END AS component, CASE WHEN k % 7 = 6 THEN NULL WHEN k % 7 = 5 THEN CASE WHEN k % 2 = 0 THEN 'lint' END
 WHEN n = 0 OR (k % 7 = 4 AND k % 2 = 0) THEN NULL ELSE 'test' END AS verification FROM (SELECT sequence AS k, CAST(floor(value) AS BIGINT) % 4 AS n FROM obs) o) c GROUP BY 1, 2, 3""", fx.OBS)
def command_classes(spark, sf):
    """Commands whose count of runs, place, flags and script come from each event's number and value."""
    k, n = F.col("sequence"), F.floor("value").cast("long") % 4
    place = F.when(k % 3 == 0, "./UPPER").otherwise(F.concat(F.lit("'./"), F.col("path"), F.lit("/...'")))
    test = F.concat_ws(" ", F.lit("/opt/bin/go test -v -count"), n.cast("string"), F.when(k % 7 == 4, F.when(k % 2 == 0, "-list=X").otherwise("-run X\\|Y")), place)
    line = F.when(k % 7 == 6, F.concat(test, F.lit(" && true"))).when(k % 7 == 5, F.when(k % 2 == 0, "npm run lint").otherwise("npm run lint --fix")).otherwise(test)
    return fx.obs(spark, sf).select(commands.classify_command(line).alias("c")).groupBy("c.signature", "c.component", "c.verification").agg(F.count("*").alias("rows"))


WRAPPED = r"""wrapped AS (SELECT session_id, ordinal, ordinal % 4 AS k, regexp_replace(text, '^\s+|\s+$', '', 'g') AS own FROM messages)"""
NOTE = '<subagent_notification>{"agent_path": "p", "status": "done"}</subagent_notification>'


@query(f"""SELECT session_id, ordinal, md5(own) AS own_md5, md5(CASE k WHEN 2 THEN '{NOTE}' ELSE '' END || own) AS first_rules_md5 FROM wrapped""", fx.MESSAGES, WRAPPED)
def own_words(spark, sf):
    """Messages behind envelopes that their ordinal chooses; the first rules do not know notifications of other agents."""
    k = F.col("ordinal") % 4
    own = F.regexp_replace("text", r"^\s+|\s+$", "")
    lead = F.when(k == 0, "<environment_context>a\nb</environment_context>\n").when(k == 1, "# AGENTS.md instructions\n\n<INSTRUCTIONS>x</INSTRUCTIONS>\n<recommended_plugins>y</recommended_plugins>\n").when(k == 2, NOTE).otherwise("")
    m = fx.messages(spark, sf).withColumn("text", F.concat(lead, own))
    return m.select("session_id", "ordinal", F.md5(commands.strip_ambient("text")).alias("own_md5"), F.md5(commands.strip_ambient("text", 1)).alias("first_rules_md5"))


@query("""SELECT doc_id, CAST(doc_id AS VARCHAR) || ' [REDACTED:ABSOLUTE_PATH], or [REDACTED:ABSOLUTE_PATH] and "[REDACTED:ABSOLUTE_PATH]" but a/' || coalesce(lang, '') || ' </b> // x' AS shown FROM documents""")
def masked_paths(spark, sf):
    i, s, g = F.col("doc_id").cast("string"), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    text = F.concat(i, F.lit(" /srv/"), s, F.lit("/"), i, F.lit(", or C:\\"), g, F.lit('\\x and "file:///home/'), s, F.lit(" b/"), i, F.lit('" but a/'), g, F.lit(" </b> // x"))
    return fx.table(spark, sf, "documents").select("doc_id", redaction.redact_paths(text).alias("shown"))


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 64 THEN text ELSE left(text, CAST(list_max(list_filter(range(0, 62), lambda n: strlen(left(text, n)) <= 61)) AS BIGINT)) || '…' END AS short, CASE WHEN length(text) <= 20 THEN text ELSE left(text, 19) || '…' END AS first_chars FROM documents""")
def cut_texts(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", scalars.truncate_utf8("text", 64).alias("short"), scalars.truncate_chars("text", 20).alias("first_chars"))


@query(r"""SELECT session_id, ordinal, CASE WHEN length(t) <= 40 THEN t ELSE left(t, 39) || '…' END AS title FROM (SELECT session_id, ordinal, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM messages) m""", fx.MESSAGES)
def request_titles(spark, sf):
    text = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("## My request: no\n## My request:"), "text")).otherwise(F.col("text"))
    return fx.messages(spark, sf).select("session_id", "ordinal", scalars.request_title(text, 40).alias("title"))


@query("""SELECT key, sha256('{"key":' || CAST(key AS VARCHAR) || ',"nation":' || coalesce(CAST(CASE WHEN key % 3 <> 0 THEN nation END AS VARCHAR), 'null') || ',"segment":"' || segment || '"}') AS content,
 'rev-' || sha256('1' || CAST(key AS VARCHAR) || chr(0) || CASE WHEN key % 3 <> 0 THEN '1' || CAST(nation AS VARCHAR) ELSE '0' END) AS identity FROM base""", fx.VERSIONS)
def row_digests(spark, sf):
    b = fx.versions(spark, sf)[0].withColumn("nation", F.when(F.col("key") % 3 != 0, F.col("nation")))
    return b.select("key", scalars.digest(F.col("segment"), F.col("key"), F.col("nation")).alias("content"), scalars.revision_id(F.col("key"), F.col("nation")).alias("identity"))


@query("SELECT revision_id, concat_ws(' · ', kind, outcome, CASE WHEN version <> 1 THEN 'exit code ' || CAST(version AS VARCHAR) END, path) AS line FROM obs", fx.OBS)
def fact_lines(spark, sf):
    return fx.obs(spark, sf).select("revision_id", scalars.fact_text(F.col("kind"), F.coalesce("outcome", F.lit(" ")), F.when(F.col("version") != 1, F.col("version")), F.col("path")).alias("line"))


SECRETS = """planted AS (SELECT doc_id, doc_id % 6 AS k, 'n' || CAST(doc_id AS VARCHAR) AS n FROM documents)"""


@query("""SELECT doc_id, 'see ' || CASE k WHEN 0 THEN '[REDACTED:BEARER_CREDENTIAL]' WHEN 1 THEN '[REDACTED:OPENAI_KEY]' WHEN 2 THEN '[REDACTED:CONNECTION_URL]' WHEN 3 THEN '[REDACTED:NAMED_SECRET]' WHEN 4 THEN '[REDACTED:PRIVATE_KEY]' ELSE n END || CASE k WHEN 3 THEN chr(10) ELSE ' ' END || n AS shown FROM planted""", SECRETS)
def planted_secrets(spark, sf):
    """A secret of the kind that each document's number chooses, or none."""
    d = F.col("doc_id")
    n = F.concat(F.lit("n"), d.cast("string"))
    return fx.table(spark, sf, "documents").select("doc_id", redaction.redact_secrets(F.concat(F.lit("see "), _secret(d, n), F.when(d % 6 == 3, "\n").otherwise(" "), n)).alias("shown"))


def _secret(d, n):
    return (
        F.when(d % 6 == 0, F.concat(F.lit("Bearer abcdefghijkl"), n)).when(d % 6 == 1, F.concat(F.lit("sk-abcdefghijklmnopqrst"), n)).when(d % 6 == 2, F.concat(F.lit("pg://u:"), n, F.lit("@h/x")))
        .when(d % 6 == 3, F.concat(F.lit("password = "), n)).when(d % 6 == 4, F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), n, F.lit("\n-----END PRIVATE KEY-----"))).otherwise(n)
    )


@query("""SELECT lang, rule, count(*) FILTER (WHERE k = r) AS findings FROM (SELECT coalesce(lang, '') AS lang, doc_id % 6 AS k FROM documents) d
CROSS JOIN (VALUES (0, 'bearer_credential'), (1, 'openai_key'), (2, 'connection_url'), (3, 'named_secret'), (4, 'private_key'), (9, 'high_entropy_token')) v(r, rule) GROUP BY 1, 2""")
def secret_findings(spark, sf):
    d = F.col("doc_id")
    n = F.concat(F.lit("n"), d.cast("string"))
    rows = fx.table(spark, sf, "documents").select(F.coalesce("lang", F.lit("")).alias("lang"), F.concat(F.lit("see "), _secret(d, n)).alias("text"))
    return redaction.redaction_findings(rows, keys=("lang",))


KEPT = """kept AS (SELECT revision_id, kind, sequence % 3 AS k, path, version, component FROM obs)"""


@query("""SELECT revision_id, CASE kind WHEN 'file' THEN 'file_change' WHEN 'command' THEN 'command_finished' ELSE kind END AS public_kind, kind = 'file' AND k = 0 AS action, CASE WHEN kind = 'file' THEN CASE WHEN k = 1 THEN 'failed' END WHEN kind = 'version' THEN 'unknown'
 WHEN k = 0 THEN 'passed' WHEN k = 1 THEN 'failed' ELSE 'unknown' END AS state, CASE kind WHEN 'file' THEN 'path=' || path WHEN 'version' THEN 'version=' || CAST(version AS VARCHAR) || '; component=' || CAST(component AS VARCHAR) WHEN 'verification' THEN 'component=' || CAST(component AS VARCHAR) ELSE '' END AS excerpt
FROM kept WHERE NOT (kind = 'file' AND k = 2)""", fx.OBS, KEPT)
def retained_rows(spark, sf):
    k, kind = F.col("sequence") % 3, F.col("kind")
    o = fx.obs(spark, sf).withColumn("operation", F.when(kind == "file", "file_change").when(kind == "command", "command_finished").otherwise(kind)).withColumn("outcome", F.when(k == 0, "success").when(k == 1, "failure"))
    return turns.retained_facts(o).select("revision_id", "public_kind", "action", "state", "excerpt")


@query("""SELECT session_id, ordinal, md5(CASE WHEN ordinal % 3 = 0 THEN text ELSE text || chr(10) || role END) AS text_md5, CASE WHEN role = 'assistant' THEN CASE WHEN session_id % 2 = 0 THEN 'final_answer' WHEN ordinal % 3 = 1 THEN 'commentary' WHEN ordinal % 3 = 2 THEN 'final_answer' END END AS phase, NULL AS reason
 FROM messages WHERE role IN ('user', 'assistant') AND ordinal % 7 <> 0 AND ordinal % 5 <> 0 AND NOT (ordinal % 3 = 0 AND text = '')
UNION ALL SELECT session_id, ordinal, NULL, NULL, CASE WHEN ordinal % 7 = 0 THEN 'bad_timestamp' ELSE 'invalid_part' END FROM messages WHERE role IN ('user', 'assistant') AND (ordinal % 7 = 0 OR ordinal % 5 = 0)""", fx.MESSAGES)
def shown_messages(spark, sf):
    """Messages as parts of which some are no text, some without text, with either kind of phase, and some without a time."""
    i, part = F.col("ordinal"), lambda t, x: F.struct(F.lit(t).alias("type"), x.cast("string").alias("text"))
    parts = F.filter(F.array(part("text", F.col("text")), part("image", F.lit("x")), F.when(i % 3 != 0, part("output_text", F.col("role"))), F.when(i % 5 == 0, part("input_text", F.lit(None)))), lambda x: x.isNotNull())
    raw = fx.messages(spark, sf).select(
        "session_id", "ordinal", F.when(F.col("session_id") % 2 == 0, "b").otherwise("a").alias("provider"), "role", F.when(i % 7 != 0, F.timestamp_seconds(i)).alias("ts"), F.lit(None).cast("string").alias("phase"),
        F.when(i % 3 == 1, "commentary").when(i % 3 == 2, "final").alias("channel"), parts.alias("content"))
    good, bad = turns.visible_messages(raw)
    none = F.lit(None).cast("string")
    return good.select("session_id", "ordinal", F.md5("text").alias("text_md5"), "phase", none.alias("reason")).unionByName(bad.select("session_id", "ordinal", none.alias("text_md5"), none.alias("phase"), "reason"))


CHAINS = """reports AS (SELECT project_id, key AS session_id, CASE WHEN project_id = 3 AND p IS NULL THEN -1 ELSE p END AS previous_id, CASE WHEN project_id = 2 AND key % 7 = 0 THEN NULL ELSE n END AS next_id
 FROM (SELECT key, nation % 5 AS project_id, lag(key) OVER w AS p, lead(key) OVER w AS n FROM base WINDOW w AS (PARTITION BY nation % 5 ORDER BY key)) b)"""


@query("""SELECT *, heads = 1 AND tails = 1 AND one_sided = 0 AND reached = sessions AS valid FROM (SELECT r.project_id, count(*) AS sessions, count(*) FILTER (WHERE previous_id IS NULL) AS heads, count(*) FILTER (WHERE next_id IS NULL) AS tails, count(*) FILTER (WHERE one_sided) AS one_sided, count(*) FILTER (WHERE reached) AS reached
 FROM (SELECT a.*, (a.previous_id IS NOT NULL AND b.next_id IS DISTINCT FROM a.session_id) OR (a.next_id IS NOT NULL AND c.previous_id IS DISTINCT FROM a.session_id) AS one_sided, a.project_id <> 3 AS reached
 FROM reports a LEFT JOIN reports b ON b.project_id = a.project_id AND b.session_id = a.previous_id LEFT JOIN reports c ON c.project_id = a.project_id AND c.session_id = a.next_id) r GROUP BY 1) g""", fx.VERSIONS, CHAINS)
def session_chains(spark, sf):
    """Customers of a project as its chain of sessions; one project forgets some links, one starts behind a session that is missing."""
    return problems.validate_session_chain(_chains(spark, sf))


def _chains(spark, sf):
    from pyspark.sql import Window

    b = fx.versions(spark, sf)[0].select((F.col("nation") % 5).alias("project_id"), F.col("key").alias("session_id"))
    w = Window.partitionBy("project_id").orderBy("session_id")
    before, after = F.lag("session_id").over(w), F.lead("session_id").over(w)
    b = b.withColumn("previous_id", before).withColumn("next_id", after)
    b = b.withColumn("previous_id", F.when((F.col("project_id") == 3) & F.col("previous_id").isNull(), -1).otherwise(F.col("previous_id")))
    return b.withColumn("next_id", F.when(~((F.col("project_id") == 2) & (F.col("session_id") % 7 == 0)), F.col("next_id")))


ACTUAL = """was AS (SELECT l.key AS id, CASE WHEN b.key IS NULL THEN 'added' WHEN l.nation > 100 AND NOT b.nation > 100 THEN 'closed' WHEN l.nation <> b.nation THEN 'revised' END AS effect FROM lft l LEFT JOIN base b USING (key)),
 said AS (SELECT key AS id, CASE WHEN key > 1000000 THEN 'added' ELSE 'closed' END AS effect FROM lft WHERE key % 4 <> 0 AND (key > 1000000 OR key % 5 = 0))"""


@query("""SELECT effect, id, 'declared' AS side FROM said WHERE (id, effect) NOT IN (SELECT (id, effect) FROM was WHERE effect IS NOT NULL)
UNION ALL SELECT effect, id, 'actual' FROM was WHERE effect IS NOT NULL AND (id, effect) NOT IN (SELECT (id, effect) FROM said)""", fx.VERSIONS, ACTUAL)
def report_effects(spark, sf):
    base, left, _ = fx.versions(spark, sf)
    k = F.col("key")
    report = left.where((k % 4 != 0) & ((k > 1_000_000) | (k % 5 == 0))).select(F.when(k > 1_000_000, "added").otherwise("closed").alias("effect"), k.alias("id"))
    return quality.check_report_effects(report, base, left, "key", "nation", F.col("nation") > 100)


@query("SELECT session_id, ordinal, row_number() OVER (ORDER BY ordinal) AS position, count(*) OVER () AS total, CASE WHEN count(*) OVER () > 4 THEN 4 END AS next_start, md5(text) AS text_md5 FROM messages WHERE session_id = 1 QUALIFY position > 1 AND position <= 4", fx.MESSAGES)
def one_page(spark, sf):
    """The second to fourth message of a conversation."""
    return search.conversation_page(fx.messages(spark, sf), 1, 3, 1).select("session_id", "ordinal", "position", "total", "next_start", F.md5("text").alias("text_md5"))


STEPS = """placed AS (SELECT o.*, t.start_ordinal, t.turn_no FROM (SELECT *, sequence % 12 AS ordinal FROM obs WHERE kind IN ('verification', 'version')) o ASOF JOIN turns t ON t.session_id = o.session_id AND t.start_ordinal <= o.ordinal),
 best AS (SELECT * FROM placed WHERE kind = 'version' OR outcome = 'success' QUALIFY row_number() OVER (PARTITION BY session_id, turn_no ORDER BY kind = 'version' DESC, ts DESC, sequence DESC) = 1),
 checks AS (SELECT session_id, turn_no, arg_max(CASE outcome WHEN 'success' THEN 'passed' WHEN 'failure' THEN 'failed' ELSE 'unknown' END, sequence) AS verification FROM placed WHERE kind = 'verification' GROUP BY 1, 2)"""


@query("""SELECT b.session_id, b.kind AS category, CASE b.kind WHEN 'version' THEN 30 ELSE 10 END AS priority, b.revision_id, md5(t.question) AS question_md5, CASE WHEN t.answer_state = 'answered' THEN md5(t.answer) END AS conclusion_md5, coalesce(c.verification, 'none') AS verification
FROM best b JOIN turns t USING (session_id, turn_no) LEFT JOIN checks c USING (session_id, turn_no)""", fx.OBS, fx.MESSAGES, TURNS, STEPS)
def turn_milestones(spark, sf):
    """Events as facts of the conversation that has their session's number, at the ordinal that their own number gives."""
    o = fx.obs(spark, sf).withColumn("operation", F.col("kind")).withColumn("ordinal", F.col("sequence") % 12)
    m = search.milestones(o, turns.turn_units(fx.messages(spark, sf)))
    return m.select("session_id", "category", "priority", "revision_id", F.md5("question").alias("question_md5"), F.md5("conclusion").alias("conclusion_md5"), "verification")


@query("SELECT row_number() OVER (ORDER BY CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END NULLS FIRST, CAST(o_orderkey AS VARCHAR)) AS place, CAST(o_orderkey AS VARCHAR) AS milestone_id FROM orders QUALIFY place <= 400")
def earliest_milestones(spark, sf):
    """The first 400 orders by date, those whose date cannot be read before the others."""
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("milestone_id"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("string")).otherwise("some day").alias("occurred_at"))
    top = search.milestone_order(o).limit(400).agg(F.collect_list("milestone_id").alias("ids"))
    return top.select(F.posexplode("ids").alias("at", "milestone_id")).select((F.col("at") + 1).cast("long").alias("place"), "milestone_id")


@query("""SELECT * FROM (SELECT session_id % 50 AS run_id, round(coalesce(sum(cost), 0), 8) AS known_subtotal, bool_and(cost IS NOT NULL) AS complete, count(*) AS rows, CASE WHEN bool_and(cost IS NOT NULL) THEN round(sum(cost), 8) END AS total FROM priced GROUP BY 1) p
JOIN (SELECT session_id % 50 AS run_id, sum(total_tokens) AS total_tokens, sum(output_tokens) AS output_tokens FROM usage GROUP BY 1) u USING (run_id)""", fx.USAGE, fx.PRICES_SQL, INTERVALS, PRICED)
def run_costs(spark, sf):
    """Costs of runs; they are multiples of 5e-7, so rounding to 8 places meets no ties."""
    r = accounting.review_run_usage(_priced(spark, sf).withColumn("run_id", F.col("session_id") % 50))
    return r.select("run_id", F.round("known_subtotal", 8).alias("known_subtotal"), "complete", "rows", F.round("total", 8).alias("total"), "total_tokens", "output_tokens")


ASKS = r"""asks AS (SELECT session_id % 3 AS project_id, session_id * 1000 + turn_no AS turn, session_id % 2 = 0 AS early, turn_no % 3 = 0 AS placed, lower(trim(regexp_replace(question, '\s+', ' ', 'g'))) AS q FROM turns),
 olds AS (SELECT project_id, q, list_sort(list(DISTINCT turn)) AS t FROM asks WHERE early AND q <> '' GROUP BY 1, 2), news AS (SELECT project_id, q, list_sort(list(DISTINCT turn)) AS t FROM asks WHERE NOT placed AND q <> '' GROUP BY 1, 2)"""


@query("""SELECT project_id, md5(q) AS question_md5, CASE WHEN n.t IS NULL THEN 'stale' ELSE 'pending' END AS status, CASE WHEN o.t IS NULL OR o.t IS NOT DISTINCT FROM n.t THEN 1 ELSE 2 END AS revision, len(coalesce(n.t, o.t)) AS turns, coalesce(n.t, o.t)[1] AS first_turn
FROM olds o FULL JOIN news n USING (project_id, q)""", fx.MESSAGES, TURNS, ASKS)
def open_problems(spark, sf):
    """Questions of even conversations as earlier candidates; nodes hold every third turn, so that some of them go and others come."""
    t = turns.turn_units(fx.messages(spark, sf)).withColumn("project_id", F.col("session_id") % 3).withColumn("turn_unit_id", F.col("session_id") * 1000 + F.col("turn_no"))
    nodes = t.where("turn_no % 3 = 0").groupBy("session_id").agg(F.collect_list(F.struct("session_id", "turn_unit_id")).alias("source_turns"))
    names = problems.discover_candidates(t).select("candidate_id", "project_id", "normalized")
    first = problems.discover_candidates(t.where("session_id % 2 = 0")).select(
        "candidate_id", F.lit("pending").alias("status"), F.lit(1).cast("long").alias("revision"), F.lit("rule").alias("origin"), "turns", F.timestamp_seconds(F.lit(0)).alias("updated_at"))
    got = search.problem_candidates(t, nodes, first, F.timestamp_seconds(F.lit(1)))
    return got.join(names, "candidate_id").select("project_id", F.md5("normalized").alias("question_md5"), "status", "revision", F.size("turns").alias("turns"), F.col("turns")[0].alias("first_turn"))


CARDS = """cards AS (SELECT project_id, max(session_id) FILTER (WHERE next_id IS NULL) AS last_session, count(*) FILTER (WHERE next_id IS NULL) AS tails FROM reports GROUP BY 1),
 force AS (SELECT o_custkey % 5 AS project_id, count(*) AS n FROM orders WHERE NOT (o_orderkey + 32 IN (SELECT o_orderkey FROM orders x WHERE x.o_custkey % 5 = orders.o_custkey % 5)) GROUP BY 1)"""


@query("""SELECT c.project_id, c.last_session, c.tails, coalesce(f.n, 0) AS decisions_in_force, coalesce(l.n, 0) AS open_loops, coalesce(u.n, 0) AS total_tokens FROM cards c LEFT JOIN force f USING (project_id)
LEFT JOIN (SELECT s_nationkey % 5 AS project_id, count(*) AS n FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1) l USING (project_id) LEFT JOIN (SELECT project_id, sum(total_tokens) AS n FROM usage GROUP BY 1) u USING (project_id)""", fx.VERSIONS, CHAINS, CARDS, fx.USAGE)
def resume_cards(spark, sf):
    """Cards of the customers' projects: orders are decisions that replace the order 32 before them, suppliers are loops."""
    k = F.col("o_orderkey")
    decisions = fx.table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("project_id"), k.alias("decision_id"), F.array(k - 32).alias("supersedes"))
    loops = fx.table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("project_id"), (F.col("s_suppkey") % 3 == 0).alias("resolved"))
    return search.resume_card(_chains(spark, sf), fx.usage(spark, sf), decisions, loops)
