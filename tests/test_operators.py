import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracemill.operators import accounting, facts, lineage, problems, projects, quality, scans, search, sessions, turns, windows

T = lambda s: dt.datetime.fromisoformat(s)
OBS = "session_id string, provider string, project_id string, sequence long, revision_id string, ts timestamp, kind string, operation string, outcome string, component string, path string, fields map<string,string>, excerpt string"


def obs(spark, rows):
    full = [{"session_id": "s", "provider": "a", "project_id": "p", "ts": T("2024-01-01") + dt.timedelta(hours=i), "sequence": i, "revision_id": f"r{i}", "operation": "verification", "component": "c", "fields": {}} | r for i, r in enumerate(rows)]
    names = [c.split()[0] for c in OBS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], OBS)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_recovery_ties_and_consumption(spark):
    rows = obs(spark, [
        {"kind": "verification", "outcome": "failed"}, {"kind": "verification", "outcome": "passed", "session_id": "s"}, {"kind": "verification", "outcome": "error", "session_id": "t"},
        {"kind": "verification", "outcome": "success", "session_id": "u"}, {"kind": "verification", "outcome": "failure", "session_id": "v", "sequence": 9}, {"kind": "verification", "outcome": "success", "session_id": "v", "sequence": 9},
    ])
    got = {r.revision_id: r.recovered_by for r in facts.session_recovery_links(rows).collect()}
    assert got == {"r0": "r1", "r2": None, "r4": None}
    assert {(r.revision_id, r.recovered_by) for r in facts.cross_session_recovery_links(rows).collect()} == {("r2", "r3")}


def test_tool_calls(spark):
    calls = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "b", 3), ("s", "c", 9), ("s", "d", 4)], "session_id string, call_id string, ordinal long")
    outs = spark.createDataFrame([("s", "a", 5, "x"), ("s", "a", 6, "y"), ("s", "b", 7, "z"), ("s", "c", 8, "early"), ("s", "q", 8, "lost")], "session_id string, call_id string, ordinal long, body string")
    rows, diag = facts.join_tool_calls(calls, outs)
    assert {(r.call_id, r.ordinal, r.output_body, r.call_state) for r in rows.collect()} == {("a", 1, "x", "finished"), ("b", 2, None, "duplicate_call"), ("b", 3, None, "duplicate_call"), ("c", 9, None, "started"), ("d", 4, None, "started")}
    assert {(r.call_id, r.diagnostic) for r in diag.collect()} == {("b", "duplicate_call"), ("q", "output_without_call")}


def test_projects_and_quarantine(spark):
    rows = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/a",), ("x",), (None,)], "path string")
    roots = spark.createDataFrame([("p", "/a/b"), ("q", "/a/b/c"), ("r", "/a/bc")], "project_id string, root string")
    got = {r.path: (r.project_id, r.owner) for r in facts.attribute_projects(rows, roots).collect()}
    assert got == {"/a/b/c": (None, "ambiguous"), "/a/bc": ("r", "owner"), "/a": (None, "foreign"), "x": (None, "foreign"), None: (None, "foreign")}
    good, bad = facts.quarantine(facts.attribute_projects(rows, roots))
    assert good.count() == 1 and bad.count() == 4


def test_outcomes_and_milestones(spark):
    rows = obs(spark, [
        {"kind": "verification", "outcome": "passed", "fields": {"exit_code": "0"}}, {"kind": "verification", "outcome": "passed", "fields": {"exit_code": "1"}}, {"kind": "verification", "outcome": "failed", "fields": {"exit_code": "0"}},
        {"kind": "command", "operation": "command_started"}, {"kind": "release", "operation": "release", "outcome": "error"}, {"kind": "commit", "operation": "commit", "outcome": None}, {"kind": "verification", "outcome": "passed", "fields": {"passed": "0"}},
    ])
    got = rows.select(facts.typed_outcome(), facts.verification_state()).collect()
    assert [tuple(r) for r in got[:4]] == [("success", "passed"), ("conflict", "conflict"), ("conflict", "conflict"), ("unrecorded", "unknown")]
    assert {(r.revision_id, r.priority) for r in facts.qualify_milestones(rows).collect()} == {("r0", 10), ("r5", 20)}
    assert {r.revision_id for r in facts.filter_direct(rows.withColumn("fields", F.when(F.col("revision_id") == "r0", F.create_map(F.lit("prompt"), F.lit("x"))).otherwise(F.col("fields")))).collect()} == {"r1", "r2", "r3", "r4", "r5", "r6"}


def test_turns(spark):
    m = spark.createDataFrame([("s", 0, "assistant", "hi"), ("s", 1, "user", "q1"), ("s", 2, "assistant", "part"), ("s", 3, "assistant", " "), ("s", 4, "user", "<environment_context>x</environment_context>"), ("s", 5, "user", "q2"), ("s", 6, "assistant", "a2"), ("s", 7, "user", "q3")], "session_id string, ordinal long, role string, text string")
    got = [(r.question, r.answers, r.answer_state, r.next_ordinal) for r in turns.turn_units(m, strip=True).orderBy("turn_no").collect()]
    assert got == [("q1", 2, "unanswered", 5), ("q2", 1, "answered", 7), ("q3", 0, "none", None)]
    cov = turns.chain_coverage(m, max_chars=3).first()
    assert (cov.orphans, cov.turns, cov.truncated) == (1, 4, 2)
    raw = spark.createDataFrame([("s", 1, "a", "assistant", T("2024-01-01"), None, "final", [("output_text", "x"), ("image", None), ("text", "y")]), ("s", 2, "a", "user", None, None, None, [("text", "z")])], "session_id string, ordinal long, provider string, role string, ts timestamp, phase string, channel string, content array<struct<type:string,text:string>>")
    good, bad = turns.visible_messages(raw)
    assert [(r.text, r.phase) for r in good.collect()] == [("x\ny", "final_answer")] and [r.reason for r in bad.collect()] == ["bad_timestamp"]


def test_retained(spark):
    rows = obs(spark, [{"kind": "command", "operation": "command_finished", "outcome": "failed", "fields": {"exit_code": "1", "command_signature": "go:test", "path": "x"}}, {"kind": "tool", "operation": "tool_call", "fields": {"tool_id": "t"}}, {"kind": "file", "operation": "file_change", "outcome": "success", "fields": {"path": "a"}}])
    assert {(r.public_kind, r.action, r.state, r.excerpt) for r in turns.retained_facts(rows).collect()} == {("command_finished", False, "failed", "command_signature=go:test; exit_code=1"), ("file_change", True, None, "path=a")}


def test_heartbeats(spark):
    u = lambda i, o, t: (i, 0, 0, o, 0, t)
    kind = "struct<input_tokens:long,cached_input_tokens:long,cache_write_input_tokens:long,output_tokens:long,reasoning_output_tokens:long,total_tokens:long>"
    rows = [("s", 1, "m1", None, None), ("s", 2, " ", u(10, 5, 15), u(10, 5, 15)), ("s", 3, None, u(0, 0, 7), u(10, 5, 15)), ("s", 4, "m2", u(1, 1, 2), None), ("s", 5, None, u(0, 0, 7), u(10, 5, 15)), ("s", 6, None, u(1, 1, 9), None)]
    frame = spark.createDataFrame([(*r, T("2024-01-01")) for r in rows], f"session_id string, ordinal long, model string, last {kind}, cumulative {kind}, ts timestamp")
    got = {r.model: (r.total_tokens, r.heartbeats, r.invalid_rows) for r in accounting.session_usage(frame).collect()}
    # a counted row without a cumulative does not reset the comparison
    assert got == {"m1": (15, 1, 0), "m2": (2, 1, 1)}


@pytest.mark.parametrize("most", [0, 200_000])
def test_usage_of_a_listing_is_not_dealt_to_one_task(spark, most, monkeypatch):
    monkeypatch.setattr(scans, "FEW", most)
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=10 * i) for i in range(6)]
    h = spark.createDataFrame([(k, d, float(i), "initial") for k in ("l", "m") for i, d in enumerate(dates)], "listing_id string, date date, rate double, event string")
    use = spark.createDataFrame([(i, k, T("2023-12-28") + dt.timedelta(hours=13 * i)) for i in range(150) for k in ("l", "l", "m", "x", None)], "i int, listing_id string, priced_at timestamp")
    got = accounting.price_asof(use, h)
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "hashpartitioning(listing_id" in x]  # one is the window over prices
    assert len([x for x in dealt if "__day" not in x]) == 1
    want = lambda k, at: max((d for d in dates if d <= at.date()), default=None) if k in ("l", "m") else None
    rows = got.collect()
    assert len(rows) == 750 and {(r.i, r.listing_id, r.date) for r in rows} == {(r.i, r.listing_id, want(r.listing_id, r.priced_at)) for r in rows}


def test_prices(spark):
    h = spark.createDataFrame([("l", dt.date(2024, 1, 1), 1.0, "initial"), ("l", dt.date(2024, 2, 1), 1.0, "refresh"), ("l", dt.date(2024, 3, 1), None, "correction")], "listing_id string, date date, rate double, event string")
    use = spark.createDataFrame([("l", T("2023-12-31T23:59:59")), ("l", T("2024-03-01")), ("l", T("2024-02-10")), ("x", T("2024-02-10"))], "listing_id string, priced_at timestamp")
    assert {(r.listing_id, str(r.priced_at)[:10], r.date and str(r.date), r.review) for r in accounting.price_asof(use, h).collect()} == {("l", "2023-12-31", None, False), ("l", "2024-03-01", "2024-03-01", True), ("l", "2024-02-10", "2024-02-01", False), ("x", "2024-02-10", None, False)}
    s = spark.createDataFrame([("l", T("2024-01-15"), T("2024-02-15")), ("l", T("2024-02-15"), T("2024-03-01")), ("l", T("2024-03-01"), T("2024-03-05"))], "listing_id string, started_at timestamp, ended_at timestamp")
    assert [r.ambiguous for r in accounting.price_period_check(s, h, ["rate"]).orderBy("started_at").collect()] == [False, True, False]
    routes = spark.createDataFrame([("h", "m", None, None, T("2024-01-01")), ("h", "n", "x", None, T("2024-01-02")), ("h", "o", None, None, T("2024-01-01"))], "host string, model_id string, mode string, region string, at timestamp")
    aliases = spark.createDataFrame([("h", "m", None, None, "l1"), ("h", "m", None, None, "l2"), ("h", "n", "x", None, "l3")], "host string, model_id string, mode string, region string, listing_id string")
    listings = spark.createDataFrame([("l1", "active", False, None), ("l3", "active", True, dt.date(2024, 1, 1))], "listing_id string, status string, promo boolean, promo_until date")
    assert {(r.model_id, r.match_status) for r in accounting.match_listing(routes, aliases, listings).collect()} == {("m", "ambiguous"), ("n", "expired_promotion"), ("o", "unlisted")}
    sup = spark.createDataFrame([("k", dt.date(2024, 1, 1), None, 9.0)], "key string, from date, until date, price double")
    req = spark.createDataFrame([("k", dt.date(2024, 1, 1), dt.date(2024, 5, 1)), ("k", dt.date(2023, 12, 31), dt.date(2024, 5, 1))], "key string, started_at date, ended_at date")
    assert [r.price for r in accounting.apply_supplement(req, sup, ["key"]).orderBy("started_at").collect()] == [None, 9.0]


def test_usage_tools(spark):
    bad = accounting.validate_summary(spark.createDataFrame([("s", 1, 1.0)], "k string, n long, usd double"), spark.createDataFrame([("s", 2, 1.0 + 1e-12)], "k string, n long, usd double"), ["k"], ["n"], ["usd"])
    assert [r.mismatches for r in bad.collect()] == [["n"]]
    m = spark.createDataFrame([("s", None, (10, 5, 2, 0, (3, 4)))], "session_id string, model string, tokens struct<input:long,output:long,reasoning:long,total:long,cache:struct<read:long,write:long>>")
    got = accounting.relational_usage(m)
    assert [(r.model, r.input_tokens, r.output_tokens, r.total_tokens) for r in got.collect()] == [("unknown", 17, 7, 24)]
    assert [r.reconciled for r in accounting.reconcile_totals(got, got.drop("model")).collect()] == [True]


def test_lineage_merge_patches(spark):
    kv = lambda rows: spark.createDataFrame(rows, "k string, v string")
    merged, conflicts = lineage.three_way_merge(kv([("a", "1"), ("b", "1"), ("c", "1"), ("d", None)]), kv([("a", "2"), ("b", "1\r\n"), ("d", "x")]), kv([("a", "1"), ("b", "1\n"), ("c", "2"), ("d", "y"), ("e", "n")]), ["k"], ["v"], normalize_lines=True)
    assert as_set(merged) == {("a", "2"), ("b", "1\n"), ("e", "n")} and as_set(conflicts) == {("c",), ("d",)}
    assert as_set(lineage.three_way_merge(None, kv([("a", "1"), ("b", "1")]), kv([("a", "1"), ("b", "2")]), ["k"], ["v"])[1]) == {("b",)}
    rev = lambda rows: spark.createDataFrame(rows, "session_id string, k string, revision_id string")
    away = spark.createDataFrame([("t",)], "session_id string")
    got = lineage.diff_lineage(rev([("s", "a", "1"), ("s", "b", "1"), ("s", "c", "1"), ("t", "d", "1")]), rev([("s", "a", "1"), ("s", "b", "2"), ("s", "e", "1")]), ["session_id", "k"], unavailable=away)
    assert {(r.k, r.change, r.new_revision) for r in got.collect()} == {("a", "unchanged", "1"), ("b", "superseded", "2"), ("c", "withdrawn", None), ("d", "unchanged", "1"), ("e", "added", "1")}
    p = lambda rows, c: spark.createDataFrame(rows, "entity_id string, field string, " + c)
    base = p([("e", "x", "g"), ("e", "y", "g"), ("e", "z", "g")], "value string")
    edits = lineage.capture_patches(p([("e", "x", "h"), ("e", "y", None), ("e", "z", "g"), ("e", "new", "n")], "value string"), base, p([("e", "z", 1)], "n int"))
    assert {(r.field, r.action) for r in edits.collect()} == {("x", "set"), ("y", "suppress"), ("z", "restore_default"), ("new", "set")}
    assert {(r.field, r.value, r.edited) for r in lineage.apply_patches(edits, base).collect()} == {("x", "h", True), ("y", None, True), ("z", "g", False)}
    st = lineage.rebase_patches(p([("e", "x", "h1"), ("e", "y", "h1"), ("e", "q", "h1")], "base_hash string"), p([("e", "x", "h1"), ("e", "y", "h2")], "hash string"))
    assert {(r.field, r.status) for r in st.collect()} == {("x", "active"), ("y", "underlay_changed"), ("q", "orphan")}


def test_sources_and_boundaries(spark):
    s = lambda rows: spark.createDataFrame(rows, "provider string, session_id string, source_identity string, boundary long, digest string, project_ids array<string>")
    got = lineage.merge_sources(s([("a", "1", "i", 5, "d", ["p"]), ("a", "2", "i", 5, "d", ["p"]), ("a", "3", "i", 5, "d", [])]), s([("a", "1", "i", 7, "e", ["q"]), ("a", "2", "i", 5, "x", ["p"]), ("a", "3", "j", 5, "d", []), ("a", "4", "i", 1, "d", None)]))
    assert {(r.session_id, r.boundary, r.digest, tuple(r.project_ids), r.conflict) for r in got.collect()} == {("1", 7, "e", ("p", "q"), None), ("2", 5, "d", ("p",), "boundary_disagrees"), ("3", 5, "d", (), "identity_changed"), ("4", 1, "d", (), None)}
    prev = spark.createDataFrame([("a", str(i), 5, "h", "u") for i in range(4)], "provider string, session_id string, lines long, prefix_hash string, usage_digest string")
    cur = spark.createDataFrame([("a", "0", 5, "h", "u", "h"), ("a", "1", 6, "k", "u", "h"), ("a", "2", 6, "k", "u", "z"), ("a", "3", 5, "h", "w", "h"), ("a", "9", 1, "h", "u", None)], "provider string, session_id string, lines long, prefix_hash string, usage_digest string, hash_at_previous string")
    assert [r.relation for r in lineage.boundary_relation(prev, cur).orderBy("session_id").collect()] == ["unchanged", "append", "replacement", "usage_refresh", "initial"]


def test_retention(spark):
    o = spark.createDataFrame([("a", 1, T("2024-01-01")), ("b", 2, T("2024-01-01")), ("c", 4, T("2024-01-30")), ("d", 8, T("2024-01-01"))], "digest string, bytes long, written_at timestamp")
    got = lineage.retention_report(o, spark.createDataFrame([(["a"],)], "refs array<string>"), spark.createDataFrame([("d",)], "digest string"), F.lit("2024-01-31").cast("timestamp"))
    assert {(r.fate, r.bytes) for r in got.collect()} == {("reachable", 9), ("cleanup", 2), ("retained", 4)}


def test_phases_and_state(spark):
    rows = obs(spark, [{"kind": "branch", "fields": {"branch": "main"}}, {"kind": "git_status", "fields": {"branch": "main", "status": "dirty"}}, {"kind": "branch", "fields": {"branch": "dev"}}, {"kind": "version", "fields": {"version": "1"}}, {"kind": "version", "fields": {"version": " "}}, {"kind": "version", "fields": {"version": "2"}}])
    assert {(r.phase_kind, r.value, r.previous_value) for r in projects.structural_phases(rows).collect()} == {("branch", "dev", "main"), ("version", "1", None), ("version", "2", "1")}
    assert {(r.state_key, r.value) for r in projects.witnessed_state(rows).collect()} == {("branch", "dev"), ("git_status", "dirty"), ("version", "2")}
    assert projects.project_view(rows, F.lit("2024-02-01").cast("timestamp")).where("kind = 'phase_boundary'").count() == 3


def test_trees_and_chains(spark):
    n = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "a", 1), ("d", "d", 1), ("e", "zz", 1), ("x", "y", 1), ("y", "x", 1), ("f", "a", 1)], "node_id string, parent_id string, sibling_order int")
    paths = problems.tree_paths(n, order="sibling_order")
    assert [r.node for r in problems.subtree(paths, "a").collect()][0] == "a" and {r.node for r in paths.collect()} == {"a", "b", "c", "f"}
    bad = {(r.node, r.violation) for r in problems.validate_tree(n).collect()}
    assert {("e", "missing_parent"), ("d", "self_parent"), ("c", "duplicate_order"), ("f", "duplicate_order"), ("x", "unreachable"), ("y", "unreachable")} <= bad
    d = spark.createDataFrame([("p", "a", ["c"]), ("p", "b", []), ("p", "c", None), ("q", "a", ["b"]), ("q", "b", ["a"])], "project_id string, decision_id string, supersedes array<string>")
    assert as_set(problems.order_by_supersession(d)) == {("p", "b", 0), ("p", "c", 1), ("p", "a", 2), ("q", "a", None), ("q", "b", None)}
    r = [("p", f"s{i:02}", f"s{i - 1:02}" if i else None, f"s{i + 1:02}" if i < 20 else None) for i in range(21)]
    r += [("q", "a", None, "b"), ("q", "b", None, None), ("z", "h", None, None), ("z", "x", "y", "y"), ("z", "y", "x", "x")]
    got = {x.project_id: (x.valid, x.one_sided, x.reached) for x in problems.validate_session_chain(spark.createDataFrame(r, "project_id string, session_id string, previous_id string, next_id string")).collect()}
    assert got["p"] == (True, 0, 21) and got["q"][:2] == (False, 1) and got["z"] == (False, 0, 1)
    snaps = spark.createDataFrame([("a", "i", None), ("b", "i", "a"), ("c", "i", "a"), ("d", "j", "c"), ("e", "i", "zz"), ("x", "i", "y"), ("y", "i", "x")], "snapshot_id string, identity string, supersedes string")
    assert {("b", "fork"), ("c", "fork"), ("d", "identity_changed"), ("e", "missing"), ("x", "cycle"), ("y", "cycle")} == as_set(problems.validate_price_chain(snaps))


def test_problems(spark):
    t = spark.createDataFrame([("p", "Why  X?", "t2"), ("p", "why x?", "t1"), ("p", "继续", "t3"), ("p", "42", "t4"), ("p", "<turn_aborted>a</turn_aborted>", "t5"), ("p", None, "t6")], "project_id string, question string, turn_unit_id string")
    [row] = problems.discover_candidates(t).collect()
    assert (row.n_turns, row.turns) == (2, ["t1", "t2"])
    q = spark.createDataFrame([("p", 1, "Why x"), ("p", 2, "why x now"), ("p", 3, "why x and y"), ("p", 4, "z")], "project_id string, question_id long, question string")
    nodes = spark.createDataFrame([("p", "n2", 2, "why X"), ("p", "n1", 1, "why  x"), ("p", "n3", 3, "x now")], "project_id string, node_id string, node_order int, question string")
    assert {(r.question_id, r.action, r.target) for r in problems.recommend_placement(q, nodes.where("node_id <> 'n1'")).collect()} == {(1, "merge", "n2"), (2, "keep_pending", None), (3, "child", "n2"), (4, "keep_pending", None)}
    assert {r.target for r in problems.recommend_placement(q, nodes).where("question_id = 1").collect()} == {"n1"}
    prev = spark.createDataFrame([("a", "pending", 1, "rule", ["t"], T("2024-01-01")), ("b", "stale", 2, "rule", ["t"], T("2024-01-01")), ("c", "accepted", 1, "human", ["t"], T("2024-01-01")), ("d", "pending", 1, "rule", ["t"], T("2024-01-01"))], "candidate_id string, status string, revision long, origin string, turns array<string>, updated_at timestamp")
    found = spark.createDataFrame([("a", ["t"]), ("b", ["t"]), ("c", ["u"]), ("n", ["v"])], "candidate_id string, turns array<string>")
    got = {(r.candidate_id, r.status, r.revision) for r in problems.reconcile_candidates(prev, found, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {("a", "pending", 1), ("b", "pending", 3), ("c", "accepted", 1), ("d", "stale", 2), ("n", "pending", 1)}
    s = "array<struct<session_id:string,turn_unit_id:string>>"
    used = spark.createDataFrame([("n", [("s", "t1")])], f"node_id string, source_turns {s}")
    assert problems.unplaced_turns(spark.createDataFrame([("s", "t1"), ("s", "t2"), (None, "t1")], "session_id string, turn_unit_id string"), used).count() == 2
    assert as_set(problems.related_problems(spark.createDataFrame([("m", [("s", "t1"), ("s", "t9")])], f"milestone_id string, source_turns {s}"), used, ["session_id", "turn_unit_id"])) == {("m", "n")}
    th = problems.themes(spark.createDataFrame([("p", "d1", ["x", "x"])], "project_id string, id string, tags array<string>"), spark.createDataFrame([("p", "l1", ["x", "y"], False), ("p", "l2", ["x"], True)], "project_id string, id string, tags array<string>, resolved boolean"))
    assert {(r.tag, tuple(r.decision_ids), tuple(r.open_loop_ids)) for r in th.collect()} == {("x", ("d1",), ("l1",)), ("y", (), ("l1",))}
    assert as_set(problems.edges(decisions=spark.createDataFrame([("a", ["b", "b"])], "id string, supersedes array<string>"))) == {("decision", "a", "supersedes", "b")}


def test_sessions(spark):
    rows = obs(spark, [{"kind": "file", "operation": "file_change", "outcome": "success", "excerpt": "a"}, {"kind": "verification", "outcome": "failed", "fields": {"exit_code": "1"}}, {"kind": "error", "operation": "error", "outcome": "error"}])
    blocks = {r.block: (r.total, [i.revision_id for i in r["items"]]) for r in sessions.session_summary(rows).collect()}
    assert blocks == {"operations": (1, ["r0"]), "verifications": (1, ["r1"]), "errors": (2, ["r1", "r2"]), "unresolved": (2, ["r1", "r2"])}
    sess = spark.createDataFrame([("a", "s", "p", T("2024-01-01"), T("2024-01-02"), "indexed", "available"), ("a", "t", "p", None, None, "unreadable", "unavailable")], "provider string, session_id string, project_id string, started_at timestamp, ended_at timestamp, terminal_state string, availability string")
    idx = sessions.session_index(sess, rows)
    assert {(r.session_id, r.processing_state, r.duration_ms, r.files) for r in idx.collect()} == {("s", "complete", 86_400_000, 1), ("t", "error", None, 0)}
    cov = sessions.index_coverage(idx).first()
    assert (cov.total, cov.complete, cov.errors, cov.timed) == (2, 1, 1, 1)
    assert [r.session_id for r in idx.orderBy(*sessions.index_order()).collect()] == ["s", "t"]
    assert sessions.filter_sessions(idx, query="A S", date_from="2024-01-01", date_to="2024-01-01").count() == 1 and sessions.filter_sessions(idx, unknown_only=True).count() == 1
    assert sessions.filter_sessions(idx, date_from="2024-01-01", tz="America/New_York").count() == 0
    assert [tuple(r) for r in projects.terminal_counts(sess).collect()] == [("p", 1, 0, 0, 1, 0)]
    c = spark.createDataFrame([("p", "a", T("2024-01-01T00:10")), ("p", "b", T("2024-01-01T00:08")), ("p", "f", T("2024-01-02")), ("q", "c", T("2024-01-01"))], "project_id string, session_id string, modified_at timestamp")
    assert {(r.project_id, r.session_id, r.ambiguous) for r in sessions.latest_session(c, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()} == {("p", "a", True), ("q", "c", False)}
    fates = spark.createDataFrame([("s", "indexed"), ("s", "collapsed"), ("t", "odd")], "session_id string, fate string")
    assert {r.session_id: r.reconciled for r in sessions.measure_sources(fates).collect()} == {"s": True, "t": False}


def test_quality(spark):
    prev = spark.createDataFrame([("a", "pending", 1, "x"), ("b", "pending", 1, "x"), ("c", "accepted", 1, "x"), ("d", "pending", 1, "x")], "id string, status string, revision long, origin string")
    nxt = spark.createDataFrame([("a", "accepted", 2, "x"), ("b", "pending", 3, "y"), ("c", "pending", 2, "x"), ("e", "pending", 2, "x")], "id string, status string, revision long, origin string")
    assert as_set(quality.audit_transitions(prev, nxt, "id", ["origin"])) == {("b", "immutable_changed"), ("b", "bad_revision"), ("c", "illegal_status"), ("d", "vanished"), ("e", "bad_revision")}
    child = spark.createDataFrame([("p", 5), ("p", 50), ("q", 1), ("r", 1)], "k string, at int")
    parent = spark.createDataFrame([("p", 1, 10), ("q", 1, 2), ("q", 1, 2)], "k string, lo int, hi int")
    assert as_set(quality.check_references(child, parent, ["k"], "lo", "hi", "at")) == {("p", 50, "out_of_range"), ("q", 1, "not_unique"), ("r", 1, "missing")}
    v = lambda rows: spark.createDataFrame(rows, "id string, v string, done boolean")
    got = quality.check_report_effects(spark.createDataFrame([("added", "n"), ("revised", "a")], "effect string, id string"), v([("a", "1", False), ("b", "1", False)]), v([("a", "1", False), ("b", "1", True), ("n", "1", False)]), "id", "v", F.col("done"))
    assert as_set(got) == {("revised", "a", "declared"), ("closed", "b", "actual")}
    rules = quality.quality_rules(obs(spark, [{"kind": "decision"}]).withColumn("subject", F.lit("")).withColumn("source_hash", F.lit("0")), ["revision_id"], quality.observation_rules())
    assert {r.rule for r in rules.collect()} == {"kind", "subject", "source_hash"}


def test_windows(spark):
    rows = spark.createDataFrame([("g", i, 10) for i in range(5)] + [("g", 5, 100), ("g", 6, 1)], "g string, o long, n long")
    assert [r.page for r in windows.greedy_pages(rows, ["g"], "o", "n", 3, 25).orderBy("o").collect()] == [0, 0, 1, 1, 2, 3, 4]
    assert [r.o for r in windows.changes(rows.withColumn("v", F.when(F.col("o") == 2, "").when(F.col("o") < 4, "a").otherwise("b")), ["g"], [F.asc("o")], "v").orderBy("o").collect()] == [0, 4]
    text = windows.cursor("g1", "d", 20)
    assert windows.read_cursor(text, "g1", "d") == 20
    with pytest.raises(ValueError):
        windows.read_cursor(text, "g2", "d")
    left, right = spark.createDataFrame([("g", 1, "l1"), ("g", 3, "l3")], "g string, o long, x string"), spark.createDataFrame([("g", 3, "v3")], "g string, o int, v string")
    assert {(r.x, r.v) for r in windows.asof_last(left, right, ["g"], "o", "v").collect()} == {("l1", None), ("l3", "v3")}
    assert {(r.x, r.v) for r in windows.asof_last(left, right, ["g"], "o", "v", ties_match=False).collect()} == {("l1", None), ("l3", None)}


def test_milestones_and_cards(spark):
    m = spark.createDataFrame([("s", 0, "user", "q"), ("s", 5, "assistant", "done"), ("s", 6, "user", "q2")], "session_id string, ordinal long, role string, text string")
    o = obs(spark, [{"kind": "verification", "outcome": "passed"}, {"kind": "commit", "operation": "commit"}, {"kind": "verification", "outcome": "failed"}]).withColumn("ordinal", F.col("sequence") + 1)
    [row] = search.milestones(o, turns.turn_units(m)).collect()
    assert (row.question, row.conclusion, row.category, row.revision_id, row.verification) == ("q", "done", "commit", "r1", "failed")
    reports = spark.createDataFrame([("p", "a", None, "b"), ("p", "b", "a", None)], "project_id string, session_id string, previous_id string, next_id string")
    use = spark.createDataFrame([("p", "m", 5, 1.0), ("p", "n", 5, None)], "project_id string, model string, total_tokens long, cost double")
    dec = spark.createDataFrame([("p", "d1", []), ("p", "d2", ["d1"])], "project_id string, decision_id string, supersedes array<string>")
    loops = spark.createDataFrame([("p", "l", [], False)], "project_id string, id string, tags array<string>, resolved boolean")
    assert tuple(search.resume_card(reports, use, dec, loops).first()) == ("p", "b", 1, 1, 1, 10)
    assert {(r.model, r.token_share, r.cost_share, r.group_total, r.known_subtotal) for r in search.usage_report(use).collect()} == {("m", 50.0, None, None, 1.0), ("n", 50.0, None, None, 1.0)}


def test_long_chains(spark):
    chain = [(i, i - 1 if i else None, 1, "a") for i in range(200)] + [(900, 901, 1, "a"), (901, 900, 2, "a"), (902, 901, 3, "a"), (903, 999, 1, "a"), (150, 10, 2, "a")]
    nodes = spark.createDataFrame(chain, "node_id long, parent_id long, sibling_order int, p string")
    got = {(r.node, r.violation) for r in problems.validate_tree(nodes, ["p"]).collect()}
    assert got == {("900", "unreachable"), ("901", "unreachable"), ("902", "unreachable"), ("903", "unreachable"), ("903", "missing_parent"), ("150", "duplicate_node")}
    prices = spark.createDataFrame([(i, "x", i - 1 if i else None) for i in range(200)] + [(900, "x", 901), (901, "x", 900), (903, "x", 999)], "snapshot_id long, identity string, supersedes long")
    assert {(r.snapshot_id, r.violation) for r in problems.validate_price_chain(prices).collect()} == {(900, "cycle"), (901, "cycle"), (903, "missing")}
    paths = {r.node: (r.depth, r.path) for r in problems.tree_paths(nodes.where("sibling_order < 3 AND node_id <> 150"), ["p"]).collect()}
    assert len(paths) == 150 and paths["149"] == (149, [str(i) for i in range(150)])
