import math
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from tests.oracle import compare
from tracemill.plans import reports


@pytest.mark.parametrize("name", sorted(reports.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert compare(reports.QUERIES[name](spark, sf), reports.ORACLE_SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(reports.QUERIES) - set(reports.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert reports.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["cross_session_recovery", "witnessed_state", "module_ranking", "session_usage", "three_way_merge"])
def test_partitioning_does_not_matter(spark, sf, name, monkeypatch):
    from tracemill.plans import fixtures

    first = sorted(map(str, reports.QUERIES[name](spark, sf).collect()))
    plain = fixtures.table
    monkeypatch.setattr(fixtures, "table", lambda s, d, t: plain(s, d, t).repartition(7))
    assert sorted(map(str, reports.QUERIES[name](spark, sf).collect())) == first


def test_document_tokens_by_hand(spark, tmp_path):
    token = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN0123"
    rows = [("en", f"see {token} and {token}x"), ("en", "a" * 60), ("en", f"password: {token}"), ("de", "ab" * 30), (None, token), (None, None), ("fr", token[:39]), ("fr", "msg_" + token[:40])]
    spark.createDataFrame(rows, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.lang, r.rule, r.findings, r.docs) for r in reports.document_tokens(spark, str(tmp_path)).collect()}
    assert got == {(lang, "high_entropy_token", n, docs) for lang, n, docs in (("en", 2, 3), ("de", 0, 1), (None, 1, 2), ("fr", 0, 2))}


def test_document_tokens_brute_force(spark, sf):
    from tracemill.functions import redaction as r

    def bits(t):
        return -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())

    docs, findings = Counter(), Counter()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r._named(d.text or "")
        for rule, pattern in zip(r.RULES[1:5], (r.PRIVATE_KEY, r.BEARER, r.API_KEY, r.CONNECTION_URL)):
            text = re.sub(pattern, f"[REDACTED:{rule.upper()}]", text)
        docs[d.lang] += 1
        findings[d.lang] += sum(bits(t) >= 4.0 - 1e-12 and not re.match(r.STABLE_ID, t) for t in re.findall("[A-Za-z0-9+/=_-]{40,}", text))
    assert {x.lang: (x.findings, x.docs) for x in reports.document_tokens(spark, sf).collect()} == {k: (findings[k], docs[k]) for k in docs}


def test_reports_cover_whole_tables(spark, sf):
    got = reports.price_totals(spark, sf).collect()
    usage = reports.fx.usage(spark, sf)
    assert sum(r.rows for r in got) == usage.count() and {(r.project_id, r.model) for r in got} == {tuple(r) for r in usage.select("project_id", "model").distinct().collect()}
    assert {r.complete for r in got} == {True, False}

    customers = {r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    orders = [(r.o_orderkey, r.o_custkey) for r in spark.read.parquet(f"{sf}/orders.parquet").collect()]
    want = Counter((0, k) for k, c in orders if c not in customers) + Counter((1, k) for k, c in orders if c not in customers or k % 17 == 0)
    assert want and Counter((r.version, r.o_orderkey) for r in reports.reference_check(spark, sf).collect()) == want

    view = reports.project_modules(spark, sf).collect()
    assert {r.kind for r in view} == {"witnessed_state", "recovery_link", "phase_boundary", "module_rank"}
