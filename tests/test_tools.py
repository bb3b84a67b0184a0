import json

from tracemill.operators.tools import calls_and_outputs, tool_observations
from tracemill.sources.transcripts import decode_a

HEAD = "ab" * 20
PATCH = "*** Begin Patch\n*** Add File: x.py\n*** Update File: ../y.py\n*** End Patch"


def _lines():
    ran = lambda i, cmd, **more: ("function_call", {"call_id": i, "name": "exec_command", "arguments": json.dumps({"cmd": cmd, **more})})
    gave = lambda i, text: ("function_call_output", {"call_id": i, "output": text})
    items = [
        ran("t1", "go test -count=1 ./a"), gave("t1", '{"exit_code":1,"output":"FAIL"}'), ran("g1", "git rev-parse HEAD", workdir="sub"), gave("g1", f"exit code: 0\n{HEAD}"), gave("g1", "exit code: 1"),
        ran("t2", "go test ./a || true"), gave("t2", "Process exited with code 0\nOutput:\nok"), ran("h", "go test -h"), gave("h", "exit code: 0"), ran("w", "go vet"), ran("d", "npm test"), gave("d", "exit code: 0"), ran("d", "npm test"),
        ("custom_tool_call", {"call_id": "p1", "name": "apply_patch", "input": PATCH}), gave("p1", "Done!"), ("custom_tool_call", {"call_id": "p2", "name": "apply_patch", "input": json.dumps({"patch": PATCH, "workdir": "/z"})}),
        gave("p2", '{"exit_code":1,"output":""}'), ("custom_tool_call", {"call_id": "p3", "name": "apply_patch", "input": "no patch"}), ("custom_tool_call", {"call_id": "e", "name": "exec", "input": "x"}), ran("b", " "),
        gave("none", "exit code: 0"), ran("no code", "go vet"), ran("s", "go vet"), gave("s", "running"), ("function_call", {"call_id": "o", "name": "other", "arguments": "{}"}), ran("q", "git status", workdir="/w/q"), gave("q", "exit code: 0\n## main"),
        ("custom_tool_call", {"call_id": "n", "name": None, "input": None}), gave("n", "x"),
    ]
    lines = [{"timestamp": "2025-01-01T00:00:00Z", "type": "turn_context", "payload": {"cwd": "/w/p"}}]
    return [*(json.dumps(x) for x in lines), *(json.dumps({"timestamp": "2025-01-01T00:00:00Z", "type": "response_item", "payload": {"type": t, **p}}) for t, p in items)]


def _run(spark, lines):
    raw = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_id string, ordinal long, line string").repartition(5)
    return tool_observations(*calls_and_outputs(decode_a(raw)))


def test_observations_of_calls(spark):
    found, odd = _run(spark, _lines())
    got = {(r.call_id, r.operation, r.object): (r.outcome, r.path, r.fields) for r in found.collect()}
    assert got[("t1", "verification", "package")] == ("failed", "/w/p", {"component": "package", "status": "test", "exit_code": "1", "passed": "false", "failed": "true", "tool_id": "t1"})
    assert got[("t1", "command_finished", "/w/p")] == ("failure", "/w/p", {"command_signature": "go:test", "exit_code": "1", "tool_id": "t1"})
    assert got[("g1", "git_observation", "head")] == ("observed", "/w/p/sub", {"git_head": HEAD, "tool_id": "g1"}) and got[("g1", "command_finished", "/w/p/sub")][0] == "success"
    assert got[("t2", "command_started", "/w/p")][2]["command_signature"] == "other" and {o for i, o, _ in got if i in ("t2", "h", "q")} == {"command_started", "command_finished"} and ("q", "command_started", "/w/q") in got
    assert {(i, o, w[0], w[1]) for (i, _, o), w in got.items() if i in ("p1", "p2")} == {("p1", "/w/p/x.py", "success", "/w/p"), ("p1", "/w/y.py", "success", "/w"), ("p2", "/z/x.py", "failure", "/z"), ("p2", "/y.py", "failure", "/")}
    assert {i for i, _, _ in got} == {"t1", "g1", "t2", "h", "w", "p1", "p2", "s", "q"} and len(got) == found.count()
    assert {(r.call_id, r.diagnostic) for r in odd.collect()} == {
        ("d", "duplicate_call"), ("p3", "unsupported_record"), ("e", "unsupported_exec_wrapper"), ("b", "malformed_payload"), ("none", "output_without_call"), ("no code", "unsupported_record"), ("s", "unsupported_record")}


def test_no_calls(spark):
    found, odd = _run(spark, _lines()[:1])
    assert found.count() == 0 and odd.count() == 0 and "fields" in found.columns
