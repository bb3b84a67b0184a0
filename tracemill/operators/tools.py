"""Tool calls with their outputs as observations: commands, verifications, repository states and file changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import commands as c
from tracemill.operators.facts import join_tool_calls

# Fixed value: what a call's id looks like.
CALL_ID = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"
OBSERVATION = "struct<sequence:bigint,kind:string,subject:string,operation:string,object:string,outcome:string,path:string,fields:map<string,string>>"


def calls_and_outputs(records: DataFrame, by: Sequence[str] = ("session_id",), order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """Tool calls with the folder that held at each, and tool outputs, of records with by, order, kind, call_id, name, input, output, cwd."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = records.withColumn("cwd", F.last("cwd", ignorenulls=True).over(w))
    ordinal = F.col(order).cast("long").alias("ordinal")
    return rows.where("kind = 'tool_call'").select(*by, "call_id", ordinal, "name", "input", "cwd"), rows.where("kind = 'tool_output'").select(*by, "call_id", ordinal, "output")


def _subject(value: Column) -> Column:
    """A value that is short and has no white space around it, else its digest."""
    return F.when((F.octet_length(value) <= 256) & ~F.rlike(value, F.lit(r"\A\s|\s\z|[\x00\r\n]")), value).otherwise(F.concat(F.lit("subject-"), F.sha2(value, 256)))


def _observed(sequence: Column, kind: str, subject: Column, operation: str, object_: Column, outcome: Column, path: Column, fields: Column) -> Column:
    return F.struct(
        sequence.alias("sequence"), F.lit(kind).alias("kind"), subject.alias("subject"), F.lit(operation).alias("operation"), object_.alias("object"), outcome.cast("string").alias("outcome"),
        path.alias("path"), fields.alias("fields"),
    ).cast(OBSERVATION)


def tool_observations(calls: DataFrame, outputs: DataFrame, by: Sequence[str] = ("session_id",)) -> tuple[DataFrame, DataFrame]:
    """Observations that commands and patches give, and diagnostics (S4 with J1 and F9 to F12).

    calls: by, call_id, ordinal, name, input, cwd; outputs: by, call_id, ordinal, output. A command gives command_started at its call and, where its output
    tells an exit code, command_finished, what its grammar proves (verification) and what git printed (git_observation) at the output; a patch gives a file_change
    of each path. ``path`` is where each belongs: the folder of a command, the folder that holds a file.

    Of a call id that occurs twice nothing holds. Diagnostics (by, call_id, ordinal, diagnostic): duplicate_call, output_without_call, malformed_payload (no
    command in the input), unsupported_record (bad call id, no absolute folder, a patch that is none or without paths, an output without an exit code or outcome),
    unsupported_exec_wrapper. Tools with other names are none of them. The two tables meet in one join by call id; all else is done within a row.
    """
    joined, lost = join_tool_calls(calls, outputs.select(*by, "call_id", "ordinal", "output"), by)
    asked = F.from_json("input", "cmd string, workdir string, patch string")
    rows = joined.where("call_state <> 'duplicate_call'").withColumn("__in", asked).withColumn("__out", c.parse_terminal_output("output_output"))
    rows = rows.withColumn("__dir", c.rooted_path(F.col("__in.workdir"), "cwd")).withColumn("__known", F.rlike("call_id", F.lit(CALL_ID)))
    command, patching = F.col("name") == "exec_command", F.col("name") == "apply_patch"
    rows = rows.withColumn("__class", F.when(command, c.classify_command("__in.cmd")))
    text = F.coalesce("__in.patch", F.when(~F.startswith(F.ltrim("input"), F.lit("{")), F.col("input")))
    lines = c.trimmed_lines(text)
    whole = (F.size(lines) >= 3) & (F.get(lines, F.lit(0)) == "*** Begin Patch") & (F.try_element_at(lines, F.lit(-1)) == "*** End Patch")
    rows = rows.withColumn("__targets", F.when(patching & whole & F.col("__dir").isNotNull(), c.patch_targets(text, "__dir")))
    rows = rows.withColumn("__patched", F.when(patching, c.patch_outcome("__out.exit_code", "__out.body")))

    call, at, folder, code = F.col("call_id"), F.col("output_ordinal"), F.col("__dir"), F.col("__out.exit_code")
    sign, component, git = F.col("__class.signature"), F.col("__class.component"), F.col("__class.git")
    runs = command & F.col("__known") & folder.isNotNull() & (F.trim(F.coalesce("__in.cmd", F.lit(""))) != "")
    ended = runs & code.isNotNull()
    n, passed = code.cast("string"), code == 0
    pairs = lambda *kv: F.create_map(*(x if isinstance(x, Column) else F.lit(x) for x in kv))
    printed = F.when(ended & passed, c.parse_git_output(git, "__out.body"))
    changed = F.when(passed, "passed").otherwise("failed")
    observed = F.array(
        F.when(runs, _observed(F.col("ordinal"), "command", call, "command_started", folder, F.lit(None), folder, pairs("command_signature", sign, "path", folder, "tool_id", call))),
        F.when(ended, _observed(at, "command", call, "command_finished", folder, F.when(passed, "success").otherwise("failure"), folder, pairs("command_signature", sign, "exit_code", n, "tool_id", call))),
        F.when(ended & component.isNotNull(), _observed(at, "verification", call, "verification", component, changed, folder, pairs(
            "component", component, "status", F.col("__class.verification"), "exit_code", n, "passed", passed.cast("string"), "failed", (~passed).cast("string"), "tool_id", call))),
        F.when(printed.isNotNull(), _observed(at, "git_status", call, "git_observation", git, F.lit("observed"), folder, F.map_concat(printed, pairs("tool_id", call)))),
    )
    files = F.when(F.col("__known") & at.isNotNull() & F.col("__patched").isNotNull(), F.transform("__targets", lambda t: _observed(
        at, "file", _subject(t), "file_change", t, F.col("__patched"), F.coalesce(F.when(F.regexp_replace(t, "/[^/]*$", "") != "", F.regexp_replace(t, "/[^/]*$", "")), F.lit("/")),
        pairs("path", t, "failed", (F.col("__patched") == "failure").cast("string"), "tool_id", call))))
    every = F.array_compact(F.concat(observed, F.coalesce(files, F.array().cast(f"array<{OBSERVATION}>"))))
    found = rows.select(*by, "call_id", F.explode(every).alias("o")).select(*by, "call_id", "o.*")

    blank = F.trim(F.coalesce("__in.cmd", F.lit(""))) == ""
    why = (
        F.when(~F.coalesce("__known", F.lit(False)), "unsupported_record").when(F.col("name") == "exec", "unsupported_exec_wrapper").when(command & blank, "malformed_payload")
        .when((command | patching) & folder.isNull(), "unsupported_record").when(patching & (F.coalesce(F.size("__targets"), F.lit(0)) <= 0), "unsupported_record")
        .when((F.col("call_state") == "finished") & ((command & code.isNull()) | (patching & F.col("__patched").isNull())), "unsupported_record")
    )
    odd = rows.select(*by, "call_id", "ordinal", why.alias("diagnostic")).where("diagnostic IS NOT NULL")
    return found, lost.unionByName(odd)
