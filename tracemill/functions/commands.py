"""Shell commands, tool outputs and patches read from their text."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.scalars import col, normalize_path

# Flags that go takes alone and with a value, and those of its tests besides.
GO_SWITCHES = ("-a", "-asan", "-msan", "-race", "-trimpath", "-v", "-work", "-x")
GO_VALUES = ("-mod", "-modfile", "-p", "-pkgdir", "-tags", "-gcflags", "-ldflags")
GO_TEST_SWITCHES = ("-cover", "-failfast", "-json", "-short")
GO_TEST_VALUES = ("-bench", "-count", "-run", "-shuffle", "-skip", "-timeout", "-covermode", "-coverpkg", "-coverprofile")
# Test patterns that select nothing.
EMPTY_PATTERNS = ("^$", "$^")


class Grammar(NamedTuple):
    """What a tool accepts after its leading words; whatever is not listed makes the command prove nothing.

    ``after`` are the words allowed behind ``--``: a tool that has some takes places only before them, one without does not know ``--``.
    """

    switches: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    after: tuple[str, ...] = ()

    def column(self) -> Column:
        return F.struct(*(F.array(*map(F.lit, v)).cast("array<string>").alias(n) for n, v in self._asdict().items()))


GO, GO_TEST, NPM = Grammar(GO_SWITCHES, GO_VALUES), Grammar(GO_SWITCHES + GO_TEST_SWITCHES, GO_VALUES + GO_TEST_VALUES), Grammar(after=("--runInBand",))
# Signature and kind of verification by leading words.
VERIFICATIONS = {
    "go test": ("go:test", "test", GO_TEST), "go build": ("go:build", "build", GO), "go vet": ("go:vet", "lint", GO), "npm test": ("npm:test", "test", NPM),
    "npm run test": ("npm:test", "test", NPM), "npm run build": ("npm:build", "build", NPM), "npm run lint": ("npm:lint", "lint", NPM),
}
# Git queries whose output is understood; their arguments may stand in any order.
GIT_QUERIES = {
    "status": (("--branch", "--porcelain=v1"), "git:status", "status"), "rev-parse": (("HEAD",), "git:head", "head"),
    "branch": (("--show-current",), "git:branch", "branch"), "describe": (("--exact-match", "--tags"), "git:tag", "tag"),
}
# Longest command, most words and longest word that are read, in bytes.
MAX_COMMAND, MAX_WORDS, MAX_WORD = 4096, 128, 512
# Leading envelopes that machines put before a user's words, and the notice of an interruption.
AMBIENT_TAGS = ("environment_context", "recommended_plugins")
INTERRUPTED = (
    "The user interrupted the previous turn on purpose. Any running unified exec processes may still be running in the background. "
    "If any tools/commands were aborted, they may have partially executed."
)
# Notices of an exit in plain text and before an output's head ends, the paths of a patch, and the line before the list of what it changed.
EXIT_CODE = r"\Aexit code: (-?[0-9]+)\z"
PROCESS_EXIT = r"\A(?:Process exited with code|exit code:) (-?[0-9]+)\z"
PATCH_TARGET = r"(?md)^\*\*\* (?:Add|Update|Delete|Move to) File: (.+)$"
PATCH_LISTED = "Success. Updated the following files:"
# A piece of a word: plain characters, a quoted text in which no shell replaces anything, or an escaped character.
PIECE = r"""(?:[^ \t\n\r\x00;&|<>()$`*?\[\]{}#'"\\]++|'[^'\n\r\x00]*+'|"[^"$`\\\n\r\x00]*+"|\\[^\n\r\x00])"""
# A package: ., ./... or path segments of lower case.
PACKAGE = r"\A(?:\.|\./\.\.\.|(?:\./)?[a-z0-9][a-z0-9._-]{0,127}(?:/[a-z0-9][a-z0-9._-]{0,127})*(?:/\.\.\.)?)\z"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it; without it an expression repeats all that stands below each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shell_words(command: str | Column) -> Column:
    """The words of a command that is literal, without quotes and escapes; null if a shell would interpret any of it, or it is too long."""
    c = col(command)
    plain = F.transform(F.regexp_extract_all(c, F.lit(f"({PIECE}++)"), F.lit(1)), lambda w: F.regexp_replace(w, r"""'([^']*)'|"([^"]*)"|\\(.)""", "$1$2$3"))
    fits = lambda words: (F.size(words) > 0) & (F.size(words) <= MAX_WORDS) & F.forall(words, lambda w: F.octet_length(w) <= MAX_WORD)
    return F.when((F.octet_length(c) <= MAX_COMMAND) & F.rlike(c, F.lit(rf"\A(?:[ \t]|{PIECE})++\z")), let(plain, lambda words: F.when(fits(words), words)))


def _read_arguments(words: Column, grammar: Column) -> Column:
    """struct(ok, component): whether the grammar accepts all words, and the kind of the first place among them.

    A fold over the words whose state is the flag that waits for its value, whether ``--`` has come, the places so far, and what tests are selected.
    """
    start = F.struct(
        F.lit("").alias("waiting"), F.lit(True).alias("ok"), F.lit(False).alias("rest"), F.lit(False).alias("places"), F.lit(".").alias("component"),
        F.lit(False).alias("bench"), F.lit(False).alias("idle"),
    )

    def read(a: Column, w: Column) -> Column:
        waits, dash, name = a.waiting != "", F.startswith(w, F.lit("-")), F.substring_index(w, "=", 1)
        flag = F.when(waits, a.waiting).when(~a.rest & dash, name).otherwise("")
        value = F.when(waits, w).otherwise(F.substring(w, F.length(name) + 2, F.length(w)))
        return F.struct(waits.alias("waits"), dash.alias("dash"), F.contains(w, F.lit("=")).alias("inline"), flag.alias("flag"), value.alias("value"))

    def judged(t: Column) -> Column:
        takes = F.array_contains(grammar.values, t.flag)
        number = F.rlike(t.value, F.lit(r"\A\+?0*[1-9][0-9]*\z")) & t.value.try_cast("long").isNotNull()
        good = F.when(t.waits, ~t.dash).otherwise(t.value != "") & ((t.flag != "-count") | number)
        return F.struct(takes.alias("takes"), (t.waits | (takes & t.inline)).alias("given"), good.alias("good"))

    def following(a: Column, w: Column, t: Column, j: Column) -> Column:
        place = ~t.waits & ~a.rest & (~t.dash | (w == "-"))
        ok = (
            F.when(j.given, j.good).when(a.rest, F.array_contains(grammar.after, w)).when(w == "-", F.size(grammar.after) == 0).when(w == "--", F.size(grammar.after) > 0)
            .when(t.dash, j.takes | F.array_contains(grammar.switches, t.flag)).otherwise(True)
        )
        kind = F.when((F.octet_length(w) <= 256) & F.rlike(w, F.lit(PACKAGE)), "package").otherwise("other")
        return F.struct(
            F.when(j.takes & ~j.given, t.flag).otherwise("").alias("waiting"), (a.ok & ok).alias("ok"), (a.rest | (~t.waits & (w == "--"))).alias("rest"), (a.places | place).alias("places"),
            F.when(place & (w != "-") & (a.component == "."), kind).otherwise(a.component).alias("component"),
            (a.bench | (j.given & (t.flag == "-bench"))).alias("bench"), F.when(j.given & (t.flag == "-run"), t.value.isin(*EMPTY_PATTERNS)).otherwise(a.idle).alias("idle"),
        )

    step = lambda a, w: let(read(a, w), lambda t: let(judged(t), lambda j: following(a, w, t, j)))
    placed = lambda a: (F.size(grammar.after) == 0) | a.rest | ~a.places
    return F.aggregate(words, start, step, lambda a: F.struct((a.ok & (a.waiting == "") & ~(a.bench & a.idle) & placed(a)).alias("ok"), a.component.alias("component")))


def _table(entries: dict[str, Column]) -> Column:
    return F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v)))


def classify_command(command: str | Column) -> Column:
    """struct(signature, component, verification, git): null parts where a command proves nothing.

    Only literal commands are understood (``shell_words``); null, blank and other ones are ``other``. Of test, build and lint commands those whose arguments
    the tool's grammar does not accept, or which run nothing (help, lists, dry runs, no counts, empty test patterns beside a benchmark), are recorded by
    signature but prove nothing. A component is package, other or . (no place) for go, and the signature for npm.
    """
    tools = _table({lead: F.struct(F.lit(sign).alias("signature"), F.lit(kind).alias("kind"), F.lit(lead.count(" ") + 2).alias("at"), g.column().alias("grammar")) for lead, (sign, kind, g) in VERIFICATIONS.items()})
    queries = _table({word: F.struct(F.array(*map(F.lit, wanted)).alias("wanted"), F.lit(sign).alias("signature"), F.lit(git).alias("git")) for word, (wanted, sign, git) in GIT_QUERIES.items()})

    def led(words: Column) -> Column:
        executable, operation = F.lower(F.regexp_extract(F.get(words, F.lit(0)), r"([^/]*)/*\z", 1)), F.lower(F.get(words, F.lit(1)))
        return F.struct(executable.alias("executable"), F.coalesce(operation, F.lit("")).alias("operation"), F.get(words, F.lit(2)).alias("third"))

    def found(words: Column, x: Column) -> Column:
        lead = F.concat_ws(" ", x.executable, x.operation, F.when((x.executable == "npm") & (x.operation == "run"), x.third))
        query = let(F.when(x.executable == "git", F.try_element_at(queries, x.operation)), lambda q: F.when(F.array_sort(F.slice(words, 3, F.size(words))) == q.wanted, q))
        read = lambda t: F.when(t.isNotNull(), _read_arguments(F.slice(words, t["at"], F.size(words)), t.grammar))
        return let(F.try_element_at(tools, lead), lambda t: F.struct(t.alias("tool"), read(t).alias("read"), query.alias("query")))

    def shown(x: Column, y: Column) -> Column:
        other = F.when(x.executable.isin("go", "npm", "git"), F.concat(x.executable, F.lit(":other"))).otherwise("other")
        return F.struct(
            F.coalesce(y.tool.signature, y.query.signature, other).alias("signature"), F.when(y["read"].ok, F.when(x.executable == "go", y["read"].component).otherwise(y.tool.signature)).alias("component"),
            F.when(y["read"].ok, y.tool.kind).alias("verification"), y.query.git.alias("git"),
        )

    return let(shell_words(command), lambda words: let(led(words), lambda x: let(found(words, x), lambda y: shown(x, y))))


def trimmed_lines(text: str | Column) -> Column:
    """Lines without white space around them; a carriage return before a line feed belongs to it."""
    return F.transform(F.split(F.replace(col(text), F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", ""))


def parse_terminal_output(output: str | Column) -> Column:
    """struct(exit_code, finished, body) of a tool's output, as JSON object or as text with or without a head before ``Output:``.

    In a head both notices of an exit count, in plain text only ``exit code: n``, which is then no part of the body. Contradictory exit codes, one beside
    a live session, and JSON that cannot be read give no exit code; null gives nothing.
    """
    c = col(output)
    result = lambda code, body: F.struct(code.alias("exit_code"), code.isNotNull().alias("finished"), body.alias("body"))
    told = lambda lines, pattern: F.array_distinct(F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit(pattern))), lambda x: F.regexp_extract(x, pattern, 1).try_cast("int")))
    code = lambda codes: F.when(F.size(codes) == 1, F.get(codes, F.lit(0)))

    def headed(lines: Column, at: Column) -> Column:
        return result(code(told(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0))), PROCESS_EXIT)), F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n"))

    def plain(lines: Column) -> Column:
        rest = F.array_join(F.filter(lines, lambda x: ~F.rlike(x, F.lit(EXIT_CODE))), "\n")
        return let(code(told(lines, EXIT_CODE)), lambda n: result(n, F.when(n.isNotNull(), rest).otherwise(c)))

    as_json = let(F.from_json(c, "output string, exit_code int, session_id string"), lambda p: result(F.when(p.session_id.isNull(), p.exit_code), F.coalesce(p.output, F.lit(""))))
    as_text = let(trimmed_lines(c), lambda lines: let(F.array_position(lines, "Output:").cast("int"), lambda at: F.when(at > 0, headed(lines, at)).otherwise(plain(lines))))
    return F.when(F.rlike(c, F.lit(r"\A\s*\{")), as_json).otherwise(as_text)


def parse_git_output(operation: str | Column, output: str | Column) -> Column:
    """map of branch, status, git_head or tag; null where the output is not what the query prints. Blank lines and notices of an exit do not count."""
    op = col(operation)
    branch_ok = lambda b: F.rlike(b, F.lit(r"\A[A-Za-z0-9][A-Za-z0-9._/-]{0,255}\z")) & ~F.contains(b, F.lit("..")) & ~F.endswith(b, F.lit(".lock"))
    pair = lambda k, v: F.create_map(F.lit(k), v)

    def status(lines: Column, first: Column) -> Column:
        named = F.substring(first, F.lit(4), F.length(first))
        entries_ok = F.forall(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.rlike(x, F.lit(r"\A[MADRCUT?!]{1,2}[ \t]+[^\r\n]+\z")))
        shown = lambda b: F.create_map(F.lit("branch"), b, F.lit("status"), F.when(F.size(lines) > 1, "dirty").otherwise("clean"))
        branch = F.when(F.contains(named, F.lit("...")), F.substring_index(named, "...", 1)).otherwise(F.substring_index(named, " ", 1))
        return let(branch, lambda b: F.when(F.startswith(first, F.lit("## ")) & branch_ok(b) & entries_ok, shown(b)))

    def read(lines: Column, first: Column) -> Column:
        one = F.size(lines) == 1
        return (
            F.when(op == "status", status(lines, first)).when((op == "head") & one & F.rlike(first, F.lit(r"\A(?:[0-9a-f]{40}|[0-9a-f]{64})\z")), pair("git_head", first))
            .when((op == "branch") & one & branch_ok(first), pair("branch", first)).when((op == "tag") & one & F.rlike(first, F.lit(r"\A[A-Za-z0-9][A-Za-z0-9._/+-]{0,255}\z")), pair("tag", first))
        )

    kept = F.filter(trimmed_lines(output), lambda x: (x != "") & ~F.rlike(x, F.lit(EXIT_CODE)))
    return let(kept, lambda lines: let(F.get(lines, F.lit(0)), lambda first: read(lines, first)))


def rooted_path(path: str | Column, base: str | Column) -> Column:
    """``path``, or ``base`` where it is empty, as an absolute path; relative ones stand under ``base``; null if that is not absolute either."""
    p, b = F.coalesce(F.when(col(path) != "", col(path)), col(base)), col(base)
    return F.when(F.startswith(p, F.lit("/")), normalize_path(p)).when(F.startswith(b, F.lit("/")) & (p != ""), normalize_path(F.concat(b, F.lit("/"), p)))


def patch_targets(patch: str | Column, cwd: str | Column) -> Column:
    """Sorted distinct absolute paths that a patch adds, updates, deletes or moves to; relative ones stand under ``cwd``."""
    found = F.regexp_extract_all(F.replace(col(patch), F.lit("\r\n"), F.lit("\n")), F.lit(PATCH_TARGET), F.lit(1))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda p: rooted_path(p, cwd)))))


def patch_outcome(exit_code: str | Column, body: str | Column) -> Column:
    """success or failure of a patch by its output; null where the text says nothing or contradicts the exit code."""
    word, code = F.regexp_replace(col(body), r"\A\s+|\s+\z", ""), col(exit_code)
    changes = lambda lines: F.forall(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.rlike(x, F.lit(r"\A[AMDR] \s*\S")))
    listed = let(trimmed_lines(body), lambda lines: (F.size(lines) > 1) & (F.get(lines, F.lit(0)) == PATCH_LISTED) & changes(lines))
    said = F.when((word == "Done!") | listed, "success").when(word == "Failed!", "failure")
    return let(said, lambda s: F.when(code.isNull(), s).when(code == 0, F.when(s == "success", s)).when(F.coalesce(s, F.lit("failure")) == "failure", "failure"))


def strip_ambient(text: str | Column, rule_version: int = 4) -> Column:
    """The user's own words without leading machine envelopes.

    Versions: 1 knows instruction files, browser and environment envelopes; 2 also notifications of other agents; 3 and 4
    also the notice of an interruption. All leading envelopes are removed.
    """
    known = [
        r"# AGENTS\.md instructions\n\s*<INSTRUCTIONS>.*?</INSTRUCTIONS>",
        r'<in-app-browser-context source="ambient-ui-state">.*?</in-app-browser-context>',
        *(f"<{t}>.*?</{t}>" for t in AMBIENT_TAGS),
    ]
    if rule_version >= 2:
        agent = r'"agent_path"\s*:\s*"[^"]*\S[^"]*"'
        status = r'"status"\s*:\s*(?:"[^"]*\S[^"]*"|\{.*?\})'
        known.append(rf"<subagent_notification>\s*\{{\s*(?:{agent}\s*,\s*{status}|{status}\s*,\s*{agent})\s*\}}\s*</subagent_notification>")
    if rule_version >= 3:
        known.append(r"<turn_aborted>\s*\Q" + INTERRUPTED + r"\E\s*</turn_aborted>")
    # each match starts where the one before ended
    lead = r"(?s)\G\s*(?:" + "|".join(known) + r")\s*"
    whole = F.trim(F.regexp_replace(col(text), r"^\s+|\s+$", ""))
    c = F.regexp_replace(whole, lead, "")
    c = F.when(c != whole, F.regexp_replace(c, r"^## My request:\s*", "")).otherwise(c)
    return F.when(F.startswith(c, F.lit("# Context from my IDE setup:")) & F.contains(c, F.lit("## My request:")), F.regexp_replace(c, r"(?s)^.*?## My request:\s*", "")).otherwise(c)
