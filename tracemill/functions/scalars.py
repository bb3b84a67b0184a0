"""Column functions over single values; all of them stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of events shown to the public, by kind of observation.
PUBLIC_KINDS = {
    "request": "message", "tool": "tool_call", "command": "command", "file": "file_change", "test": "verification", "build": "verification",
    "lint": "verification", "verification": "verification", "error": "error", "artifact": "artifact", "commit": "artifact", "release": "artifact",
    "deployment": "artifact", "branch": "artifact", "git_status": "artifact", "sync": "artifact", "tag": "artifact", "version": "artifact",
}
# Outcomes that count as failed and as passed.
FAILED = ("failed", "failure", "error")
PASSED = ("passed", "success")
MAX_SAFE = 2**53 - 1


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def millis(c: str | Column) -> Column:
    """Milliseconds since the epoch of a timestamp with or without a zone (then that of the session)."""
    return F.unix_millis(col(c).cast("timestamp"))


def micros(c: str | Column) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def collapse_space(s: str | Column) -> Column:
    """Any run of Unicode white space becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col(s), r"[\s\p{Z}]+", " "))


def normalize_identity(s: str | Column) -> Column:
    return F.lower(collapse_space(s))


def normalized_outcome(s: str | Column) -> Column:
    """failure, success or the empty string; null counts as empty."""
    v = normalize_identity(F.coalesce(col(s), F.lit("")))
    return F.when(v.isin(*FAILED), "failure").when(v.isin(*PASSED), "success").otherwise("")


def public_event_kind(kind: str | Column) -> Column:
    """The public kind, null where the observation is not public."""
    pairs = [F.lit(x) for kv in PUBLIC_KINDS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(kind))


def normalize_path(path: str | Column) -> Column:
    """Forward slashes, no empty or ``.`` segments, ``..`` resolved; a rooted path stays rooted."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    rooted = F.startswith(p, F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    pop = lambda a: F.slice(a, 1, F.size(a) - 1)
    stack = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, x: F.when(
            x == "..", F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), pop(a)).when(rooted, a).otherwise(F.array_append(a, x))
        ).otherwise(F.array_append(a, x)),
    )
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(stack, "/"))


def shannon_entropy(s: str | Column) -> Column:
    """Bits a character of a string's character distribution; 0 for the empty string."""
    letters = F.filter(F.split(col(s), ""), lambda x: x != "")
    n = F.size(letters)
    share = lambda x: F.size(F.filter(letters, lambda y: y == x)) / n
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, x: acc - share(x) * F.log2(share(x))))


def truncate_utf8(s: str | Column, max_bytes: int, suffix: str = "…") -> Column:
    """At most ``max_bytes`` bytes of UTF-8, cut between characters, with ``suffix`` where something was cut."""
    c = col(s)
    room = max_bytes - len(suffix.encode())
    # a character has 1 to 4 bytes: the longest prefix that fits lies among at most ``room`` characters
    letters = F.split(F.substring(c, 1, room), "")
    fit = F.aggregate(
        letters, F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda a, x: F.struct(
            F.when(a.open & (a.b + F.octet_length(x) <= room), a.b + F.octet_length(x)).otherwise(a.b).alias("b"),
            F.when(a.open & (a.b + F.octet_length(x) <= room), a.n + F.length(x)).otherwise(a.n).alias("n"),
            (a.open & (a.b + F.octet_length(x) <= room)).alias("open"),
        ),
    )
    return F.when(F.octet_length(c) <= max_bytes, c).otherwise(F.concat(F.substring(c, F.lit(1), fit.n), F.lit(suffix)))


def truncate_chars(s: str | Column, max_chars: int, suffix: str = "…") -> Column:
    c = col(s)
    return F.when(F.char_length(c) <= max_chars, c).otherwise(F.concat(F.substring(c, 1, max_chars - len(suffix)), F.lit(suffix)))


def single_line(s: str | Column) -> Column:
    """Control characters become spaces, runs of white space one space."""
    return collapse_space(F.regexp_replace(col(s), r"[\x00-\x1f\x7f]", " "))


def request_title(s: str | Column, max_chars: int = 160) -> Column:
    """What follows the last ``## My request:`` mark, in one line, bounded."""
    return truncate_chars(single_line(F.substring_index(col(s), "## My request:", -1)), max_chars)


def format_duration_ms(ms: str | Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s; null stays null."""
    s = (col(ms) / 1000).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m "), two(r), F.lit("s")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(r), F.lit("s")))
        .otherwise(F.concat(r.cast("string"), F.lit("s")))
    )


def format_integer(n: str | Column) -> Column:
    return F.format_number(col(n), 0)


def recency_bucket(reference: str | Column, ts: str | Column) -> Column:
    """3 within 7 days, 2 within 30, 1 within 90, else 0."""
    age = micros(col(reference)) - micros(col(ts))
    day = 86_400_000_000
    return F.when(age <= 7 * day, 3).when(age <= 30 * day, 2).when(age <= 90 * day, 1).otherwise(0)


def freshness(retrieved: str | Column, now: str | Column) -> Column:
    """current up to 24 hours, stale up to 7 days, then expired."""
    age = micros(col(now)) - micros(col(retrieved))
    return F.when(age <= 86_400_000_000, "current").when(age <= 7 * 86_400_000_000, "stale").otherwise("expired")


def duration_ms(start: str | Column, end: str | Column) -> Column:
    """Milliseconds from start to end; null unless both are known and ordered."""
    d = millis(col(end)) - millis(col(start))
    return F.when(d >= 0, d)


def valid_usage(input_: Column, cached: Column, cache_write: Column, output: Column, reasoning: Column, total: Column) -> Column:
    """No class negative or over 2^53 - 1, cached classes within the input, total = input + output."""
    bounded = [(x >= 0) & (x <= MAX_SAFE) for x in (input_, cached, cache_write, output, reasoning, total)]
    ok = bounded[0]
    for b in bounded[1:]:
        ok = ok & b
    return F.coalesce(ok & (cached + cache_write <= input_) & (total == input_ + output), F.lit(False))


def price_usage(input_: Column, cached: Column, cache_write: Column, output: Column, rates: Sequence[Column]) -> Column:
    """USD for a usage at per-million rates of (uncached input, cached, cache write, output); reasoning is part of output."""
    quantities = (input_ - cached - cache_write, cached, cache_write, output)
    return sum((q.cast("double") * r for q, r in zip(quantities, rates)), F.lit(0.0)) / F.lit(1_000_000)


def line_costs(names: Sequence[str], quantities: Sequence[Column], rates: Sequence[Column]) -> Column:
    """struct(costs by name, missing names, complete, known_subtotal, total): a null rate is unknown, and matters only with a quantity."""
    costs = [F.when(q == 0, F.lit(0.0)).otherwise(q.cast("double") * r / 1_000_000) for q, r in zip(quantities, rates)]
    missing = F.array_compact(F.array(*(F.when((q > 0) & r.isNull(), F.lit(n)) for n, q, r in zip(names, quantities, rates))))
    known = sum((F.coalesce(c, F.lit(0.0)) for c in costs), F.lit(0.0))
    complete = F.size(missing) == 0
    return F.struct(
        F.struct(*(c.alias(n) for n, c in zip(names, costs))).alias("costs"), missing.alias("missing"), complete.alias("complete"),
        known.alias("known_subtotal"), F.when(complete, known).alias("total"),
    )


def sorted_map(m: str | Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(col(m))))


def digest(*columns: Column, maps: Sequence[str] = ()) -> Column:
    """SHA-256 of canonical JSON: fields sorted by name, nulls kept, maps with sorted keys."""
    named = sorted(columns, key=lambda c: c._jc.toString() if hasattr(c, "_jc") else str(c))
    fields = [sorted_map(c) if str(c) in maps else c for c in named]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def content_id(prefix: str, *columns: Column) -> Column:
    """Identity by content: ``prefix`` and the SHA-256 of the values, each preceded by its presence and separated by NUL."""
    parts = [F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0")) for c in columns]
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\x00", *parts), 256))


def revision_id(*key: Column) -> Column:
    return content_id("rev-", *key)


def turn_unit_id(session: Column, ordinal: Column) -> Column:
    return content_id("turn-", session, ordinal)


def milestone_id(turn: Column, revision: Column) -> Column:
    return content_id("milestone-", turn, revision)


def candidate_id(*identity: Column) -> Column:
    return content_id("candidate-", *identity)


def problem_id(*identity: Column) -> Column:
    return content_id("problem-", *identity)


def derived_id(kind: Column, subject: Column, dependencies: Column) -> Column:
    return content_id("derived-", kind, subject, F.array_join(dependencies, "\x00"))


def fact_text(label: Column, outcome: Column, exit_code: Column, excerpt: Column) -> Column:
    """label · outcome · exit code · excerpt, without what is empty."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(" · ", blank(label), blank(outcome), F.concat(F.lit("exit code "), exit_code.cast("string")), blank(excerpt))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns))


def bounded(c: Column, low: float, high: float) -> Column:
    return F.coalesce((c >= low) & (c <= high), F.lit(False))
