"""Problem candidates, placement, trees, chains and histories over many projects at once."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import candidate_id, normalize_identity
from tracemill.operators.graphs import connected_components
from tracemill.operators.scans import join_few, only_wanted, positioned
from tracemill.sources.shared import discard, materialize

# Replies that only steer a conversation, and envelopes that hold no question.
CONTROL_REPLY = r"^(?:[0-9]+|[一二三四五六七八九十]|(?:好的)?继续|确认|同意|符合|可以|允许|发布|补吧|好|好的|是|否|不|开始|重试)$"
MACHINE_TAGS = ("turn_aborted", "subagent_notification", "app-context", "environment_context", "recommended_plugins")


def candidate_eligible(question: str = "question") -> Column:
    """Not blank, no control reply, not wholly a machine's envelope."""
    t = F.trim(F.regexp_replace(F.col(question), r"^\s+|\s+$", ""))
    ok = (normalize_identity(question) != "") & ~F.rlike(normalize_identity(question), F.lit(CONTROL_REPLY))
    for tag in MACHINE_TAGS:
        ok = ok & ~(F.startswith(t, F.lit(f"<{tag}>")) & F.endswith(t, F.lit(f"</{tag}>")))
    return F.coalesce(ok, F.lit(False))


def discover_candidates(turns: DataFrame, rule_version: str = "placement-1", project: str = "project_id", question: str = "question", turn: str = "turn_unit_id", max_turns: int | None = None) -> DataFrame:
    """Eligible questions grouped by project and normalized text, with the ordered distinct turns that ask them.

    A question's turns become an array at this report's edge; ``max_turns`` bounds it (all turns are counted).
    """
    rows = turns.where(candidate_eligible(question)).withColumn("normalized", normalize_identity(question)).select(project, "normalized", turn).distinct()
    w = Window.partitionBy(project, "normalized").orderBy(turn)
    rows = rows.withColumn("__rn", F.row_number().over(w))
    keep = F.lit(True) if max_turns is None else F.col("__rn") <= max_turns
    got = rows.groupBy(project, "normalized").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.when(keep, F.col(turn)))).alias("turns"))
    return got.withColumn("candidate_id", candidate_id(F.col(project), F.col("normalized"), F.lit(rule_version)))


def unplaced_turns(turns: DataFrame, nodes: DataFrame, refs: Sequence[str] = ("session_id", "turn_unit_id")) -> DataFrame:
    """Turns that no node refers to yet (J18). nodes.source_turns: array of structs of ``refs``."""
    used = nodes.select(F.explode("source_turns").alias("t")).select(*(F.col(f"t.{r}").alias(f"__{r}") for r in refs)).distinct()
    on = F.lit(True)
    for r in refs:
        on = on & F.col(r).eqNullSafe(F.col(f"__{r}"))
    return turns.join(used, on, "left_anti")


def _grams(df: DataFrame, keys: Sequence[str], text: str, size: int, step: int = 64) -> DataFrame:
    """The distinct substrings of ``size`` code points of each row's text; none of shorter texts. Texts are cut every ``step`` first, as a substring is looked for from its text's start."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1), F.lit(step)), lambda i: F.substring(text, i, F.lit(step + size - 1)))
    grams = F.flatten(F.transform(pieces, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (size - 1)), lambda i: F.substring(t, i, F.lit(size)))))
    return df.where(F.length(text) >= size).select(*keys, F.explode(F.array_distinct(grams)).alias("gram"))


def contained_texts(questions: DataFrame, nodes: DataFrame, by: Sequence[str] = ("project_id",), question: str = "q", node: str = "n", size: int = 6) -> DataFrame:
    """Pairs of question and node (``by``, question_id, node_id) whose question contains the node's text, which is not empty.

    An inverted index instead of all pairs: of each node the gram of ``size`` code points that the fewest questions hold is its key, and only questions with that
    gram are compared with it. A node of which some gram is in no question is out. Shorter nodes are looked up whole among the questions' substrings of their length.
    Ids are unique within ``by``. What grams are joined to is written and counted, as the planner takes a row's grams for one row and would broadcast them all.
    Questions' grams are many times their text, so they are never shuffled as they are: a bitmap of those wanted goes first, they are counted before they are dealt, and
    only those of anchors are joined. Pairs meet the short text of the node before the long one of the question.
    """
    keys, gram = [*by, "question_id"], [*by, "gram"]
    q, n = questions.select(*keys, F.col(question).alias("__q")), nodes.select(*by, "node_id", F.col(node).alias("__n")).where("__n <> ''")
    long = n.where(F.length("__n") >= size)
    held = _grams(q, keys, "__q", size)
    wanted = _grams(long, [*by, "node_id"], "__n", size)
    often = materialize(only_wanted(held, wanted, gram).groupBy(*gram).agg(F.count("*").alias("many")))
    anchors = wanted.join(often.hint("merge"), gram, "left").groupBy(*by, "node_id").agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "gram")).alias("m"))
    anchors = materialize(anchors.where("m.many > 0").select(*by, "node_id", F.col("m.gram").alias("gram")))
    discard(often)
    met = materialize(join_few(only_wanted(held, anchors, gram), anchors, gram).select(*keys, "node_id"))
    met = met.join(long, [*by, "node_id"]).join(q, keys).where(F.contains("__q", "__n")).select(*keys, "node_id")
    short = materialize(n.where(F.length("__n") < size).select(*by, "node_id", F.col("__n").alias("gram")))
    for length in sorted(r[0] for r in short.select(F.length("gram")).distinct().collect()):
        some = short.where(F.length("gram") == length)
        met = met.unionByName(join_few(only_wanted(_grams(q, keys, "__q", length), some, gram), some, gram).select(*keys, "node_id"))
    return met


def recommend_placement(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where a question belongs (J17): merge with a node of the same text (the first by order), child of the only node
    whose question it contains, else pending. Containment is looked for within a project only, once for equal texts. question_id is unique.
    """
    q = questions.withColumn("__q", normalize_identity("question"))
    n = nodes.select("project_id", "node_id", "node_order", normalize_identity("question").alias("__n")).where("__n <> ''")
    # dealt to all tasks, as a row's grams are many more bytes than the row
    parts = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = materialize(q.select("project_id", "__q").distinct().repartition(parts).withColumn("question_id", F.monotonically_increasing_id()))
    # of the nodes of one text the least and the largest tell whether a question holds a single one
    said = n.groupBy("project_id", "__n").agg(F.min_by("node_id", F.struct("node_order", "node_id")).alias("same_node"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    said = materialize(said.withColumn("node_id", F.monotonically_increasing_id()))
    pairs = contained_texts(asked, said, question="__q", node="__n").join(said.select("project_id", "node_id", "lo", "hi"), ["project_id", "node_id"])
    inside = pairs.groupBy("project_id", "question_id").agg(F.min("lo").alias("held_node"), (F.min("lo") == F.max("hi")).alias("alone"))
    placed = asked.join(said.select("project_id", F.col("__n").alias("__q"), "same_node"), ["project_id", "__q"], "left").join(inside, ["project_id", "question_id"], "left").drop("question_id")
    rows = q.join(materialize(placed), ["project_id", "__q"], "left")
    discard(asked, said)
    action = F.when(F.col("same_node").isNotNull(), "merge").when(F.col("alone"), "child").otherwise("keep_pending")
    return rows.select(
        *questions.columns, action.alias("action"), F.when(action == "keep_pending", "low").otherwise("high").alias("confidence"),
        F.coalesce("same_node", F.when(F.col("alone"), F.col("held_node"))).alias("target"),
    )


def related_problems(milestones: DataFrame, nodes: DataFrame, refs: Sequence[str]) -> DataFrame:
    """Pairs of milestone and node that share a source turn exactly."""
    m = milestones.select("milestone_id", F.explode("source_turns").alias("t")).select("milestone_id", *(F.col(f"t.{r}").alias(r) for r in refs))
    n = nodes.select("node_id", F.explode("source_turns").alias("t")).select("node_id", *(F.col(f"t.{r}").alias(r) for r in refs))
    return m.join(n, list(refs)).select("milestone_id", "node_id").distinct()


def tree_paths(nodes: DataFrame, by: Sequence[str] = (), node: str = "node_id", parent: str = "parent_id", order: str | None = None) -> DataFrame:
    """Every node reached from a root, at any depth: depth, path of ids, and a key that sorts siblings in their order (G1).

    Each row holds a piece of its path; a round puts the piece of the row above in front, so pieces double and a chain of n nodes takes log2(n) rounds.
    Rows behind a missing node vanish, and those whose piece repeats a node, which are in a cycle or behind it.
    """
    key = F.format_string("%012d", F.col(order).cast("long")) if order else F.col(node).cast("string")
    state = materialize(nodes.select(*by, F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("up"), F.array(F.col(node).cast("string")).alias("path"), F.array(key).alias("sort_key")))
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"d.{c}").eqNullSafe(F.col(f"a.{c}"))
    while state.where("up IS NOT NULL").limit(1).count():
        below = state.where("up IS NOT NULL").alias("d").join(state.alias("a"), on & (F.col("d.up") == F.col("a.node"))).select(
            *(f"d.{c}" for c in (*by, "node")), F.col("a.up").alias("up"), F.concat("a.path", "d.path").alias("path"), F.concat("a.sort_key", "d.sort_key").alias("sort_key")
        ).where(F.size(F.array_distinct("path")) == F.size("path"))
        before, state = state, materialize(state.where("up IS NULL").unionByName(below))
        discard(before)
    return state.select(*by, "node", (F.size("path") - 1).alias("depth"), "path", "sort_key")


def _reached(nodes: DataFrame, by: Sequence[str], node: str, parent: str) -> DataFrame:
    """by, node: the nodes that a root reaches, at any depth. Distances double each round, so a chain of n nodes takes log2(n) joins."""
    state, waiting = materialize(nodes.select(*by, F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("up")).distinct()), -1
    while True:
        done = state.where("up IS NULL").select(*by, "node")
        left = state.join(done, [*by, "node"], "left_anti")
        n = left.select(*by, "node").distinct().count()
        if n in (0, waiting):  # none, or only those behind a cycle or a missing node
            return done
        waiting = n
        hop = done.withColumn("__up", F.lit(None).cast("string")).unionByName(left.withColumnRenamed("up", "__up")).withColumnRenamed("node", "up")
        state = materialize(done.withColumn("up", F.lit(None).cast("string")).unionByName(left.join(hop, [*by, "up"]).select(*by, "node", F.col("__up").alias("up")).distinct()))


def subtree(paths: DataFrame, node: str) -> DataFrame:
    """The node and what stands below it, in sibling order (G1)."""
    return paths.where(F.array_contains("path", node)).orderBy("sort_key")


def validate_tree(nodes: DataFrame, by: Sequence[str] = (), node: str = "node_id", parent: str = "parent_id", order: str = "sibling_order") -> DataFrame:
    """Violations (G2): missing_parent, self_parent, duplicate_order, duplicate_node, unreachable (a cycle above)."""
    out = lambda d, why: d.select(*by, F.col(node).cast("string").alias("node"), F.lit(why).alias("violation"))
    ids = nodes.select(*by, F.col(node).alias(parent)).distinct()
    missing = nodes.where(F.col(parent).isNotNull()).join(ids, [*by, parent], "left_anti")
    siblings = nodes.withColumn("__n", F.count("*").over(Window.partitionBy(*by, F.coalesce(F.col(parent).cast("string"), F.lit("")), order))).where("__n > 1")
    twice = nodes.groupBy(*by, node).count().where("count > 1")
    reached = _reached(nodes, by, node, parent)
    names = nodes.select(*by, F.col(node).cast("string").alias("node")).distinct()
    lost = names.join(reached, [*by, "node"], "left_anti").select(*by, "node", F.lit("unreachable").alias("violation"))
    return (
        out(missing, "missing_parent").unionByName(out(nodes.where(F.col(parent) == F.col(node)), "self_parent")).unionByName(out(siblings, "duplicate_order"))
        .unionByName(out(twice, "duplicate_node")).unionByName(lost)
    )


def order_by_supersession(decisions: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Decisions after all that they supersede, the smallest id first among the free (G3): position, null within or behind a cycle or a missing decision.

    decisions: by, decision_id string, supersedes array<string>; rows that repeat an id are one decision that supersedes what any of them does.

    Decisions that supersede each other, over any number of steps, are ordered together in a task. Taking the smallest first head of such sequences one after another is
    the same as sorting all by the largest id so far in their sequence, so a project's positions come from a sort; it may be larger than a task.
    """
    import heapq

    keys, same = [*by, "decision_id"], lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in by]
    some = F.coalesce("supersedes", F.array().cast("array<string>"))
    rows = decisions.select(*keys, some.alias("supersedes")).groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("supersedes"))).alias("supersedes"))
    rows = materialize(rows.withColumn("__n", F.monotonically_increasing_id()))  # written, so that the numbers stay
    to = rows.select(*by, "__n", F.explode("supersedes").alias("decision_id")).alias("x").join(rows.alias("y"), [*same("x", "y"), F.col("x.decision_id") == F.col("y.decision_id")])
    parts = connected_components(to.select(F.col("x.__n").alias("a"), F.col("y.__n").alias("b"))).select(F.col("id").alias("__n"), "component")
    rows = materialize(rows.join(parts, "__n", "left"))

    def order(group: pd.DataFrame) -> pd.DataFrame:
        waits = dict(zip(group["decision_id"], group["supersedes"]))
        later: dict[str, list[str]] = {}
        for d, s in waits.items():
            for x in s:
                later.setdefault(x, []).append(d)
        left = {d: len(s) for d, s in waits.items()}
        free = [d for d, n in left.items() if not n]
        heapq.heapify(free)
        place: dict[str, tuple[int, str]] = {}
        top = ""
        while free:
            d = heapq.heappop(free)
            top = max(top, d)
            place[d] = len(place), top
            for x in later.get(d, ()):
                left[x] -= 1
                if not left[x]:
                    heapq.heappush(free, x)
        found = [(n, *place[d]) for n, d in zip(group["__n"], group["decision_id"]) if d in place]
        return pd.DataFrame(found, columns=["__n", "__place", "__top"], dtype=object)

    together = rows.where("component IS NOT NULL").select("component", "__n", "decision_id", "supersedes").groupBy("component").applyInPandas(order, "__n long, __place long, __top string")
    alone = rows.where("component IS NULL AND size(supersedes) = 0").select("__n", F.lit(0).cast("long").alias("__place"), F.col("decision_id").alias("__top"))
    ordered = positioned(rows.join(together.unionByName(alone), "__n").select(*keys, "__top", "__place"), by, ["__top", "__place"])
    return decisions.select(*keys).alias("d").join(ordered.alias("o"), [*same("d", "o"), F.col("d.decision_id") == F.col("o.decision_id")], "left").select(*(f"d.{c}" for c in keys), "o.position")


def validate_session_chain(reports: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Per project: heads, tails, one-sided links, sessions that a head reaches; valid if one chain holds all (G4). reports: by, session_id, previous_id, next_id.

    Distances from the head double each round, so a chain of n sessions takes log2(n) joins.
    """
    links = reports.select(*by, "session_id", "previous_id", "next_id")
    back = links.select(*by, F.col("session_id").alias("previous_id"), F.col("next_id").alias("__back"))
    fore = links.select(*by, F.col("session_id").alias("next_id"), F.col("previous_id").alias("__fore"))
    checked = links.join(back, [*by, "previous_id"], "left").join(fore, [*by, "next_id"], "left")
    one_sided = (F.col("previous_id").isNotNull() & ~F.col("__back").eqNullSafe(F.col("session_id"))) | (F.col("next_id").isNotNull() & ~F.col("__fore").eqNullSafe(F.col("session_id")))
    reached = _reached(links, by, "session_id", "previous_id").distinct().groupBy(*by).agg(F.count("*").alias("reached"))
    got = checked.groupBy(*by).agg(
        F.count("*").alias("sessions"), F.count_if(F.col("previous_id").isNull()).alias("heads"), F.count_if(F.col("next_id").isNull()).alias("tails"), F.count_if(one_sided).alias("one_sided")
    ).join(reached, list(by), "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    return got.withColumn("valid", (F.col("heads") == 1) & (F.col("tails") == 1) & (F.col("one_sided") == 0) & (F.col("reached") == F.col("sessions")))


def validate_price_chain(snapshots: DataFrame) -> DataFrame:
    """Violations of supersession (G5): missing, fork, identity_changed, cycle. snapshots: snapshot_id, identity, supersedes."""
    s = snapshots.select("snapshot_id", "identity", "supersedes")
    old = s.select(F.col("snapshot_id").alias("supersedes"), F.col("identity").alias("__old"))
    out = lambda d, why: d.select("snapshot_id", F.lit(why).alias("violation"))
    missing = s.where("supersedes IS NOT NULL").join(old, "supersedes", "left_anti")
    fork = s.where("supersedes IS NOT NULL").withColumn("__n", F.count("*").over(Window.partitionBy("supersedes"))).where("__n > 1")
    other = s.join(old, "supersedes").where(~F.col("identity").eqNullSafe(F.col("__old")))
    reached = _reached(s, (), "snapshot_id", "supersedes").withColumnRenamed("node", "snapshot_id")
    lost = s.join(reached, "snapshot_id", "left_anti").join(missing.select("snapshot_id"), "snapshot_id", "left_anti")
    return out(missing, "missing").unionByName(out(fork, "fork")).unionByName(out(other, "identity_changed")).unionByName(out(lost, "cycle"))


def edges(events: DataFrame | None = None, sessions: DataFrame | None = None, decisions: DataFrame | None = None, loops: DataFrame | None = None) -> DataFrame:
    """Edge lists of a history (G6): event and session to decision and loop, decision to superseded, loop to blocker. Each has id and arrays of ids."""
    out = None
    for frame, kind, columns in ((events, "event", ("decisions", "loops")), (sessions, "session", ("decisions", "loops")), (decisions, "decision", ("supersedes",)), (loops, "loop", ("blockers",))):
        for c in columns if frame is not None else ():
            part = frame.select(F.lit(kind).alias("from_kind"), F.col("id").alias("from_id"), F.lit(c).alias("relation"), F.explode(F.array_distinct(c)).alias("to_id"))
            out = part if out is None else out.unionByName(part)
    return out


def themes(decisions: DataFrame, loops: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Per tag the decisions and the loops still open (A15). decisions: by, id, tags; loops: by, id, tags, resolved."""
    d = decisions.select(*by, "id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy(*by, "tag").agg(F.array_sort(F.collect_set("id")).alias("decision_ids"))
    o = loops.where("NOT resolved").select(*by, "id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy(*by, "tag").agg(F.array_sort(F.collect_set("id")).alias("open_loop_ids"))
    none = F.array().cast("array<string>")
    return d.join(o, [*by, "tag"], "full_outer").select(*by, "tag", F.coalesce("decision_ids", none).alias("decision_ids"), F.coalesce("open_loop_ids", none).alias("open_loop_ids"))


def reconcile_candidates(previous: DataFrame, discovered: DataFrame, now: Column) -> DataFrame:
    """Candidates carried on (V1): human rows and statuses stay, stale ones revive, vanished ones go stale, new ones are pending; the revision
    grows only with a change. Columns: candidate_id, status, revision, origin, turns (array), updated_at; ``discovered`` has candidate_id and turns.
    """
    p = previous.select("candidate_id", F.lit(True).alias("__p"), "status", "revision", "origin", F.col("turns").alias("__t"), "updated_at")
    d = discovered.select("candidate_id", F.lit(True).alias("__d"), F.array_sort("turns").alias("__n"))
    rows = p.join(d, "candidate_id", "full_outer")
    new, gone, human = F.col("__p").isNull(), F.col("__d").isNull(), F.col("origin") == "human"
    status = F.when(new, "pending").when(human, F.col("status")).when(gone & (F.col("status") == "pending"), "stale").when(~gone & (F.col("status") == "stale"), "pending").otherwise(F.col("status"))
    turns = F.when(new, F.col("__n")).when(human | gone, F.col("__t")).otherwise(F.col("__n"))
    changed = new | ~status.eqNullSafe(F.col("status")) | ~turns.eqNullSafe(F.array_sort("__t"))
    return rows.select(
        "candidate_id", status.alias("status"), F.when(new, 1).when(changed, F.col("revision") + 1).otherwise(F.col("revision")).cast("long").alias("revision"),
        F.coalesce("origin", F.lit("rule")).alias("origin"), turns.alias("turns"), F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
