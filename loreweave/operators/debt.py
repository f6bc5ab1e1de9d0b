"""Debt: what is open, unverified, failing or in breach of a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from .scans import P, register_sessions, unresolved

_ITEM = ["debt_type", "node_ids", "description", "severity"]


def severity_points(severity: Column) -> Column:
    out = F.lit(1)
    for name, points in schema.SEVERITY.items():
        out = F.when(severity == name, points).otherwise(out)
    return out


def unresolved_open_items(nodes: DataFrame, edges: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """High where the item's session is not the current (last) one; unknown sessions have age 0."""
    sessions = register_sessions(nodes) if sessions is None else sessions
    now = sessions.groupBy(P).agg(F.max("session_index").alias("now"))
    items = unresolved(nodes, edges).join(sessions, [P, "session_id"], "left").join(now, P, "left")
    age = F.greatest(F.coalesce(F.col("now") - F.col("session_index"), F.lit(0)), F.lit(0))
    return items.select(
        P, F.lit("UnresolvedOpenItem").alias("debt_type"), F.array("id").alias("node_ids"),
        F.format_string("Open item '%s' raised by %s has not been resolved", "label", "agent_id").alias("description"),
        F.when(age >= 1, "High").otherwise("Medium").alias("severity"), "seq",
    )


def scratch(tool_events: DataFrame, keep: int = 100, sessions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edits, checks) of the tool events, the last `keep` of each per session; optionally only the last active sessions."""
    rows = tool_events.withColumn("class", tx.tool_class(F.col("tool_name"), F.col("text")))
    if sessions is not None:
        active = tool_events.groupBy(P, "session_id").agg(F.max("seq").alias("last"))
        place = F.row_number().over(Window.partitionBy(P).orderBy(F.col("last").desc(), "session_id"))
        rows = rows.join(active.withColumn("place", place).where(F.col("place") <= sessions).select(P, "session_id"), [P, "session_id"], "left_semi")
    ring = F.row_number().over(Window.partitionBy(P, "session_id", "class").orderBy(F.col("seq").desc(), "id"))
    rows = rows.where("class <> 'Read'").withColumn("ring", ring).where(F.col("ring") <= keep)
    columns = [P, "session_id", "id", "tool_name", "files", F.col("end_time").alias("timestamp"), "seq"]
    return rows.where("class = 'Write'").select(columns), rows.where("class = 'Check'").select(*columns, tx.check_passed(F.col("text")).alias("passed"))


def current_sessions(tool_events: DataFrame) -> DataFrame:
    """(project_id, session_id): the session that was active last."""
    return tool_events.groupBy(P).agg(F.max_by("session_id", F.struct("seq", "id")).alias("session_id"))


def _few(files: str) -> Column:
    return F.array_join(F.slice(files, 1, 3), ", ")


def unverified_changes(edits: DataFrame, checks: DataFrame) -> DataFrame:
    """Edits with files that no check of the session, passed or failed, follows on any of them."""
    last = checks.select(P, "session_id", F.explode("files").alias("file"), "timestamp").groupBy(P, "session_id", "file").agg(F.max("timestamp").alias("checked"))
    each = edits.select(P, "session_id", "id", "timestamp", F.explode("files").alias("file"))
    seen = each.join(last, [P, "session_id", "file"]).where("checked >= timestamp").select(P, "session_id", "id").distinct()
    left = edits.where("size(files) > 0").join(seen, [P, "session_id", "id"], "left_anti")
    return left.select(P, F.lit("UnverifiedChange").alias("debt_type"), F.array("id").alias("node_ids"), F.format_string("Edited '%s' via %s — no test/lint/build run covered it afterwards", _few("files"), "tool_name").alias("description"), F.lit("Medium").alias("severity"), "seq")


def failed_verifications(edits: DataFrame, checks: DataFrame) -> DataFrame:
    """Failed checks that are the latest of some file (first wins on equal time) and that no later edit touches."""
    each = checks.select("*", F.explode("files").alias("file"))
    order = Window.partitionBy(P, "session_id", "file").orderBy(F.col("timestamp").desc(), "seq")
    failed = each.withColumn("place", F.row_number().over(order)).where("place = 1 AND NOT passed").select(P, "session_id", "id").distinct()
    edited = edits.select(P, "session_id", F.explode("files").alias("file"), F.col("timestamp").alias("edited")).groupBy(P, "session_id", "file").agg(F.max("edited").alias("edited"))
    cleared = each.join(edited, [P, "session_id", "file"]).where("edited >= timestamp").select(P, "session_id", "id").distinct()
    left = checks.join(failed, [P, "session_id", "id"], "left_semi").join(cleared, [P, "session_id", "id"], "left_anti")
    return left.select(P, F.lit("FailedVerification").alias("debt_type"), F.array("id").alias("node_ids"), F.format_string("Check '%s' on '%s' failed — no fix attempted since", "tool_name", _few("files")).alias("description"), F.lit("High").alias("severity"), "seq")


def rule_violations(checks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Failed checks on files of an active rule, with the earliest inserted such rule."""
    rules = nodes.where("node_type = 'Rule' AND status = 'Active'").select(P, F.col("id").alias("rule"), "label", F.col("seq").alias("rule_seq"), F.explode("files").alias("file"))
    first = rules.groupBy(P, "file").agg(F.min(F.struct("rule_seq", "rule", "label")).alias("first"))
    hit = checks.where("NOT passed").select(P, "id", "tool_name", "seq", F.explode("files").alias("file")).join(first, [P, "file"])
    hit = hit.groupBy(P, "id", "tool_name", "seq").agg(F.min("first").alias("first"))
    return hit.select(P, F.lit("RuleViolation").alias("debt_type"), F.array("id", "first.rule").alias("node_ids"), F.format_string("Check '%s' failed on files under rule '%s' — possible violation", "tool_name", "first.label").alias("description"), F.lit("High").alias("severity"), "seq")


def debt_items(nodes: DataFrame, edges: DataFrame, tool_events: DataFrame | None = None) -> DataFrame:
    items = unresolved_open_items(nodes, edges)
    if tool_events is not None:
        edits, checks = scratch(tool_events)
        for more in (unverified_changes(edits, checks), failed_verifications(edits, checks), rule_violations(checks, nodes)):
            items = items.unionByName(more)
    return items


def debt_band(total_score: Column) -> Column:
    """Of a whole report: green without debt, amber below five points, else red."""
    return F.when(total_score == 0, "green").when(total_score < 5, "amber").otherwise("red")


def debt_report(items: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """One row per project: number of items, total score and its band. projects: (project_id) of all projects, so that those without debt have a row too."""
    sums = items.groupBy(P).agg(F.count("*").alias("n_items"), F.sum(severity_points(F.col("severity"))).alias("total_score"))
    if projects is not None:
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        sums = projects.select(P).distinct().join(sums, P, "left").select(P, zero("n_items"), zero("total_score"))
    return sums.withColumn("band", debt_band(F.col("total_score")))


def debt_by_type(items: DataFrame) -> DataFrame:
    """(project_id, debt_type, n, band): the count of each type, and beside each the band of the project's total score; a project without debt has no row, see debt_report()."""
    types = items.groupBy(P, "debt_type").agg(F.count("*").alias("n"), F.sum(severity_points(F.col("severity"))).alias("score"))
    return types.select(P, "debt_type", "n", debt_band(F.sum("score").over(Window.partitionBy(P))).alias("band"))


def debt_delta(current: DataFrame, prior: DataFrame) -> DataFrame:
    """(project_id, new_items, resolved_items, persisted_items, net) by (type, sorted ids)."""
    key = lambda d, name: d.select(P, "debt_type", F.array_sort("node_ids").alias("ids")).distinct().withColumn(name, F.lit(1))
    both = key(current, "now").join(key(prior, "was"), [P, "debt_type", "ids"], "full")
    count = lambda c: F.count(F.when(c, 1))
    new, gone = count(F.col("was").isNull()), count(F.col("now").isNull())
    return both.groupBy(P).agg(new.alias("new_items"), gone.alias("resolved_items"), count(F.col("was") + F.col("now") == 2).alias("persisted_items"), (new - gone).alias("net"))


def debt_over_sessions(nodes: DataFrame, edges: DataFrame, tool_events: DataFrame, keep: int = 100, active: int = 16) -> DataFrame:
    """The debt report as of the end of every session, in one job: (project_id, session_id, session_index, open_items, unverified, failing,
    violations, raised, total_score), raised being the items that are new in the session.

    Sessions are numbered by their first row in nodes or tool events. Each item stands from one session to another, and what stands at a
    session is a running sum of the steps up and down. An open item stands from its own session (as Medium there, as High later) to the one
    that resolves it. What a session's tools left open at its end (edits no check followed, failed checks no edit followed, failed checks under
    a rule) stands while the session is among the `active` latest; a violation starts no earlier than the rule.
    """
    sessions = register_sessions(nodes.select(P, "session_id", "seq").union(tool_events.select(P, "session_id", "seq")))
    of = lambda d, name: d.join(sessions, [P, "session_id"]).withColumnRenamed("session_index", name)
    born = of(nodes.where("node_type = 'OpenItem' AND status <> 'Invalidated'"), "born").select(P, "id", "born")
    resolver = of(nodes, "done").select(P, F.col("id").alias("source_node_id"), "done")
    ends = edges.where("edge_type = 'Resolves'").join(resolver, [P, "source_node_id"]).groupBy(P, F.col("target_node_id").alias("id")).agg(F.min("done").alias("done"))
    open_items = born.join(ends, [P, "id"], "left").where("done IS NULL OR done > born").select(P, F.lit("open").alias("kind"), "born", "done")
    edits, checks = scratch(tool_events, keep)
    events = edits.select(P, "id", "session_id").union(checks.select(P, "id", "session_id"))
    first = lambda d: d.select(P, F.col("node_ids")[0].alias("id"))
    spans = open_items
    for kind, found in (("unverified", unverified_changes(edits, checks)), ("failing", failed_verifications(edits, checks))):
        own = of(first(found).join(events, [P, "id"]), "born")
        spans = spans.union(own.select(P, F.lit(kind), "born", F.col("born") + active))
    rules = of(nodes.where("node_type = 'Rule' AND status = 'Active'").select(P, "session_id", F.explode("files").alias("file")), "since").groupBy(P, "file").agg(F.min("since").alias("since"))
    failed = of(checks.where("NOT passed").select(P, "id", "session_id", F.explode("files").alias("file")), "own").join(rules, [P, "file"])
    failed = failed.groupBy(P, "id").agg(F.max("own").alias("own"), F.min("since").alias("since")).where(F.col("since") < F.col("own") + active)
    spans = spans.union(failed.select(P, F.lit("violations"), F.greatest("own", "since"), F.col("own") + active))

    kinds = {"open": "open_items", "unverified": "unverified", "failing": "failing", "violations": "violations"}
    moves = spans.select(P, "kind", F.explode(F.array(F.struct(F.col("born").alias("session_index"), F.lit(1).alias("step")), F.struct(F.col("done").alias("session_index"), F.lit(-1).alias("step")))).alias("m"))
    moves = moves.select(P, "kind", "m.*").where("session_index IS NOT NULL")
    steps = moves.groupBy(P, "session_index").agg(
        *(F.sum(F.when(F.col("kind") == kind, F.col("step"))).alias(name) for kind, name in kinds.items()),
        F.count(F.when(F.col("step") > 0, 1)).alias("raised"), F.count(F.when((F.col("step") > 0) & (F.col("kind") == "open"), 1)).alias("fresh"),
    )
    run = Window.partitionBy(P).orderBy("session_index")
    per = sessions.join(steps, [P, "session_index"], "left")
    for name in kinds.values():
        per = per.withColumn(name, F.sum(F.coalesce(name, F.lit(0))).over(run).cast("long"))
    fresh, raised = F.coalesce("fresh", F.lit(0)), F.coalesce("raised", F.lit(0)).cast("long").alias("raised")
    score = 3 * (F.col("open_items") + F.col("failing") + F.col("violations")) - fresh + 2 * F.col("unverified")
    return per.select(P, "session_id", "session_index", *kinds.values(), raised, score.cast("long").alias("total_score"))
