"""Decisions, risks, summaries and snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .debt import debt_delta, unresolved_open_items
from .scans import P, register_sessions


def _flags(edges: DataFrame, end: str, kinds: dict[str, str]) -> DataFrame:
    return edges.groupBy(P, F.col(end).alias("id")).agg(*(F.max(F.col("edge_type") == kind).alias(name) for name, kind in kinds.items()))


def decision_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Decisions that are not invalidated, as Superseded, Validated, Blocked or Pending."""
    into = _flags(edges, "target_node_id", {"superseded": "Supersedes", "grounded": "RelatesTo", "refuted": "Refutes"})
    out = _flags(edges, "source_node_id", {"resolves": "Resolves"})
    rows = nodes.where("node_type = 'Decision' AND status <> 'Invalidated'").join(into, [P, "id"], "left").join(out, [P, "id"], "left")
    status = F.when(F.col("superseded"), "Superseded").when(F.col("grounded") & F.col("resolves"), "Validated").when(F.col("refuted") & ~F.coalesce("resolves", F.lit(False)), "Blocked").otherwise("Pending")
    return rows.select(P, "id", "label", "description", "agent_id", "session_id", "timestamp", "seq", status.alias("decision_status"))


def decision_rationale(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What grounds, refutes or supersedes a decision, newest edge first; else who made it."""
    short = register_sessions(nodes).select(P, "session_id", F.concat(F.lit("S"), F.col("session_index") + 1).alias("short"))
    source = nodes.select(P, F.col("id").alias("source_node_id"), "agent_id", "session_id").join(short, [P, "session_id"], "left")
    verb = F.when(F.col("edge_type") == "RelatesTo", "Grounded by ").when(F.col("edge_type") == "Refutes", "Refuted by ").when(F.col("edge_type") == "Supersedes", "Superseded by ")
    line = F.concat(verb, "agent_id", F.lit(" ("), F.coalesce("short", "session_id"), F.lit("): "), "reasoning")
    lines = edges.where("edge_type <> 'Resolves'").join(source, [P, "source_node_id"]).groupBy(P, F.col("target_node_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("seq")).alias("o"), F.col("id").alias("e"), line.alias("line")))).alias("lines")
    )
    made = nodes.where("node_type = 'Decision' AND status <> 'Invalidated'").join(short, [P, "session_id"], "left").join(lines, [P, "id"], "left")
    default = F.concat(F.lit("Decision made by "), "agent_id", F.lit(" in "), F.coalesce("short", "session_id"), F.lit(": "), "description")
    return made.select(P, "id", F.coalesce(F.array_join(F.col("lines.line"), "; "), default).alias("rationale"))


def reach(starts: DataFrame, edges: DataFrame, hops: int, edge_type: str | None = None) -> DataFrame:
    """(project_id, start) -> (project_id, start, id): nodes within `hops` outgoing edges, the start itself left out."""
    steps = edges.where(F.col("edge_type") == edge_type) if edge_type else edges
    steps = steps.select(P, F.col("source_node_id").alias("at"), F.col("target_node_id").alias("next")).distinct()
    front = starts.select(P, "start", F.col("start").alias("at"))
    found = None
    for _ in range(hops):
        front = front.join(steps, [P, "at"]).select(P, "start", F.col("next").alias("at")).distinct()
        found = front if found is None else found.union(front)
    return found.where("at <> start").distinct().withColumnRenamed("at", "id")


def least_reached(edges: DataFrame, hops: int, most: int) -> DataFrame:
    """(project_id, id, least): the `most` smallest ids within `hops` outgoing edges of each node that has any, in order; the node itself is among
    them if a cycle leads back. A node takes over at most so many ids of each neighbour, and the smallest of all are among these, so a hub
    of any degree makes bounded rows at every hop."""
    steps = edges.select(P, F.col("source_node_id").alias("id"), F.col("target_node_id").alias("next")).distinct()
    kept = None
    place = F.row_number().over(Window.partitionBy(P, "id").orderBy("reached"))  # cut before and after its shuffle
    for hop in range(hops):
        near = steps.select(P, "id", F.col("next").alias("reached"))
        if kept is not None:
            far = kept.select(P, F.col("id").alias("next"), "reached")
            near = near.union(steps.join(far, [P, "next"]).select(P, "id", "reached")).distinct()
        kept = near.withColumn("place", place).where(F.col("place") <= most).drop("place")
    return kept.groupBy(P, "id").agg(F.array_sort(F.collect_list("reached")).alias("least"))


def decision_blocked_work(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """Labels of direct RelatesTo targets and of OpenItems within two such hops: sorted, distinct, the first ten."""
    made = nodes.where("node_type = 'Decision' AND status <> 'Invalidated'").select(P, F.col("id").alias("start"))
    near = edges.where("edge_type = 'RelatesTo'").select(P, F.col("source_node_id").alias("start"), F.col("target_node_id").alias("id"))
    far = reach(made, edges, 2, "RelatesTo").join(nodes.where("node_type = 'OpenItem'").select(P, "id"), [P, "id"], "left_semi").select(P, "start", "id")
    labels = near.union(far).join(nodes.select(P, "id", "label"), [P, "id"]).groupBy(P, "start").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    none = F.array().cast("array<string>")
    return made.join(labels, [P, "start"], "left").select(P, F.col("start").alias("id"), F.slice(F.coalesce("labels", none), 1, most).alias("blocked_work"))


def decision_validation_criteria(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    items = nodes.where("node_type = 'OpenItem'").select(P, F.col("id").alias("target_node_id"), "label")
    done = edges.where("edge_type = 'Resolves'").join(items, [P, "target_node_id"])
    line = F.concat(F.lit("Resolves open item: "), "label")
    lists = done.groupBy(P, F.col("source_node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("seq")).alias("o"), F.col("target_node_id").alias("t"), line.alias("line")))).alias("lines"))
    made = nodes.where("node_type = 'Decision' AND status <> 'Invalidated'").select(P, "id")
    none = F.array().cast("array<string>")
    return made.join(lists, [P, "id"], "left").select(P, "id", F.coalesce("lines.line", none).alias("criteria"))


def decision_timeline(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = decision_status(nodes, edges)
    for more in (decision_rationale(nodes, edges), decision_blocked_work(nodes, edges), decision_validation_criteria(nodes, edges)):
        rows = rows.join(more, [P, "id"], "left")
    return rows.withColumn("owner", F.when(F.col("agent_id") != "", F.col("agent_id")))


def risks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One per open item in debt: impact from what is downstream and how recent its session is. downstream counts to four, all that the impact
    needs, so that no node's whole reach is built; decision-wide counts come from reach()."""
    sessions = register_sessions(nodes)
    now = sessions.groupBy(P).agg(F.max("session_index").alias("now"))
    items = unresolved_open_items(nodes, edges, sessions).select(P, F.col("node_ids")[0].alias("id"), "severity")
    others = F.size(F.filter("least", lambda x: x != F.col("id")))
    down = least_reached(edges, 3, 5).select(P, "id", F.least(others, F.lit(4)).alias("downstream"))
    rows = items.join(nodes.select(P, "id", "label", "session_id"), [P, "id"]).join(down, [P, "id"], "left").join(sessions, [P, "session_id"], "left").join(now, P)
    n = F.coalesce("downstream", F.lit(0))
    recent = F.when(F.col("session_index").isNull(), 0).when(F.col("session_index") >= F.col("now") - 1, 20).otherwise(5)
    impact = F.greatest(F.least(n / 4 * 60 + recent, F.lit(100.0)), F.lit(5.0))
    return rows.select(P, "id", "label", "severity", n.cast("long").alias("downstream"), F.round(impact).cast("long").alias("impact"), F.lit("Unvalidated").alias("risk_status"))


def diff_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project_id, id, change): added or removed."""
    a, b = before.select(P, "id").distinct(), after.select(P, "id").distinct()
    return b.join(a, [P, "id"], "left_anti").withColumn("change", F.lit("added")).union(a.join(b, [P, "id"], "left_anti").withColumn("change", F.lit("removed")))


def diff_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project_id, id, fields): the fields that differ, in a fixed order."""
    names = ["label", "description", "node_type", "agent_id"]
    both = before.select(P, "id", *(F.col(c).alias(f"old_{c}") for c in [*names, "confidence"])).join(after, [P, "id"])
    tests = [F.when(~F.col(f"old_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in names]
    tests.append(F.when(F.abs(F.col("old_confidence") - F.col("confidence")) > 0.01, F.lit("confidence")))
    return both.select(P, "id", F.filter(F.array(*tests), lambda x: x.isNotNull()).alias("fields")).where("size(fields) > 0")


def record_history(history: DataFrame | None, snapshot: DataFrame, t: float) -> DataFrame:
    """The history of a keyed table (project_id, id, ...) with one more snapshot: a row a version, valid from valid_from to before valid_to (null: still).
    Versions that the snapshot lacks or has otherwise are closed at t, and what it has anew is opened; only open versions are compared."""
    columns = [c for c in snapshot.columns if c not in (P, "id")]
    fresh = snapshot.select(P, "id", *columns, F.lit(float(t)).alias("valid_from"), F.lit(None).cast("double").alias("valid_to"))
    if history is None:
        return fresh
    held = history.where("valid_to IS NULL")
    versions = lambda d, name: d.select(P, "id", F.struct(*columns, "valid_from", "valid_to").alias(name))
    both = versions(held, "was").join(versions(fresh, "now"), [P, "id"], "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}"))
    closed = F.when(F.col("was").isNotNull(), F.struct(*(F.col(f"was.{c}").alias(c) for c in columns), F.col("was.valid_from").alias("valid_from"), F.lit(float(t)).alias("valid_to")))
    kept = F.when(F.col("was").isNotNull() & F.col("now").isNotNull() & same, F.array("was")).otherwise(F.filter(F.array(closed, F.col("now")), lambda v: v.isNotNull()))
    merged = both.select(P, "id", F.explode(kept).alias("v")).select(P, "id", "v.*")
    return history.where("valid_to IS NOT NULL").select(*fresh.columns).unionByName(merged)


def as_of(history: DataFrame, t: float) -> DataFrame:
    """The version of each row that was valid at t."""
    return history.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def graph_diff_between(nodes_history: DataFrame, edges_history: DataFrame, t0: float, t1: float) -> DataFrame:
    """(project_id, kind: node or edge, id, change: added, removed or changed, fields: those of a node that differ) between two times, in either
    order. Versions that were valid at both are no part of the comparison."""
    both = lambda h: ~((F.col("valid_from") <= min(t0, t1)) & (F.col("valid_to").isNull() | (F.col("valid_to") > max(t0, t1))))
    none = F.array().cast("array<string>")
    out = None
    for kind, history in (("node", nodes_history), ("edge", edges_history)):
        moved = history.where(both(history))
        before, after = as_of(moved, t0), as_of(moved, t1)
        rows = diff_ids(before, after).withColumn("fields", none)
        rows = rows.union(diff_changed(before, after).select(P, "id", F.lit("changed"), "fields")) if kind == "node" else rows
        rows = rows.select(P, F.lit(kind).alias("kind"), "id", "change", "fields")
        out = rows if out is None else out.union(rows)
    return out


def executive_summary(nodes: DataFrame, edges: DataFrame, prior_items: DataFrame | None = None) -> DataFrame:
    """One row per project: its decisions in the order of insertion and its risks by falling impact, as arrays, how many there are, how the debt
    changed against the prior items (all of it is new without them), the current session and the one before. For projects too large for one row,
    decision_timeline() and risks() are the same as tables, and export_summary_markdown() writes from those."""
    current = unresolved_open_items(nodes, edges)
    delta = debt_delta(current, current.limit(0) if prior_items is None else prior_items)
    listed = lambda order, *columns: F.transform(F.array_sort(F.collect_list(F.struct(order, "id", F.struct("id", *columns).alias("row")))), lambda x: x["row"])
    made = listed(F.col("seq").alias("o"), "label", "decision_status", "owner", "session_id", "rationale", "blocked_work", "criteria")
    status = decision_timeline(nodes, edges).groupBy(P).agg(F.count("*").alias("n_decisions"), F.count(F.when(F.col("decision_status") == "Pending", 1)).alias("n_pending"), made.alias("decisions"))
    risk = risks(nodes, edges).groupBy(P).agg(F.count("*").alias("n_risks"), listed((-F.col("impact")).alias("o"), "label", "severity", "impact", "risk_status").alias("risks"))
    sessions = register_sessions(nodes)
    last = sessions.groupBy(P).agg(F.max_by("session_id", "session_index").alias("session_id"), F.max("session_index").alias("now"))
    prior = sessions.select(P, (F.col("session_index") + 1).alias("now"), F.col("session_id").alias("prior_session_id"))
    rows = last.join(prior, [P, "now"], "left").drop("now").join(status, P, "left").join(risk, P, "left").join(delta, P, "left")
    counts = ["n_decisions", "n_pending", "n_risks", "new_items", "resolved_items", "persisted_items", "net"]
    lists = [F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("decisions", "risks")]
    return rows.select(P, "session_id", "prior_session_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), *lists)
