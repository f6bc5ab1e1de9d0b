"""Briefs and answers as ordered text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..staging import stage
from .debt import current_sessions, failed_verifications, rule_violations, scratch, unresolved_open_items, unverified_changes
from .decisions import decision_status
from .graph import reasoning_chains
from .scans import P, nodes_where

CUT = 110


def _with_total(rows: DataFrame) -> DataFrame:
    """total: the rows of the project, by an aggregate that is joined back."""
    return rows.join(rows.groupBy(P).agg(F.count("*").alias("total")), P)


def brief_decisions(nodes: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """Decided ones newest first, then pending ones oldest first whose label is not there yet; total counts all."""
    rows = _with_total(decision_status(nodes, edges))
    pending = F.col("decision_status") == "Pending"
    one = F.row_number().over(Window.partitionBy(P, "label").orderBy(pending, F.when(pending, F.col("seq")).otherwise(-F.col("seq")), "id"))
    rows = rows.withColumn("copy", one).where(~pending | (F.col("copy") == 1))
    order = Window.partitionBy(P).orderBy(pending, F.when(pending, F.col("seq")).otherwise(-F.col("seq")), "id")
    place = F.row_number().over(order)
    return rows.withColumn("place", place).where(F.col("place") <= most).select(P, "place", "id", tx.truncated(F.col("label"), CUT).alias("label"), "decision_status", "total")


def brief_rules(nodes: DataFrame, most: int = 3) -> DataFrame:
    rules = nodes_where(nodes, "node_type = 'Rule' AND status = 'Active'", most)
    place = F.row_number().over(Window.partitionBy(P).orderBy("seq", "id"))
    return rules.select(P, place.alias("place"), "id", tx.truncated(F.col("label"), CUT).alias("label"))


def _first(items: DataFrame, most: int) -> DataFrame:
    """(project_id, place, id, description cut, total) of a project's first debt items."""
    place = F.row_number().over(Window.partitionBy(P).orderBy("seq", "id"))
    rows = _with_total(items.withColumn("id", F.col("node_ids")[0])).withColumn("place", place).where(F.col("place") <= most)
    return rows.select(P, "place", "id", tx.truncated(F.col("description"), CUT).alias("description"), "total")


def brief_open_items(nodes: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """Open items in the order of insertion, with their label and what the brief says of them."""
    found = _first(unresolved_open_items(nodes, edges), most)
    return found.join(nodes.select(P, "id", tx.truncated(F.col("label"), CUT).alias("label")), [P, "id"])


def brief_warnings(nodes: DataFrame, tool_events: DataFrame, unverified: int = 3, failing: int = 2) -> DataFrame:
    """(project_id, kind, place, id, description, total) of the session that was active last: its unverified edits, then its failing checks,
    failed verifications before rule violations."""
    edits, checks = scratch(tool_events.join(current_sessions(tool_events), [P, "session_id"], "left_semi"))
    loose = _first(unverified_changes(edits, checks), unverified).withColumn("kind", F.lit("unverified"))
    failed = failed_verifications(edits, checks).withColumn("late", F.lit(0)).unionByName(rule_violations(checks, nodes).withColumn("late", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(P).orderBy("late", "seq", "id"))
    rows = _with_total(failed.withColumn("id", F.col("node_ids")[0])).withColumn("place", place).where(F.col("place") <= failing)
    rows = rows.select(P, "place", "id", tx.truncated(F.col("description"), CUT).alias("description"), "total", F.lit("failing").alias("kind"))
    return loose.unionByName(rows)


def _ends_met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, project_id, r, own) in order -> the own strings r that start with another one, or with which another one starts. Two stacks of
    strings, each the start of the one above it, hold all that can still meet."""
    key, others, open_own = None, [], []
    for pdf in batches:
        out = []
        for part, project, r, own in pdf[["part", P, "r", "own"]].itertuples(index=False):
            if (part, project) != key:
                key, others, open_own = (part, project), [], []
            for stack in (others, open_own):
                while stack and not r.startswith(stack[-1]):
                    stack.pop()
            if not own:
                out += [(project, x) for x in open_own]
                open_own.clear()
                others.append(r)
            elif others:
                out.append((project, r))
            else:
                open_own.append(r)
        yield pd.DataFrame(out, columns=[P, "r"])


def suffix_matches(own: DataFrame, active: DataFrame) -> DataFrame:
    """(project_id, file) of own that equal an active one, end with it, or are its end; once each.

    Turned round, ends are starts, and strings with one start lie together when sorted. Different strings are dealt to ranges; a string that is the
    start of a later range's first string is carried there too, at most as many as that string is long. One pass over each range does the rest.
    """
    turned = lambda d, mine: d.select(P, F.reverse("file").alias("r"), F.lit(mine).alias("own")).where("r <> ''").distinct()
    ranged = stage(turned(active, False).union(turned(own, True)).repartitionByRange(P, "r").withColumn("part", F.spark_partition_id()), "paths")
    bounds = ranged.groupBy("part").agg(F.min(F.struct(P, "r")).alias("b")).select(F.col("part").alias("to"), "b.*")
    starts = bounds.select("to", P, F.explode(F.transform(F.sequence(F.lit(1), F.length("r")), lambda n: F.substr(F.col("r"), F.lit(1), n))).alias("r"))
    carried = ranged.join(starts, [P, "r"]).where(F.col("part") < F.col("to")).select(P, "r", "own", F.col("to").alias("part"))
    rows = ranged.unionByName(carried).repartition("part").sortWithinPartitions("part", P, "r", "own")
    return rows.mapInPandas(_ends_met, f"{P} string, r string").distinct().select(P, F.reverse("r").alias("file"))


def brief_binding(nodes: DataFrame, active_files: DataFrame, most: int = 5) -> DataFrame:
    """Active rules and decisions on an active file: equal, or one path ends with the other."""
    own = nodes.where("status = 'Active' AND node_type IN ('Rule', 'Decision')").select(P, "id", F.explode("files").alias("file")).where("file <> ''")
    met = own.join(suffix_matches(own.select(P, "file"), active_files.select(P, "file")), [P, "file"], "left_semi").select(P, "id").distinct()
    rows = nodes.join(met, [P, "id"], "left_semi")
    place = F.row_number().over(Window.partitionBy(P).orderBy(F.col("node_type") != "Rule", "seq", "id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select(P, "place", "id", "node_type", tx.truncated(F.col("label"), CUT).alias("label"))


def _joined(rows: DataFrame, keys: list[str], order: str, text: str, mark: str, name: str) -> DataFrame:
    """The texts of each key's few rows, in order, as one."""
    listed = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), mark).alias(name))


def brief_text(nodes: DataFrame, edges: DataFrame, tool_events: DataFrame, active_files: DataFrame) -> DataFrame:
    """(project_id, brief): decisions, rules, open items, what binds the active files, and the warnings of the session that was active
    last; a project without a section has an empty brief."""
    lines = lambda d, n, title, text: d.select(P, F.lit(n).alias("section"), title.alias("title"), F.col("place").cast("long").alias("place"), text.alias("line"))
    titled = lambda name: F.concat(F.lit(f"{name} ("), F.col("total"), F.lit("):"))
    said = F.concat(F.lit("- "), "description")
    warnings = brief_warnings(nodes, tool_events)
    rows = lines(brief_decisions(nodes, edges), 1, titled("Decisions"), F.concat(F.lit("- ["), "decision_status", F.lit("] "), "label"))
    rows = rows.union(lines(_with_total(brief_rules(nodes)), 2, titled("Rules"), F.concat(F.lit("- "), "label")))
    rows = rows.union(lines(brief_open_items(nodes, edges), 3, titled("Open items"), said))
    rows = rows.union(lines(_with_total(brief_binding(nodes, active_files)), 4, titled("Binding here"), F.concat(F.lit("- ["), "node_type", F.lit("] "), "label")))
    rows = rows.union(lines(warnings.where("kind = 'unverified'"), 5, titled("Unverified edits"), said))
    rows = rows.union(lines(warnings.where("kind = 'failing'"), 6, titled("Failing checks"), said))
    sections = _joined(rows, [P, "section", "title"], "place", "line", "\n", "body").withColumn("whole", F.concat("title", F.lit("\n"), "body"))
    body = _joined(sections, [P], "section", "whole", "\n", "body")
    counts = nodes.groupBy(P).agg(F.count("*").alias("n")).join(edges.groupBy(P).agg(F.count("*").alias("m")), P, "left")
    head = F.concat(F.lit('<reasoning-state nodes="'), "n", F.lit('" edges="'), F.coalesce("m", F.lit(0)), F.lit('">\n'))
    return counts.join(body, P, "left").select(P, F.coalesce(F.concat(head, "body", F.lit("\n</reasoning-state>")), F.lit("")).alias("brief"))


NOTHING = "No relevant nodes found in the graph."
EMPTY = "The graph does not yet contain enough information to answer this question."


def _verb(kind: Column) -> tuple[Column, Column]:
    """(word, preference) of an edge type."""
    word, rank = F.lit(None).cast("string"), F.lit(0)
    for name, (preference, _, said) in schema.EDGE_TYPES.items():
        word, rank = F.when(kind == name, said).otherwise(word), F.when(kind == name, preference).otherwise(rank)
    return word, rank


def answer_sections(questions: DataFrame, seen: DataFrame, trace: DataFrame, nodes: DataFrame, inside: DataFrame, most: int = 12, links: int = 3) -> DataFrame:
    """(question_id, project_id, answer) of every question: the first trace nodes as decisions, rules, reasoning chains and open items, each
    node with up to three edges inside the trace: of parallel edges the newest, then by preference, newest first among equals. seen: the
    nodes of each question's subgraph."""
    key = ["question_id", P]
    first_nodes = trace.where(F.col("place") < most)
    kept = first_nodes.join(nodes.select(P, "id", "node_type", "label", "agent_id", "session_id"), [P, "id"])
    verb, rank = _verb(F.col("edge_type"))
    target = kept.select(*key, F.col("id").alias("target_node_id"), F.col("label").alias("target_label"))
    out = inside.join(kept.select(*key, F.col("id").alias("source_node_id")), [*key, "source_node_id"], "left_semi").join(target, [*key, "target_node_id"])
    first = F.row_number().over(Window.partitionBy(*key, "source_node_id", "target_node_id").orderBy(F.desc("seq"), F.desc("id")))
    out = out.withColumn("first", first).where("first = 1").withColumn("preference", rank)
    place = F.row_number().over(Window.partitionBy(*key, "source_node_id").orderBy("preference", F.desc("seq"), F.desc("id")))
    out = out.withColumn("edge_place", place).where(F.col("edge_place") <= links)
    out = out.withColumn("line", F.concat(F.lit("  - *"), verb, F.lit("* → "), "target_label")).withColumnRenamed("source_node_id", "of")
    listed = _joined(out, [*key, "of"], "edge_place", "line", "\n", "links").withColumnRenamed("of", "id")
    rows = kept.join(listed, [*key, "id"], "left")
    section = F.when(F.col("node_type") == "Decision", 1).when(F.col("node_type") == "Rule", 2).otherwise(4)
    text = F.concat_ws("\n", F.format_string("- **%s** (%s) %s", "agent_id", "session_id", "label"), "links")
    parts = _joined(rows.withColumns({"section": section, "text": text}), [*key, "section"], "place", "text", "\n", "body")
    # A chain names who said each step, and how the step before led to it.
    steps = reasoning_chains(first_nodes, inside).select(*key, "chain_no", F.posexplode("chain").alias("step", "id"), "verbs")
    steps = steps.join(nodes.select(P, "id", "agent_id", "session_id"), [P, "id"])
    said = _verb(F.get("verbs", F.col("step")))[0]
    steps = steps.withColumn("text", F.concat(F.format_string("%s (%s)", "agent_id", "session_id"), F.coalesce(F.concat(F.lit(" → *"), said, F.lit("*")), F.lit(""))))
    chains = _joined(steps, [*key, "chain_no"], "step", "text", " ", "text").withColumn("line", F.concat((F.col("chain_no") + 1).cast("string"), F.lit(". "), "text"))
    parts = parts.unionByName(_joined(chains, key, "chain_no", "line", "\n", "body").withColumn("section", F.lit(3)))
    title = F.element_at(F.array(*(F.lit(f"### {t}") for t in ("Decisions", "Rules", "Reasoning Chains", "Open Items"))), F.col("section"))
    whole = _joined(parts.withColumn("whole", F.concat(title, F.lit("\n"), "body")), key, "section", "whole", "\n\n", "answer")
    filled = seen.select(*key).distinct().withColumn("filled", F.lit(True))
    every = questions.select(*key).distinct().join(filled, key, "left").join(whole, key, "left")
    return every.select(*key, F.coalesce("answer", F.when(F.col("filled"), NOTHING).otherwise(EMPTY)).alias("answer"))


def export_summary_markdown(summary: DataFrame, timeline: DataFrame, risks: DataFrame) -> DataFrame:
    """(project_id, section, seq, id, line): Markdown of executive_summary(), decision_timeline() and risks(), to be written in the order of
    section, seq and id; a decision is a block of lines, risks come by falling impact."""
    of = lambda d, section, seq, text, name=F.lit(""): d.select(P, F.lit(section).alias("section"), seq.cast("long").alias("seq"), name.alias("id"), text.alias("line"))
    sign = F.when(F.col("net") >= 0, "+").otherwise("")
    heads = [
        (0, 0, F.concat(F.lit("# Executive Summary — "), "session_id")), (0, 1, F.concat(F.lit("*Compared to: "), F.coalesce("prior_session_id", F.lit("N/A")), F.lit("*"))), (1, 0, F.lit("## Debt Delta")),
        (1, 1, F.concat(F.lit("- **New:** "), "new_items")), (1, 2, F.concat(F.lit("- **Resolved:** "), "resolved_items")), (1, 3, F.concat(F.lit("- **Persisted:** "), "persisted_items")),
        (1, 4, F.concat(F.lit("- **Net Change:** "), sign, "net")), (2, -1_000_000_000, F.format_string("## Decisions (%d)", "n_decisions")), (3, -1_000_000_000, F.format_string("## Top Risks (%d)", "n_risks")),
    ]
    listed = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"**{title}:** "), F.array_join(c, ", ")))
    block = F.concat_ws(
        "\n", F.concat(F.lit("### "), "label"), F.concat(F.lit("**Status:** "), "decision_status"), F.concat(F.lit("**Owner:** "), F.coalesce("owner", F.lit("Unassigned"))),
        F.concat(F.lit("**Session:** "), "session_id"), F.concat(F.lit("**Rationale:** "), "rationale"), listed("Blocked Work", "blocked_work"), listed("Validation Needed", "criteria"),
    )
    risk = F.format_string("- **%s** (Impact: %d/100) — UnresolvedOpenItem, %s", "label", "impact", "risk_status")
    rows = of(timeline, 2, F.col("seq"), block, F.col("id")).union(of(risks, 3, -F.col("impact"), risk, F.col("id")))
    for section, seq, text in heads:
        rows = rows.union(of(summary, section, F.lit(seq), text))
    return rows
