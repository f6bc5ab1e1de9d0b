"""Scans, projections and filters over nodes, edges and events. Every operator is keyed by project_id; order is seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..staging import stage

P = "project_id"


def newest(partition: list[str] | None = None, order: str = "seq"):
    return Window.partitionBy(*(partition or [P])).orderBy(F.col(order).desc(), F.col("id").desc())


def register_sessions(rows: DataFrame) -> DataFrame:
    """(project_id, session_id, session_index): sessions in first-seen order, from 0."""
    first = rows.groupBy(P, "session_id").agg(F.min("seq").alias("first_seq"))
    place = F.row_number().over(Window.partitionBy(P).orderBy("first_seq", "session_id")) - 1
    return first.select(P, "session_id", place.cast("long").alias("session_index"))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    ids = nodes.select(P, "id").distinct()
    source = ids.withColumnRenamed("id", "source_node_id")
    target = ids.withColumnRenamed("id", "target_node_id")
    return edges.join(source, [P, "source_node_id"], "left_semi").join(target, [P, "target_node_id"], "left_semi")


def snapshot_at_time(nodes: DataFrame, edges: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(F.col("timestamp") <= t)
    return kept, with_ends(edges.where(F.col("timestamp") <= t), kept)


def nodes_where(nodes: DataFrame, predicate: Column | str, limit: int) -> DataFrame:
    """The first nodes by insertion that meet the predicate."""
    place = F.row_number().over(Window.partitionBy(P).orderBy("seq", "id"))
    return nodes.where(predicate).withColumn("place", place).where(F.col("place") <= limit).drop("place")


def last_n_nodes(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.withColumn("place", F.row_number().over(newest())).where(F.col("place") <= n).drop("place")


def recent_snapshot(nodes: DataFrame, edges: DataFrame, n: int, m: int) -> tuple[DataFrame, DataFrame]:
    """The newest n nodes, and of the edges inside them the m whose targets, then edges, are newest."""
    top = last_n_nodes(nodes, n)
    inside = with_ends(edges, top).join(top.select(P, F.col("id").alias("target_node_id"), F.col("seq").alias("target_seq")), [P, "target_node_id"])
    order = Window.partitionBy(P).orderBy(F.col("target_seq").desc(), F.col("seq").desc(), F.col("id").desc())
    return top, inside.withColumn("place", F.row_number().over(order)).where(F.col("place") <= m).drop("place", "target_seq")


def recent_touching(nodes: DataFrame, edges: DataFrame, n: int, m: int) -> tuple[DataFrame, DataFrame]:
    """The newest n nodes, and the newest m edges with either end among them."""
    top = last_n_nodes(nodes, n)
    ids = top.select(P, "id")
    ends = edges.select(P, "id", F.explode(F.array("source_node_id", "target_node_id")).alias("end"))
    touching = ends.join(ids.withColumnRenamed("id", "end"), [P, "end"], "left_semi").select(P, "id").distinct()
    kept = edges.join(touching, [P, "id"], "left_semi")
    return top, kept.withColumn("place", F.row_number().over(newest())).where(F.col("place") <= m).drop("place")


def unresolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """OpenItems that are not invalidated and that nothing resolves."""
    done = edges.where("edge_type = 'Resolves'").select(P, F.col("target_node_id").alias("id")).distinct()
    return nodes.where("node_type = 'OpenItem' AND status <> 'Invalidated'").join(done, [P, "id"], "left_anti")


def open_questions(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    return last_n_nodes(unresolved(nodes, edges), limit)


def signal_filter(events: DataFrame, least: int = 5) -> DataFrame:
    """Events with enough whitespace words to be extracted from."""
    return events.where(F.size(tx.words(F.col("text"))) >= least)


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes named by (project_id, id); names that do not exist give no row."""
    return nodes.join(ids.select(P, "id"), [P, "id"], "left_semi")


def route_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tool calls, which go to scratch; everything else, which goes to extraction) by event_kind; a null kind is prose."""
    tool = F.coalesce(F.col("event_kind") == "tool_call", F.lit(False))
    return events.where(tool), events.where(~tool)


def _ranges(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows dealt to ranges of (project_id, order), with the number of the range: no project has to fit in one task."""
    return stage(rows.repartitionByRange(P, *order).withColumn("part", F.spark_partition_id()), name)


def numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    """Rows with their number in the project in the order of seq and id, from 0. Only the sizes of the ranges meet in one place."""
    ranged = _ranges(rows, ["seq", "id"], "numbered")
    sizes = ranged.groupBy(P, "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(P).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(P, "part").orderBy("seq", "id")) - 1
    found = ranged.withColumn("own", own).join(sizes.select(P, "part", before.alias("before")), [P, "part"])
    return found.withColumn(name, (F.col("own") + F.col("before")).cast("long")).drop("own", "before", "part")


def _carried(tails: DataFrame, parts: DataFrame, most: dict[str, int]) -> DataFrame:
    """(project_id, part, kind, seq, late, id): the last rows of each kind before each range, from the tails of the ranges before it."""
    order = Window.partitionBy(P, "kind").orderBy("part", "seq", "late", "id")
    numbered_tails = tails.withColumn("r", F.row_number().over(order))
    counts = tails.groupBy(P, "kind", "part").agg(F.count("*").alias("n"))
    kinds = parts.crossJoin(tails.sparkSession.createDataFrame(list(most.items()), "kind string, most int"))
    sums = kinds.join(counts, [P, "kind", "part"], "left")
    before = F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(P, "kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    wanted = sums.withColumn("before", before).where("before > 0")
    wanted = wanted.select(P, "kind", F.col("part").alias("for_part"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("before") - F.col("most") + 1), F.col("before"))).alias("r"))
    return numbered_tails.join(wanted, [P, "kind", "r"]).select(P, F.col("for_part").alias("part"), "kind", "seq", "late", "id")


def context_asof(events: DataFrame, nodes: DataFrame, edges: DataFrame, window: int = 20, most_nodes: int = 50, most_edges: int = 100) -> DataFrame:
    """For each event the ids of the last events up to it, and of the newest nodes and edges that were known by then, oldest first.

    Events, nodes and edges share one timeline; a node or edge counts from its own seq on. No join between them: the timeline is dealt
    to ranges, and each range is given the last rows of every kind before it.
    """
    most = {"event": window, "node": most_nodes, "edge": most_edges}
    of = lambda d, kind, late: d.select(P, "seq", F.lit(late).alias("late"), "id", F.lit(kind).alias("kind"))
    line = of(events, "event", 1).union(of(nodes, "node", 0)).union(of(edges, "edge", 0))
    ranged = _ranges(line, ["seq", "late", "id"], "timeline")
    limit = F.lit(0)
    for kind, n in most.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    newest_first = Window.partitionBy(P, "part", "kind").orderBy(F.col("seq").desc(), F.col("late").desc(), F.col("id").desc())
    tails = stage(ranged.withColumn("r", F.row_number().over(newest_first)).where(F.col("r") <= limit).drop("r"), "tails")
    carried = _carried(tails, ranged.select(P, "part").distinct(), most).withColumn("own", F.lit(False))
    rows = ranged.withColumn("own", F.lit(True)).unionByName(carried)
    # Numbers of the kinds so far, then the ids behind the last numbers.
    at = Window.partitionBy(P, "part").orderBy("seq", "late", "id", "kind")
    for kind in most:
        rows = rows.withColumn(f"n_{kind}", F.count(F.when(F.col("kind") == kind, 1)).over(at))
    found = rows.where("kind = 'event'")
    last = Window.partitionBy(P, "part").orderBy("n_event").rowsBetween(-(window - 1), 0)
    found = found.withColumn("history", F.collect_list("id").over(last)).where("own")
    none = F.array().cast("array<string>")
    for kind, name in (("node", "known"), ("edge", "known_edges")):
        known = Window.partitionBy(P, "part").orderBy(f"n_{kind}").rowsBetween(-(most[kind] - 1), 0)
        lists = rows.where(F.col("kind") == kind).select(P, "part", f"n_{kind}", F.collect_list("id").over(known).alias(name))
        found = found.join(lists, [P, "part", f"n_{kind}"], "left").withColumn(name, F.coalesce(name, none))
    return found.select(P, "id", "seq", "history", "known", "known_edges")


def history_chunks(events: DataFrame, every: int = 10) -> DataFrame:
    """Each run of `every` events as `[start] role: text` lines."""
    chunks = numbered(events).withColumn("chunk", F.floor(F.col("place") / every))
    line = F.concat(F.lit("["), F.format_string("%.1f", "start_time"), F.lit("] "), "agent_role", F.lit(": "), "text")
    rows = chunks.groupBy(P, "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", "id", line.alias("line")))).alias("lines"))
    return rows.select(P, "chunk", F.array_join(F.col("lines.line"), "\n").alias("history"))


def recent_files(events: DataFrame, most: int = 20) -> DataFrame:
    """Per session the files touched last, newest first."""
    last = events.select(P, "session_id", F.explode("files").alias("file"), "seq").groupBy(P, "session_id", "file").agg(F.max("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy(P, "session_id").orderBy(F.col("seq").desc(), "file"))
    return last.withColumn("place", place).where(F.col("place") <= most)


def brief_changes(briefs: DataFrame) -> DataFrame:
    """(project_id, session_id, seq, brief): only the briefs that differ from the session's previous one."""
    before = F.lag(F.sha2("brief", 256)).over(Window.partitionBy(P, "session_id").orderBy("seq"))
    return briefs.withColumn("before", before).where("before IS NULL OR before <> sha2(brief, 256)").drop("before")
