"""Writes as idempotent derivations: commands and batches -> rows to append."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import P, with_ends


def first_by_id(rows: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(P, "id").orderBy("seq"))
    return rows.withColumn("place", first).where("place = 1").drop("place")


def add_nodes(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch to append: first write of an id wins, stored ids are ignored."""
    return first_by_id(batch).join(stored.select(P, "id"), [P, "id"], "left_anti")


def add_edges(nodes: DataFrame, stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Like add_nodes; edges without both ends are left out (see rejected_edges)."""
    return first_by_id(with_ends(batch, nodes)).join(stored.select(P, "id"), [P, "id"], "left_anti")


def rejected_edges(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    kept = with_ends(batch, nodes).select(P, "id")
    return batch.join(kept, [P, "id"], "left_anti").withColumn("reason", F.lit("missing endpoint"))


def bulk_commit(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes of a batch before any edge."""
    added = add_nodes(nodes, new_nodes)
    every = nodes.select(P, "id").union(added.select(P, "id"))
    return added, add_edges(every, edges, new_edges)


def apply_decision(commands: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project_id, seq, id, label, agent_id, resolves, resolutions) -> Decision nodes and their Resolves edges."""
    agent = F.coalesce("agent_id", F.lit("agent"))
    made = commands.select(P, "seq", "id", F.lit("Decision").alias("node_type"), "label", agent.alias("agent_id"), F.lit(1.0).alias("confidence"))
    each = commands.select(P, "seq", F.col("id").alias("source_node_id"), "label", "resolutions", F.posexplode("resolves").alias("pos", "target_node_id"))
    default = F.concat(F.lit("Decision '"), "label", F.lit("' resolves this"))
    reason = F.coalesce(F.get("resolutions", F.col("pos")), default)
    edges = each.select(P, "seq", F.concat("source_node_id", F.lit(">"), "target_node_id").alias("id"), F.lit("Resolves").alias("edge_type"), "source_node_id", "target_node_id", reason.alias("reasoning"))
    return made, edges.join(nodes.select(P, F.col("id").alias("target_node_id")), [P, "target_node_id"], "left_semi")


def apply_question(commands: DataFrame) -> DataFrame:
    """(project_id, seq, id, label, description, agent_id, session_id, files, timestamp) -> OpenItem nodes, active, sure, mentioned once."""
    agent = F.coalesce("agent_id", F.lit("agent"))
    return commands.select(
        P, "seq", "id", F.lit("OpenItem").alias("node_type"), "label", "description", agent.alias("agent_id"), "session_id", "timestamp",
        F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.lit("Active").alias("status"), F.lit(1.0).alias("confidence"), F.lit(1).alias("mention_count"),
    )


def fold_status(nodes: DataFrame, commands: DataFrame) -> DataFrame:
    """Nodes with the status that their last invalidate or restore command gives."""
    last = commands.groupBy(P, "id").agg(F.max_by("status", "seq").alias("new_status"))
    return nodes.join(last, [P, "id"], "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def refutations(commands: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project_id, seq, id: target, reasoning) -> a Decision node and a Refutes edge for each target that exists."""
    hit = commands.join(nodes.select(P, "id", "label"), [P, "id"])
    made = hit.select(P, "seq", F.concat(F.lit("inv-"), "id").alias("id"), F.lit("Decision").alias("node_type"), F.concat(F.lit("Invalidated: "), F.substring("label", 1, 60)).alias("label"), F.lit("").alias("session_id"))
    edges = hit.select(P, "seq", F.concat(F.lit("inv-"), "id", F.lit(">"), "id").alias("id"), F.lit("Refutes").alias("edge_type"), F.concat(F.lit("inv-"), "id").alias("source_node_id"), F.col("id").alias("target_node_id"), "reasoning")
    return made, edges


def upsert_latest(rows: DataFrame) -> DataFrame:
    """Last write of an id wins."""
    last = F.row_number().over(Window.partitionBy(P, "id").orderBy(F.col("seq").desc()))
    return rows.withColumn("place", last).where("place = 1").drop("place")


def apply_resolve(commands: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project_id, seq, resolver, question, reasoning) -> Resolves edges; commands without both nodes make none."""
    for end in ("resolver", "question"):
        commands = commands.join(nodes.select(P, F.col("id").alias(end)), [P, end], "left_semi")
    return commands.select(
        P, "seq", F.concat("resolver", F.lit(">"), "question").alias("id"), F.lit("Resolves").alias("edge_type"),
        F.col("resolver").alias("source_node_id"), F.col("question").alias("target_node_id"), "reasoning",
    )
