"""Decision-memory tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = "p0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        f"'{PROJECT}' AS project_id",
        "concat('c', conv_id, '-', turn) AS id",
        "CASE WHEN (conv_id + turn) % 5 = 0 THEN 'Rule' WHEN (conv_id + turn) % 5 IN (1, 2) THEN 'Decision' ELSE 'OpenItem' END AS node_type",
        "substr(text, 1, 60) AS label", "text AS description", "concat('u', conv_id, '-', turn) AS event_id", "role AS agent_id",
        "concat('s', conv_id % 20) AS session_id", "cast(conv_id * 100 + turn AS double) AS timestamp",
        "array(concat('src/m', (conv_id * 7 + turn) % 12, '.rs')) AS files",
        "CASE WHEN (conv_id * 3 + turn) % 11 = 0 THEN 'Invalidated' ELSE 'Active' END AS status",
        "cast(conv_id * 100 + turn AS bigint) AS seq",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).select("project_id", "id", "seq", "timestamp")
    b = n.select("project_id", F.col("id").alias("target_node_id"), F.col("seq").alias("target_seq"))
    steps = n.withColumn("d", F.explode(F.array(F.lit(1), F.lit(2), F.lit(100)))).where("d <> 100 OR seq % 3 = 0")
    pairs = steps.withColumn("target_seq", F.col("seq") - F.col("d")).join(b, ["project_id", "target_seq"])
    kind = "((seq * 31 + target_seq * 17) % 97) % 4"
    return pairs.selectExpr(
        "project_id", "concat('e', id, '>', target_node_id) AS id",
        f"CASE {kind} WHEN 0 THEN 'RelatesTo' WHEN 1 THEN 'Resolves' WHEN 2 THEN 'Refutes' ELSE 'Supersedes' END AS edge_type",
        "id AS source_node_id", "target_node_id", "concat('because ', id) AS reasoning", "timestamp", "seq",
    )


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"'{PROJECT}' AS project_id", "concat('t', event_id) AS id", "concat('s', user_id) AS session_id", "cast(event_id AS bigint) AS seq", "cast(event_id AS double) AS end_time",
        "CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'read' WHEN 'signup' THEN 'lint' ELSE 'bash' END AS tool_name",
        "CASE event_type WHEN 'click' THEN 'edited file' WHEN 'view' THEN 'read file' WHEN 'signup' THEN 'lint clean, 0 failures' WHEN 'error' THEN 'Bash cargo test: 2 failed' ELSE 'Bash mkdir out' END AS text",
        "array(concat('src/m', cast(get_json_object(props, '$.k') AS bigint) % 12, '.rs')) AS files",
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        f"'{PROJECT}' AS project_id", "concat('u', conv_id, '-', turn) AS id", "concat('s', conv_id % 20) AS session_id", "role AS agent_role",
        "cast(conv_id * 100 + turn AS double) AS start_time", "cast(conv_id * 100 + turn AS double) AS end_time", "text", "cast(conv_id * 100 + turn AS bigint) AS seq",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text, asked of the project."""
    return table(spark, sf_dir, "benchmark").selectExpr("item_id AS question_id", f"'{PROJECT}' AS project_id", "text AS question")


#: The same views as SQL for oracles.
FX_SQL = r"""
fx_nodes AS (
  SELECT concat('c', conv_id, '-', turn) AS id,
    CASE WHEN (conv_id + turn) % 5 = 0 THEN 'Rule' WHEN (conv_id + turn) % 5 IN (1, 2) THEN 'Decision' ELSE 'OpenItem' END AS node_type,
    substr(text, 1, 60) AS label, text AS description, concat('u', conv_id, '-', turn) AS event_id, role AS agent_id,
    concat('s', conv_id % 20) AS session_id, CAST(conv_id * 100 + turn AS DOUBLE) AS timestamp,
    concat('src/m', (conv_id * 7 + turn) % 12, '.rs') AS file,
    CASE WHEN (conv_id * 3 + turn) % 11 = 0 THEN 'Invalidated' ELSE 'Active' END AS status,
    CAST(conv_id * 100 + turn AS BIGINT) AS seq
  FROM conversations),
fx_edges AS (
  SELECT concat('e', a.id, '>', b.id) AS id,
    CASE ((a.seq * 31 + b.seq * 17) % 97) % 4 WHEN 0 THEN 'RelatesTo' WHEN 1 THEN 'Resolves' WHEN 2 THEN 'Refutes' ELSE 'Supersedes' END AS edge_type,
    a.id AS source_node_id, b.id AS target_node_id, concat('because ', a.id) AS reasoning, a.timestamp AS timestamp, a.seq AS seq
  FROM fx_nodes a JOIN fx_nodes b ON b.seq = a.seq - 1 OR b.seq = a.seq - 2 OR (b.seq = a.seq - 100 AND a.seq % 3 = 0)),
fx_sessions AS (
  SELECT session_id, row_number() OVER (ORDER BY min(seq)) - 1 AS session_index FROM fx_nodes GROUP BY session_id),
fx_tools AS (
  SELECT concat('t', event_id) AS id, concat('s', user_id) AS session_id, event_id AS seq, CAST(event_id AS DOUBLE) AS end_time,
    CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'read' WHEN 'signup' THEN 'lint' ELSE 'bash' END AS tool_name,
    CASE event_type WHEN 'click' THEN 'edited file' WHEN 'view' THEN 'read file' WHEN 'signup' THEN 'lint clean, 0 failures' WHEN 'error' THEN 'Bash cargo test: 2 failed' ELSE 'Bash mkdir out' END AS text,
    concat('src/m', CAST(json_extract(props, '$.k') AS BIGINT) % 12, '.rs') AS file
  FROM events),
fx_edits AS (SELECT * FROM fx_tools WHERE tool_name = 'edit' OR text = 'Bash mkdir out'),
fx_checks AS (SELECT *, text NOT LIKE '%2 failed%' AS passed FROM fx_tools WHERE tool_name = 'lint' OR text LIKE 'Bash cargo test%'),
fx_debt_open AS (
  SELECT n.id, n.label, n.seq, n.session_id,
    CASE WHEN (SELECT max(session_index) FROM fx_sessions) - s.session_index >= 1 THEN 'High' ELSE 'Medium' END AS severity
  FROM fx_nodes n JOIN fx_sessions s USING (session_id)
  WHERE node_type = 'OpenItem' AND status <> 'Invalidated' AND id NOT IN (SELECT target_node_id FROM fx_edges WHERE edge_type = 'Resolves')),
fx_questions AS (
  SELECT item_id AS question_id, text AS question FROM benchmark)
"""
