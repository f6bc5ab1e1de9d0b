"""The library's queries over the test tables, each with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..operators import communities as cm
from ..operators import debt as de
from ..operators import decisions as dc
from ..operators import evaluation as ev
from ..operators import extraction as ex
from ..operators import graph as gr
from ..operators import reports as rp
from ..operators import retrieval as rt
from ..operators import scans as sc
from ..operators import studies as st
from ..operators import writes as wr
from ..operators.bm25_store import Bm25Store
from ..sources import fixtures as fx
from ..sources import readers as rd
from ..sources.graph_store import GraphStore
from ..staging import new_path, stage
from ..streaming import streams
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in schema.INDEX_STOP)
_CONTENT = ", ".join(f"'{w}'" for w in schema.CONTENT_STOP)
_COMMUNITY = ", ".join(f"'{w}'" for w in schema.COMMUNITY_STOP)


def _contains_any(text: str, marks: list[str]) -> str:
    quoted = [m.replace("'", "''") for m in marks]
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in quoted) + ")"


# Scans, projections, filters


@query("SELECT id, node_type, label, status, seq FROM fx_nodes")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    return fx.nodes(spark, d).select("id", "node_type", "label", "status", "seq")


@query("""t AS (SELECT max(timestamp) / 2 AS t FROM fx_nodes), n AS (SELECT * FROM fx_nodes WHERE timestamp <= (SELECT t FROM t))
SELECT e.id, e.edge_type FROM fx_edges e WHERE timestamp <= (SELECT t FROM t) AND source_node_id IN (SELECT id FROM n) AND target_node_id IN (SELECT id FROM n)""")
def snapshot_at_time(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    t = nodes.agg(F.max("timestamp") / 2).first()[0] or 0.0
    return sc.snapshot_at_time(nodes, fx.edges(spark, d), t)[1].select("id", "edge_type")


@query("SELECT id, label, seq FROM (SELECT *, row_number() OVER (ORDER BY seq) AS p FROM fx_nodes WHERE node_type = 'Rule' AND status = 'Active') WHERE p <= 20")
def nodes_where(spark: SparkSession, d: str) -> DataFrame:
    return sc.nodes_where(fx.nodes(spark, d), "node_type = 'Rule' AND status = 'Active'", 20).select("id", "label", "seq")


@query("SELECT id, seq FROM fx_nodes ORDER BY seq DESC LIMIT 50")
def last_n_nodes(spark: SparkSession, d: str) -> DataFrame:
    return sc.last_n_nodes(fx.nodes(spark, d), 50).select("id", "seq")


@query("""top AS (SELECT id, seq FROM fx_nodes ORDER BY seq DESC LIMIT 50)
SELECT e.id, e.edge_type FROM fx_edges e JOIN top s ON s.id = e.source_node_id JOIN top t ON t.id = e.target_node_id ORDER BY t.seq DESC, e.seq DESC, e.id DESC LIMIT 40""")
def recent_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return sc.recent_snapshot(fx.nodes(spark, d), fx.edges(spark, d), 50, 40)[1].select("id", "edge_type")


@query("""top AS (SELECT id FROM fx_nodes ORDER BY seq DESC LIMIT 50)
SELECT id, edge_type FROM fx_edges WHERE source_node_id IN (SELECT id FROM top) OR target_node_id IN (SELECT id FROM top) ORDER BY seq DESC, id DESC LIMIT 40""")
def recent_touching(spark: SparkSession, d: str) -> DataFrame:
    return sc.recent_touching(fx.nodes(spark, d), fx.edges(spark, d), 50, 40)[1].select("id", "edge_type")


@query("SELECT (SELECT count(*) FROM fx_nodes) AS n_nodes, (SELECT count(*) FROM fx_edges) AS n_edges")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    n = fx.nodes(spark, d).groupBy("project_id").agg(F.count("*").alias("n_nodes"))
    m = fx.edges(spark, d).groupBy("project_id").agg(F.count("*").alias("n_edges"))
    return n.join(m, "project_id", "left").select("n_nodes", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


@query("SELECT id, label FROM fx_nodes")
def node_labels(spark: SparkSession, d: str) -> DataFrame:
    return fx.nodes(spark, d).select("id", "label")


@query("""SELECT id, label, seq FROM fx_nodes WHERE node_type = 'OpenItem' AND status <> 'Invalidated'
AND id NOT IN (SELECT target_node_id FROM fx_edges WHERE edge_type = 'Resolves') ORDER BY seq DESC LIMIT 25""")
def open_questions(spark: SparkSession, d: str) -> DataFrame:
    return sc.open_questions(fx.nodes(spark, d), fx.edges(spark, d), 25).select("id", "label", "seq")


@query("SELECT node_type, n, id FROM fx_nodes JOIN (SELECT node_type, count(*) AS n FROM fx_nodes GROUP BY node_type) USING (node_type)")
def nodes_by_type(spark: SparkSession, d: str) -> DataFrame:
    """A row a member, with the size of its type."""
    nodes = fx.nodes(spark, d).select("project_id", "node_type", "id")
    return nodes.join(nodes.groupBy("project_id", "node_type").agg(F.count("*").alias("n")), ["project_id", "node_type"]).select("node_type", "n", "id")


@query("SELECT id, label, status FROM fx_nodes WHERE id IN (SELECT target_node_id FROM fx_edges WHERE seq % 5 = 0)")
def get_node(spark: SparkSession, d: str) -> DataFrame:
    """The targets of some edges, and a name that does not exist, looked up at once."""
    asked = fx.edges(spark, d).where("seq % 5 = 0").select("project_id", F.explode(F.array("target_node_id", F.lit("missing"))).alias("id"))
    return sc.get_nodes(fx.nodes(spark, d), asked).select("id", "label", "status")


@query("SELECT id, 'scratch' AS branch FROM fx_tools UNION ALL SELECT concat('u', conv_id, '-', turn), 'extraction' FROM conversations")
def route_events(spark: SparkSession, d: str) -> DataFrame:
    tool, prose = sc.route_events(_events(spark, d))
    return tool.select("id", F.lit("scratch").alias("branch")).union(prose.select("id", F.lit("extraction")))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls and prose as one table of events."""
    tools = fx.tool_events(spark, d).select("project_id", "id", "session_id", "seq", "end_time", "text", F.lit("tool_call").alias("event_kind"), "tool_name", "files")
    prose = fx.utterances(spark, d).select("project_id", "id", "session_id", "seq", "end_time", "text", F.when(F.col("agent_role") == "user", "user_prompt").alias("event_kind"))
    return tools.unionByName(prose, allowMissingColumns=True)


@query("SELECT session_id, session_index FROM fx_sessions")
def register_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sc.register_sessions(fx.nodes(spark, d)).select("session_id", "session_index")


@query("SELECT n.id, concat('S', s.session_index + 1) AS short FROM fx_nodes n JOIN fx_sessions s USING (session_id)")
def session_short_name(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    short = F.coalesce(F.concat(F.lit("S"), F.col("session_index") + 1), "session_id")
    return nodes.join(sc.register_sessions(nodes), ["project_id", "session_id"], "left").select("id", short.alias("short"))


@query(r"SELECT concat('u', conv_id, '-', turn) AS id FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 5")
def signal_filter(spark: SparkSession, d: str) -> DataFrame:
    return sc.signal_filter(fx.utterances(spark, d)).select("id")


@query("SELECT CASE WHEN tool_name = 'read' THEN 'Read' WHEN tool_name = 'edit' OR text = 'Bash mkdir out' THEN 'Write' ELSE 'Check' END AS class, count(*) AS n FROM fx_tools GROUP BY 1")
def classify_tool(spark: SparkSession, d: str) -> DataFrame:
    return fx.tool_events(spark, d).groupBy(tx.tool_class(F.col("tool_name"), F.col("text")).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT id, passed FROM fx_checks")
def check_passed(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.tool_events(spark, d).where(tx.tool_class(F.col("tool_name"), F.col("text")) == "Check")
    return rows.select("id", tx.check_passed(F.col("text")).alias("passed"))


@query("""n AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM fx_nodes), kr AS (SELECT id, seq, r FROM n),
er AS (SELECT id, seq, row_number() OVER (ORDER BY seq, id) AS r FROM fx_edges),
pos AS (SELECT n.id, n.r, (SELECT count(*) FROM kr WHERE kr.seq <= n.seq) AS rk, (SELECT count(*) FROM er WHERE er.seq <= n.seq) AS re FROM n)
SELECT replace(pos.id, 'c', 'u') AS id, (SELECT string_agg(replace(b.id, 'c', 'u'), ',' ORDER BY b.r) FROM n b WHERE b.r BETWEEN pos.r - 19 AND pos.r) AS history,
  coalesce((SELECT string_agg(id, ',' ORDER BY r) FROM kr WHERE r BETWEEN rk - 49 AND rk), '') AS known, coalesce((SELECT string_agg(id, ',' ORDER BY r) FROM er WHERE r BETWEEN re - 99 AND re), '') AS known_edges FROM pos""")
def context_asof(spark: SparkSession, d: str) -> DataFrame:
    found = sc.context_asof(fx.utterances(spark, d), fx.nodes(spark, d), fx.edges(spark, d))
    return found.select("id", *(F.array_join(c, ",").alias(c) for c in ("history", "known", "known_edges")))


@query("""n AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM fx_nodes)
SELECT CAST(i // 10 AS BIGINT) AS chunk, string_agg(concat('[', printf('%.1f', timestamp), '] ', agent_id, ': ', description), chr(10) ORDER BY seq) AS history FROM n GROUP BY i // 10""")
def history_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sc.history_chunks(fx.utterances(spark, d)).select(F.col("chunk").cast("long").alias("chunk"), "history")


@query("""m AS (SELECT session_id, file, max(seq) AS seq FROM fx_tools GROUP BY ALL)
SELECT session_id, file, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, file) AS p FROM m) WHERE p <= 20""")
def recent_files_ring(spark: SparkSession, d: str) -> DataFrame:
    return sc.recent_files(fx.tool_events(spark, d)).select("session_id", "file", "seq")


@query("""b AS (SELECT session_id, seq, node_type AS brief, lag(node_type) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM fx_nodes)
SELECT session_id, seq, brief FROM b WHERE p IS NULL OR p <> brief""")
def brief_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.nodes(spark, d).select("project_id", "session_id", "seq", F.col("node_type").alias("brief"))
    return sc.brief_changes(rows).select("session_id", "seq", "brief")


# Text

_LINES = "concat(CASE i % 5 WHEN 0 THEN '- You must ' WHEN 1 THEN '- We use ' WHEN 2 THEN '- TODO ' WHEN 3 THEN '- ' ELSE '' END, line)"


@query(f"""t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents),
k AS (SELECT doc_id, lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS w FROM t)
SELECT doc_id, count(*) AS tokens, count(DISTINCT w) AS terms FROM k WHERE w <> '' AND w NOT IN ({_STOP}) GROUP BY doc_id""")
def tokenize_index(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents")
    tokens = docs.select("doc_id", F.explode(tx.index_tokens(F.col("text"))).alias("w"))
    return tokens.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.countDistinct("w").alias("terms"))


@query(r"""SELECT id, trim(regexp_replace(lower(regexp_replace(description, '[^A-Za-z0-9\s]', '', 'g')), '\s+', ' ', 'g')) AS normalized FROM fx_nodes""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return fx.nodes(spark, d).select("id", tx.normalized(F.col("description")).alias("normalized"))


@query(rf"""k AS (SELECT id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(description, '[^A-Za-z0-9\s]', '', 'g')), '\s+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ({_CONTENT}))) AS t FROM fx_nodes)
SELECT id, array_to_string(list_sort(t), ' ') AS tokens FROM k""")
def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    return fx.nodes(spark, d).select("id", F.array_join(F.array_sort(tx.content_tokens(F.col("description"))), " ").alias("tokens"))


@query(r"""w AS (SELECT id, list_filter(regexp_split_to_array(description, '\s+'), lambda x: x <> '') AS w FROM fx_nodes)
SELECT id, CASE WHEN len(w) > 12 THEN concat(array_to_string(w[1:12], ' '), '…') ELSE (SELECT description FROM fx_nodes n WHERE n.id = w.id) END AS short FROM w""")
def make_label(spark: SparkSession, d: str) -> DataFrame:
    return fx.nodes(spark, d).select("id", tx.label(F.col("description")).alias("short"))


@query("SELECT id, CASE WHEN length(description) > 110 THEN concat(substr(description, 1, 110), '…') ELSE description END AS short FROM fx_nodes")
def truncate_chars(spark: SparkSession, d: str) -> DataFrame:
    return fx.nodes(spark, d).select("id", tx.truncated(F.col("description"), 110).alias("short"))


@query(r"""w AS (SELECT id, unnest(list_filter(regexp_split_to_array(description, '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(description, '\s+'), lambda x: x <> ''), 1) AS i FROM fx_nodes),
n AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(w, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w),
g AS (SELECT id, s, string_agg(w, ' ' ORDER BY i) AS sentence FROM n GROUP BY id, s HAVING count(*) >= 6),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS idx FROM g)
SELECT replace(id, 'c', 'u') AS event_id, CAST(idx AS INTEGER) AS idx, sentence FROM r WHERE idx < 12""")
def sentence_table(spark: SparkSession, d: str) -> DataFrame:
    return ex.sentence_table(fx.utterances(spark, d)).select("event_id", "idx", "sentence")


def _notes(spark: SparkSession, d: str) -> DataFrame:
    lines = fx.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.withColumn("line", F.expr(_LINES))


@query(f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT trim(CASE i % 5 WHEN 0 THEN concat('- You must ', line) WHEN 1 THEN concat('- We use ', line) WHEN 2 THEN concat('- TODO ', line) WHEN 3 THEN concat('- ', line) ELSE line END, ' ') AS raw FROM l),
b AS (SELECT raw, regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_replace(raw, '^[-*+>]+', ''), ' '), '^[0-9.)]+', ''), ' '), '[.;]+$', ''), '[*_`]', '', 'g') AS note FROM p),
k AS (SELECT CASE WHEN regexp_matches(raw, '^[-*+>0-9]') AND octet_length(encode(note)) >= 8 AND NOT starts_with(note, '|') AND NOT starts_with(note, '#') THEN
  CASE WHEN contains(lower(note), '?') OR starts_with(lower(note), 'todo') OR starts_with(lower(note), 'tbd') OR starts_with(lower(note), 'open question') THEN 'OpenItem'
    WHEN {_contains_any('lower(note)', schema.DECISION_MARKERS)} THEN 'Decision' WHEN {_contains_any('lower(note)', schema.RULE_MARKERS)} THEN 'Rule' END END AS node_type FROM b)
SELECT node_type, count(*) AS n FROM k GROUP BY node_type""")
def classify_markdown_line(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every document, marked or not; a null class counts those that say nothing."""
    return _notes(spark, d).select(tx.note_class(F.col("line")).alias("node_type")).groupBy("node_type").agg(F.count("*").alias("n"))


@query(r"SELECT id, concat('imp-', substr(sha256(trim(regexp_replace(lower(label), '[^a-z0-9\s]', '', 'g'))), 1, 16)) AS stable FROM fx_nodes")
def stable_id(spark: SparkSession, d: str) -> DataFrame:
    return fx.nodes(spark, d).select("id", tx.stable_id(F.col("label")).alias("stable"))


@query()
def import_markdown(spark: SparkSession, d: str) -> DataFrame:
    docs = _notes(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    docs = docs.select(F.lit(fx.PROJECT).alias("project_id"), F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), F.array_join(F.col("l.line"), "\n").alias("content"))
    return rd.import_markdown(docs)


@query("SELECT page_id, CASE WHEN url LIKE '%.gov%' OR url LIKE '%.edu%' THEN 0.85 ELSE 0.5 END AS credibility FROM pages WHERE lower(url) NOT SIMILAR TO '.*(wikipedia.org|nature.com|reuters.com|apnews.com|bbc.com|nytimes.com|wsj.com|economist.com).*'")
def domain_credibility(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select("page_id", F.round(tx.domain_credibility(F.col("url")), 2).cast("decimal(3,2)").alias("credibility"))


# Readers, over lines that the tables are written as


@query("SELECT concat('u', conv_id, '-', turn) AS id, concat('s', conv_id % 20) AS session_id, text, CASE WHEN role = 'user' THEN 'user_prompt' ELSE 'utterance' END AS event_kind FROM conversations WHERE turn % 4 <> 3 AND text IS NOT NULL")
def scan_events_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Turns as JSON lines, among blank and broken ones and ones of an unknown kind, read from a folder."""
    rows = fx.utterances(spark, d).withColumn("turn", F.col("seq") % 100)
    kind = F.when(F.col("turn") % 4 == 3, "other").when(F.col("agent_role") == "user", "user_prompt")
    good = F.to_json(F.struct("id", "session_id", "agent_role", "start_time", "end_time", "text", kind.alias("event_kind")))
    path = new_path(spark, "event-lines")
    rows.select(F.explode(F.array(good, F.lit(""), F.lit("{broken"), F.to_json(F.struct("id")))).alias("value")).write.text(path)
    return rd.scan_events_jsonl(spark, path).select("id", "session_id", "text", "event_kind")


@query("SELECT text FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND conv_id % 5 <> 0")
def transcript_to_events(spark: SparkSession, d: str) -> DataFrame:
    """Turns as transcript lines: blocks or plain text, every fifth conversation a side chain."""
    turns = fx.table(spark, d, "conversations")
    blocks = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"))).alias("content")).alias("message")))
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message"), (F.col("conv_id") % 5 == 0).alias("isSidechain")))
    return rd.transcript_to_events(turns.select(F.when((F.col("turn") % 2 == 0) & (F.col("conv_id") % 5 != 0), blocks).otherwise(plain).alias("value")))


@query("""SELECT concat('t', event_id) AS id, concat('/w/src/m', CAST(json_extract(props, '$.k') AS BIGINT) % 12, '.rs') AS file, concat(event_type, ' ', event_id) AS text FROM events""")
def tool_payload_to_events(spark: SparkSession, d: str) -> DataFrame:
    """Tool events as hook payloads: the file in one of two fields, twice, relative to the working folder."""
    rows = fx.table(spark, d, "events").selectExpr("event_id", "event_type AS tool_name", "'/w' AS cwd", "concat('src/m', cast(get_json_object(props, '$.k') AS bigint) % 12, '.rs') AS file")
    said = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("file").alias("file_path"), F.array("file").alias("paths")))).otherwise(F.to_json(F.struct(F.col("file").alias("path"))))
    calls = rows.select("tool_name", "cwd", said.alias("input"), F.to_json(F.struct(F.col("event_id").cast("string").alias("output"))).alias("response"))
    found = rd.tool_payload_to_events(calls)
    return found.select(F.concat(F.lit("t"), F.element_at(F.split("text", " "), -1)).alias("id"), F.array_join("files", ",").alias("file"), "text")


@query("""SELECT concat('s', conv_id % 20) AS session_id, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'system' END AS agent_role, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY ALL""")
def capture_prompts(spark: SparkSession, d: str) -> DataFrame:
    turns = fx.utterances(spark, d)
    of = lambda role: turns.where(F.col("agent_role") == role if role else ~F.col("agent_role").isin("user", "assistant")).select("session_id", "text")
    return rd.capture_prompts(of("user"), of("assistant"), of(None)).groupBy("session_id", "agent_role").agg(F.count("*").alias("n"))


@query("SELECT concat('b', seq) AS batch_id, id, label FROM fx_nodes WHERE seq % 3 <> 2")
def load_raw_responses(spark: SparkSession, d: str) -> DataFrame:
    """A node a response: as tool input, in prose and cut off after it, or not at all."""
    node = F.to_json(F.struct(F.array(F.struct("id", "node_type", "label")).alias("nodes")))
    tool = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct("id", "node_type", "label")).alias("nodes")).alias("input"))).alias("content")))
    cut = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("Here: "), F.substring(node, 1, 1_000_000), F.lit("")).alias("text"))).alias("content")))
    body = F.when(F.col("seq") % 3 == 0, tool).when(F.col("seq") % 3 == 1, cut).otherwise(F.lit("nothing to say"))
    parsed, _ = rd.load_raw_responses(fx.nodes(spark, d).select(F.concat(F.lit("b"), "seq").alias("batch_id"), body.alias("body")))
    return parsed.select("batch_id", F.explode("r.nodes").alias("n")).select("batch_id", "n.id", "n.label")


# Writes


@query("SELECT id, node_type, seq FROM fx_nodes WHERE seq % 7 <> 0")
def add_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    batch = nodes.union(nodes.withColumn("seq", F.col("seq") + 1_000_000).withColumn("label", F.lit("late")))
    return wr.add_nodes(nodes.where("seq % 7 = 0"), batch).select("id", "node_type", "seq")


@query("SELECT e.id, edge_type FROM fx_edges e JOIN fx_nodes a ON a.id = source_node_id JOIN fx_nodes b ON b.id = target_node_id WHERE a.seq % 7 <> 0 AND b.seq % 7 <> 0 AND e.seq % 5 <> 0")
def add_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.edges(spark, d)
    return wr.add_edges(fx.nodes(spark, d).where("seq % 7 <> 0"), edges.where("seq % 5 = 0"), edges.union(edges)).select("id", "edge_type")


@query("SELECT id, edge_type FROM fx_edges WHERE source_node_id IN (SELECT id FROM fx_nodes WHERE status = 'Active') AND target_node_id IN (SELECT id FROM fx_nodes WHERE status = 'Active')")
def load_graph(spark: SparkSession, d: str) -> DataFrame:
    return sc.with_ends(fx.edges(spark, d), fx.nodes(spark, d).where("status = 'Active'")).select("id", "edge_type")


@query("""SELECT concat('d', o.id, '>', o.id) AS id, o.id AS target_node_id, concat('Decision ''settle ', o.label, ''' resolves this') AS reasoning FROM fx_nodes o WHERE node_type = 'OpenItem'""")
def apply_decision(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    commands = nodes.where("node_type = 'OpenItem'").select(
        "project_id", "seq", F.concat(F.lit("d"), "id").alias("id"), F.concat(F.lit("settle "), "label").alias("label"), F.lit(None).cast("string").alias("agent_id"),
        F.array(F.col("id"), F.lit("missing")).alias("resolves"), F.array().cast("array<string>").alias("resolutions"),
    )
    return wr.apply_decision(commands, nodes)[1].select("id", "target_node_id", "reasoning")


@query("""SELECT concat('q', conv_id, '-', turn) AS id, 'OpenItem' AS node_type, substr(text, 1, 60) AS label, CASE WHEN turn % 4 = 0 THEN 'agent' ELSE role END AS agent_id,
  concat('s', conv_id % 20) AS session_id, 0 AS n_files, 'Active' AS status, 1 AS mention_count FROM conversations WHERE role = 'user'""")
def apply_question(spark: SparkSession, d: str) -> DataFrame:
    asked = fx.utterances(spark, d).where("agent_role = 'user'").select(
        "project_id", "seq", F.concat(F.lit("q"), F.substring("id", 2, 40)).alias("id"), F.substring("text", 1, 60).alias("label"), F.col("text").alias("description"),
        F.expr("CASE WHEN seq % 100 % 4 <> 0 THEN agent_role END").alias("agent_id"), "session_id", F.lit(None).cast("array<string>").alias("files"), F.col("start_time").alias("timestamp"),
    )
    return wr.apply_question(asked).select("id", "node_type", "label", "agent_id", "session_id", F.size("files").alias("n_files"), "status", "mention_count")


@query("SELECT id, CASE WHEN seq % 3 = 0 THEN 'Invalidated' ELSE status END AS status FROM fx_nodes")
def fold_commands(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    hit = nodes.where("seq % 3 = 0").select("project_id", "id", "seq")
    commands = hit.withColumn("status", F.lit("Active")).union(hit.withColumn("seq", F.col("seq") + 1).withColumn("status", F.lit("Invalidated")))
    return wr.fold_status(nodes, commands).select("id", "status")


@query("SELECT concat('inv-', id) AS source_node_id, id AS target_node_id, concat('Invalidated: ', substr(label, 1, 60)) AS label FROM fx_nodes WHERE seq % 3 = 0")
def apply_invalidate_with_refutation(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    made, edges = wr.refutations(nodes.where("seq % 3 = 0").select("project_id", "seq", "id", F.lit("wrong").alias("reasoning")), nodes)
    return edges.join(made.select("project_id", F.col("id").alias("source_node_id"), "label"), ["project_id", "source_node_id"]).select("source_node_id", "target_node_id", "label")


@query("SELECT id, concat(label, ' v2') AS label FROM fx_nodes WHERE seq % 7 = 0 UNION ALL SELECT id, label FROM fx_nodes WHERE seq % 7 <> 0")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d).select("project_id", "id", "label", "seq")
    late = nodes.where("seq % 7 = 0").select("project_id", "id", F.concat("label", F.lit(" v2")), F.col("seq") + 1)
    return wr.upsert_latest(nodes.union(late)).select("id", "label")


# Debt

_DEBT_SQL = """ring_e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM fx_edits) WHERE r <= 100),
ring_c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM fx_checks) WHERE r <= 100),
unverified AS (SELECT id FROM ring_e e WHERE NOT EXISTS (SELECT 1 FROM ring_c c WHERE c.session_id = e.session_id AND c.file = e.file AND c.end_time >= e.end_time)),
latest AS (SELECT *, row_number() OVER (PARTITION BY session_id, file ORDER BY end_time DESC, seq) AS p FROM ring_c),
failing AS (SELECT id FROM latest c WHERE p = 1 AND NOT passed AND NOT EXISTS (SELECT 1 FROM ring_e e WHERE e.session_id = c.session_id AND e.file = c.file AND e.end_time >= c.end_time)),
violations AS (SELECT c.id, (SELECT arg_min(n.id, n.seq) FROM fx_nodes n WHERE n.node_type = 'Rule' AND n.status = 'Active' AND n.file = c.file) AS rule FROM ring_c c WHERE NOT c.passed),
items AS (SELECT 'UnresolvedOpenItem' AS debt_type, id AS ids, severity FROM fx_debt_open UNION ALL SELECT 'UnverifiedChange', id, 'Medium' FROM unverified
  UNION ALL SELECT 'FailedVerification', id, 'High' FROM failing UNION ALL SELECT 'RuleViolation', concat(id, ',', rule), 'High' FROM violations WHERE rule IS NOT NULL)
"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return de.debt_items(fx.nodes(spark, d), fx.edges(spark, d), fx.tool_events(spark, d))


@query("SELECT id, severity FROM fx_debt_open")
def debt_unresolved_open_item(spark: SparkSession, d: str) -> DataFrame:
    return de.unresolved_open_items(fx.nodes(spark, d), fx.edges(spark, d)).select(F.col("node_ids")[0].alias("id"), "severity")


@query(_DEBT_SQL + "SELECT id, session_id, file FROM ring_e")
def scratch_edits(spark: SparkSession, d: str) -> DataFrame:
    return de.scratch(fx.tool_events(spark, d))[0].select("id", "session_id", F.col("files")[0].alias("file"))


@query(_DEBT_SQL + "SELECT id, session_id, file, passed FROM ring_c")
def scratch_checks(spark: SparkSession, d: str) -> DataFrame:
    return de.scratch(fx.tool_events(spark, d))[1].select("id", "session_id", F.col("files")[0].alias("file"), "passed")


@query(_DEBT_SQL + "SELECT id FROM unverified")
def debt_unverified_change(spark: SparkSession, d: str) -> DataFrame:
    return de.unverified_changes(*de.scratch(fx.tool_events(spark, d))).select(F.col("node_ids")[0].alias("id"))


@query(_DEBT_SQL + "SELECT id FROM failing")
def debt_failed_verification(spark: SparkSession, d: str) -> DataFrame:
    return de.failed_verifications(*de.scratch(fx.tool_events(spark, d))).select(F.col("node_ids")[0].alias("id"))


@query(_DEBT_SQL + "SELECT id, rule FROM violations WHERE rule IS NOT NULL")
def debt_rule_violation(spark: SparkSession, d: str) -> DataFrame:
    found = de.rule_violations(de.scratch(fx.tool_events(spark, d))[1], fx.nodes(spark, d))
    return found.select(F.col("node_ids")[0].alias("id"), F.col("node_ids")[1].alias("rule"))


@query(_DEBT_SQL + "SELECT count(*) AS n_items, CAST(sum(CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS BIGINT) AS total_score, CASE WHEN count(*) = 0 THEN 'green' WHEN total_score < 5 THEN 'amber' ELSE 'red' END AS band FROM items")
def debt_report(spark: SparkSession, d: str) -> DataFrame:
    return de.debt_report(_items(spark, d), fx.nodes(spark, d)).drop("project_id")


@query(_DEBT_SQL + "SELECT debt_type, count(*) AS n, CASE WHEN sum(sum(CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END)) OVER () < 5 THEN 'amber' ELSE 'red' END AS band FROM items GROUP BY debt_type")
def debt_by_type(spark: SparkSession, d: str) -> DataFrame:
    return de.debt_by_type(_items(spark, d)).drop("project_id")


@query("""half AS (SELECT median(seq) AS m FROM fx_nodes),
prior AS (SELECT id FROM fx_nodes WHERE seq < (SELECT m FROM half) AND node_type = 'OpenItem' AND status <> 'Invalidated' AND id NOT IN (
  SELECT e.target_node_id FROM fx_edges e JOIN fx_nodes a ON a.id = e.source_node_id JOIN fx_nodes b ON b.id = e.target_node_id
  WHERE edge_type = 'Resolves' AND a.seq < (SELECT m FROM half) AND b.seq < (SELECT m FROM half)))
SELECT count(*) FILTER (p.id IS NULL) AS new_items, count(*) FILTER (c.id IS NULL) AS resolved_items, count(*) FILTER (p.id IS NOT NULL AND c.id IS NOT NULL) AS persisted_items,
  count(*) FILTER (p.id IS NULL) - count(*) FILTER (c.id IS NULL) AS net FROM fx_debt_open c FULL JOIN prior p ON p.id = c.id""")
def debt_delta(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = fx.nodes(spark, d), fx.edges(spark, d)
    half = nodes.agg(F.expr("percentile(seq, 0.5)")).first()[0] or 0
    old = nodes.where(F.col("seq") < half)
    prior = de.unresolved_open_items(old, sc.with_ends(edges, old))
    return de.debt_delta(de.unresolved_open_items(nodes, edges), prior).drop("project_id")


@query(_DEBT_SQL + """, ses AS (SELECT session_id, row_number() OVER (ORDER BY min(seq), session_id) - 1 AS i FROM (SELECT session_id, seq FROM fx_nodes UNION ALL SELECT session_id, seq FROM fx_tools) GROUP BY session_id),
done AS (SELECT target_node_id AS id, min(s.i) AS d FROM fx_edges e JOIN fx_nodes n ON n.id = e.source_node_id JOIN ses s ON s.session_id = n.session_id WHERE edge_type = 'Resolves' GROUP BY 1),
rules AS (SELECT file, min(s.i) AS since FROM fx_nodes n JOIN ses s USING (session_id) WHERE node_type = 'Rule' AND status = 'Active' GROUP BY file),
spans AS (SELECT 'open' AS kind, s.i AS b, done.d AS d FROM fx_nodes n JOIN ses s USING (session_id) LEFT JOIN done ON done.id = n.id WHERE node_type = 'OpenItem' AND status <> 'Invalidated' AND (done.d IS NULL OR done.d > s.i)
  UNION ALL SELECT 'unverified', s.i, s.i + 16 FROM unverified u JOIN fx_tools t ON t.id = u.id JOIN ses s USING (session_id) UNION ALL SELECT 'failing', s.i, s.i + 16 FROM failing f JOIN fx_tools t ON t.id = f.id JOIN ses s USING (session_id)
  UNION ALL SELECT 'violations', greatest(s.i, since), s.i + 16 FROM ring_c c JOIN rules USING (file) JOIN ses s USING (session_id) WHERE NOT passed AND since < s.i + 16)
SELECT session_id, i AS session_index, count(*) FILTER (kind = 'open' AND (d IS NULL OR d > i)) AS open_items, count(*) FILTER (kind = 'unverified' AND d > i) AS unverified,
  count(*) FILTER (kind = 'failing' AND d > i) AS failing, count(*) FILTER (kind = 'violations' AND d > i) AS violations, count(*) FILTER (b = i) AS raised,
  CAST(coalesce(sum(CASE WHEN kind = 'unverified' OR (kind = 'open' AND b = i) THEN 2 ELSE 3 END) FILTER (d IS NULL OR d > i), 0) AS BIGINT) AS total_score
FROM ses LEFT JOIN spans ON b <= i GROUP BY session_id, i""")
def debt_over_sessions(spark: SparkSession, d: str) -> DataFrame:
    return de.debt_over_sessions(fx.nodes(spark, d), fx.edges(spark, d), fx.tool_events(spark, d)).drop("project_id")


# Decisions, risks, diff

_STATUS_SQL = """dec AS (SELECT n.*, (SELECT count(*) FROM fx_edges e WHERE e.target_node_id = n.id AND edge_type = 'Supersedes') AS sup,
  (SELECT count(*) FROM fx_edges e WHERE e.target_node_id = n.id AND edge_type = 'RelatesTo') AS rel, (SELECT count(*) FROM fx_edges e WHERE e.target_node_id = n.id AND edge_type = 'Refutes') AS ref,
  (SELECT count(*) FROM fx_edges e WHERE e.source_node_id = n.id AND edge_type = 'Resolves') AS res FROM fx_nodes n WHERE node_type = 'Decision' AND status <> 'Invalidated'),
st AS (SELECT *, CASE WHEN sup > 0 THEN 'Superseded' WHEN rel > 0 AND res > 0 THEN 'Validated' WHEN ref > 0 AND res = 0 THEN 'Blocked' ELSE 'Pending' END AS decision_status FROM dec)
"""


@query(_STATUS_SQL + "SELECT id, decision_status FROM st")
def decision_status(spark: SparkSession, d: str) -> DataFrame:
    return dc.decision_status(fx.nodes(spark, d), fx.edges(spark, d)).select("id", "decision_status")


_RATIONALE_SQL = """why AS (SELECT e.target_node_id AS id, string_agg(concat(CASE edge_type WHEN 'RelatesTo' THEN 'Grounded by ' WHEN 'Refutes' THEN 'Refuted by ' ELSE 'Superseded by ' END, n.agent_id, ' (S', s.session_index + 1, '): ', e.reasoning), '; ' ORDER BY e.seq DESC, e.id) AS r
  FROM fx_edges e JOIN fx_nodes n ON n.id = e.source_node_id JOIN fx_sessions s ON s.session_id = n.session_id WHERE edge_type <> 'Resolves' GROUP BY 1)
"""


@query(_RATIONALE_SQL + """SELECT n.id, coalesce(r, concat('Decision made by ', agent_id, ' in S', session_index + 1, ': ', description)) AS rationale FROM fx_nodes n JOIN fx_sessions USING (session_id) LEFT JOIN why ON why.id = n.id WHERE node_type = 'Decision' AND status <> 'Invalidated'""")
def decision_rationale(spark: SparkSession, d: str) -> DataFrame:
    return dc.decision_rationale(fx.nodes(spark, d), fx.edges(spark, d)).select("id", "rationale")


_BLOCKED_SQL = """rel AS (SELECT DISTINCT source_node_id AS a, target_node_id AS b FROM fx_edges WHERE edge_type = 'RelatesTo'),
hop AS (SELECT a, b FROM rel UNION SELECT x.a, y.b FROM rel x JOIN rel y ON y.a = x.b),
blocked AS (SELECT a AS id, label FROM rel JOIN fx_nodes n ON n.id = b UNION SELECT a, label FROM hop JOIN fx_nodes n ON n.id = b WHERE n.node_type = 'OpenItem' AND a <> b)
"""


@query(_BLOCKED_SQL + """SELECT n.id, coalesce((SELECT array_to_string(list_sort(list(label))[1:10], '|') FROM blocked b WHERE b.id = n.id), '') AS blocked_work FROM fx_nodes n WHERE node_type = 'Decision' AND status <> 'Invalidated'""")
def decision_blocked_work(spark: SparkSession, d: str) -> DataFrame:
    return dc.decision_blocked_work(fx.nodes(spark, d), fx.edges(spark, d)).select("id", F.array_join("blocked_work", "|").alias("blocked_work"))


@query("""SELECT n.id, coalesce((SELECT string_agg(concat('Resolves open item: ', t.label), '|' ORDER BY e.seq DESC, t.id) FROM fx_edges e JOIN fx_nodes t ON t.id = e.target_node_id
  WHERE e.source_node_id = n.id AND edge_type = 'Resolves' AND t.node_type = 'OpenItem'), '') AS criteria FROM fx_nodes n WHERE node_type = 'Decision' AND status <> 'Invalidated'""")
def decision_validation_criteria(spark: SparkSession, d: str) -> DataFrame:
    return dc.decision_validation_criteria(fx.nodes(spark, d), fx.edges(spark, d)).select("id", F.array_join("criteria", "|").alias("criteria"))


@query(_STATUS_SQL + ", " + _RATIONALE_SQL + ", " + _BLOCKED_SQL + """SELECT st.id, nullif(agent_id, '') AS owner, decision_status, timestamp, coalesce(r, concat('Decision made by ', agent_id, ' in S', session_index + 1, ': ', description)) AS rationale,
  coalesce((SELECT array_to_string(list_sort(list(label))[1:10], '|') FROM blocked b WHERE b.id = st.id), '') AS blocked_work,
  coalesce((SELECT string_agg(concat('Resolves open item: ', t.label), '|' ORDER BY e.seq DESC, t.id) FROM fx_edges e JOIN fx_nodes t ON t.id = e.target_node_id WHERE e.source_node_id = st.id AND edge_type = 'Resolves' AND t.node_type = 'OpenItem'), '') AS criteria
FROM st JOIN fx_sessions USING (session_id) LEFT JOIN why ON why.id = st.id""")
def decision_timeline(spark: SparkSession, d: str) -> DataFrame:
    found = dc.decision_timeline(fx.nodes(spark, d), fx.edges(spark, d))
    return found.select("id", "owner", "decision_status", "timestamp", "rationale", F.array_join("blocked_work", "|").alias("blocked_work"), F.array_join("criteria", "|").alias("criteria"))


_DOWN_SQL = """e1 AS (SELECT DISTINCT source_node_id AS a, target_node_id AS b FROM fx_edges),
e2 AS (SELECT a, b FROM e1 UNION SELECT x.a, y.b FROM e1 x JOIN e1 y ON y.a = x.b), e3 AS (SELECT a, b FROM e2 UNION SELECT x.a, y.b FROM e2 x JOIN e1 y ON y.a = x.b),
down AS (SELECT a AS id, count(*) AS n FROM e3 WHERE a <> b GROUP BY a)
"""


@query(_DOWN_SQL + "SELECT n.id, coalesce(d.n, 0) AS downstream FROM fx_nodes n LEFT JOIN down d ON d.id = n.id")
def downstream_count(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    found = dc.reach(nodes.select("project_id", F.col("id").alias("start")), fx.edges(spark, d), 3).groupBy("start").agg(F.count("*").alias("n"))
    return nodes.join(found, F.col("id") == F.col("start"), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("downstream"))


@query(_BLOCKED_SQL + "SELECT a AS id, b AS item FROM hop JOIN fx_nodes n ON n.id = b WHERE n.node_type = 'OpenItem' AND a <> b")
def downstream_open_items(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    found = dc.reach(nodes.select("project_id", F.col("id").alias("start")), fx.edges(spark, d), 2, "RelatesTo")
    return found.join(nodes.where("node_type = 'OpenItem'").select("project_id", "id"), ["project_id", "id"], "left_semi").select(F.col("start").alias("id"), F.col("id").alias("item"))


@query(_DOWN_SQL + """SELECT o.id, o.severity, CAST(round(greatest(least(least(coalesce(d.n, 0), 4) / 4.0 * 60 + CASE WHEN s.session_index >= (SELECT max(session_index) FROM fx_sessions) - 1 THEN 20 ELSE 5 END, 100), 5)) AS BIGINT) AS impact
FROM fx_debt_open o JOIN fx_sessions s USING (session_id) LEFT JOIN down d ON d.id = o.id""")
def risks(spark: SparkSession, d: str) -> DataFrame:
    return dc.risks(fx.nodes(spark, d), fx.edges(spark, d)).select("id", "severity", "impact")


_SUMMARY_SQL = _STATUS_SQL + """, now AS (SELECT max(session_index) AS i FROM fx_sessions), old AS (SELECT n.* FROM fx_nodes n JOIN fx_sessions s USING (session_id) WHERE session_index < (SELECT i FROM now)),
was AS (SELECT id FROM old WHERE node_type = 'OpenItem' AND status <> 'Invalidated' AND id NOT IN (SELECT target_node_id FROM fx_edges WHERE edge_type = 'Resolves' AND source_node_id IN (SELECT id FROM old) AND target_node_id IN (SELECT id FROM old))),
d AS (SELECT count(*) FILTER (w.id IS NULL) AS new_items, count(*) FILTER (o.id IS NULL) AS resolved_items, count(*) FILTER (w.id IS NOT NULL AND o.id IS NOT NULL) AS persisted_items FROM fx_debt_open o FULL JOIN was w ON w.id = o.id),
summary AS (SELECT (SELECT session_id FROM fx_sessions WHERE session_index = (SELECT i FROM now)) AS session_id, (SELECT session_id FROM fx_sessions WHERE session_index = (SELECT i - 1 FROM now)) AS prior_session_id,
  (SELECT count(*) FROM st) AS n_decisions, (SELECT count(*) FROM st WHERE decision_status = 'Pending') AS n_pending, (SELECT count(*) FROM fx_debt_open) AS n_risks, *, new_items - resolved_items AS net FROM d)
"""


def _summary(spark: SparkSession, d: str) -> DataFrame:
    """Against the debt before the current session."""
    nodes, edges = fx.nodes(spark, d), fx.edges(spark, d)
    sessions = sc.register_sessions(nodes)
    now = sessions.groupBy("project_id").agg(F.max("session_index").alias("now"))
    old = nodes.join(sessions.join(now, "project_id").where("session_index < now").select("project_id", "session_id"), ["project_id", "session_id"], "left_semi").select(*nodes.columns)
    return dc.executive_summary(nodes, edges, de.unresolved_open_items(old, sc.with_ends(edges, old)))


@query(_SUMMARY_SQL + """, down1 AS (SELECT DISTINCT source_node_id AS a, target_node_id AS b FROM fx_edges), down2 AS (SELECT a, b FROM down1 UNION SELECT x.a, y.b FROM down1 x JOIN down1 y ON y.a = x.b),
down3 AS (SELECT a, b FROM down2 UNION SELECT x.a, y.b FROM down2 x JOIN down1 y ON y.a = x.b), down AS (SELECT a AS id, count(*) AS n FROM down3 WHERE a <> b GROUP BY a),
risk AS (SELECT o.id, CAST(round(greatest(least(least(coalesce(d.n, 0), 4) / 4.0 * 60 + CASE WHEN s.session_index >= (SELECT i FROM now) - 1 THEN 20 ELSE 5 END, 100), 5)) AS BIGINT) AS impact
  FROM fx_debt_open o JOIN fx_sessions s USING (session_id) LEFT JOIN down d ON d.id = o.id)
SELECT *, coalesce((SELECT string_agg(concat(id, ' ', decision_status), '|' ORDER BY seq, id) FROM st), '') AS decisions, coalesce((SELECT string_agg(concat(id, ' ', impact), '|' ORDER BY impact DESC, id) FROM risk), '') AS risks FROM summary""")
def executive_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = lambda c, what: F.array_join(F.transform(c, lambda x: F.concat(x["id"], F.lit(" "), x[what])), "|").alias(c)
    found = _summary(spark, d).drop("project_id")
    return found.select(*(c for c in found.columns if c not in ("decisions", "risks")), lines("decisions", "decision_status"), lines("risks", "impact"))


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    before = fx.nodes(spark, d).withColumn("confidence", F.lit(0.5))
    after = before.where("seq % 17 <> 0").withColumn("label", F.when(F.col("seq") % 7 == 0, F.concat("label", F.lit(" v2"))).otherwise(F.col("label")))
    return before.where("seq % 13 <> 0"), after.withColumn("confidence", F.when(F.col("seq") % 5 == 0, 0.7).otherwise(0.505))


@query("SELECT id, 'added' AS change FROM fx_nodes WHERE seq % 13 = 0 AND seq % 17 <> 0 UNION ALL SELECT id, 'removed' FROM fx_nodes WHERE seq % 13 <> 0 AND seq % 17 = 0")
def diff_added_removed(spark: SparkSession, d: str) -> DataFrame:
    return dc.diff_ids(*_history(spark, d)).select("id", "change")


@query("""SELECT id, concat_ws(',', CASE WHEN seq % 7 = 0 THEN 'label' END, CASE WHEN seq % 5 = 0 THEN 'confidence' END) AS fields FROM fx_nodes WHERE seq % 13 <> 0 AND seq % 17 <> 0 AND (seq % 7 = 0 OR seq % 5 = 0)""")
def diff_changed(spark: SparkSession, d: str) -> DataFrame:
    return dc.diff_changed(*_history(spark, d)).select("id", F.array_join("fields", ",").alias("fields"))


@query("""n AS (SELECT *, seq % 13 <> 0 AS was, seq % 17 <> 0 AS is_now FROM fx_nodes),
e AS (SELECT e.id, a.was AND b.was AS was, a.is_now AND b.is_now AND e.seq % 11 <> 0 AS is_now FROM fx_edges e JOIN n a ON a.id = e.source_node_id JOIN n b ON b.id = e.target_node_id)
SELECT 'node' AS kind, id, CASE WHEN NOT was THEN 'added' ELSE 'removed' END AS change, '' AS fields FROM n WHERE was <> is_now
UNION ALL SELECT 'node', id, 'changed', concat_ws(',', CASE WHEN seq % 7 = 0 THEN 'label' END, CASE WHEN seq % 5 = 0 THEN 'confidence' END) FROM n WHERE was AND is_now AND (seq % 7 = 0 OR seq % 5 = 0)
UNION ALL SELECT 'edge', id, CASE WHEN NOT was THEN 'added' ELSE 'removed' END, '' FROM e WHERE was <> is_now""")
def graph_diff_between(spark: SparkSession, d: str) -> DataFrame:
    """Three snapshots recorded one after the other; what differs between the first and the last."""
    first, last = _history(spark, d)
    columns = ["project_id", "id", "label", "description", "node_type", "agent_id", "confidence"]
    edges = fx.edges(spark, d).select("project_id", "id", "edge_type", "source_node_id", "target_node_id", "seq")
    middle = first.where("seq % 3 <> 0")
    held, links = None, None
    for t, nodes, kept in ((1.0, first, edges), (2.0, middle, edges), (3.0, last, edges.where("seq % 11 <> 0"))):
        held = dc.record_history(held, nodes.select(columns), t)
        links = dc.record_history(links, sc.with_ends(kept, nodes), t)
    found = dc.graph_diff_between(stage(held, "nodes-history"), stage(links, "edges-history"), 1.5, 3.0)
    return found.select("kind", "id", "change", F.array_join("fields", ",").alias("fields"))


# Retrieval and traversal

_BM25_SQL = rf"""tok AS (SELECT id, lower(regexp_replace(unnest(regexp_split_to_array(lower(concat(label, ' ', description)), '\s+')), '[^\p{{L}}\p{{N}}]', '', 'g')) AS term FROM fx_nodes),
kept AS (SELECT * FROM tok WHERE term <> '' AND term NOT IN ({_STOP})),
tf AS (SELECT id, term, count(*) AS tf FROM kept GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), ln AS (SELECT id, count(*) AS l FROM kept GROUP BY id),
tot AS (SELECT (SELECT count(*) FROM fx_nodes) AS n, (SELECT count(*) FROM kept) AS total),
qt AS (SELECT question_id, lower(regexp_replace(unnest(regexp_split_to_array(question, '\s+')), '[^\p{{L}}\p{{N}}]', '', 'g')) AS term FROM fx_questions),
q AS (SELECT question_id, term, count(*) AS times FROM qt WHERE term <> '' AND term NOT IN ({_STOP}) GROUP BY ALL),
deg AS (SELECT n.id, (SELECT count(*) FROM fx_edges e WHERE e.source_node_id = n.id) + (SELECT count(*) FROM fx_edges e WHERE e.target_node_id = n.id) AS degree FROM fx_nodes n),
part AS (SELECT question_id, tf.id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / greatest(total / n, 1)))) AS s FROM q JOIN df USING (term) JOIN tf USING (term) JOIN ln ON ln.id = tf.id CROSS JOIN tot GROUP BY ALL),
scored AS (SELECT qq.question_id, deg.id, round(coalesce(s, 0) + 0.1 * degree, 6) AS score FROM (SELECT DISTINCT question_id FROM q) qq CROSS JOIN deg LEFT JOIN part ON part.question_id = qq.question_id AND part.id = deg.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM scored)
"""


@query("SELECT n.id, (SELECT count(*) FROM fx_edges e WHERE e.source_node_id = n.id) + (SELECT count(*) FROM fx_edges e WHERE e.target_node_id = n.id) AS degree FROM fx_nodes n")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return rt.node_degree(fx.nodes(spark, d), fx.edges(spark, d)).select("id", "degree")


@query(_BM25_SQL + "SELECT tf.id, term, tf, l AS length, df FROM tf JOIN df USING (term) JOIN ln ON ln.id = tf.id")
def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    postings, terms = rt.bm25_index(fx.nodes(spark, d))
    return postings.join(terms, ["project_id", "term"]).select("id", "term", "tf", F.col("length").cast("long").alias("length"), "df")


@query(_BM25_SQL + "SELECT question_id, id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rt.bm25_topk(fx.questions(spark, d), fx.nodes(spark, d), fx.edges(spark, d)).select("question_id", "id", "score", "rank")


@query(_BM25_SQL + "SELECT question_id, id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def bm25_stored_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking from a stored index that took a first version of some nodes, then changes and removals, then the rest."""
    nodes = fx.nodes(spark, d)
    store = Bm25Store(spark, new_path(spark, "bm25-store"))
    store.commit(0, nodes.where("seq % 3 <> 0").withColumn("label", F.expr("CASE WHEN seq % 5 = 0 THEN concat(label, ' of old') ELSE label END")).union(nodes.where("seq % 3 = 0").withColumn("id", F.concat(F.lit("gone-"), "id"))))
    store.commit(1, nodes.where("seq % 5 = 0 OR seq % 3 = 0"), nodes.where("seq % 3 = 0").select("project_id", F.concat(F.lit("gone-"), "id").alias("id")))
    return store.topk(fx.questions(spark, d), fx.edges(spark, d))[0].select("question_id", "id", "score", "rank")


_COS_SQL = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS question_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM s)
"""


@query(_COS_SQL + "SELECT question_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "embeddings").select(F.lit(fx.PROJECT).alias("project_id"), F.col("vec_id").alias("id"), "embedding")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("question_id"), "project_id", "id", "embedding")
    return rt.embedding_topk(asked, rows).select("question_id", "id", "score", "rank")


_HYBRID_SQL = """vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), vn AS (SELECT count(*) AS c FROM embeddings),
near AS (SELECT q.question_id, n.id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM (SELECT DISTINCT question_id FROM fx_questions) q CROSS JOIN vn JOIN vec a ON a.vec_id = q.question_id % c CROSS JOIN fx_nodes n JOIN vec b ON b.vec_id = n.seq % c),
nr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM near),
both_ AS (SELECT question_id, id, min(o) AS o FROM (SELECT question_id, id, rank AS o FROM ranked WHERE rank <= 10 UNION ALL SELECT question_id, id, 1000 + rank FROM nr WHERE rank <= 10) GROUP BY ALL)
"""


@query(_BM25_SQL + ", " + _HYBRID_SQL + "SELECT question_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY o) AS rank FROM both_) WHERE rank <= 15")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first ten by words, then what the ten nearest vectors add; a node's vector is that of its seq, a question's that of its id."""
    nodes, edges, questions = fx.nodes(spark, d), fx.edges(spark, d), fx.questions(spark, d)
    vectors = fx.table(spark, d, "embeddings").select("vec_id", "embedding")
    count = vectors.count() or 1
    of = lambda rows, key: rows.withColumn("vec_id", F.col(key) % count).join(vectors, "vec_id")
    second = rt.embedding_topk(of(questions, "question_id").select("question_id", "project_id", "embedding"), of(nodes, "seq").select("project_id", "id", "embedding"), 10)
    return rt.hybrid_topk(rt.bm25_topk(questions, nodes, edges, 10), second, 15).select("question_id", "id", "rank")


_KEYWORD_SQL = """und AS (SELECT source_node_id AS a, target_node_id AS b FROM fx_edges UNION SELECT target_node_id, source_node_id FROM fx_edges),
g0 AS (SELECT question_id, id FROM ranked WHERE rank <= 5), g1 AS (SELECT * FROM g0 UNION SELECT question_id, b FROM g0 JOIN und ON a = id), g2 AS (SELECT * FROM g1 UNION SELECT question_id, b FROM g1 JOIN und ON a = id),
g3 AS (SELECT * FROM g2 UNION SELECT question_id, b FROM g2 JOIN und ON a = id),
kw AS (SELECT q.question_id, tf.id, sum(times * tf) AS s FROM q JOIN tf USING (term) GROUP BY ALL),
kr AS (SELECT g3.question_id, g3.id, coalesce(kw.s, 0) AS score, row_number() OVER (PARTITION BY g3.question_id ORDER BY coalesce(kw.s, 0) DESC, n.seq) AS rank FROM g3 JOIN fx_nodes n ON n.id = g3.id LEFT JOIN kw ON kw.question_id = g3.question_id AND kw.id = g3.id)
"""


@query(_BM25_SQL + ", " + _KEYWORD_SQL + "SELECT question_id, id, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM kr WHERE rank <= 3 AND (score > 0 OR (SELECT max(score) FROM kr k WHERE k.question_id = kr.question_id) = 0)")
def keyword_count_rank(spark: SparkSession, d: str) -> DataFrame:
    """In the subgraph around each question's first five nodes."""
    nodes, edges, questions = fx.nodes(spark, d), fx.edges(spark, d), fx.questions(spark, d)
    seen = gr.bfs_nodes(rt.bm25_topk(questions, nodes, edges), edges, 3)
    return rt.keyword_count_rank(questions, seen, nodes).select("question_id", "id", "score", "rank")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d).where("node_type = 'Rule'")
    return nodes.select(F.col("session_id").alias("question_id"), "project_id", "id", F.row_number().over(sc.Window.partitionBy("session_id").orderBy("seq")).alias("rank"))


_BFS_SQL = """und AS (SELECT source_node_id AS a, target_node_id AS b FROM fx_edges UNION SELECT target_node_id, source_node_id FROM fx_edges),
b0 AS (SELECT session_id AS question_id, id FROM fx_nodes WHERE node_type = 'Rule'), b1 AS (SELECT * FROM b0 UNION SELECT question_id, b FROM b0 JOIN und ON a = id), b2 AS (SELECT * FROM b1 UNION SELECT question_id, b FROM b1 JOIN und ON a = id)
"""


@query(_BFS_SQL + "SELECT question_id, id FROM b2")
def bfs_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return gr.bfs_nodes(_seeds(spark, d), fx.edges(spark, d), 2).select("question_id", "id")


def _inside(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.edges(spark, d)
    return gr.induced_edges(gr.bfs_nodes(_seeds(spark, d), edges, 2), edges)


@query(_BFS_SQL + """, ins AS (SELECT s.question_id, e.source_node_id AS a, e.target_node_id AS b FROM fx_edges e JOIN b2 s ON s.id = e.source_node_id JOIN b2 t ON t.id = e.target_node_id AND t.question_id = s.question_id)
SELECT question_id, count(*) AS n_edges FROM ins GROUP BY question_id""")
def induced_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return _inside(spark, d).groupBy("question_id").agg(F.count("*").alias("n_edges"))


@query(_BFS_SQL + """, ins AS (SELECT s.question_id, e.source_node_id AS a, e.target_node_id AS b FROM fx_edges e JOIN b2 s ON s.id = e.source_node_id JOIN b2 t ON t.id = e.target_node_id AND t.question_id = s.question_id),
back AS (WITH RECURSIVE up AS (SELECT question_id, id FROM b0 UNION SELECT up.question_id, a FROM up JOIN ins ON ins.question_id = up.question_id AND ins.b = up.id) SELECT * FROM up)
SELECT question_id, id FROM back""")
def reverse_trace_set(spark: SparkSession, d: str) -> DataFrame:
    return gr.reverse_trace_set(_seeds(spark, d), _inside(spark, d)).select("question_id", "id")


def _each_rule(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(seeds, edges inside): a question for every rule, so that there are more questions and no larger ones as the table grows."""
    edges = fx.edges(spark, d)
    seeds = fx.nodes(spark, d).where("node_type = 'Rule'").select(F.col("id").alias("question_id"), "project_id", "id", F.lit(1).alias("rank"))
    return seeds, stage(gr.induced_edges(gr.bfs_nodes(seeds, edges, 2), edges), "inside")


@query()
def reverse_trace_order(spark: SparkSession, d: str) -> DataFrame:
    return gr.reverse_trace_order(*_each_rule(spark, d)).select("question_id", "id", "place")


@query()
def reasoning_chains(spark: SparkSession, d: str) -> DataFrame:
    seeds, inside = _each_rule(spark, d)
    return gr.reasoning_chains(gr.reverse_trace_order(seeds, inside), inside)


@query()
def answer_questions(spark: SparkSession, d: str) -> DataFrame:
    """Seeds by BM25, subgraph, the nodes in it that hold the question's words most, reverse trace from them, answer: one job for all questions."""
    nodes, edges, questions = fx.nodes(spark, d), fx.edges(spark, d), fx.questions(spark, d)
    seen = stage(gr.bfs_nodes(rt.bm25_topk(questions, nodes, edges), edges, 3), "seen")
    inside = stage(gr.induced_edges(seen, edges), "inside")
    trace = stage(gr.reverse_trace_order(rt.keyword_count_rank(questions, seen, nodes), inside), "trace")
    return rp.answer_sections(questions, seen, trace, nodes, inside).select("question_id", "answer")


# Communities

_COMM_SQL = """adj AS (SELECT least(source_node_id, target_node_id) AS a, greatest(source_node_id, target_node_id) AS b, sum(CASE edge_type WHEN 'RelatesTo' THEN 1.0 WHEN 'Resolves' THEN 0.8 WHEN 'Supersedes' THEN 0.6 ELSE 0.3 END) AS weight FROM fx_edges WHERE source_node_id <> target_node_id GROUP BY ALL),
k AS (SELECT id, sum(weight) AS k FROM (SELECT a AS id, weight FROM adj UNION ALL SELECT b, weight FROM adj) GROUP BY id), m AS (SELECT sum(weight) AS m FROM adj),
c AS (SELECT id, session_id AS community FROM fx_nodes), tot AS (SELECT community, sum(k) AS tot FROM k JOIN c USING (id) GROUP BY community)
"""


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return fx.nodes(spark, d).select("project_id", "id", F.col("session_id").alias("community"))


@query(_COMM_SQL + "SELECT a, b, round(CAST(weight AS DOUBLE), 6) AS weight FROM adj")
def community_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return cm.community_adjacency(fx.edges(spark, d)).select("a", "b", F.round("weight", 6).alias("weight"))


@query(_COMM_SQL + """, ins AS (SELECT ca.community, sum(weight) AS w FROM adj JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE ca.community = cb.community GROUP BY 1)
SELECT round(CAST(sum(coalesce(w, 0) / m - power(tot / (2 * m), 2)) AS DOUBLE), 6) AS modularity FROM tot LEFT JOIN ins USING (community) CROSS JOIN m""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    return cm.modularity(cm.community_adjacency(fx.edges(spark, d)), _assigned(spark, d)).select("modularity")


@query()
def louvain_communities(spark: SparkSession, d: str) -> DataFrame:
    return cm.louvain(fx.nodes(spark, d), fx.edges(spark, d))


@query("""t AS (SELECT session_id, node_type, count(*) AS n FROM fx_nodes GROUP BY ALL), g AS (SELECT session_id, agent_id, count(*) AS n FROM fx_nodes GROUP BY ALL)
SELECT session_id AS community, count(*) AS size, (SELECT string_agg(concat(node_type, ':', n), ',' ORDER BY n DESC, node_type) FROM t WHERE t.session_id = f.session_id) AS top_node_types,
  (SELECT string_agg(concat(agent_id, ':', n), ',' ORDER BY n DESC, agent_id) FROM g WHERE g.session_id = f.session_id) AS top_agents FROM fx_nodes f GROUP BY session_id""")
def community_descriptors(spark: SparkSession, d: str) -> DataFrame:
    found = cm.community_descriptors(fx.nodes(spark, d), _assigned(spark, d))
    return found.select("community", "size", *(F.array_join(c, ",").alias(c) for c in ("top_node_types", "top_agents")))


@query(r"""w AS (SELECT session_id AS community, unnest(regexp_split_to_array(lower(label), '\s+')) AS word FROM fx_nodes), n AS (SELECT community, word, count(*) AS n FROM w WHERE octet_length(encode(word)) > 2 AND word NOT IN (""" + _COMMUNITY + r""") GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, word) AS p FROM n), named AS (SELECT community, string_agg(word, ' · ' ORDER BY p) AS l FROM r WHERE p <= 3 GROUP BY community)
SELECT s.community, coalesce(l, concat('Community ', s.community)) AS community_label FROM (SELECT DISTINCT session_id AS community FROM fx_nodes) s LEFT JOIN named USING (community)""")
def community_label(spark: SparkSession, d: str) -> DataFrame:
    return cm.community_label(fx.nodes(spark, d), _assigned(spark, d)).select("community", "community_label")


@query(_COMM_SQL + """, x AS (SELECT e.id, least(s.community, t.community) AS ca, greatest(s.community, t.community) AS cb FROM fx_edges e JOIN c s ON s.id = source_node_id JOIN c t ON t.id = target_node_id WHERE s.community <> t.community),
p AS (SELECT ca, cb, count(*) AS n FROM x GROUP BY ALL)
SELECT x.id, x.ca AS community_a, x.cb AS community_b, round(CAST(n / (ta.tot * tb.tot / (2 * m)) AS DOUBLE), 6) AS unexpectedness FROM x JOIN p USING (ca, cb) JOIN tot ta ON ta.community = ca JOIN tot tb ON tb.community = cb CROSS JOIN m""")
def surprising_connections(spark: SparkSession, d: str) -> DataFrame:
    return cm.surprising_connections(fx.edges(spark, d), _assigned(spark, d)).select("id", "community_a", "community_b", "unexpectedness")


# Briefs


@query(_STATUS_SQL + """, pen AS (SELECT *, decision_status = 'Pending' AS pending, CASE WHEN decision_status = 'Pending' THEN seq ELSE -seq END AS o FROM st),
one AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pending, o, id) AS copy FROM pen), r AS (SELECT *, row_number() OVER (ORDER BY pending, o, id) AS place FROM one WHERE NOT pending OR copy = 1)
SELECT id, decision_status, (SELECT count(*) FROM st) AS total FROM r WHERE place <= 6""")
def brief_decisions(spark: SparkSession, d: str) -> DataFrame:
    return rp.brief_decisions(fx.nodes(spark, d), fx.edges(spark, d)).select("id", "decision_status", "total")


@query("SELECT id, label FROM fx_nodes WHERE node_type = 'Rule' AND status = 'Active' ORDER BY seq LIMIT 3")
def brief_rules(spark: SparkSession, d: str) -> DataFrame:
    return rp.brief_rules(fx.nodes(spark, d)).select("id", "label")


@query("SELECT id, label, (SELECT count(*) FROM fx_debt_open) AS total FROM fx_debt_open ORDER BY seq LIMIT 3")
def brief_open_items(spark: SparkSession, d: str) -> DataFrame:
    return rp.brief_open_items(fx.nodes(spark, d), fx.edges(spark, d)).select("id", "label", "total")


@query("""a AS (SELECT DISTINCT file FROM fx_tools WHERE session_id IN (SELECT session_id FROM fx_tools ORDER BY seq DESC LIMIT 1)),
n AS (SELECT * FROM fx_nodes n WHERE status = 'Active' AND node_type IN ('Rule', 'Decision') AND EXISTS (SELECT 1 FROM a WHERE ends_with(n.file, a.file) OR ends_with(a.file, n.file)))
SELECT id, node_type FROM (SELECT *, row_number() OVER (ORDER BY node_type <> 'Rule', seq) AS p FROM n) WHERE p <= 5""")
def brief_binding(spark: SparkSession, d: str) -> DataFrame:
    tools = fx.tool_events(spark, d)
    last = tools.groupBy("project_id").agg(F.max_by("session_id", "seq").alias("session_id"))
    active = tools.join(last, ["project_id", "session_id"], "left_semi").select("project_id", F.explode("files").alias("file"))
    return rp.brief_binding(fx.nodes(spark, d), active).select("id", "node_type")


def _cut(text: str) -> str:
    return f"CASE WHEN length({text}) > 110 THEN concat(substr({text}, 1, 110), '…') ELSE {text} END"


_WARNING_SQL = _DEBT_SQL + """, cur AS (SELECT arg_max(session_id, seq) AS s FROM fx_tools), own AS (SELECT * FROM fx_tools WHERE session_id = (SELECT s FROM cur)),
w0 AS (SELECT 'unverified' AS kind, 0 AS late, o.seq, o.id, concat('Edited ''', file, ''' via ', tool_name, ' — no test/lint/build run covered it afterwards') AS said FROM unverified JOIN own o USING (id)
  UNION ALL SELECT 'failing', 0, o.seq, o.id, concat('Check ''', tool_name, ''' on ''', file, ''' failed — no fix attempted since') FROM failing JOIN own o USING (id)
  UNION ALL SELECT 'failing', 1, o.seq, o.id, concat('Check ''', tool_name, ''' failed on files under rule ''', (SELECT label FROM fx_nodes n WHERE n.id = v.rule), ''' — possible violation') FROM violations v JOIN own o USING (id) WHERE rule IS NOT NULL),
w AS (SELECT kind, id, """ + _cut("said") + """ AS description, count(*) OVER (PARTITION BY kind) AS total, row_number() OVER (PARTITION BY kind ORDER BY late, seq, id) AS place FROM w0)
"""


@query(_WARNING_SQL + "SELECT kind, id, description, total, CAST(place AS INTEGER) AS place FROM w WHERE place <= CASE kind WHEN 'unverified' THEN 3 ELSE 2 END")
def brief_warnings(spark: SparkSession, d: str) -> DataFrame:
    return rp.brief_warnings(fx.nodes(spark, d), fx.tool_events(spark, d)).select("kind", "id", "description", "total", "place")


_BRIEF_SQL = _STATUS_SQL + ", " + _WARNING_SQL + """, pen AS (SELECT *, decision_status = 'Pending' AS pending, CASE WHEN decision_status = 'Pending' THEN seq ELSE -seq END AS o FROM st),
one AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pending, o, id) AS copy FROM pen), r AS (SELECT *, row_number() OVER (ORDER BY pending, o, id) AS place FROM one WHERE NOT pending OR copy = 1),
a AS (SELECT DISTINCT file FROM own),
bind AS (SELECT *, row_number() OVER (ORDER BY node_type <> 'Rule', seq) AS place FROM fx_nodes n WHERE status = 'Active' AND node_type IN ('Rule', 'Decision') AND EXISTS (SELECT 1 FROM a WHERE ends_with(n.file, a.file) OR ends_with(a.file, n.file))),
rules AS (SELECT *, row_number() OVER (ORDER BY seq) AS place FROM fx_nodes WHERE node_type = 'Rule' AND status = 'Active'),
open_ AS (SELECT concat('Open item ''', n.label, ''' raised by ', n.agent_id, ' has not been resolved') AS said, row_number() OVER (ORDER BY n.seq, n.id) AS place FROM fx_debt_open o JOIN fx_nodes n USING (id)),
l AS (SELECT 1 AS s, 'Decisions' AS t, (SELECT count(*) FROM st) AS n, place, concat('- [', decision_status, '] ', """ + _cut("label") + """) AS line FROM r WHERE place <= 6
  UNION ALL SELECT 2, 'Rules', least((SELECT count(*) FROM rules), 3), place, concat('- ', """ + _cut("label") + """) FROM rules WHERE place <= 3
  UNION ALL SELECT 3, 'Open items', (SELECT count(*) FROM open_), place, concat('- ', """ + _cut("said") + """) FROM open_ WHERE place <= 3
  UNION ALL SELECT 4, 'Binding here', least((SELECT count(*) FROM bind), 5), place, concat('- [', node_type, '] ', """ + _cut("label") + """) FROM bind WHERE place <= 5
  UNION ALL SELECT 5, 'Unverified edits', total, place, concat('- ', description) FROM w WHERE kind = 'unverified' AND place <= 3
  UNION ALL SELECT 6, 'Failing checks', total, place, concat('- ', description) FROM w WHERE kind = 'failing' AND place <= 2),
parts AS (SELECT s, concat(t, ' (', n, '):', chr(10), string_agg(line, chr(10) ORDER BY place)) AS part FROM l GROUP BY s, t, n)
"""


@query(_BRIEF_SQL + """SELECT concat('<reasoning-state nodes="', (SELECT count(*) FROM fx_nodes), '" edges="', (SELECT count(*) FROM fx_edges), '">', chr(10), string_agg(part, chr(10) ORDER BY s), chr(10), '</reasoning-state>') AS brief FROM parts""")
def brief_text(spark: SparkSession, d: str) -> DataFrame:
    """With the files of the session that was active last."""
    tools = fx.tool_events(spark, d)
    active = tools.join(de.current_sessions(tools), ["project_id", "session_id"], "left_semi").select("project_id", F.explode("files").alias("file"))
    return rp.brief_text(fx.nodes(spark, d), fx.edges(spark, d), tools, active).select("brief")


# Extraction policy

_JUDGED = "CASE (conv_id + turn + idx) % 3 WHEN 0 THEN 'Decision' WHEN 1 THEN 'OpenItem' ELSE 'noise' END"


def _judgments(sentences: DataFrame) -> DataFrame:
    rows = sentences.withColumn("conv_id", F.split(F.substring("event_id", 2, 40), "-")[0].cast("long")).withColumn("turn", F.split("event_id", "-")[1].cast("long"))
    return rows.select("project_id", "event_id", "idx", F.expr(_JUDGED).alias("choice"), F.expr("0.5D + ((conv_id * 13 + turn * 7 + idx) % 50) / 100.0D").alias("probability"))


_SENTENCE_SQL = r"""w AS (SELECT id, unnest(list_filter(regexp_split_to_array(description, '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(description, '\s+'), lambda x: x <> ''), 1) AS i FROM fx_nodes),
n AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(w, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w),
g AS (SELECT id, s, string_agg(w, ' ' ORDER BY i) AS sentence FROM n GROUP BY id, s HAVING count(*) >= 6),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS idx FROM g),
sen AS (SELECT replace(r.id, 'c', 'u') AS event_id, CAST(idx AS INTEGER) AS idx, sentence, f.session_id, f.timestamp, f.seq, f.seq // 100 AS conv_id, f.seq % 100 AS turn FROM r JOIN fx_nodes f ON f.id = r.id WHERE idx < 12),
jud AS (SELECT *, CASE (conv_id + turn + idx) % 3 WHEN 0 THEN 'Decision' WHEN 1 THEN 'OpenItem' ELSE 'noise' END AS choice, 0.5::DOUBLE + ((conv_id * 13 + turn * 7 + idx) % 50) / 100.0::DOUBLE AS probability FROM sen)
"""


@query(_SENTENCE_SQL + r""", kept AS (SELECT *, row_number() OVER (PARTITION BY session_id, trim(regexp_replace(lower(regexp_replace(sentence, '[^A-Za-z0-9\s]', '', 'g')), '\s+', ' ', 'g')) ORDER BY seq, idx) AS copy FROM jud WHERE choice <> 'noise' AND probability >= 0.65)
SELECT concat('""" + schema.JUDGED_ID + r"""', event_id, '-s', idx) AS id, choice AS node_type, CASE WHEN len(string_split(sentence, ' ')) > 12 THEN concat(array_to_string(string_split(sentence, ' ')[1:12], ' '), '…') ELSE sentence END AS label,
  CASE WHEN length(sentence) > 400 THEN concat(substr(sentence, 1, 400), '…') ELSE sentence END AS description, round(greatest(least(probability, 0.95), 0.1), 6) AS confidence, timestamp, session_id, seq FROM kept WHERE copy = 1""")
def judged_nodes(spark: SparkSession, d: str) -> DataFrame:
    sentences = ex.sentence_table(fx.utterances(spark, d))
    return ex.judged_nodes(sentences, _judgments(sentences)).drop("project_id")


@query(_SENTENCE_SQL + f""", c AS (SELECT CASE WHEN contains(lower(sentence), '?') THEN 'OpenItem' WHEN {_contains_any('lower(sentence)', schema.DECISION_MARKERS)} THEN 'Decision' WHEN {_contains_any('lower(sentence)', schema.RULE_MARKERS)} THEN 'Rule' ELSE 'noise' END AS choice FROM sen)
SELECT choice, count(*) AS n FROM c GROUP BY choice""")
def lexical_judgments(spark: SparkSession, d: str) -> DataFrame:
    return ex.lexical_judgments(ex.sentence_table(fx.utterances(spark, d))).groupBy("choice").agg(F.count("*").alias("n"))


@query(r"""SELECT trim(regexp_replace(lower(regexp_replace(description, '[^A-Za-z0-9\s]', '', 'g')), '\s+', ' ', 'g')) AS text, count(*) AS mention_count FROM fx_nodes GROUP BY 1""")
def dedup_mentions(spark: SparkSession, d: str) -> DataFrame:
    return ex.dedup_mentions(fx.nodes(spark, d)).select("text", "mention_count")


@query(rf"""f AS (SELECT id, timestamp, list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(description, '[^A-Za-z0-9\s]', '', 'g')), '\s+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ({_CONTENT}))) AS t, row_number() OVER (ORDER BY seq DESC) AS p FROM fx_nodes),
x AS (SELECT id, timestamp, p, unnest(t) AS w FROM f WHERE p <= 70)
SELECT a.id AS earlier_id, b.id AS later_id, count(*) AS shared FROM x a JOIN x b ON a.w = b.w AND (a.timestamp, a.id) < (b.timestamp, b.id) AND (a.p <= 20 OR b.p <= 20) GROUP BY ALL""")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    newest = sc.last_n_nodes(fx.nodes(spark, d), 70)
    fresh = sc.last_n_nodes(newest, 20)
    known = newest.join(fresh.select("project_id", "id"), ["project_id", "id"], "left_anti").select(*fresh.columns)
    return ex.candidate_pairs(fresh, known).select("earlier_id", "later_id", "shared")


@query("""j AS (SELECT b.id AS e, a.id AS l, (a.seq + b.seq) % 5 AS k, 0.5 + ((a.seq * 13 + b.seq * 7) % 50) / 100.0 AS p, greatest(a.timestamp, b.timestamp) AS timestamp FROM fx_edges x JOIN fx_nodes a ON a.id = x.source_node_id JOIN fx_nodes b ON b.id = x.target_node_id)
SELECT CASE k WHEN 0 THEN 'Supersedes' WHEN 1 THEN 'Resolves' WHEN 2 THEN 'RelatesTo' ELSE 'Refutes' END AS edge_type, CASE WHEN k = 3 THEN e ELSE l END AS source_node_id, CASE WHEN k = 3 THEN l ELSE e END AS target_node_id,
  CASE WHEN p >= 0.8 THEN 'EXTRACTED' ELSE 'INFERRED' END AS provenance FROM j WHERE k < 4 AND p >= 0.7""")
def judged_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    seq = nodes.select("project_id", F.col("id").alias("target_node_id"), F.col("seq").alias("b"))
    rows = fx.edges(spark, d).join(seq, ["project_id", "target_node_id"])
    choice = "CASE (seq + b) % 5 WHEN 0 THEN 'later_supersedes_earlier' WHEN 1 THEN 'later_resolves_earlier' WHEN 2 THEN 'later_relates_earlier' WHEN 3 THEN 'earlier_refutes_later' ELSE 'none' END"
    judged = rows.selectExpr("project_id", "target_node_id AS earlier_id", "source_node_id AS later_id", f"{choice} AS choice", "cast(cast(0.5 + ((seq * 13 + b * 7) % 50) / 100.0 AS decimal(10,4)) AS double) AS probability")
    return ex.judged_edges(judged, nodes).select("edge_type", "source_node_id", "target_node_id", "provenance")


@query("SELECT id, node_type, 0.95 AS confidence FROM fx_nodes WHERE agent_id = 'user'")
def validate_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d).withColumn("confidence", F.lit(0.99))
    kept = ex.validate_nodes(nodes, fx.utterances(spark, d).where("agent_role = 'user'"))
    return kept.select("id", "node_type", F.col("confidence").cast("decimal(3,2)").alias("confidence"))


@query("""SELECT e.id, CASE WHEN e.seq % 6 = 0 THEN 'self edge' WHEN a.status <> 'Active' OR b.status <> 'Active' THEN 'unknown endpoint' WHEN e.seq % 6 = 1 THEN 'short reasoning'
  WHEN e.seq % 6 = 2 THEN CASE WHEN strlen(trim(b.label)) < 10 THEN 'short reasoning' WHEN trim(b.label) = b.label OR trim(b.label) = a.label THEN 'reasoning is a label'
    WHEN strlen(a.label) >= 3 AND strlen(b.label) >= 3 AND contains(trim(b.label), a.label) AND contains(trim(b.label), b.label) THEN 'reasoning repeats labels' END
  WHEN e.seq % 6 = 3 AND strlen(trim(concat(a.label, ' so ', b.label))) < 10 THEN 'short reasoning'
  WHEN e.seq % 6 = 3 AND strlen(a.label) >= 3 AND strlen(b.label) >= 3 AND contains(trim(concat(a.label, ' so ', b.label)), a.label) AND contains(trim(concat(a.label, ' so ', b.label)), b.label) THEN 'reasoning repeats labels' END AS reject_reason
FROM fx_edges e JOIN fx_nodes a ON a.id = e.source_node_id JOIN fx_nodes b ON b.id = e.target_node_id""")
def validate_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every edge against the active nodes; some end where they start, or have a short reasoning, a label or both labels for one."""
    nodes = fx.nodes(spark, d)
    end = lambda c, name: nodes.select("project_id", F.col("id").alias(c), F.col("label").alias(name))
    edges = fx.edges(spark, d).join(end("source_node_id", "sl"), ["project_id", "source_node_id"]).join(end("target_node_id", "tl"), ["project_id", "target_node_id"])
    edges = edges.withColumns({
        "target_node_id": F.expr("CASE WHEN seq % 6 = 0 THEN source_node_id ELSE target_node_id END"),
        "reasoning": F.expr("CASE WHEN seq % 6 = 1 THEN 'short' WHEN seq % 6 = 2 THEN tl WHEN seq % 6 = 3 THEN concat(sl, ' so ', tl) ELSE concat(reasoning, ' of what was said') END"),
    })
    return ex.validate_edges(edges, nodes.where("status = 'Active'")).select("id", "reject_reason")


@query("""o AS (SELECT id FROM fx_debt_open ORDER BY seq DESC LIMIT 25)
SELECT concat('l', o.id) AS id FROM o""")
def link_resolutions(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    items = sc.unresolved(nodes, fx.edges(spark, d))
    links = items.select("project_id", F.concat(F.lit("l"), "id").alias("id"), F.lit("Resolves").alias("edge_type"), F.lit("new").alias("source_node_id"), F.col("id").alias("target_node_id"))
    fresh = nodes.select("project_id", F.lit("new").alias("id")).distinct()
    return ex.link_resolutions(links, fresh, sc.last_n_nodes(items, 25)).select("id")


@query("SELECT e.id AS edge_id, concat_ws(' ', a.label, e.reasoning, b.label, 'evidence') AS query FROM fx_edges e JOIN fx_nodes a ON a.id = source_node_id JOIN fx_nodes b ON b.id = target_node_id")
def grounding_queries(spark: SparkSession, d: str) -> DataFrame:
    return ex.grounding_queries(fx.edges(spark, d), fx.nodes(spark, d)).select("edge_id", "query")


def _evidence(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page, whole, as evidence of one edge: its hash modulo the number of edges, numbered in the order of their ids.

    Ids are dealt out by range; only the counts of the ranges meet in one place.
    """
    ranged = stage(edges.select(F.col("id").alias("edge_id")).repartitionByRange("edge_id").withColumn("part", F.spark_partition_id()), "evidence-edges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(sc.Window.orderBy("part").rowsBetween(sc.Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(sc.Window.partitionBy("part").orderBy("edge_id")) - 1
    numbered = ranged.withColumn("place", place).join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    numbered = numbered.select("edge_id", (F.col("before") + F.col("place")).alias("k"))
    total = F.broadcast(counts.agg(F.sum("n").alias("n_edges")))
    dealt = pages.select("page_id", "url", F.lit("").alias("title"), F.col("html").alias("snippet")).crossJoin(total)
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("page_id"), F.col("n_edges"))).drop("n_edges")
    return dealt.join(numbered, "k").drop("k")


@query()
def evidence_score(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.edges(spark, d)
    return ex.evidence_score(ex.grounding_queries(edges, fx.nodes(spark, d)), _evidence(edges, fx.table(spark, d, "pages")))


@query("""r AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 10 AS part FROM conversations)
SELECT concat('u', conv_id, '-', turn) AS id, CAST(dense_rank() OVER (ORDER BY conv_id, part) - 1 AS BIGINT) AS batch FROM r""")
def extraction_batches(spark: SparkSession, d: str) -> DataFrame:
    """Turns are a second apart, conversations more than the wait."""
    return ex.extraction_batches(fx.utterances(spark, d)).select("id", "batch")


# Evaluation

_GOLD_SQL = """j AS (SELECT d.lang AS section, l.quality = 1 AS g, d.n_chars % 2 = 1 AS p FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT section, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM j GROUP BY section
  UNION ALL SELECT 'overall', count(*) FILTER (g AND p), count(*) FILTER (NOT g AND p), count(*) FILTER (g AND NOT p) FROM j)
"""


@query(_GOLD_SQL + "SELECT section, tp, fp, fn, round(tp / (tp + fp), 3) AS p, round(tp / (tp + fn), 3) AS r, round(2 * tp / (2 * tp + fp + fn), 3) AS f1 FROM s")
def prf_report(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return ev.prf_report(rows.select(F.col("lang").alias("section"), (F.col("quality") == 1).alias("gold"), (F.col("n_chars") % 2 == 1).alias("predicted")))


@query("""j AS (SELECT l.quality = 1 AS g, (d.n_chars % 100) / 100.0 AS p FROM labels l JOIN documents d USING (doc_id)), t AS (SELECT unnest([0.25, 0.5, 0.75]) AS gate)
SELECT CAST(gate AS DOUBLE) AS gate, round(2 * count(*) FILTER (g AND p >= gate) / (2 * count(*) FILTER (g AND p >= gate) + count(*) FILTER (NOT g AND p >= gate) + count(*) FILTER (g AND p < gate)), 3) AS f1 FROM j CROSS JOIN t GROUP BY gate""")
def threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return ev.threshold_curve(rows.select((F.col("quality") == 1).alias("gold"), ((F.col("n_chars") % 100) / 100).alias("probability")), [0.25, 0.5, 0.75])


@query()
def match_gold(spark: SparkSession, d: str) -> DataFrame:
    bench = fx.table(spark, d, "benchmark").selectExpr("concat('b', item_id % 4) AS section", "cast(item_id AS string) AS id", "text AS label", "'' AS description")
    return ev.match_gold(bench, bench.withColumn("id", F.concat(F.lit("f"), "id")))


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "conversations").select("conv_id").distinct().selectExpr("conv_id AS pair", "conv_id % 6 <> 5 AS a", "conv_id % 3 <> 2 AS b")


_ARMS_SQL = "p AS (SELECT DISTINCT conv_id, conv_id % 6 <> 5 AS a, conv_id % 3 <> 2 AS b FROM conversations) "


@query(_ARMS_SQL + """SELECT count(*) AS pairs, round(avg(CAST(a AS INT)), 6) AS rate_a, round(avg(CAST(b AS INT)), 6) AS rate_b, round(avg(CAST(a AS INT) - CAST(b AS INT)), 6) AS mean_delta,
count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only FROM p""")
def paired_study(spark: SparkSession, d: str) -> DataFrame:
    return ev.paired_study(_arms(spark, d))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return ev.bootstrap_ci(_arms(spark, d).select((F.col("a").cast("int") - F.col("b").cast("int")).cast("double").alias("delta")))


@query(_ARMS_SQL + """, c AS (SELECT count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only FROM p),
t AS (SELECT a_only, b_only, a_only + b_only AS n, unnest(range(0, least(a_only, b_only) + 1)) AS k FROM c)
SELECT a_only, b_only, round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))), 6) AS p FROM t GROUP BY a_only, b_only""")
def sign_test(spark: SparkSession, d: str) -> DataFrame:
    return ev.sign_test(ev.paired_study(_arms(spark, d)).select("a_only", "b_only"))


def _eval_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda x: x NOT IN ({_CONTENT})))"


@query(f"SELECT id, array_to_string(list_sort({_eval_sql('description')}), ' ') AS tokens FROM fx_nodes")
def eval_tokens(spark: SparkSession, d: str) -> DataFrame:
    return fx.nodes(spark, d).select("id", F.array_join(F.array_sort(ev.eval_tokens(F.col("description"))), " ").alias("tokens"))


@query(f"""k AS (SELECT id, {_eval_sql('description')} AS t FROM fx_nodes)
SELECT e.id, CASE WHEN least(len(a.t), len(b.t)) > 0 THEN round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) ELSE 0.0 END AS score FROM fx_edges e JOIN k a ON a.id = e.source_node_id JOIN k b ON b.id = e.target_node_id""")
def containment(spark: SparkSession, d: str) -> DataFrame:
    """Of the words of the two ends of each edge."""
    words = fx.nodes(spark, d).select("project_id", "id", ev.eval_tokens(F.col("description")).alias("t"))
    end = lambda c, name: words.select("project_id", F.col("id").alias(c), F.col("t").alias(name))
    rows = fx.edges(spark, d).join(end("source_node_id", "a"), ["project_id", "source_node_id"]).join(end("target_node_id", "b"), ["project_id", "target_node_id"])
    return rows.select("id", F.round(tx.containment(F.col("a"), F.col("b")), 6).alias("score"))


@query(f"""gold AS (SELECT e.id, CASE WHEN e.seq % 3 = 0 THEN 'RelatesTo' ELSE e.edge_type END AS edge_type, a.label AS sl, b.label AS tl FROM fx_edges e JOIN fx_nodes a ON a.id = source_node_id JOIN fx_nodes b ON b.id = target_node_id),
k AS (SELECT id, seq, {_eval_sql('label')} AS t FROM fx_nodes UNION ALL SELECT id, seq, {_eval_sql("concat(label, ' ', description)")} FROM fx_nodes),
ends AS (SELECT DISTINCT label, {_eval_sql('label')} AS t FROM (SELECT sl AS label FROM gold UNION SELECT tl FROM gold)),
sc AS (SELECT ends.label, k.id, k.seq, len(list_intersect(ends.t, k.t)) / least(len(ends.t), len(k.t)) AS score FROM ends JOIN k ON least(len(ends.t), len(k.t)) > 0),
best AS (SELECT label, id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, seq) AS p FROM sc WHERE score >= 0.5) WHERE p = 1),
keys AS (SELECT DISTINCT source_node_id AS s, target_node_id AS t, edge_type FROM fx_edges),
hit AS (SELECT keys.* FROM gold JOIN best a ON a.label = sl JOIN best b ON b.label = tl JOIN keys ON keys.s = a.id AND keys.t = b.id AND keys.edge_type = gold.edge_type),
n AS (SELECT (SELECT count(*) FROM gold) AS gold, (SELECT count(*) FROM keys) AS n_edges, (SELECT count(*) FROM hit) AS tp, (SELECT count(*) FROM (SELECT DISTINCT * FROM hit)) AS used)
SELECT gold, n_edges, tp, n_edges - used AS fp, gold - tp AS fn, round(coalesce(tp / nullif(tp + n_edges - used, 0), 0), 3) AS p, round(coalesce(tp / nullif(gold, 0), 0), 3) AS r, round(coalesce(2 * tp / nullif(2 * tp + n_edges - used + gold - tp, 0), 0), 3) AS f1 FROM n""")
def relation_prf(spark: SparkSession, d: str) -> DataFrame:
    """Every edge as gold, by the labels of its ends and some with another type, against the graph."""
    nodes, edges = fx.nodes(spark, d), fx.edges(spark, d)
    end = lambda c, name: nodes.select("project_id", F.col("id").alias(c), F.col("label").alias(name))
    gold = edges.withColumn("edge_type", F.expr("CASE WHEN seq % 3 = 0 THEN 'RelatesTo' ELSE edge_type END")).join(end("source_node_id", "source_label"), ["project_id", "source_node_id"]).join(end("target_node_id", "target_label"), ["project_id", "target_node_id"])
    return ev.relation_prf(gold.select(F.col("id").alias("relation_id"), "source_label", "target_label", "edge_type"), nodes, edges)


@query("SELECT n.id, CASE WHEN seq % 4 = 1 AND node_type <> 'Rule' THEN 'Rule' ELSE node_type END AS node_type FROM fx_nodes n WHERE seq % 4 <> 0")
def verdict_policy(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    verdicts = nodes.selectExpr("project_id", "id", "CASE WHEN seq % 4 = 0 THEN 0.1D ELSE 0.9D END AS grounded", "CASE WHEN seq % 4 = 1 THEN 'Rule' ELSE node_type END AS choice", "0.9D AS confidence")
    return ev.verdict_policy(nodes, verdicts, fx.edges(spark, d))[0].select("id", "node_type")


@query("""n AS (SELECT session_id, id, (seq % 10) / 10.0 AS noul, row_number() OVER (PARTITION BY session_id ORDER BY (seq % 10) DESC, seq) AS p FROM fx_nodes WHERE seq % 10 >= 6)
SELECT session_id AS event_id, id FROM n WHERE p <= 3""")
def assumption_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.nodes(spark, d).selectExpr("project_id", "session_id AS event_id", "seq AS idx", "id", "(seq % 10) / 10.0D AS noul")
    return ev.assumption_sweep(rows).select("event_id", "id")


@query(_SENTENCE_SQL + """SELECT count(*) AS sentences, count(*) FILTER (choice <> 'noise' AND probability >= 0.65) AS kept, count(*) FILTER (choice = 'noise') AS noise, count(*) FILTER (choice <> 'noise' AND probability < 0.65) AS below FROM jud""")
def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    return ev.scan_stats(_judgments(ex.sentence_table(fx.utterances(spark, d)))).drop("project_id")


@query("SELECT 'tool_events' AS metric, count(*) AS n FROM fx_tools UNION ALL SELECT 'prose_events', count(*) FROM conversations UNION ALL SELECT 'nodes', count(*) FROM fx_nodes UNION ALL SELECT 'edges', count(*) FROM fx_edges")
def pipeline_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ev.pipeline_metrics(fx.tool_events(spark, d), fx.utterances(spark, d), fx.nodes(spark, d), fx.edges(spark, d)).select("metric", "n")


@query("SELECT CAST(sum(turn) AS BIGINT) AS input_tokens, CAST(sum(length(text)) AS BIGINT) AS output_tokens FROM conversations")
def usage_meter(spark: SparkSession, d: str) -> DataFrame:
    turns = fx.table(spark, d, "conversations")
    odd = F.to_json(F.struct(F.struct(F.col("turn").alias("prompt_tokens"), F.length("text").alias("completion_tokens")).alias("usage")))
    even = F.to_json(F.struct(F.struct(F.col("turn").alias("input_tokens"), F.length("text").alias("output_tokens")).alias("usage")))
    return ev.usage_meter(turns.select(F.when(F.col("conv_id") % 2 == 1, odd).otherwise(even).alias("body")))


@query("""b AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM fx_nodes)
SELECT id, round((timestamp - lo) / (hi - lo), 6) AS x, CASE node_type WHEN 'Decision' THEN 0 WHEN 'Rule' THEN 1 ELSE 2 END AS lane FROM fx_nodes CROSS JOIN b""")
def timeline_layout(spark: SparkSession, d: str) -> DataFrame:
    return ev.timeline_layout(fx.nodes(spark, d)).select("id", "x", "lane")


@query("""b AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM fx_nodes)
SELECT session_id, min(round((timestamp - lo) / (hi - lo), 6)) AS x_min, max(round((timestamp - lo) / (hi - lo), 6)) AS x_max FROM fx_nodes CROSS JOIN b GROUP BY session_id""")
def session_bands(spark: SparkSession, d: str) -> DataFrame:
    return ev.session_bands(ev.timeline_layout(fx.nodes(spark, d))).drop("project_id")


@query("""SELECT 'p0' AS project_id, session_id, count(*) AS n_nodes, count(*) FILTER (node_type = 'Decision') AS n_decisions, count(*) FILTER (status = 'Invalidated') AS n_invalidated FROM fx_nodes GROUP BY session_id
UNION ALL SELECT 'p0', NULL, count(*), count(*) FILTER (node_type = 'Decision'), count(*) FILTER (status = 'Invalidated') FROM fx_nodes
UNION ALL SELECT NULL, NULL, count(*), count(*) FILTER (node_type = 'Decision'), count(*) FILTER (status = 'Invalidated') FROM fx_nodes""")
def org_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ev.org_rollup(fx.nodes(spark, d))


@query("SELECT date_trunc('hour', ts) AS window_start, CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'read' WHEN 'signup' THEN 'lint' ELSE 'bash' END AS tool_name, count(*) AS n FROM events GROUP BY ALL")
def windowed_activity(spark: SparkSession, d: str) -> DataFrame:
    ts = fx.table(spark, d, "events").select(F.concat(F.lit("t"), "event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = streams.windowed_activity(fx.tool_events(spark, d).join(ts, "id"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "tool_name", "n")


# Streams over the tables, each run to its end


def _streamed(rows: DataFrame, run: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows as a stream through run, to a table."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, name)
    rows.write.parquet(f"{path}/in")
    out = run(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
    q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("SELECT id, seq FROM fx_tools")
def stream_dedupe_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event twice, once out."""
    ts = fx.table(spark, d, "events").select(F.concat(F.lit("t"), "event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = fx.tool_events(spark, d).select("project_id", "id", "seq").join(ts, "id")
    return _streamed(rows.union(rows), lambda s: streams.dedupe_events(s, "3650 days"), "dedupe").select("id", "seq")


@query("SELECT (SELECT max(seq) FROM fx_tools) AS at, (SELECT string_agg(id, ',' ORDER BY seq) FROM (SELECT id, seq FROM fx_tools ORDER BY seq DESC LIMIT 20)) AS ids WHERE EXISTS (SELECT 1 FROM fx_tools)")
def stream_event_log(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(fx.tool_events(spark, d), streams.stream_event_log, "event-log").groupBy("project_id").agg(F.max("at").alias("at"), F.array_join(F.max_by("ids", "at"), ",").alias("ids")).select("at", "ids")


@query("""SELECT session_id, row_number() OVER (ORDER BY min(seq)) - 1 AS session_index, max(seq) = (SELECT max(seq) FROM fx_tools) AS current FROM fx_tools GROUP BY session_id""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = _streamed(fx.tool_events(spark, d), lambda s: streams.stream_sessions(s, 1_000_000), "sessions")
    return found.groupBy("session_id", "session_index").agg(F.max("current").alias("current"))


@query("""acts AS (SELECT id, session_id, seq, 'e' AS k FROM fx_edits UNION ALL SELECT id, session_id, seq, 'c' FROM fx_checks),
ring AS (SELECT *, row_number() OVER (PARTITION BY session_id, k ORDER BY seq DESC) AS r FROM acts)
SELECT session_id, coalesce(string_agg(id, ',' ORDER BY seq) FILTER (k = 'e'), '') AS edits, coalesce(string_agg(id, ',' ORDER BY seq) FILTER (k = 'c'), '') AS checks FROM ring WHERE r <= 100 GROUP BY session_id""")
def stream_scratch(spark: SparkSession, d: str) -> DataFrame:
    found = _streamed(fx.tool_events(spark, d), lambda s: streams.stream_scratch(s, sessions=1_000_000), "scratch")
    last = found.groupBy("session_id").agg(F.max_by(F.struct("edits", "checks"), "at").alias("s"))
    return last.select("session_id", F.array_join("s.edits", ",").alias("edits"), F.array_join("s.checks", ",").alias("checks"))


@query("""SELECT id AS event_id, session_id, 'unverified' AS warning FROM fx_edits e WHERE NOT EXISTS (SELECT 1 FROM fx_checks c WHERE c.session_id = e.session_id AND c.file = e.file AND c.seq > e.seq)
UNION ALL SELECT id, session_id, 'failing' FROM fx_checks c WHERE NOT passed AND NOT EXISTS (SELECT 1 FROM fx_edits e WHERE e.session_id = c.session_id AND e.file = c.file AND e.seq > c.seq)
  AND NOT EXISTS (SELECT 1 FROM fx_checks p WHERE p.passed AND p.session_id = c.session_id AND p.file = c.file AND p.seq > c.seq)""")
def stream_debt_warnings(spark: SparkSession, d: str) -> DataFrame:
    """The warnings that were raised and not cleared."""
    found = _streamed(fx.tool_events(spark, d), lambda s: streams.debt_warnings(s, 1_000_000, 1_000_000), "warnings")
    left = found.groupBy("event_id", "session_id", "warning").agg(F.sum(F.when(F.col("action") == "raise", 1).otherwise(-1)).alias("n"))
    return left.where("n > 0").select("event_id", "session_id", "warning")


@query("SELECT count(*) AS ingested, count(*) FILTER (tool_name <> 'read') AS tool_events, count(*) FILTER (tool_name = 'read') AS queued, CAST(0 AS BIGINT) AS late FROM fx_tools")
def stream_backpressure_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reading counts as prose here; one batch, so nothing is late."""
    rows, path = fx.tool_events(spark, d).withColumn("event_kind", F.expr("CASE WHEN tool_name = 'read' THEN 'utterance' ELSE 'tool_call' END")), new_path(spark, "counted")
    rows.write.parquet(f"{path}/in")
    counts = streams.BatchCounts()
    sink = counts.into(lambda batch, number: batch.write.mode("append").parquet(f"{path}/out"))
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in").writeStream.foreachBatch(sink)
    stream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    names = ["ingested", "tool_events", "queued", "late"]
    return spark.createDataFrame([tuple(counts.totals()[k] for k in names)], ", ".join(f"{k} long" for k in names))


@query("SELECT 'node' AS kind, id FROM fx_nodes UNION ALL SELECT 'edge', id FROM fx_edges")
def stream_upsert_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges as one stream into the store, twice; edges without both ends are not among these."""
    nodes = fx.nodes(spark, d).selectExpr("'node' AS kind", "project_id", "id", "node_type", "label", "CAST(NULL AS STRING) AS edge_type", "CAST(NULL AS STRING) AS source_node_id", "CAST(NULL AS STRING) AS target_node_id", "seq")
    edges = fx.edges(spark, d).selectExpr("'edge' AS kind", "project_id", "id", "CAST(NULL AS STRING) AS node_type", "CAST(NULL AS STRING) AS label", "edge_type", "source_node_id", "target_node_id", "seq")
    path = new_path(spark, "graph")
    rows = nodes.union(edges).union(edges.withColumns({"id": F.concat("id", F.lit("?")), "target_node_id": F.lit("nowhere")}))
    rows.write.parquet(f"{path}/in")
    store = GraphStore(spark, f"{path}/store", buckets=8)
    for run in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in").writeStream.foreachBatch(streams.upsert_graph(store))
        stream.option("checkpointLocation", f"{path}/checkpoint-{run}").trigger(availableNow=True).start().awaitTermination()
    held = store.read()
    return held[0].select(F.lit("node").alias("kind"), "id").union(held[1].select(F.lit("edge"), "id"))


@query("SELECT concat('u', conv_id, '-', turn) AS id, concat('s', conv_id % 20) AS session_id, role AS agent_role, text FROM conversations WHERE text IS NOT NULL")
def scan_event_stream_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "event-files")
    fx.utterances(spark, d).select(F.to_json(F.struct("id", "session_id", "agent_role", "start_time", "end_time", "text"))).write.text(f"{path}/in")
    out = rd.scan_event_stream_file(spark, f"{path}/in", suffix=".txt").select("id", "session_id", "agent_role", "text")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("SELECT CASE node_type WHEN 'Decision' THEN 'decisions' WHEN 'OpenItem' THEN 'questions' ELSE 'assumptions' END AS section, id, label, agent_id AS who, status FROM fx_nodes WHERE label IS NOT NULL")
def load_gold(spark: SparkSession, d: str) -> DataFrame:
    """Gold files of a hundred conversations of a session each, written from the nodes."""
    path = new_path(spark, "gold")
    item = F.struct("id", "label", F.col("agent_id").alias("who"), "status")
    lists = [F.collect_list(F.when(F.col("node_type") == kind, item)).alias(name) for kind, name in (("Decision", "decisions"), ("OpenItem", "questions"), ("Rule", "assumptions"))]
    files = fx.nodes(spark, d).withColumn("file", F.concat_ws("-", "session_id", F.floor(F.col("seq") / 10_000))).groupBy("file").agg(*lists)
    files.select("file", F.to_json(F.struct("decisions", "questions", "assumptions")).alias("value")).write.partitionBy("file").text(path)
    return rd.load_gold(spark, path)[0]


# Writes, gates and studies


@query("""SELECT concat(a.id, '>', b.id) AS id, a.id AS source_node_id, b.id AS target_node_id FROM fx_nodes a JOIN fx_nodes b ON b.seq = a.seq - 1""")
def apply_resolve(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    commands = nodes.selectExpr("project_id", "seq", "id AS resolver", "concat('c', floor((seq - 1) / 100), '-', (seq - 1) % 100) AS question", "'asked' AS reasoning")
    return wr.apply_resolve(commands, nodes).select("id", "source_node_id", "target_node_id")


@query("SELECT seq AS question_id, CAST(0 AS INTEGER) AS place, id FROM fx_nodes UNION ALL SELECT b.seq, CAST(2 AS INTEGER), a.id FROM fx_nodes a JOIN fx_nodes b ON a.seq = b.seq - 1")
def filter_candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    answers = nodes.selectExpr("project_id", "seq AS question_id", "array(id, 'nothing', concat('c', floor((seq - 1) / 100), '-', (seq - 1) % 100)) AS ids")
    return rt.filter_candidate_ids(answers, nodes).drop("project_id")


@query("""SELECT id, concat_ws(' ', label, description, node_type, agent_id, CASE WHEN seq % 7 = 0 THEN 'v2' END) AS text FROM fx_nodes WHERE seq % 17 <> 0""")
def embedding_index_maintain(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    index = nodes.select("project_id", "id", F.concat_ws(" ", "label", "description", "node_type", "agent_id").alias("text"))
    changed = nodes.where("seq % 7 = 0").withColumn("agent_id", F.concat_ws(" ", "agent_id", F.lit("v2")))
    return rt.embedding_index_maintain(index, changed, nodes.where("seq % 17 = 0")).drop("project_id")


@query("""SELECT e.id, CASE WHEN e.seq % 2 = 1 THEN 'AMBIGUOUS' WHEN a.session_id = b.session_id THEN 'EXTRACTED' ELSE 'INFERRED' END AS provenance
FROM fx_edges e JOIN fx_nodes a ON a.id = source_node_id JOIN fx_nodes b ON b.id = target_node_id""")
def clamp_provenance(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.edges(spark, d).selectExpr("*", "'INFERRED' AS provenance").withColumn("reasoning", F.expr("CASE WHEN seq % 2 = 1 THEN 'short' ELSE 'because of what was said before' END"))
    return ex.clamp_provenance(edges, fx.nodes(spark, d).withColumn("event_id", F.col("session_id"))).select("id", "provenance")


@query("""f AS (SELECT session_id, min(seq) AS first FROM fx_nodes WHERE seq % 3 <> 0 GROUP BY session_id), m AS (SELECT * FROM fx_nodes WHERE seq % 3 <> 0)
SELECT e.id, coalesce(least(a.seq, b.seq), f.first) AS position FROM fx_edges e JOIN fx_nodes n ON n.id = source_node_id JOIN f ON f.session_id = n.session_id
LEFT JOIN m a ON a.id = source_node_id LEFT JOIN m b ON b.id = target_node_id AND b.session_id = n.session_id""")
def attribute_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d).selectExpr("project_id", "session_id AS batch", "id", "seq AS position")
    edges = fx.edges(spark, d).join(nodes.selectExpr("project_id", "batch", "id AS source_node_id"), ["project_id", "source_node_id"])
    return ex.attribute_edges(edges, nodes.where("position % 3 <> 0")).select("id", "position")


@query()
def split_sentences_eval(spark: SparkSession, d: str) -> DataFrame:
    return fx.utterances(spark, d).select("id", F.posexplode(ex.split_sentences_eval(F.col("text"))).alias("idx", "sentence"))


@query(_SUMMARY_SQL + ", " + _RATIONALE_SQL + ", " + _BLOCKED_SQL + ", " + _DOWN_SQL + """,
crit AS (SELECT e.source_node_id AS id, string_agg(concat('Resolves open item: ', t.label), ', ' ORDER BY e.seq DESC, t.id) AS c FROM fx_edges e JOIN fx_nodes t ON t.id = e.target_node_id WHERE edge_type = 'Resolves' AND t.node_type = 'OpenItem' GROUP BY 1),
work AS (SELECT id, array_to_string(list_sort(list(label))[1:10], ', ') AS b FROM blocked GROUP BY id),
risk AS (SELECT o.id, o.label, CAST(round(greatest(least(least(coalesce(d.n, 0), 4) / 4.0 * 60 + CASE WHEN s.session_index >= (SELECT i FROM now) - 1 THEN 20 ELSE 5 END, 100), 5)) AS BIGINT) AS impact FROM fx_debt_open o JOIN fx_sessions s USING (session_id) LEFT JOIN down d ON d.id = o.id)
SELECT 2 AS section, st.seq, st.id, concat_ws(chr(10), concat('### ', st.label), concat('**Status:** ', decision_status), concat('**Owner:** ', coalesce(nullif(st.agent_id, ''), 'Unassigned')), concat('**Session:** ', st.session_id),
  concat('**Rationale:** ', coalesce(why.r, concat('Decision made by ', st.agent_id, ' in S', x.session_index + 1, ': ', st.description))), '**Blocked Work:** ' || b, '**Validation Needed:** ' || c) AS line
FROM st JOIN fx_sessions x USING (session_id) LEFT JOIN why ON why.id = st.id LEFT JOIN work ON work.id = st.id LEFT JOIN crit ON crit.id = st.id
UNION ALL SELECT 3, -impact, id, concat('- **', label, '** (Impact: ', impact, '/100) — UnresolvedOpenItem, Unvalidated') FROM risk
UNION ALL SELECT 0, 0, '', concat('# Executive Summary — ', session_id) FROM summary UNION ALL SELECT 0, 1, '', concat('*Compared to: ', coalesce(prior_session_id, 'N/A'), '*') FROM summary
UNION ALL SELECT 1, 0, '', '## Debt Delta' UNION ALL SELECT 1, 1, '', concat('- **New:** ', new_items) FROM summary UNION ALL SELECT 1, 2, '', concat('- **Resolved:** ', resolved_items) FROM summary
UNION ALL SELECT 1, 3, '', concat('- **Persisted:** ', persisted_items) FROM summary UNION ALL SELECT 1, 4, '', concat('- **Net Change:** ', CASE WHEN net >= 0 THEN '+' ELSE '' END, net) FROM summary
UNION ALL SELECT 2, -1000000000, '', concat('## Decisions (', n_decisions, ')') FROM summary UNION ALL SELECT 3, -1000000000, '', concat('## Top Risks (', n_risks, ')') FROM summary""")
def export_summary_markdown(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = fx.nodes(spark, d), fx.edges(spark, d)
    return rp.export_summary_markdown(_summary(spark, d), dc.decision_timeline(nodes, edges), dc.risks(nodes, edges)).drop("project_id")


@query("SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN NULL ELSE CASE conv_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'lines' END END AS format FROM conversations")
def sniff_record_format(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE WHEN trim(text) = '' THEN '' WHEN conv_id % 3 = 0 THEN to_json(array(text)) WHEN conv_id % 3 = 1 THEN concat('1: a\n\n2: ', conv_id) ELSE concat('x\n1: ', turn) END")
    return fx.table(spark, d, "conversations").select("conv_id", "turn", st.sniff_record_format(text, r"^\d+: .+").alias("format"))


@query("""l AS (SELECT conv_id, lower(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, bool_or(contains(t, 'er')) AS j, bool_or(contains(t, 'un')) AS l FROM l WHERE p <= 2 GROUP BY conv_id)
SELECT conv_id AS session_id, CASE WHEN j AND l THEN 'both' WHEN j THEN 'json' WHEN l THEN 'lines' END AS choice FROM s""")
def stated_choice(spark: SparkSession, d: str) -> DataFrame:
    turns = fx.table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")
    return st.stated_choice(turns, ["er"], ["un"])


@query("""o AS (SELECT conv_id * 100 + turn AS pair, CASE (conv_id + turn) % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'lines' END AS f1, CASE turn % 2 WHEN 0 THEN 'json' ELSE 'lines' END AS f2 FROM conversations),
v AS (SELECT pair, CASE WHEN f1 IS NOT NULL THEN CASE WHEN f1 = f2 THEN 'PASS' ELSE 'FAIL' END WHEN pair % 5 = 0 THEN 'PASS' ELSE 'UNCLEAR' END AS cross_session, CASE WHEN pair % 4 = 0 THEN 'UNCLEAR' WHEN f2 = 'json' THEN 'PASS' ELSE 'FAIL' END AS in_session FROM o)
SELECT *, cross_session = 'PASS' AND in_session = 'PASS' AS consistent FROM v""")
def consistency_verdict(spark: SparkSession, d: str) -> DataFrame:
    seen = fx.table(spark, d, "conversations").selectExpr(
        "conv_id * 100 + turn AS pair", "CASE (conv_id + turn) % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'lines' END AS format1", "CASE turn % 2 WHEN 0 THEN 'json' ELSE 'lines' END AS format2",
        "CASE WHEN (conv_id * 100 + turn) % 4 <> 0 THEN 'json' END AS export_format", "CASE WHEN (conv_id * 100 + turn) % 5 = 0 THEN 'json' ELSE 'both' END AS choice1", "'json' AS choice2",
    )
    return st.consistency_verdict(seen)


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a file per turn; the later one is stored in toml where seq % 4 = 1."""
    rows = fx.nodes(spark, d)
    text = "concat('# Backend: ', CASE WHEN seq % {0} = 1 THEN 'toml' ELSE 'json' END, ' config = env\n', label, CASE WHEN seq % {1} = 0 THEN '\nimport sqlite3' ELSE '' END) AS text"
    return rows.selectExpr("project_id", "id AS path", text.format(1000000, 6)), rows.selectExpr("project_id", "id AS path", text.format(4, 3))


@query("SELECT id AS path, 'backend' AS key, 'json' AS before, 'toml' AS after FROM fx_nodes WHERE seq % 4 = 1 AND seq % 1000000 <> 1")
def decision_flips(spark: SparkSession, d: str) -> DataFrame:
    return st.decision_flips(*_versions(spark, d), ["backend", "config"]).drop("project_id")


@query("SELECT id AS path, 'database import' AS rule FROM fx_nodes WHERE seq % 3 = 0 AND seq % 6 <> 0")
def forbidden_pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    rules = {"database import": r"(?m)^import sqlite3\b", "timestamp": r"\d{4}-\d\d-\d\dT\d\d:\d\d"}
    return st.forbidden_pattern_scan(*_versions(spark, d), rules).drop("project_id")
