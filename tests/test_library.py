"""Hand-made cases of the decision-memory operators, and streams against batches."""

from __future__ import annotations

import json
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from loreweave.functions import text as tx
from loreweave.operators import debt, decisions, evaluation, graph, reports, writes
from loreweave.plans import catalog, registry
from loreweave.sources import fixtures, readers
from loreweave.streaming import streams

SF = "/root/testdata/sf0.001"
NODE = "project_id string, id string, node_type string, label string, description string, agent_id string, session_id string, timestamp double, files array<string>, status string, seq long"
EDGE = "project_id string, id string, edge_type string, source_node_id string, target_node_id string, reasoning string, timestamp double, seq long"
TOOL = "project_id string, id string, session_id string, tool_name string, text string, files array<string>, end_time double, seq long"


def nodes(spark, *rows):
    return spark.createDataFrame([("p", i, kind, i.upper(), i, "dev", s, float(n), files, status, n) for n, (i, kind, s, files, status) in enumerate(rows)], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([("p", f"{a}>{b}-{n}", kind, a, b, "because", float(n), n) for n, (a, kind, b) in enumerate(rows)], EDGE)


def tools(spark, *rows):
    return spark.createDataFrame([("p", i, "s", tool, text, files, float(n), n) for n, (i, tool, text, files) in enumerate(rows)], TOOL)


def ids(df):
    return sorted(tuple(r.node_ids) for r in df.collect())


@pytest.mark.parametrize("name", ["debt_report", "bm25_topk", "decision_status", "risks", "surprising_connections", "sentence_table", "diff_changed", "brief_binding", "context_asof"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    shown = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    ours = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    found = con.execute(registry.ORACLES[name])
    names = [x[0] for x in found.description]
    assert ours == sorted(tuple(shown(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())


def test_debt_cases(spark):
    n = nodes(spark, ("a", "OpenItem", "s1", [], "Active"), ("b", "OpenItem", "s1", [], "Active"), ("c", "OpenItem", "s1", [], "Invalidated"), ("d", "Decision", "s2", [], "Active"), ("r", "Rule", "s2", ["x"], "Active"))
    items = debt.debt_items(n, edges(spark, ("d", "RelatesTo", "a")))
    assert debt.debt_report(items).first()[1:] == (2, 6, "red")
    assert ids(debt.unresolved_open_items(n, edges(spark, ("d", "Resolves", "a")))) == [("b",)]
    edit, fail, ok = ("e", "edit", "", ["x", "y"]), ("k", "test", "1 failed", ["y"]), ("k2", "test", "ok", ["x"])
    assert ids(debt.unverified_changes(*debt.scratch(tools(spark, edit)))) == [("e",)]
    assert ids(debt.unverified_changes(*debt.scratch(tools(spark, edit, ok)))) == []
    assert ids(debt.failed_verifications(*debt.scratch(tools(spark, edit, fail)))) == [("k",)]
    assert ids(debt.failed_verifications(*debt.scratch(tools(spark, fail, edit)))) == []
    assert ids(debt.rule_violations(debt.scratch(tools(spark, ("k", "test", "1 failed", ["x"])))[1], n)) == [("k", "r")]


def test_decision_states(spark):
    n = nodes(spark, *((i, "Decision", "s", [], "Active") for i in "abcd"), ("o", "OpenItem", "s", [], "Active"))
    e = edges(spark, ("b", "Supersedes", "a"), ("a", "RelatesTo", "b"), ("b", "Resolves", "o"), ("a", "Refutes", "c"), ("d", "RelatesTo", "d"))
    found = {r.id: r.decision_status for r in decisions.decision_status(n, e).collect()}
    assert found == {"a": "Superseded", "b": "Validated", "c": "Blocked", "d": "Pending"}


def test_traversal(spark):
    e = edges(spark, ("a", "RelatesTo", "b"), ("b", "Supersedes", "c"), ("x", "Refutes", "c"), ("c", "Resolves", "d"), ("d", "RelatesTo", "e"))
    seeds = spark.createDataFrame([("q", "p", "c", 1)], "question_id string, project_id string, id string, rank int")
    near = graph.bfs_nodes(seeds, e, 1)
    assert sorted(r.id for r in near.collect()) == ["b", "c", "d", "x"]
    inside = graph.induced_edges(graph.bfs_nodes(seeds, e, 3), e)
    assert sorted(r.id for r in graph.reverse_trace_set(seeds, inside).collect()) == ["a", "b", "c", "x"]
    assert [r.id for r in graph.reverse_trace_order(seeds, inside).orderBy("place").collect()] == ["c", "b", "a", "x"]


def test_writes_are_idempotent(spark):
    n = nodes(spark, ("a", "Rule", "s", [], "Active"), ("b", "Rule", "s", [], "Active"))
    assert writes.add_nodes(n.limit(0), n.union(n)).count() == 2 and writes.add_nodes(n, n).count() == 0
    e = edges(spark, ("a", "Resolves", "b"), ("a", "Resolves", "zz"))
    assert writes.add_edges(n, e.limit(0), e.union(e)).count() == 1 and writes.rejected_edges(n, e).count() == 1


def test_text_functions(spark):
    row = spark.createDataFrame([("10 failed", "NotebookEdit", "One two three four five six. Short. a b c d e f g", "- **We use** over.", "foo-bar The Été")], "c string, t string, s string, m string, w string")
    r = row.select(
        tx.check_passed(F.col("c")).alias("loose"), tx.check_passed(F.col("c"), strict=True).alias("strict"), tx.tool_class(F.col("t"), F.col("c")).alias("tool"),
        tx.sentences(F.col("s")).alias("sentences"), tx.note_class(F.col("m")).alias("note"), tx.note_text(F.col("m")).alias("text"), tx.index_tokens(F.col("w")).alias("tokens"),
    ).first()
    assert r.loose and not r.strict and r.tool == "Read" and r.note == "Decision" and r.text == "We use over"
    assert r.sentences == ["One two three four five six.", "a b c d e f g"] and r.tokens == ["foobar", "été"]


def test_suffix_binding(spark):
    n = nodes(spark, ("a", "Decision", "s", ["src/a.rs"], "Active"), ("b", "Rule", "s", ["rs"], "Active"), ("c", "Rule", "s", ["src/b.rs"], "Active"))
    active = spark.createDataFrame([("p", "a.rs")], "project_id string, file string")
    assert [r.id for r in reports.brief_binding(n, active).orderBy("place").collect()] == ["b", "a"]


def test_statistics(spark):
    counts = spark.createDataFrame([(2, 0), (0, 0), (40, 10)], "a_only int, b_only int")
    assert [r.p for r in evaluation.sign_test(counts).orderBy("a_only").collect()] == [1.0, 0.5, pytest.approx(2.4e-05, abs=2e-6)]
    deltas = spark.createDataFrame([(1.0,)] * 20 + [(0.0,)] * 20, "delta double")
    r = evaluation.bootstrap_ci(deltas, 2000).first()
    assert 0.3 < r.low < 0.42 and 0.58 < r.high < 0.7


def test_evidence_takes_every_page_whole(spark):
    sf = "/root/testdata/sf0.01"
    edges, pages = fixtures.edges(spark, sf), fixtures.table(spark, sf, "pages")
    dealt = catalog._evidence(edges, pages).select("page_id", "edge_id", "snippet").collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(dealt) == len(html) > 200 and {r.page_id: r.snippet for r in dealt} == html
    assert {r.edge_id for r in dealt} <= {r.id for r in edges.collect()} and len({r.edge_id for r in dealt}) > len(html) // 3
    scores = {r.edge_id: r.score for r in registry.QUERIES["evidence_score"](spark, sf).collect()}
    assert set(scores) == {r.edge_id for r in dealt}
    query = {r.edge_id: r["query"] for r in registry.QUERIES["grounding_queries"](spark, sf).collect()}
    url = {r.page_id: r.url for r in pages.collect()}
    pages_of = Counter(r.edge_id for r in dealt)
    alone = [r for r in dealt if pages_of[r.edge_id] == 1 and ".gov" not in url[r.page_id] and ".edu" not in url[r.page_id]][:20]
    for r in alone:
        words = {w for w in query[r.edge_id].lower().split() if len(w.encode()) > 3}
        hits = sum(w in html[r.page_id].lower() for w in words)
        assert abs(scores[r.edge_id] - (0.5 * hits / len(words) + 0.25)) < 1e-5


def test_readers(spark, tmp_path):
    good = {"id": "1", "session_id": "s", "agent_role": "a", "start_time": 1, "end_time": 2, "text": "t", "extra": 1}
    lines = [json.dumps(good), "", "{broken", json.dumps({"id": "2"}), json.dumps(good | {"id": "3", "event_kind": "other"})]
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    rows = readers.scan_events_jsonl(spark, str(tmp_path)).collect()
    assert [(r.id, r.event_kind, r.files) for r in rows] == [("1", "utterance", [])]
    said = [{"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use"}]}}, {"type": "assistant", "isSidechain": True, "message": {"content": "no"}}, {"type": "user"}, {"type": "assistant", "message": {"content": "plain"}}]
    df = spark.createDataFrame([(json.dumps(x),) for x in said], "value string")
    assert sorted(r.text for r in readers.transcript_to_events(df).collect()) == ["hi", "plain"]
    body = json.dumps({"content": [{"text": 'Sure: ```json {"nodes":[{"id":"n1","node_type":"Rule","label":"l"},{"id":"n2"'}]})
    parsed, bad = readers.load_raw_responses(spark.createDataFrame([("b", body), ("c", "nothing")], "batch_id string, body string"))
    assert [x.id for x in parsed.first().r.nodes] == ["n1"] and [r.batch_id for r in bad.collect()] == ["c"]
    call = spark.createDataFrame([("Edit", "/w", json.dumps({"file_path": "src/a.rs", "paths": ["src/a.rs", "/b/c"]}), json.dumps({"output": " done "}))], "tool_name string, cwd string, input string, response string")
    r = readers.tool_payload_to_events(call).first()
    assert r.files == ["/w/src/a.rs", "/b/c"] and r.text == "Edit done"


def test_markdown_import(spark):
    text = "- You must test it\n```\n- We use nothing here\n```\n1. TODO later on\n- You must test it.\nplain must line"
    found = readers.import_markdown(spark.createDataFrame([("p", "a.md", text)], "project_id string, path string, content string")).collect()
    assert sorted((r.node_type, r.description) for r in found) == [("OpenItem", "TODO later on"), ("Rule", "You must test it")]


def test_markdown_import_looks_at_a_line_once_and_before_the_order(spark):
    docs = spark.createDataFrame([("p", "a.md", "- You must test it")], "project_id string, path string, content string")
    plan = readers.import_markdown(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^[-*+>0-9]") == 1 and plan.rindex("Window") < plan.index("^[-*+>0-9]")


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streamed_warnings_raise_and_clear(spark, tmp_path):
    rows = tools(spark, ("e", "edit", "", ["x"]), ("k", "test", "1 failed", ["x"]), ("e2", "edit", "", ["x"]), ("k2", "test", "ok", ["x"]))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = drain(streams.debt_warnings(stream), "warnings").orderBy("seq", "action").collect()
    assert [(r.event_id, r.warning, r.action) for r in found] == [("e", "unverified", "raise"), ("e", "unverified", "clear"), ("k", "failing", "raise"), ("k", "failing", "clear"), ("e2", "unverified", "raise"), ("e2", "unverified", "clear")]


def test_streamed_dedupe(spark, tmp_path):
    rows = spark.createDataFrame([("p", "1"), ("p", "1"), ("p", "2")], "project_id string, id string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert drain(streams.dedupe_events(stream), "deduped").count() == 2


def test_entry_without_extras(spark, monkeypatch, tmp_path):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    monkeypatch.setattr(entry, "ROOT", tmp_path)
    assert not any(k.startswith("op") and k[2].isdigit() for k in entry.queries()) and "debt_report" in entry.oracle_sql()
