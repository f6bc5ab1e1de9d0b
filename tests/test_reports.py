"""Briefs, answers, lookups and scores by hand-made cases, with several projects and several files a row, and queries against their SQL."""

from __future__ import annotations

import json
import os
import random
import sys
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave import staging
from loreweave.operators import communities, debt, evaluation, extraction, graph, reports, retrieval, scans
from loreweave.plans import registry
from loreweave.sources import readers

SF = "/root/testdata/sf0.001"
NODE = "project_id string, id string, node_type string, label string, description string, agent_id string, session_id string, timestamp double, files array<string>, status string, seq long"
EDGE = "project_id string, id string, edge_type string, source_node_id string, target_node_id string, reasoning string, timestamp double, seq long"
TOOL = "project_id string, id string, session_id string, tool_name string, text string, files array<string>, end_time double, seq long"


def nodes(spark, *rows):
    """(project, id, type, session, files, label)"""
    return spark.createDataFrame([(p, i, kind, label, label, f"agent-{p}", s, float(n), files, "Active", n) for n, (p, i, kind, s, files, label) in enumerate(rows)], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(p, f"{a}>{b}-{n}", kind, a, b, "because", float(n), n) for n, (p, a, kind, b) in enumerate(rows)], EDGE)


def tools(spark, *rows):
    return spark.createDataFrame([(p, i, s, tool, text, files, float(n), n) for n, (p, i, s, tool, text, files) in enumerate(rows)], TOOL)


NEW = ["brief_text", "keyword_count_rank", "community_label", "extraction_batches", "judged_nodes", "classify_markdown_line", "route_events", "containment", "load_raw_responses",
       "debt_report", "debt_by_type", "debt_over_sessions", "executive_summary", "graph_diff_between", "apply_question"]


@pytest.mark.parametrize("name", NEW)
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
    assert sorted(names) == columns and ours == sorted(tuple(shown(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())


def test_brief_of_two_projects_with_several_files(spark):
    n = nodes(
        spark, ("p", "d1", "Decision", "s1", [], "x" * 120), ("q", "d1", "Decision", "s1", [], "other project"), ("p", "d2", "Decision", "s2", ["lib/a.rs", "src/b.rs"], "bound"),
        ("p", "r1", "Rule", "s1", ["src/a.rs", "src/c.rs"], "keep a"), ("p", "o1", "OpenItem", "s1", [], "why"), ("p", "r2", "Rule", "missing", ["z.rs"], "elsewhere"),
    )
    e = edges(spark, ("p", "d1", "Resolves", "r1"), ("q", "d1", "RelatesTo", "d1"))
    t = tools(
        spark, ("p", "e0", "old", "edit", "", ["src/z.rs"]), ("p", "e1", "now", "edit", "", ["m1", "m2", "m3", "m4"]), ("p", "e2", "now", "edit", "", ["src/a.rs", "src/b.rs"]),
        ("p", "c1", "now", "pytest", "ran", ["src/a.rs"]), ("p", "c2", "now", "test", "2 failed", ["src/b.rs", "src/c.rs"]),
    )
    active = spark.createDataFrame([("p", "a.rs"), ("p", "b.rs")], "project_id string, file string")
    found = {r.project_id: r.brief for r in reports.brief_text(n, e, t, active).collect()}
    assert found["p"].split("\n") == [
        '<reasoning-state nodes="5" edges="1">', "Decisions (2):", "- [Pending] " + "x" * 110 + "…", "- [Pending] bound", "Rules (2):", "- keep a", "- elsewhere", "Open items (1):",
        "- Open item 'why' raised by agent-p has not been resolved", "Binding here (2):", "- [Rule] keep a", "- [Decision] bound", "Unverified edits (1):",
        "- Edited 'm1, m2, m3' via edit — no test/lint/build run covered it afterwards", "Failing checks (2):", "- Check 'test' on 'src/b.rs, src/c.rs' failed — no fix attempted since",
        "- Check 'test' failed on files under rule 'keep a' — possible violation", "</reasoning-state>",
    ]
    assert found["q"].split("\n")[1:3] == ["Decisions (1):", "- [Pending] other project"]
    empty = reports.brief_text(n.where("id = 'none'"), e, t, active).collect()
    assert empty == []
    assert reports.brief_text(n.where("id = 'r2'").withColumn("status", F.lit("Invalidated")), e.limit(0), t.limit(0), active).first().brief == ""


def test_answer_has_all_sections(spark):
    n = nodes(spark, ("p", "a", "Decision", "s1", [], "use rust"), ("p", "b", "Rule", "s1", [], "no unsafe rust"), ("p", "c", "OpenItem", "s2", [], "which rust"), ("p", "d", "Decision", "s2", [], "use go"), ("q", "z", "Rule", "s1", [], "rust rust rust"))
    e = edges(spark, ("p", "a", "Resolves", "c"), ("p", "a", "RelatesTo", "c"), ("p", "d", "Supersedes", "a"), ("p", "b", "Refutes", "d"))
    asked = spark.createDataFrame([(1, "p", "rust rust unsafe"), (2, "p", "nothing here"), (3, "empty", "rust")], "question_id long, project_id string, question string")
    seen = spark.createDataFrame([(1, "p", x) for x in "abcd"] + [(2, "p", x) for x in "cd"], "question_id long, project_id string, id string")
    ranked = retrieval.keyword_count_rank(asked, seen, n)
    assert sorted((r.question_id, r["rank"], r.id, r.score) for r in ranked.collect()) == [(1, 1, "b", 6), (1, 2, "a", 4), (1, 3, "c", 4), (2, 1, "c", 0), (2, 2, "d", 0)]
    inside = graph.induced_edges(seen, e)
    trace = graph.reverse_trace_order(ranked, inside)
    assert [r.id for r in trace.where("question_id = 1").orderBy("place").collect()] == ["b", "a", "d", "c"]
    found = {r.question_id: r.answer for r in reports.answer_sections(asked, seen, trace, n, inside).collect()}
    assert found[1] == (
        "### Decisions\n- **agent-p** (s1) use rust\n  - *relates to* → which rust\n- **agent-p** (s2) use go\n  - *supersedes* → use rust\n\n"
        "### Rules\n- **agent-p** (s1) no unsafe rust\n  - *refutes* → use go\n\n"
        "### Reasoning Chains\n1. agent-p (s1) agent-p (s2) → *refutes* agent-p (s1) → *supersedes* agent-p (s2) → *relates to*\n\n"
        "### Open Items\n- **agent-p** (s2) which rust"
    )
    assert found[2] == "### Decisions\n- **agent-p** (s2) use go\n\n### Open Items\n- **agent-p** (s2) which rust" and found[3] == reports.EMPTY


def test_answer_takes_the_newest_edges(spark):
    n = nodes(spark, *(("p", x, "Decision", "s1", [], f"label {x}") for x in "abcdef"))
    e = edges(spark, *(("p", "a", "RelatesTo", x) for x in "bcdef"), ("p", "b", "Refutes", "c"), ("p", "b", "Resolves", "c"), ("p", "b", "Supersedes", "d"))
    asked = spark.createDataFrame([(1, "p", "x")], "question_id long, project_id string, question string")
    seen = spark.createDataFrame([(1, "p", x) for x in "abcdef"], "question_id long, project_id string, id string")
    trace = spark.createDataFrame([(1, "p", x, k) for k, x in enumerate("abcdef")], "question_id long, project_id string, id string, place long")
    text = reports.answer_sections(asked, seen, trace, n, graph.induced_edges(seen, e)).first().answer
    parts = [p.split("\n") for p in text.split("### Reasoning")[0].split("- **agent-p**")[1:]]
    assert [x.rsplit(" ", 1)[1] for x in parts[0] if "→" in x] == ["f", "e", "d"]  # equal preference: newest first, three of five
    assert [x for x in parts[1] if "→" in x] == ["  - *resolves* → label c", "  - *supersedes* → label d"]  # of parallel edges the newest


def test_chains_of_more_than_six_nodes_are_left_out(spark):
    ids = "abcdefghij"
    e = edges(spark, *(("p", x, "RelatesTo", y) for x, y in zip(ids[:7], ids[1:8])), ("p", "i", "Resolves", "j"))
    trace = spark.createDataFrame([("q", "p", x, k) for k, x in enumerate(ids)], "question_id string, project_id string, id string, place long")
    inside = graph.induced_edges(trace.select("question_id", "project_id", "id"), e)
    assert [(r.chain, r.verbs) for r in graph.reasoning_chains(trace, inside).collect()] == [(["i", "j"], [None, "Resolves"])]


def test_context_asof_over_many_ranges_and_projects(spark):
    rng = random.Random(2)
    event, node, edge = [], [], []
    for p in ("p", "q"):
        for seq in range(400):
            for rows, mark, share in ((event, "u", 0.5), (node, "n", 0.6), (edge, "e", 0.9)):
                if rng.random() < share:
                    rows.append((p, f"{mark}{seq:04d}", seq))
    table = lambda rows: spark.createDataFrame(rows, "project_id string, id string, seq long").repartition(7)
    found = scans.context_asof(table(event), table(node), table(edge), 6, 9, 15).collect()
    assert len(found) == len(event)
    last = lambda rows, r, k: [i for p, i, s in sorted(rows) if p == r.project_id and s <= r.seq][-k:]
    for r in found:
        assert r.history == last(event, r, 6) and r.known == last(node, r, 9) and r.known_edges == last(edge, r, 15)


def test_numbers_in_a_project_equal_the_order(spark):
    rows = [(p, f"i{n % 7}-{n}", n // 3) for n in range(500) for p in ("p", "q")]
    found = scans.numbered(spark.createDataFrame(rows, "project_id string, id string, seq long").repartition(5)).collect()
    for p in ("p", "q"):
        own = sorted((r.seq, r.id, r.place) for r in found if r.project_id == p)
        assert [x[2] for x in own] == list(range(500))


def test_community_labels_leave_stop_words_out(spark):
    n = nodes(spark, ("p", "a", "Rule", "s", [], "The shall shall cat and dog"), ("p", "b", "Rule", "s", [], "the and of it"))
    own = spark.createDataFrame([("p", "a", "c1"), ("p", "b", "c2")], "project_id string, id string, community string")
    assert {r.community: r.community_label for r in communities.community_label(n, own).collect()} == {"c1": "shall · cat · dog", "c2": "Community c2"}


def test_embedding_topk_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((300, 8))
    data[100:140], data[7] = data[3], 0
    rows = [("p", i, v.tolist()) for i, v in enumerate(data)] + [("q", 1000, data[0].tolist()), ("p", 2000, None), ("p", 2001, [1.0, None]), ("p", 2002, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "project_id string, id long, embedding array<double>")
    asked = vectors.where("id < 20").withColumn("question_id", F.concat(F.lit("x"), "id"))
    unit = data / np.where((norm := np.linalg.norm(data, axis=1)) > 0, norm, 1)[:, None]
    for block in (20, 10_000):
        found = {}
        for r in retrieval.embedding_topk(asked, vectors, 6, block).collect():
            found.setdefault(int(r.question_id[1:]), []).append((r["rank"], r.id, r.score))
        for q in range(20):
            score = np.round(unit @ unit[q], 6)
            want = [int(i) for i in np.lexsort((np.arange(300), -score)) if i != q][:6]
            assert [i for _, i, _ in sorted(found[q])] == want
    assert retrieval.embedding_topk(asked.limit(0), vectors).count() == 0


def test_questions_without_a_vector_are_answered_by_words(spark):
    n = nodes(spark, ("p", "a", "Rule", "s", [], "rust compiler"), ("p", "b", "Rule", "s", [], "go linker"), ("q", "c", "Rule", "s", [], "rust"))
    vectors = spark.createDataFrame([("p", "a", [1.0, 0.0]), ("p", "b", [0.0, 1.0])], "project_id string, id string, embedding array<double>")
    asked = spark.createDataFrame(
        [(1, "p", "rust", [0.1, 1.0]), (2, "p", "rust", None), (3, "p", "rust", [1.0]), (4, "q", "rust", [1.0, 0.0])], "question_id long, project_id string, question string, embedding array<double>"
    )
    found = {(r.question_id, r["rank"]): (r.id, r.source) for r in retrieval.embedding_or_bm25_topk(asked, vectors, n, edges(spark, ("p", "a", "Resolves", "b")), 1).collect()}
    assert found == {(1, 1): ("b", "embedding"), (2, 1): ("a", "bm25"), (3, 1): ("a", "bm25"), (4, 1): ("c", "bm25")}


def test_suffix_matches_equal_brute_force(spark):
    rng = random.Random(8)
    path = lambda: "".join(rng.choice("ab/") for _ in range(rng.randrange(1, 7)))
    own = [(p, path()) for p in "pq" for _ in range(300)] + [("p", ""), ("p", "x/é.rs")]
    active = [(p, path()) for p in "pq" for _ in range(12)] + [("p", "é.rs"), ("r", "a")]
    table = lambda rows: spark.createDataFrame(rows, "project_id string, file string").repartition(5)
    for some in (active, active[:2], active[12:14], []):
        want = {(p, f) for p, f in own for q, g in some if p == q and f and g and (f.endswith(g) or g.endswith(f))}
        found = [tuple(r) for r in reports.suffix_matches(table(own), table(some) if some else table(active).limit(0)).collect()]
        assert set(found) == want and len(found) == len(want)


def test_extraction_batches_by_size_and_wait(spark):
    times = [0, 1, 14, 15, 16, 40, *(41 + k / 10 for k in range(12))]
    rows = [("p", f"e{n:02d}", n, float(t)) for n, t in enumerate(times)] + [("q", "e", 0, 5.0)]
    found = extraction.extraction_batches(spark.createDataFrame(rows, "project_id string, id string, seq long, start_time double")).collect()
    assert [r.batch for r in sorted(found, key=lambda r: (r.project_id, r.seq))] == [0, 0, 0, 0, 1, 2, *[2] * 9, *[3] * 3, 0]


def test_relation_scores_from_a_gold_file(spark, tmp_path):
    gold = {
        "meta": {"v": 1}, "decisions": [{"id": "d1", "label": "Use the rust compiler", "who": "ann", "status": "open"}, {"id": "d2", "label": None}], "questions": [{"id": "q1", "label": "which linker works"}],
        "key_relations": [{"source": "d1", "target": "q1", "type": "Resolves", "note": "n"}, {"source": "q1", "target": "d1", "type": "Refutes", "note": ""}],
    }
    (tmp_path / "gold.json").write_text(json.dumps(gold, indent=1))
    items, relations = readers.load_gold(spark, str(tmp_path / "gold.json"))
    assert sorted((r.section, r.id, r.who) for r in items.collect()) == [("decisions", "d1", "ann"), ("questions", "q1", None)]
    label = {r.id: r.label for r in items.collect()}
    rows = spark.createDataFrame([(str(k), label[r.source], label[r.target], r.type) for k, r in enumerate(relations.collect())], "relation_id string, source_label string, target_label string, edge_type string")
    n = nodes(spark, ("p", "a", "Decision", "s", [], "we use rust compiler now"), ("p", "b", "OpenItem", "s", [], "linker works maybe"), ("p", "c", "Rule", "s", [], "unrelated"))
    e = edges(spark, ("p", "a", "Resolves", "b"), ("p", "c", "Resolves", "b"))
    r = evaluation.relation_prf(rows, n, e).first()
    assert (r.gold, r.n_edges, r.tp, r.fp, r.fn, r.p, r.r, r.f1) == (2, 2, 1, 1, 1, 0.5, 0.5, 0.5)


def test_best_nodes_meet_in_rare_words_and_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    text = lambda least, most: " ".join(["we01", *(f"w{min(int(rng.exponential(12)), 60)}" for _ in range(rng.integers(least, most)))])
    held = [(f"n{k:03d}", k // 2, text(0, 4), text(0, 12)) for k in range(150)]
    asked = [(f"e{k}", text(0, 9)) for k in range(120)] + [("none", ""), ("far", "nothing like it")]
    n = spark.createDataFrame(held, "id string, seq long, label string, description string")
    ends = spark.createDataFrame(asked, "end_id string, label string")
    for threshold in (0.5, 0.8, 1.0):
        want = {}
        for end, label in asked:
            a = set(label.split())
            scores = [(len(a & b) / min(len(a), len(b)), -seq, i) for i, seq, l, d in held for b in (set(l.split()), set(l.split()) | set(d.split())) if a]
            if scores and max(scores)[0] >= threshold:
                want[end] = max(scores)[2]
        assert {r.end_id: r.id for r in evaluation.best_nodes(ends, n, threshold).collect()} == want
    # A word that all have makes no pairs by itself.
    sets = [x for k in range(300) for x in ((f"s{k}", k, "all", 4, 4), (f"s{k}", k, f"own{k}", 4, 1))]
    rows = spark.createDataFrame(sets, "id string, set long, word string, m int, place int").withColumns({"low": F.lit(0), "high": F.lit(0)})
    asks = rows.select(F.col("id").alias("end_id"), "word", F.col("m").alias("n"), "place", "low", "high")
    assert evaluation._pairs(asks, rows, 1.0).count() == 300 and evaluation._pairs(asks, rows, 0.5).count() == 300


@pytest.mark.parametrize("buckets", [50_000, 2])
def test_bootstrap_is_the_resampled_mean(spark, buckets):
    deltas = [1.0] * 13 + [0.0] * 20 + [-1.0] * 7
    r = evaluation.bootstrap_ci(spark.createDataFrame([(d,) for d in deltas], "delta double"), 4000, bucket_values=buckets).first()
    means = np.random.default_rng(1).choice(deltas, (20_000, 40)).mean(1)
    assert r.total == 40 and abs(r.low - np.percentile(means, 2.5)) < 0.03 and abs(r.high - np.percentile(means, 97.5)) < 0.03


def test_debt_of_several_files_and_projects(spark):
    t = tools(spark, ("p", "e", "s", "edit", "", ["a", "b"]), ("q", "k", "s", "test", "ok", ["a"]), ("p", "k2", "t", "test", "ok", ["a"]), ("p", "e2", "s", "edit", "", []))
    found = debt.unverified_changes(*debt.scratch(t)).collect()
    assert [(r.project_id, r.node_ids) for r in found] == [("p", ["e"])]
    assert {(r.project_id, r.session_id) for r in debt.current_sessions(t).collect()} == {("p", "s"), ("q", "s")}


def test_debt_report_bands(spark):
    item = lambda p, s: (p, "UnverifiedChange", ["x"], "d", s, 1)
    items = spark.createDataFrame([item("a", "Medium"), item("a", "Medium"), item("b", "High"), item("b", "Medium")], "project_id string, debt_type string, node_ids array<string>, description string, severity string, seq long")
    found = debt.debt_report(items, spark.createDataFrame([("a",), ("b",), ("c",)], "project_id string")).collect()
    assert sorted(tuple(r) for r in found) == [("a", 2, 4, "amber"), ("b", 2, 5, "red"), ("c", 0, 0, "green")]
    assert sorted((r.project_id, r.n) for r in debt.debt_by_type(items).collect()) == [("a", 2), ("b", 2)]


def test_debt_by_type_has_the_band_of_the_whole_report(spark):
    rows = [("a", "UnverifiedChange", "Medium"), ("a", "UnresolvedOpenItem", "Medium"), ("b", "FailedVerification", "High"), ("b", "UnverifiedChange", "Medium"), ("c", "UnresolvedOpenItem", "Low"), *[("c", "RuleViolation", "Low")] * 3]
    items = spark.createDataFrame([(p, kind, ["x"], "d", s, 1) for p, kind, s in rows], "project_id string, debt_type string, node_ids array<string>, description string, severity string, seq long")
    found = sorted((r.project_id, r.debt_type, r.n, r.band) for r in debt.debt_by_type(items).collect())
    assert found == [
        ("a", "UnresolvedOpenItem", 1, "amber"), ("a", "UnverifiedChange", 1, "amber"), ("b", "FailedVerification", 1, "red"), ("b", "UnverifiedChange", 1, "red"),
        ("c", "RuleViolation", 3, "amber"), ("c", "UnresolvedOpenItem", 1, "amber"),
    ]
    assert debt.debt_by_type(items.limit(0)).collect() == []
    assert registry.QUERIES["debt_by_type"](spark, SF).columns == ["debt_type", "n", "band"]


def test_debt_over_sessions_by_hand(spark):
    n = nodes(spark, ("p", "o1", "OpenItem", "s0", [], "q1"), ("p", "o2", "OpenItem", "s1", [], "q2"), ("p", "d", "Decision", "s2", [], "d"), ("p", "r", "Rule", "s2", ["a"], "r"), ("q", "o", "OpenItem", "s9", [], "z"))
    e = edges(spark, ("p", "d", "Resolves", "o1"))
    t = spark.createDataFrame(
        [("p", "e1", "s0", "edit", "", ["a"], 0.0, 10), ("p", "e2", "s0", "edit", "", ["b"], 1.0, 11), ("p", "c1", "s0", "test", "ok", ["b"], 2.0, 12), ("p", "c2", "s1", "test", "2 failed", ["a"], 3.0, 13), ("p", "c3", "s3", "test", "1 failed", ["a"], 4.0, 14), ("p", "e3", "s3", "edit", "", ["a"], 5.0, 15)], TOOL
    )
    found = {(r.project_id, r.session_id): tuple(r)[2:] for r in debt.debt_over_sessions(n, e, t).collect()}
    # index, open, unverified, failing, violations, raised, score
    assert found[("p", "s0")] == (0, 1, 1, 0, 0, 2, 4)
    assert found[("p", "s1")] == (1, 2, 1, 1, 0, 2, 3 + 2 + 2 + 3)
    assert found[("p", "s2")] == (2, 1, 1, 1, 1, 1, 3 + 2 + 3 + 3)  # o1 resolved; the rule comes: c2 breaks it
    assert found[("p", "s3")] == (3, 1, 2, 1, 2, 2, 3 + 4 + 3 + 6)  # c3 fixed by e3, which nothing checks; c3 breaks the rule
    assert found[("q", "s9")] == (0, 1, 0, 0, 0, 1, 2)
    short = {r.session_id: (r.unverified, r.failing, r.violations) for r in debt.debt_over_sessions(n, e, t, active=2).collect() if r.project_id == "p"}
    assert short == {"s0": (1, 0, 0), "s1": (1, 1, 0), "s2": (0, 1, 1), "s3": (1, 0, 1)}


def test_history_keeps_every_snapshot(spark):
    from loreweave.operators import decisions

    rng = random.Random(4)
    state, states, history = {}, [], None
    columns = "project_id string, id string, label string, description string, node_type string, agent_id string, confidence double"
    for t in range(5):
        for k in range(12):
            if rng.random() < 0.4:
                state[f"n{k}"] = (rng.choice(["x", "y", None]), "d", "Rule", "a", rng.choice([0.5, 0.505, 0.7]))
            elif rng.random() < 0.2:
                state.pop(f"n{k}", None)
        states.append(dict(state))
        history = staging.stage(decisions.record_history(history, spark.createDataFrame([("p", i, *v) for i, v in state.items()], columns), float(t)), "history")
    for t, want in enumerate(states):
        assert {r.id: tuple(r)[2:7] for r in decisions.as_of(history, t + 0.5).collect()} == want
    links = decisions.record_history(None, spark.createDataFrame([("p", "e", "RelatesTo")], "project_id string, id string, edge_type string"), 3.0)
    for a in range(5):
        for b in range(5):
            found = {(r.kind, r.id): (r.change, r.fields) for r in decisions.graph_diff_between(history, links, a, b).collect()}
            want = {("edge", "e"): ("added" if b > a else "removed", [])} if (a < 3) != (b < 3) else {}
            for i in states[a].keys() | states[b].keys():
                x, y = states[a].get(i), states[b].get(i)
                if x is None or y is None:
                    want["node", i] = ("added" if x is None else "removed", [])
                elif fields := [c for c, u, v in (("label", x[0], y[0]), ("confidence", x[4], y[4])) if (abs(u - v) > 0.01 if c == "confidence" else u != v)]:
                    want["node", i] = ("changed", fields)
            assert found == want


@pytest.mark.parametrize("block", [10, 13, 64, 50_000])
def test_extraction_batches_over_blocks(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for p, n in (("p", 700), ("q", 61), ("r", 1), ("s", 200)):
        at, number, size, first = 0.0, -1, 0, 0.0
        for k in range(n):
            at += rng.choice([0, 0.1, 0.5, 3, 3, 16, 40, -2]) if p != "s" else 0.0
            rows.append((p, f"e{k:04d}", k, at))
            if number < 0 or size == 10 or at > first + 15:
                number, size, first = number + 1, 0, at
            size += 1
            want[p, f"e{k:04d}"] = number
    table = spark.createDataFrame(rows, "project_id string, id string, seq long, start_time double").repartition(6)
    assert {(r.project_id, r.id): r.batch for r in extraction.extraction_batches(table, block=block).collect()} == want
    assert extraction.extraction_batches(table.limit(0), block=block).count() == 0


def test_gold_is_matched_as_by_the_walk(spark):
    rng = random.Random(7)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    gold = [(f"s{rng.randrange(3)}", f"g{k:03d}", said(rng.randrange(1, 4))) for k in range(120)] + [("s0", f"x{k}", "alpha beta") for k in range(6)]
    found = [(f"s{rng.randrange(3)}", f"f{k:03d}", said(2), said(rng.randrange(4))) for k in range(100)]
    g = spark.createDataFrame(gold, "section string, id string, label string")
    f = spark.createDataFrame(found, "section string, id string, label string, description string")
    contained = lambda a, b: len(set(a.split()) & set(b.split())) / max(1, min(len(set(a.split())), len(set(b.split()))))
    want, taken = set(), set()
    for s, i, label in sorted(gold, key=lambda r: r[1]):
        free = [(-max(contained(label, a), contained(label, f"{a} {b}".strip())), j) for t, j, a, b in found if t == s and j not in taken]
        score, best = min((x for x in free if x[0] <= -0.5), default=(0, None))
        if best:
            taken.add(best)
            want.add((s, i, best, -score))
    assert {tuple(r) for r in evaluation.match_gold(g, f).collect()} == want
    assert evaluation.match_gold(g.limit(0), f).count() == 0


def test_settled_pairs_of_many(spark):
    rng = random.Random(2)
    rows = list({(f"s{rng.randrange(2)}", f"g{rng.randrange(900):04d}", f"f{rng.randrange(800):04d}"): rng.choice([0.5, 0.6, 0.75, 1.0]) for _ in range(10_000)}.items())
    pairs = spark.createDataFrame([(*k, v) for k, v in rows], "section string, gold string, found string, score double")
    want, taken = set(), set()
    for s, gold in sorted({k[:2] for k, _ in rows}):
        free = sorted((-v, k[2]) for k, v in rows if k[:2] == (s, gold) and (s, k[2]) not in taken)
        if free:
            taken.add((s, free[0][1]))
            want.add((s, gold, free[0][1], -free[0][0]))
    assert {tuple(r) for r in evaluation.settled(pairs).collect()} == want


def test_least_reached_is_bounded_at_hubs(spark):
    from loreweave.operators import decisions

    rng = random.Random(1)
    links = [("p", "hub", "RelatesTo", f"t{k:04d}") for k in range(3000)] + [("p", f"s{k}", "Resolves", "hub") for k in range(50)] + [("p", f"t{k:04d}", "Refutes", "a0") for k in range(20)] + [("p", "a0", "RelatesTo", "a0")]
    links += [("q", f"n{rng.randrange(40)}", "RelatesTo", f"n{rng.randrange(40)}") for _ in range(80)]
    out = {}
    for p, a, _, b in links:
        out.setdefault((p, a), set()).add(b)
    found = {(r.project_id, r.id): r.least for r in decisions.least_reached(edges(spark, *links), 3, 5).collect()}
    for p, a in out:
        near, front = set(), {a}
        for _ in range(3):
            front = set().union(*(out.get((p, x), set()) for x in front))
            near |= front
        assert found[p, a] == sorted(near)[:5]


def test_many_questions_search_at_once(spark):
    rng = random.Random(5)
    links = [(p, f"n{rng.randrange(60)}", "RelatesTo", f"n{rng.randrange(60)}") for p in "pq" for _ in range(70)]
    seeds = [(k, rng.choice("pq"), f"n{rng.randrange(60)}") for k in range(200) for _ in range(2)]
    near = {}
    for p, a, _, b in links:
        near.setdefault((p, a), set()).add(b)
        near.setdefault((p, b), set()).add(a)
    table = spark.createDataFrame(seeds, "question_id long, project_id string, id string")
    for depth in (0, 1, 3):
        want = set()
        for q, p, i in seeds:
            held = front = {i}
            for _ in range(depth):
                front = set().union(*(near.get((p, x), set()) for x in front)) - held
                held = held | front
            want |= {(q, p, x) for x in held}
        found = [tuple(r) for r in graph.bfs_nodes(table, edges(spark, *links), depth).collect()]
        assert set(found) == want and len(found) == len(want)


def sequential_moves(links, passes=50):
    """Local moving, a node at a time in order, to the neighbouring community of the largest gain; until no node moves."""
    weight, degree = {}, {}
    for a, b, w in links:
        weight.setdefault(a, {}).setdefault(b, 0.0)
        weight.setdefault(b, {}).setdefault(a, 0.0)
        weight[a][b] += w
        weight[b][a] += w
    m = sum(w for _, _, w in links)
    degree = {x: sum(n.values()) for x, n in weight.items()}
    own, total = {x: x for x in weight}, dict(degree)
    for _ in range(passes):
        moved = False
        for x in sorted(weight):
            total[own[x]] -= degree[x]
            into = {}
            for y, w in weight[x].items():
                into[own[y]] = into.get(own[y], 0.0) + w
            gain = lambda c: into.get(c, 0.0) / m - degree[x] * total[c] / (2 * m * m)
            best = max(sorted({own[x], *into}), key=lambda c: (gain(c), c == own[x]))
            moved |= best != own[x]
            own[x] = best
            total[best] += degree[x]
        if not moved:
            break
    q = sum(w for a, b, w in links if own[a] == own[b]) / m
    return q - sum((t / (2 * m)) ** 2 for t in total.values())


@pytest.mark.parametrize("kind", ["cliques", "random", "fixture"])
def test_louvain_is_near_a_sequential_run(spark, kind):
    rng = random.Random(3)
    if kind == "fixture":
        from loreweave.sources import fixtures as fx

        n, e = fx.nodes(spark, SF), fx.edges(spark, SF)
    else:
        pairs = [(a, b) for a in range(60) for b in range(a) if (rng.random() < (0.5 if a // 10 == b // 10 else 0.02) if kind == "cliques" else rng.random() < 0.05)]
        n = nodes(spark, *(("p", f"n{k:02d}", "Rule", "s", [], "x") for k in range(60)))
        e = edges(spark, *(("p", f"n{a:02d}", "RelatesTo", f"n{b:02d}") for a, b in pairs))
    adjacency = communities.community_adjacency(e)
    q = communities.modularity(adjacency, communities.louvain(n, e)).first().modularity
    assert q >= 0.98 * sequential_moves([(r.a, r.b, float(r.weight)) for r in adjacency.collect()])


def test_staged_tables_go_with_their_scope(spark, tmp_path):
    kept = staging.stage(spark.range(3).toDF("x"), "kept")
    with staging.scope(spark):
        gone = staging.stage(spark.range(4).toDF("x"), "gone")
        assert gone.count() == 4
    place = lambda d: d.staged_path.removeprefix("file://")
    assert os.path.isdir(place(kept)) and not os.path.exists(place(gone))


def test_entry_without_an_import(spark, monkeypatch):
    import __spark_entry__ as entry

    assert "op2_language_id" in entry.queries() or not os.path.isdir(entry.ROOT / "loreweave/llm")
    for name in [m for m in sys.modules if m.startswith("loreweave.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    if "loreweave.llm" in vars(sys.modules["loreweave"]):
        monkeypatch.delattr(sys.modules["loreweave"], "llm")
    monkeypatch.setitem(sys.modules, "zstandard", None)  # importing it fails
    found = entry.queries()
    assert "pipeline" not in found and "op2_language_id" not in found and "debt_report" in found and "debt_report" in entry.oracle_sql()


def test_a_cluster_must_name_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            staging.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
