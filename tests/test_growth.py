"""Steps that findings on growth named: same results from parts, and no step done twice."""

from __future__ import annotations

import collections
import math
import random

import pyarrow as pa

from loreweave.operators import bm25_store, communities, graph, retrieval
from loreweave.operators.bm25_store import Bm25Store

NODE = "project_id string, id string, label string, description string, seq long"
EDGE = "project_id string, id string, source_node_id string, target_node_id string"
ASK = "question_id long, project_id string, question string"


def ranked(nodes, edges, asked, n):
    """BM25 with a degree boost, each node against each question."""
    found = set()
    for q, project, question in asked:
        own = {i: (label + " " + (more or "")).split() for p, i, label, more, _ in nodes if p == project}
        words = collections.Counter(question.split())
        if not own or not words:
            continue
        mean = max(1.0, sum(map(len, own.values())) / len(own))
        df = {t: sum(t in w for w in own.values()) for t in words}
        degree = collections.Counter(x for p, _, a, b in edges if p == project for x in (a, b))
        score = {}
        for i, w in own.items():
            part = sum(k * math.log((len(own) - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, k in words.items())
            score[i] = round(part + 0.1 * degree[i], 6)
        best = sorted(score, key=lambda i: (-score[i], i))[:n]
        found |= {(q, project, i, score[i], k + 1) for k, i in enumerate(best)}
    return found


def test_bm25_over_parts_and_copies_ranks_as_node_by_node(spark):
    rng = random.Random(5)
    text = lambda most: " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(most)))
    nodes = [(p, f"n{k}", text(9), rng.choice([None, text(9)]), k) for k in range(90) for p in "pq"] + [("alone", "x", "w1", None, 0)]
    edges = [(p, f"e{k}", f"n{rng.randrange(100)}", f"n{rng.randrange(40)}") for k in range(60) for p in "pq"]
    asked = [(k, rng.choice("pq"), text(12)) for k in range(30)] + [(50, "p", "unknown"), (51, "none", "w1"), (52, "alone", "w1 w2"), (53, "q", "")]
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((asked, ASK), (nodes, NODE), (edges, EDGE))]
    for sizes in ({}, {"part_rows": 7, "part_questions": 4}, {"part_words": 50}):
        found = retrieval.bm25_topk(*tables, 4, **sizes).select("question_id", "project_id", "id", "score", "rank").collect()
        assert {tuple(r) for r in found} == ranked(nodes, edges, asked, 4) and len(found) == len({tuple(r) for r in found})
    plan = retrieval.bm25_topk(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # no row a question and node is shuffled


def test_a_search_works_its_seeds_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    seeds = spark.createDataFrame([(k, "p", f"n{k}") for k in range(5)], "question_id long, project_id string, id string").mapInArrow(counted, "question_id long, project_id string, id string")
    edges = spark.createDataFrame([("p", f"e{k}", f"n{k}", f"n{k + 1}") for k in range(8)], EDGE)
    found = {tuple(r) for r in graph.bfs_nodes(seeds, edges, 2).select("question_id", "id").collect()}
    assert found == {(k, f"n{j}") for k in range(5) for j in range(max(0, k - 2), min(8, k + 2) + 1)} and made.value == 5


def test_a_stored_search_over_parts_and_copies_ranks_as_node_by_node(spark, tmp_path):
    rng = random.Random(8)
    text = lambda most: " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(most)))
    nodes = [("p", f"n{k}", text(20), text(20), k) for k in range(300)]
    edges = [("p", f"e{k}", f"n{rng.randrange(300)}", f"n{rng.randrange(40)}") for k in range(200)]
    asked = [(k, "p", text(10) + " w0") for k in range(12)]
    store = Bm25Store(spark, str(tmp_path / "index"), block=8)
    store.commit(0, spark.createDataFrame([(p, i, "w1 old", None, k) for p, i, _, _, k in nodes[:150]], NODE))
    store.commit(1, spark.createDataFrame(nodes, NODE))
    found, _ = store.topk(spark.createDataFrame(asked, ASK), spark.createDataFrame(edges, EDGE), 4, part_rows=40, part_questions=4)
    assert {tuple(r) for r in found.select("question_id", "project_id", "id", "score", "rank").collect()} == ranked(nodes, edges, asked, 4)


def test_blocks_of_one_hash_stay_apart():
    rows = [(7, "p", "a", 0, 1, 0), (7, "p", "b", 0, 1, 0), (7, "p", "a", 0, 1, 0), (9, "p", "c", 0, 2, 1), (9, "p", "c", 0, 2, 1)]
    names = ["block", "project_id", "term", "class", "splits", "split"]
    table = pa.table([*(pa.array(c) for c in zip(*rows)), pa.array([f"n{k}" for k in range(5)]), pa.array([1, 2, 3, 4, 5]), pa.array([9, 8, 7, 6, 5])], [*names, "id", "tf", "length"])
    for size in (1, 2, 5):
        found = [r for b in bm25_store._gathered(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        got = sorted((r["term"], r["n"], r["max_tf"], r["min_length"], sorted(e["id"] for e in r["entries"])) for r in found)
        assert got == [("a", 2, 3, 7, ["n0", "n2"]), ("b", 1, 2, 8, ["n1"]), ("c", 2, 5, 5, ["n3", "n4"])]


def test_communities_write_one_table_a_round_and_reruns_agree(spark, monkeypatch):
    rng = random.Random(4)
    kinds = ["Supersedes", "Refutes", "Resolves", "RelatesTo"]
    edges = [(p, f"{p}{k}", rng.choice(kinds), f"n{rng.randrange(k // 6 * 6, k // 6 * 6 + 12)}", f"n{k}") for k in range(60) for p in "pq"] + [("p", "loop", "Resolves", "n1", "n1")]
    nodes = [(p, f"n{k}") for k in range(75) for p in "pq"] + [("r", "n0")]
    written, real = [], communities.stage
    monkeypatch.setattr(communities, "stage", lambda df, name: written.append(name) or real(df, name))
    runs = []
    for parts in (1, 7):
        rng.shuffle(edges)
        tables = spark.createDataFrame(nodes, "project_id string, id string"), spark.createDataFrame(edges, "project_id string, id string, edge_type string, source_node_id string, target_node_id string").repartition(parts)
        runs.append({(r.project_id, r.id): r.community for r in communities.louvain(*tables, rounds=3, cycles=1).collect()})
    assert runs[0] == runs[1] and set(runs[0]) == set(nodes)
    assert runs[0]["r", "n0"] == "n0" and runs[0]["p", "n74"] == "n74" and len(set(runs[0].values())) < 60
    levels = written.count("neighbours")
    assert "moves" not in written and written.count("assignment") <= levels * 3 + levels - 2
    none = spark.createDataFrame([], "project_id string, id string, edge_type string, source_node_id string, target_node_id string")
    assert {r.community for r in communities.louvain(tables[0].where("project_id = 'r'"), none).collect()} == {"n0"}
