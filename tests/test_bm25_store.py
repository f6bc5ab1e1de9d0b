"""The stored index against the search over all nodes: changes, removals, repeats, compaction, early end."""

from __future__ import annotations

import random

from loreweave.operators import retrieval
from loreweave.operators.bm25_store import Bm25Store

NODE = "project_id string, id string, label string, description string, seq long"
EDGE = "project_id string, id string, source_node_id string, target_node_id string"
ASK = "question_id long, project_id string, question string"


def text(rng, words):
    return " ".join(f"w{k}" for k in rng.choices(range(words), [1 / (k + 1) for k in range(words)], k=rng.randrange(1, 25)))


def test_a_stored_index_ranks_as_the_search_over_all_nodes(spark, tmp_path):
    rng = random.Random(6)
    store = Bm25Store(spark, str(tmp_path / "index"), block=16)
    held: dict = {}
    edges = spark.createDataFrame([(p, f"e{k}", f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for k in range(150) for p in "pq"], EDGE)
    asked = spark.createDataFrame([(k, rng.choice("pq"), text(rng, 40) + " w39 w38") for k in range(12)] + [(90, "p", ""), (91, "none", "w1"), (92, "p", "unknown word")], ASK)
    ask = lambda n=3: store.topk(asked, edges, n)
    assert ask()[0].count() == 0
    for number in range(4):
        changed = {(rng.choice("pq"), f"n{rng.randrange(200)}"): (text(rng, 40), rng.choice([None, text(rng, 40)])) for _ in range(250 if not number else 60)}
        gone = [k for k in held if rng.random() < 0.1 and k not in changed] + [("p", "never")] if number else []
        held = {k: v for k, v in held.items() if k not in gone} | changed
        rows = spark.createDataFrame([(*k, *v, number) for k, v in changed.items()] + [(*k, "older", None, -1) for k in list(changed)[:3]], NODE)
        removed = spark.createDataFrame(gone, "project_id string, id string") if gone else None
        assert store.commit(number, rows, removed) and not store.commit(number, rows, removed)
        if number == 2:
            store.compact()
            store.compact()
        nodes = spark.createDataFrame([(*k, *v, 0) for k, v in held.items()], NODE)
        want = {tuple(r) for r in retrieval.bm25_topk(asked, nodes, edges, 3).select("question_id", "project_id", "id", "score", "rank").collect()}
        found, counts = ask()
        assert {tuple(r) for r in found.select("question_id", "project_id", "id", "score", "rank").collect()} == want
        assert all(0 <= r.scored <= r.postings for r in counts.collect())
    store.compact()
    store.compact()
    assert {tuple(r) for r in ask()[0].select("question_id", "project_id", "id", "score", "rank").collect()} == want and len(store.segments()) == 1


def test_postings_that_cannot_matter_are_skipped(spark, tmp_path):
    rng = random.Random(1)
    rows = [("p", f"n{k:04d}", "common " * rng.choice([1, 1, 1, 2]) + f"filler{k % 50} " * rng.randrange(1, 20) + ("rare rare rare" if k % 150 == 0 else ""), None, k) for k in range(1500)]
    nodes = spark.createDataFrame(rows, NODE)
    store = Bm25Store(spark, str(tmp_path / "index"), block=32)
    store.commit(0, nodes)
    asked = spark.createDataFrame([(1, "p", "rare common")], ASK)
    edges = spark.createDataFrame([], EDGE)
    found, counts = store.topk(asked, edges)
    want = retrieval.bm25_topk(asked, nodes, edges)
    assert [tuple(r) for r in found.orderBy("rank").select("id", "score").collect()] == [tuple(r) for r in want.orderBy("rank").select("id", "score").collect()]
    r = counts.first()
    assert r.postings > 1500 and r.scored < r.postings / 2
