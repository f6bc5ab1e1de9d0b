"""The stored graph: one commit over two tables, replays, stops between the tables, buckets of projects, compaction, two writers."""

from __future__ import annotations

import json
import random

import pytest

from loreweave.sources.graph_store import CommitConflict, GraphStore
from loreweave.streaming import streams

NODE = "project_id string, id string, node_type string, label string, seq long"
EDGE = "project_id string, id string, edge_type string, source_node_id string, target_node_id string, seq long"
BOTH = "kind string, project_id string, id string, node_type string, label string, edge_type string, source_node_id string, target_node_id string, seq long"


def batch(spark, rows):
    """(project, id) nodes and (project, id, source, target) edges."""
    return spark.createDataFrame([("node", r[0], r[1], "Rule", r[1].upper(), None, None, None, k) if len(r) == 2 else ("edge", *r[:2], None, None, "Resolves", *r[2:], k) for k, r in enumerate(rows)], BOTH)


def held(store):
    nodes, edges = store.read()
    return sorted(((r.project_id or "", r.id) for r in nodes.collect())), sorted(((r.project_id or "", r.id) for r in edges.collect()))


ROWS = [[("p", "a"), ("p", "b"), ("p", "ab", "a", "b"), ("p", "az", "a", "z"), ("q", "a"), (None, "n")], [("p", "c"), ("p", "a"), ("p", "cb", "c", "b"), ("p", "ab", "a", "b"), ("q", "qb", "a", "b"), (None, "nn", "n", "n")]]
WANT = [([("", "n"), ("p", "a"), ("p", "b"), ("q", "a")], [("p", "ab")]), ([("", "n"), ("p", "a"), ("p", "b"), ("p", "c"), ("q", "a")], [("", "nn"), ("p", "ab"), ("p", "cb")])]


def test_batches_come_once(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), buckets=4)
    commit = streams.upsert_graph(store)
    with pytest.raises(ValueError):
        store.read()
    for number, rows in enumerate(ROWS):
        for _ in range(2):
            commit(batch(spark, rows), number)
        assert held(store)[0] == WANT[number][0] and [e for e in held(store)[1] if e[0]] == [e for e in WANT[number][1] if e[0]]
    commit(batch(spark, ROWS[0]), 0)  # a batch long since taken
    assert store.manifest()["version"] == 2 and store.manifest()["ledger"] == {"graph": 1}
    streams.upsert_graph(store, "other")(batch(spark, [("q", "new")]).limit(0), 0)
    assert store.manifest()["ledger"] == {"graph": 1, "other": 0} and held(store)[0] == WANT[1][0]


def test_a_stop_between_nodes_and_edges_leaves_nothing(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), buckets=4)
    commit = streams.upsert_graph(store)
    commit(batch(spark, ROWS[0]), 0)
    before = held(store)

    def stop():
        raise KeyboardInterrupt

    store._between = stop
    with pytest.raises(KeyboardInterrupt):
        commit(batch(spark, ROWS[1]), 1)
    assert held(store) == before and held(GraphStore(spark, str(tmp_path / "g"), buckets=4)) == before
    store = GraphStore(spark, str(tmp_path / "g"), buckets=4)  # a new process replays the batch
    streams.upsert_graph(store)(batch(spark, ROWS[1]), 1)
    assert held(store)[0] == WANT[1][0]


def test_of_two_writers_one_fails_whole(spark, tmp_path):
    one, two = (GraphStore(spark, str(tmp_path / "g"), buckets=2) for _ in range(2))
    streams.upsert_graph(one)(batch(spark, ROWS[0]), 0)
    one._between = lambda: streams.upsert_graph(two, "two")(batch(spark, [("q", "x")]), 0)
    with pytest.raises(CommitConflict):
        streams.upsert_graph(one)(batch(spark, ROWS[1]), 1)
    assert held(two)[0] == sorted([*WANT[0][0], ("q", "x")])
    one._between = lambda: None
    streams.upsert_graph(one)(batch(spark, ROWS[1]), 1)
    assert held(two)[0] == sorted([*WANT[1][0], ("q", "x")])


def test_compaction_and_pruning(spark, tmp_path):
    rng = random.Random(3)
    store = GraphStore(spark, str(tmp_path / "g"), buckets=8, compact_after=3)
    want, reader = set(), None
    for number in range(7):
        rows = [(f"p{rng.randrange(30)}", f"n{rng.randrange(50)}") for _ in range(40)]
        want |= set(rows)
        streams.upsert_graph(store)(batch(spark, rows), number)
        if number == 1:
            reader, seen = store.read()[0], len(want)
        if number == 3:
            assert reader.count() == seen  # a compaction later its folders still stand
    assert set(held(store)[0]) == want and max(len(store.manifest()[t]) for t in ("nodes", "edges")) < 3
    store.compact()
    store.compact()
    assert set(held(store)[0]) == want and len(list((tmp_path / "g" / "data").iterdir())) <= 7 + 5
    rows = [("p1", "fresh")]
    plan = []
    read = store._read
    store._read = lambda *a: plan.append(a) or read(*a)
    streams.upsert_graph(store)(batch(spark, rows), 100)
    assert all(len(a[2]) == 1 for a in plan if len(a) > 2)  # the buckets of its own project alone


def test_a_stream_into_the_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), buckets=4)
    for k, rows in enumerate(ROWS):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(BOTH).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(streams.upsert_graph(store)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert held(store)[0] == WANT[1][0]
    manifests = sorted((tmp_path / "g" / "manifests").glob("*.json"))
    assert [json.loads(m.read_text())["version"] for m in manifests] == [1, 2]
