"""Streaming state against the same rules run over lists."""

from __future__ import annotations

import random
import time
import types

import pandas as pd

from loreweave.streaming import streams

TOOL = "project_id string, id string, session_id string, tool_name string, text string, files array<string>, end_time double, seq long, event_kind string"


def feed(spark, path, rows, per_file):
    """rows as a stream, per_file of them a trigger in their order."""
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k : k + per_file], TOOL).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are taken by age
    return spark.readStream.schema(TOOL).option("maxFilesPerTrigger", 1).parquet(path)


def tool(n, session, project="p", kind="edit", event_kind="tool_call", at=None):
    return (project, f"{kind}{n}", session, kind, "5 passed", ["a"], float(n if at is None else at), n, event_kind)


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return df.sparkSession.table(name).collect()


def test_scratch_keeps_rings_and_pushes_out_the_least_recent_session(spark, tmp_path):
    rows = [tool(n, f"s{n}") for n in range(17)] + [tool(n, "s1", kind="test" if n % 2 else "edit") for n in range(17, 130)] + [tool(130, "s0"), tool(131, "s9", kind="read")]
    found = drain(streams.stream_scratch(feed(spark, str(tmp_path / "in"), rows, 40), keep=20), "scratch")
    held, gone = {}, set()
    for _, i, s, kind, *_ in rows:
        if kind == "read":
            continue
        own = held.pop(s, ([], []))
        own[kind != "edit"].append(i)
        held[s] = own
        while len(held) > 16:
            gone.add(next(iter(held)))
            del held[next(iter(held))]
    last = {}
    for r in sorted(found, key=lambda r: (r.at, r.evicted)):
        last[r.session_id] = r
    assert {s for s, r in last.items() if not r.evicted} == set(held) and "s0" in gone and not last["s0"].evicted and last["s2"].evicted
    for s, (edits, checks) in held.items():
        assert last[s].edits == edits[-20:] and last[s].checks == checks[-20:]


def test_batches_close_by_size_and_by_the_clock(spark, tmp_path):
    rows = [tool(n, "s", event_kind="utterance") for n in range(23)]
    df = streams.stream_extraction_batches(feed(spark, str(tmp_path / "in"), rows, 8), most=10, wait_ms=2_000)
    q = df.writeStream.format("memory").queryName("batches").outputMode("append").start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline and sum(len(r.ids) for r in spark.table("batches").collect()) < 23:
            time.sleep(0.5)
        found = sorted((r.batch, r.ids) for r in spark.table("batches").collect())
    finally:
        q.stop()
    assert [b for b, _ in found] == list(range(len(found))) and [i for _, ids in found for i in ids] == [r[1] for r in rows]
    assert all(len(ids) <= 10 for _, ids in found)


def test_event_log_sessions_and_counts(spark, tmp_path):
    rows = [tool(n, f"s{n % 3}", "pq"[n % 2], "edit" if n % 5 else "note", "tool_call" if n % 5 else "utterance", at=n if n != 50 else -9000) for n in range(60)]
    path = str(tmp_path / "in")
    feed(spark, path, rows, 25)
    stream = lambda: spark.readStream.schema(TOOL).option("maxFilesPerTrigger", 1).parquet(path)
    log = drain(streams.stream_event_log(stream(), 7), "log")
    sessions = drain(streams.stream_sessions(stream()), "sessions")
    for p in "pq":
        own = [r for r in rows if r[0] == p]
        assert max((r for r in log if r.project_id == p), key=lambda r: r.at).ids == [r[1] for r in own][-7:]
        order = list(dict.fromkeys(r[2] for r in own))
        assert sorted((r.session_index, r.session_id) for r in sessions if r.project_id == p and not r.current) == list(enumerate(order))
        assert max((r for r in sessions if r.project_id == p and r.current), key=lambda r: r.at).session_id == own[-1][2]


def test_counts_by_observation(spark, tmp_path):
    rows = [tool(n, f"s{n % 3}", "pq"[n % 2], "edit" if n % 5 else "note", "tool_call" if n % 5 else "utterance", at=n if n not in (10, 50, 51) else -9000) for n in range(60)]
    stream = feed(spark, str(tmp_path / "in"), rows, 25)
    counts, taken, listener = streams.BatchCounts(), [], streams.ObservedMetrics()
    write = counts.into(lambda b, n: taken.append((n, b.count())))
    spark.streams.addListener(listener)
    try:
        q = streams.observe_metrics(stream).writeStream.queryName("counted").foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        deadline = time.time() + 20
        while time.time() < deadline and listener.totals.get("counted", {}).get("events") != 60:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    tools = sum(r[8] == "tool_call" for r in rows)
    want = {"batch": 2, "ingested": 60, "tool_events": tools, "queued": 60 - tools, "late": 2, "latest": 59.0}  # the late one of the first batch has nothing before it
    assert taken == [(0, 25), (1, 25), (2, 10)] and counts.totals() == want
    assert listener.totals["counted"] == {"events": 60, "tool_events": tools, "queued": 60 - tools}
    write(spark.createDataFrame(rows[50:], TOOL), 2)  # again
    assert counts.totals() == want
    more = streams.BatchCounts(**want)
    more.into(lambda b, n: b.count())(spark.createDataFrame([tool(60, "s", at=-5000)], TOOL), 3)
    assert more.totals() == want | {"batch": 3, "ingested": 61, "tool_events": tools + 1, "late": 3}


def test_sessions_seen_long_ago_are_forgotten(spark, tmp_path):
    rows = [tool(n, f"s{n}") for n in range(40)] + [tool(40, "s39"), tool(41, "s0")]
    found = drain(streams.stream_sessions(feed(spark, str(tmp_path / "in"), rows, 10), keep=8), "forgetful")
    new = [(r.session_index, r.session_id) for r in found if not r.current]
    assert sorted(new) == [*((n, f"s{n}") for n in range(40)), (40, "s0")]  # s0 is new again, s39 is not


def test_warnings_over_many_sessions_and_triggers(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for n in range(300):
        kind = rng.choice(["edit", "test", "read"])
        rows.append(("pq"[rng.randrange(2)], f"e{n}", f"s{rng.randrange(6)}", kind, rng.choice(["ok", "2 failed"]), rng.sample("abcd", rng.randrange(3)), float(n), n, "tool_call"))
    found = drain(streams.debt_warnings(feed(spark, str(tmp_path / "in"), rows, 70), keep=5, sessions=3), "many_warnings")
    want, held = [], {}
    for p, i, s, kind, text, files, _, n, _ in rows:
        if kind == "read":
            continue
        own, files = held.setdefault(p, {}), set(files)
        edits, checks = own.pop(s, ([], []))
        clear = lambda xs, w: want.extend((p, s, x, w, "clear", n) for x, f in xs if f & files)
        if kind == "edit":
            clear(checks, "failing")
            checks = [x for x in checks if not x[1] & files]
            if files:
                edits = [*edits, (i, files)]
                want.append((p, s, i, "unverified", "raise", n))
        else:
            clear(edits, "unverified")
            edits = [x for x in edits if not x[1] & files]
            if text == "ok":
                clear(checks, "failing")
                checks = [x for x in checks if not x[1] & files]
            else:
                checks = [*checks, (i, files)]
                want.append((p, s, i, "failing", "raise", n))
        own[s] = (edits[-5:], checks[-5:])
        if len(own) > 3:
            gone = next(iter(own))
            want += [(p, gone, x, w, "clear", n) for w, xs in zip(("unverified", "failing"), own.pop(gone)) for x, _ in xs]
    assert sorted(tuple(r) for r in found) == sorted(want)


def _held(value):
    """A state value that starts as told, in place of Spark's."""
    cell = [value]
    return types.SimpleNamespace(get=lambda: cell[0], exists=lambda: cell[0] is not None, update=lambda v: cell.__setitem__(0, v))


def test_a_project_meets_in_packed_blocks_and_sessions_leave_as_in_a_walk(spark):
    rng = random.Random(3)
    rows = [("p", f"e{n}", f"s{int(rng.expovariate(0.2))}", n // 2) for n in rng.sample(range(1000), 1000)]  # two of each seq
    table = spark.createDataFrame(rows, "project_id string, id string, session_id string, seq long").repartition(3)
    blocks = streams._packed(table).collect()
    assert len(blocks) == 3 and sum(len(b.codes) + len(b.seqs) + len(b.ids) for b in blocks) < 9 * len(rows)
    for most in (4, 1000):
        last = streams._LastActive(most)
        last.last = _held((["s1", "old"],))
        order, gone = ["s1", "old"], {}
        for _, i, s, seq in sorted(rows, key=lambda r: (r[3], r[1])):
            order = [x for x in order if x != s] + [s]
            if len(order) > most:
                gone.setdefault(order.pop(0), []).append({"seq": seq, "id": i})
        found = last.pushed(blocks)
        assert last.last.get() == (order,) and {s: g for s, _, g in found if g} == gone
        assert {s for s, *_ in found} == {r[2] for r in rows} | set(gone) and {at for _, at, _ in found} == {499}


def test_tasks_send_on_what_the_log_and_the_sessions_need(spark, tmp_path):
    rows = [tool(n, f"s{n % 3}") for n in range(3000)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, TOOL).repartition(2).write.parquet(path)
    stream = spark.readStream.schema(TOOL).parquet(path)
    for name, df in (("short_log", streams.stream_event_log(stream, 5)), ("few_sessions", streams.stream_sessions(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        assert "MapInPandas" in q._jsq.explainInternal(False)
    assert [r.ids for r in spark.table("short_log").collect()] == [[r[1] for r in rows[-5:]]]
    assert {(r.session_id, r.session_index, r.current) for r in spark.table("few_sessions").collect()} == {("s0", 0, False), ("s1", 1, False), ("s2", 2, False), ("s2", 2, True)}
    fold = streams._seen(pd.DataFrame([("p", f"s{n % 3}", n, f"e{n}", n, f"e{n}") for n in range(90)], columns=["project_id", "session_id", *streams._SEEN]))
    assert sorted(fold.itertuples(index=False, name=None)) == [("p", f"s{k}", k, f"e{k}", 87 + k, f"e{87 + k}") for k in range(3)]


def test_communities_are_refreshed_now_and_then(spark):
    size, calls = [3], []
    read = lambda: (spark.range(size[0]), spark.range(0))
    commit = streams.community_refresh(read, lambda nodes, edges: calls.append(nodes.count()), every=5, small=10)
    for number in range(11):
        size[0] = 3 if number < 3 else 12
        commit(spark.range(1), number)
    assert calls == [3, 3, 3, 12, 12]
