"""The source of appended lines: append, half a last line, a shrunk file, a restart, pieces of a file, and playback in order."""

from __future__ import annotations

import json
import random

import pytest

from loreweave.sources import readers, tail


def prose(text, **more):
    return json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": text}]}} | more) + "\n"


@pytest.fixture
def told(spark, tmp_path):
    """Runs the stream until nothing is new and gives the texts of that run; every call restarts the query from its checkpoint."""
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        out = []
        stream = readers.stream_transcripts(spark, str(folder))
        q = stream.writeStream.foreachBatch(lambda b, n: out.extend((r.file.rsplit("/", 1)[1], r.reset, r.text) for r in b.orderBy("file", "place").collect()))
        assert q.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(120)
        return out

    return folder, run


def test_each_line_comes_once_over_restarts(told):
    folder, run = told
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    a.write_text(prose("one") + prose("side", isSidechain=True) + " " + prose("indented") + '{"type": "user"}\n')
    (folder / "other.txt").write_text(prose("no transcript"))
    assert run() == [("a.jsonl", False, "one")]
    assert run() == []
    half = prose("zwei ü")
    with a.open("a") as f:
        f.write(prose("two") + half[:30])
    b.write_text("")
    assert run() == [("a.jsonl", False, "two")]  # the half line waits
    with a.open("a") as f:
        f.write(half[30:] + "no object\n")
    b.write_text(prose("b1"))
    assert run() == [("a.jsonl", False, "zwei ü"), ("b.jsonl", False, "b1")]
    a.write_text(prose("new"))  # replaced by a shorter one: read anew
    assert run() == [("a.jsonl", True, "new")]
    with a.open("a") as f:
        f.write(prose("newer"))
    assert run() == [("a.jsonl", False, "newer")]


def test_a_running_query_reads_on(spark, tmp_path):
    file = tmp_path / "in.jsonl"
    file.write_text("".join(f"{i}\n" for i in range(5)))
    stream = tail.appended_lines(spark, str(file), maxBytesPerTrigger="3")
    q = stream.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for n in (5, 9, 10):
            with file.open("a") as f:
                f.write("".join(f"{i}\n" for i in range({5: 5, 9: 5, 10: 9}[n], n)))
            q.processAllAvailable()
            assert sorted(int(r.value) for r in spark.table("tailed").collect()) == list(range(n))
    finally:
        q.stop()


def test_pieces_of_a_file_hold_each_line_once(tmp_path):
    rng = random.Random(1)
    lines = ["".join(rng.choice("abü") for _ in range(rng.randrange(12))) for _ in range(200)]
    file = tmp_path / "x.jsonl"
    file.write_bytes("".join(x + rng.choice(["\n", "\n", "\r\n"]) for x in lines).encode() + b"half")
    for size in (1, 3, 7, 64, 10_000):
        reader = tail._Whole({"path": str(tmp_path), "bytesperpartition": str(size)})
        rows = [r for piece in reader.partitions() for b in reader.read(piece) for r in b.to_pylist()]
        assert [r["value"] for r in rows] == lines and len({r["place"] for r in rows}) == len(lines)


def test_a_batch_has_all_lines(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jsonl").write_text("x\ny\nz")
    assert sorted(r.value for r in tail.appended_lines(spark, str(tmp_path), stream=False).collect()) == ["x", "y"]
    assert tail.appended_lines(spark, str(tmp_path / "nothing"), stream=False).count() == 0


def test_playback_keeps_the_order_and_resumes(spark, tmp_path):
    event = lambda n: json.dumps({"id": f"e{n}", "session_id": "s", "agent_role": "a", "start_time": n, "end_time": n + 1, "text": f"t{n}"}) + "\n"
    file, out = tmp_path / "events.jsonl", []
    file.write_text("".join(event(n) for n in range(50)) + "broken\n")
    play = lambda: readers.play_events(readers.scan_event_stream_file(spark, str(file)), lambda b, n: out.append((n, [r.id for r in b.collect()])), str(tmp_path / "c"))
    play()
    with file.open("a") as f:
        f.write("".join(event(n) for n in range(50, 60)))
    play()
    assert out == [(0, [f"e{n}" for n in range(50)]), (1, [f"e{n}" for n in range(50, 60)])]

    def stops(batch, number):
        raise RuntimeError("stop")

    with file.open("a") as f:
        f.write(event(60))
    with pytest.raises(Exception):
        readers.play_events(readers.scan_event_stream_file(spark, str(file)), stops, str(tmp_path / "c"))
    play()
    assert out[2:] == [(2, ["e60"])]
