from pyspark.sql import functions as F

from loreweave.operators import extraction as ex
from loreweave.operators import retrieval as rt
from loreweave.operators import studies as st
from loreweave.operators import writes as wr
from loreweave.sources.writers import write_training_jsonl


def test_formats_nulls_blanks_and_mixed_lines(spark):
    texts = [None, "", " \n ", '["a"]', '{"a": 1}', "1: a\n\n2: b", "1: a\nx", "[1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.f for r in rows.select("i", st.sniff_record_format(F.col("t"), r"^\d+: .+").alias("f")).collect()}
    assert found == {0: None, 1: None, 2: None, 3: "json", 4: None, 5: "lines", 6: None, 7: None}


def test_verdicts_and_choices(spark):
    seen = spark.createDataFrame(
        [(1, "json", "json", "json", None, None), (2, None, "json", "lines", "lines", "lines"), (3, None, None, None, "both", "json")],
        "pair int, format1 string, format2 string, export_format string, choice1 string, choice2 string",
    )
    found = {r.pair: (r.cross_session, r.in_session, r.consistent) for r in st.consistency_verdict(seen).collect()}
    assert found == {1: ("PASS", "PASS", True), 2: ("PASS", "FAIL", False), 3: ("UNCLEAR", "UNCLEAR", False)}
    turns = spark.createDataFrame([("a", 1, "assistant", "per line"), ("a", 2, "assistant", "JSON"), ("a", 3, "user", "per line"), ("a", 4, "assistant", None)], "session_id string, turn int, role string, text string")
    assert st.stated_choice(turns, ["json"], ["per line"]).collect()[0].choice == "json"


def test_flips_and_banned_patterns(spark):
    files = lambda *rows: spark.createDataFrame([("p", *r) for r in rows], "project_id string, path string, text string")
    before, after = files(("a", "Backend: JSON\nconfig = env"), ("b", None)), files(("a", "# backend: toml\nconfig: env"), ("b", "import sqlite3"), ("b", "import sqlite3"))
    assert [tuple(r) for r in st.decision_flips(before, after, ["backend", "config"]).collect()] == [("p", "a", "backend", "json", "toml")]
    assert [tuple(r) for r in st.forbidden_pattern_scan(before, after, {"db": "sqlite3"}).collect()] == [("p", "b", "db")]
    assert st.forbidden_pattern_scan(after, after, {"db": "sqlite3"}).count() == 0


def test_gates_and_writes(spark):
    nodes = spark.createDataFrame([("p", "a", "e1"), ("p", "b", "e1"), ("p", "c", None)], "project_id string, id string, event_id string")
    edges = spark.createDataFrame(
        [("p", "1", "a", "b", "x" * 20), ("p", "2", "a", "b", "x" * 19), ("p", "3", "a", "c", "x" * 30), ("p", "4", "c", "z", None)],
        "project_id string, id string, source_node_id string, target_node_id string, reasoning string",
    ).withColumn("provenance", F.lit("INFERRED"))
    assert {r.id: r.provenance for r in ex.clamp_provenance(edges, nodes).collect()} == {"1": "EXTRACTED", "2": "AMBIGUOUS", "3": "INFERRED", "4": "INFERRED"}
    commands = spark.createDataFrame([("p", 1, "a", "b", None), ("p", 2, "a", "z", None), ("q", 3, "a", "b", None)], "project_id string, seq int, resolver string, question string, reasoning string")
    assert [r.id for r in wr.apply_resolve(commands, nodes).collect()] == ["a>b"]
    answers = spark.createDataFrame([("p", 1, ["c", "z", "a", None]), ("p", 2, None)], "project_id string, question_id int, ids array<string>")
    assert [(r.place, r.id) for r in rt.filter_candidate_ids(answers, nodes).orderBy("place").collect()] == [(0, "c"), (2, "a")]


def test_training_lines_are_appended(spark, tmp_path):
    records = spark.createDataFrame([("extract", 5, "x"), ("judge", 7, None)], "operation string, duration_ms int, payload string")
    for _ in range(2):
        write_training_jsonl(records, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).groupBy("operation").count().orderBy("operation").collect() == [("extract", 2), ("judge", 2)]
