"""Readers: event lines, transcripts, hook payloads, notes, raw model responses."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .tail import appended_lines

_EVENT = (
    "id string, session_id string, agent_role string, start_time double, end_time double, text string, event_kind string, tool_name string,"
    " files array<string>, commit string"
)
_REQUIRED = ["id", "session_id", "agent_role", "start_time", "end_time", "text"]
_KINDS = ["utterance", "tool_call", "user_prompt"]


def _events(lines: DataFrame) -> DataFrame:
    rows = lines.select(*(c for c in lines.columns if c != "value"), F.from_json("value", _EVENT).alias("e")).select("*", "e.*").drop("e")
    for column in _REQUIRED:
        rows = rows.where(F.col(column).isNotNull())
    rows = rows.withColumn("event_kind", F.coalesce("event_kind", F.lit("utterance"))).where(F.col("event_kind").isin(_KINDS))
    return rows.withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def scan_events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; blank and malformed lines, lines without a required field and unknown kinds are skipped."""
    return _events(spark.read.text(path))


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """The same records as they arrive in a folder."""
    return _events(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def scan_event_stream_file(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Event lines of files as they are appended, each once and over restarts: the columns of scan_events_jsonl() with file and place (the byte at
    which a line starts), which keep the order. Options as for appended_lines()."""
    return _events(appended_lines(spark, path, **options).drop("reset"))


def play_events(events: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give what is new in scan_event_stream_file() to each(batch, number), in the order of the files' lines, then end. The next call with the
    same checkpoint goes on from there; a call that broke off is given its batch again, with the same number."""
    ordered = lambda batch, number: each(batch.orderBy("file", "place"), number)
    events.writeStream.foreachBatch(ordered).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def transcript_to_events(lines: DataFrame) -> DataFrame:
    """(value, ...) lines of a transcript -> (..., text): assistant prose, no side chains; content is a string or text blocks. Lines that do not
    start with an object go. Columns beside value come along (file and place of appended_lines(), which tell each prose once)."""
    kind = F.get_json_object("value", "$.type")
    side = F.coalesce(F.get_json_object("value", "$.isSidechain"), F.lit("false"))
    content = F.get_json_object("value", "$.message.content")
    kept = [c for c in lines.columns if c != "value"]
    rows = lines.where(F.col("value").startswith("{") & (kind == "assistant") & (side != "true")).select(*kept, content.alias("content"))
    blocks = F.filter(F.from_json("content", "array<struct<type:string,text:string>>"), lambda b: b["type"] == "text")
    texts = F.when(F.col("content").startswith("["), F.transform(blocks, lambda b: b["text"])).otherwise(F.array("content"))
    return rows.select(*kept, F.explode(texts).alias("text")).where(F.trim("text") != "")


def stream_transcripts(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, place, reset, text): assistant prose of transcripts as they grow, from where the query's checkpoint stands."""
    return transcript_to_events(appended_lines(spark, path, **options))


def tool_payload_to_events(payloads: DataFrame, summary_bytes: int = 400, most_files: int = 8) -> DataFrame:
    """(tool_name, cwd, input, response: JSON text) -> (tool_name, files, text).

    Files come from the known path fields, need a slash, are joined to cwd where relative; consecutive repeats go.
    """
    fields = ["$.file_path", "$.filePath", "$.path", "$.notebook_path"]
    single = F.array(*(F.get_json_object("input", f) for f in fields))
    many = F.coalesce(F.from_json(F.get_json_object("input", "$.paths"), "array<string>"), F.array().cast("array<string>"))
    paths = F.filter(F.concat(single, many), lambda p: p.isNotNull() & p.contains("/"))
    joined = F.transform(paths, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.rtrim("cwd"), F.lit("/"), p)))
    rows = payloads.withColumn("paths", joined)
    apart = F.filter("paths", lambda p, i: (i == 0) | (p != F.get(F.col("paths"), i - 1)))
    found = [F.nullif(F.trim(F.get_json_object("response", f)), F.lit("")) for f in ("$.stdout", "$.output", "$.content", "$.result", "$.text", "$.filePath", "$.file_path", "$.type")]
    summary = F.coalesce(*found, F.col("response"))
    # Cut at bytes; a character split by the cut goes.
    cut = F.regexp_replace(F.decode(F.substring(F.encode(F.concat_ws(" ", "tool_name", summary), "UTF-8"), 1, summary_bytes), "UTF-8"), "�+$", "")
    return rows.select("tool_name", F.slice(apart, 1, most_files).alias("files"), cut.alias("text"))


def capture_prompts(prompts: DataFrame, prose: DataFrame, summaries: DataFrame, most_bytes: int = 2000) -> DataFrame:
    """Three (session_id, text) tables -> events with role user, assistant and system; blank texts go, long ones are cut."""
    part = lambda d, role, kind: d.select("session_id", F.lit(role).alias("agent_role"), F.lit(kind).alias("event_kind"), "text")
    rows = part(prompts, "user", "user_prompt").unionByName(part(prose, "assistant", "utterance")).unionByName(part(summaries, "system", "utterance"))
    cut = F.regexp_replace(F.decode(F.substring(F.encode("text", "UTF-8"), 1, most_bytes), "UTF-8"), "�+$", "")
    return rows.where(F.trim("text") != "").withColumn("text", cut)


def import_markdown(docs: DataFrame) -> DataFrame:
    """(project_id, path, content) -> nodes from list lines outside code fences, one per stable id. Only lines that open or close a fence or say something
    are put in order."""
    lines = docs.select("project_id", "path", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("fence", F.trim("line").startswith("```")).where(F.col("fence") | tx.is_listed(F.col("line")))
    # A column that explode makes is worked out once, however often it is used.
    once = lambda d, c, name: d.withColumn(name, F.explode(F.array(c)))
    lines = once(lines.repartition("project_id", "path"), tx.note_text(F.col("line")), "description")
    lines = once(lines, F.lower("description"), "low")
    lines = once(lines, tx.note_kind(F.col("description"), F.col("low")), "node_type").where("fence OR node_type IS NOT NULL").drop("line", "low")
    own = Window.partitionBy("project_id", "path").orderBy("line_no")
    rows = lines.withColumn("fences", F.sum(F.col("fence").cast("int")).over(own)).where((F.col("fences") % 2 == 0) & ~F.col("fence"))
    rows = rows.withColumn("id", tx.stable_id(F.col("description")))
    first = F.row_number().over(Window.partitionBy("project_id", "id").orderBy("path", "line_no"))
    return rows.withColumn("copy", first).where("copy = 1").select("project_id", "id", "node_type", tx.label(F.col("description")).alias("label"), "description", "path", "line_no")


def load_gold(spark: SparkSession, path: str, sections: tuple[str, ...] = ("decisions", "questions", "assumptions", "evidence", "contradictions")) -> tuple[DataFrame, DataFrame]:
    """Gold files, one JSON object each, an array a section -> (items: section, id, label, who, status; relations: source, target, type, note).
    Items without an id or a label go, as do sections that a file lacks."""
    item = "array<struct<id:string,label:string,who:string,status:string>>"
    schema = ", ".join([*(f"{s} {item}" for s in sections), "key_relations array<struct<source:string,target:string,type:string,note:string>>"])
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    listed = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.col(s).alias("items")) for s in sections)))
    items = rows.select(listed.alias("s")).select("s.section", F.explode("s.items").alias("i")).select("section", "i.*").where("id IS NOT NULL AND label IS NOT NULL")
    return items, rows.select(F.explode("key_relations").alias("r")).select("r.*")


_RESULT = "struct<nodes:array<struct<id:string,node_type:string,label:string,description:string,confidence:double>>,edges:array<struct<edge_type:string,source_node_id:string,target_node_id:string,reasoning:string>>>"


def first_json(text: str | None) -> str | None:
    """The first balanced JSON object of a text; where the text ends too early, what is open is closed after the last whole element."""
    start = (text or "").find("{")
    if start < 0:
        return None
    decoder = json.JSONDecoder()
    try:
        return text[start : decoder.raw_decode(text, start)[1]]
    except ValueError:
        pass
    for end in range(len(text), start, -1):
        if text[end - 1] not in "}]":
            continue
        stack, inside, skip = [], False, False
        for c in text[start:end]:
            if skip:
                skip = False
            elif inside:
                skip, inside = c == "\\", c != '"'
            elif c == '"':
                inside = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
        closed = text[start:end] + "".join(reversed(stack))
        try:
            json.loads(closed)
            return closed
        except ValueError:
            continue
    return None


def load_raw_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch_id, body) -> (parsed: batch_id, r; quarantine: batch_id, body): tool input, tool arguments, else the text."""
    tool = F.get_json_object("body", "$.content[0].input")
    call = F.get_json_object("body", "$.choices[0].message.tool_calls[0].function.arguments")
    said = F.coalesce(F.get_json_object("body", "$.content[0].text"), F.get_json_object("body", "$.choices[0].message.content"), F.col("body"))

    @F.pandas_udf(T.StringType())
    def repaired(texts: pd.Series) -> pd.Series:
        return texts.map(first_json)

    rows = responses.withColumn("json", repaired(F.coalesce(tool, call, said))).withColumn("r", F.from_json("json", _RESULT))
    fine = F.coalesce(F.col("r.nodes").isNotNull() | F.col("r.edges").isNotNull(), F.lit(False))
    return rows.where(fine).select("batch_id", "r"), rows.where(~fine).select("batch_id", "body")
