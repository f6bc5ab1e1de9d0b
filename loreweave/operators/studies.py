"""Observations of paired studies: formats of files, stated choices, flips between versions, banned patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import P


def sniff_record_format(text: Column, record: str) -> Column:
    """'json' for a JSON array, 'lines' where every line that isn't blank matches `record`, else null; null and blank texts: null."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    array = F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY")
    every = (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(record))
    return F.when(F.trim(text) == "", None).when(array, "json").when(every, "lines")


def stated_choice(turns: DataFrame, json_marks: list[str], line_marks: list[str]) -> DataFrame:
    """(session_id, turn, role, text) -> (session_id, choice): what the last two assistant turns mention; both, or null for none."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("turn").desc()))
    last = turns.where("role = 'assistant'").withColumn("place", place).where("place <= 2").withColumn("low", F.lower("text"))
    has = lambda marks: F.max(F.exists(F.array(*map(F.lit, marks)), lambda m: F.col("low").contains(m)))
    said = last.groupBy("session_id").agg(has(json_marks).alias("j"), has(line_marks).alias("l"))
    return said.select("session_id", F.when(F.col("j") & F.col("l"), "both").when(F.col("j"), "json").when(F.col("l"), "lines").alias("choice"))


def consistency_verdict(seen: DataFrame) -> DataFrame:
    """(pair, format1, format2, export_format, choice1, choice2) -> cross and in-session verdicts; stated choices stand in
    for formats where one is unknown and both choices are clear."""
    same = lambda a, b: F.when(F.col(a) == F.col(b), "PASS").otherwise("FAIL")
    known = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    clear = F.col("choice1").isin("json", "lines") & F.col("choice2").isin("json", "lines")
    cross = F.when(known("format1", "format2"), same("format1", "format2")).when(clear, same("choice1", "choice2")).otherwise("UNCLEAR")
    inner = F.when(known("format2", "export_format"), same("format2", "export_format")).otherwise("UNCLEAR")
    rows = seen.select("pair", cross.alias("cross_session"), inner.alias("in_session"))
    return rows.withColumn("consistent", (F.col("cross_session") == "PASS") & (F.col("in_session") == "PASS"))


def decision_flips(earlier: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """(project_id, path, text) twice -> (project_id, path, key, before, after): keys declared as `key: value` with another value later."""
    def declared(files: DataFrame, name: str) -> DataFrame:
        values = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lower(F.regexp_extract("text", rf"(?im)\b{k}\s*[:=]\s*([\w.-]+)", 1)).alias(name)) for k in keys)))
        return files.select(P, "path", values.alias("d")).select(P, "path", "d.*").where(F.col(name) != "")

    return declared(earlier, "before").join(declared(later, "after"), [P, "path", "key"]).where("before <> after")


def forbidden_pattern_scan(earlier: DataFrame, later: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(project_id, path, text) twice -> (project_id, path, rule): later files that match a banned pattern which they did not match before."""
    def hits(files: DataFrame) -> DataFrame:
        found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(name)) for name, p in patterns.items())))
        return files.select(P, "path", F.explode(found).alias("rule"))

    return hits(later).join(hits(earlier), [P, "path", "rule"], "left_anti").distinct()
