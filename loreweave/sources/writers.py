"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_training_jsonl(records: DataFrame, path: str) -> None:
    """Append model interactions (operation, duration, payload columns) as JSON lines, in a folder for each operation."""
    records.write.mode("append").partitionBy("operation").json(path)
