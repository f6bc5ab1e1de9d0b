"""Helpers of this subpackage: staged tables and bounded Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import new_path, shared_dir, stage, unstage

__all__ = ["by_hot_key", "hot_keys", "least_by_key", "new_path", "over_keys", "shared_dir", "slices", "stage", "trim", "unstage"]


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text column holds about limit bytes at most, one row at least. Freed memory goes
    back to the system, as Python workers live on between tasks."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        start, held = 0, 0
        for i, text in enumerate(batch.column(column)):
            size = len(text.as_buffer()) if text.is_valid else 0
            if held + size > limit and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
    trim()


def trim() -> None:
    """Give freed memory back; a C library without this call keeps it."""
    if hasattr(library := ctypes.CDLL(None), "malloc_trim"):
        library.malloc_trim(0)


def by_hot_key(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """The inner join of rows with a staged table of distinct keys, which counts the rows of each. Keys with more than a thousandth of all
    counted rows, a thousand at most, are broadcast, so that no task gets all rows of such a key; the rest is shuffled."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(count) > total / 1000))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(count) <= total / 1000), key)
    return rows.join(hot, key).unionByName(rest)


def hot_keys(rows: DataFrame, key: str, name: str) -> DataFrame | None:
    """(key) of at most a thousand keys that most of a sample's rows have, staged; None without any. rows: the whole or a sample of it. Which keys
    these are decides only how a key is summed, never what comes out."""
    found = stage(rows.groupBy(key).count().where("count >= 20").orderBy(F.desc("count")).limit(1000).select(key), name)
    if found.isEmpty():
        unstage(found)
        return None
    return found


def over_keys(rows: DataFrame, key: str, total: Column, name: str, hot: DataFrame | None) -> DataFrame:
    """rows with an aggregate over their key as another column: a window, and for the hot keys, which would be one task each, sums where the
    rows lie that are sent back to them."""
    if hot is None:
        return rows.withColumn(name, total.over(Window.partitionBy(key)))
    hot = F.broadcast(hot)
    few = rows.join(hot, key).groupBy(key).agg(total.alias(name))
    rest = rows.join(hot, key, "left_anti").withColumn(name, total.over(Window.partitionBy(key)))
    return rest.unionByName(rows.join(F.broadcast(few), key).select(*rest.columns))


def least_by_key(rows: DataFrame, key: str, value: str, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """((a: a value, b: the least value of its key), the staged tables behind it)."""
    hot = hot_keys(rows.sample(0.02, seed=1), key, name)
    found = over_keys(rows.select(key, value), key, F.min(value), "__least", hot)
    return found.select(F.col(value).alias("a"), F.col("__least").alias("b")), [] if hot is None else [hot]
