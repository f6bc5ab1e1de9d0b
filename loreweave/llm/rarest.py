"""Splits candidate clusters by prefixes in the order of how many sets hold an element."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import slices


def _elements(num: int, den: int, halves: bool):
    """(key, grams) -> a row for each counted element, and for those outside that complete a prefix (rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            keys, names, slacks, rests, grams = [], [], [], [], []
            for key, own in zip(batch.column(0).to_numpy(), batch.column(1)):
                raw = own.as_buffer()
                s = np.frombuffer(raw, np.uint64)
                prefix = len(s) - -(-num * len(s) // den) + 1
                counted = int(np.searchsorted(s, np.uint64(1 << 63))) if halves else len(s)
                s = s[: max(counted, prefix)]
                keys.append(np.full(len(s), key))
                names.append(np.full(len(s), np.uint64(xxhash.xxh3_64_intdigest(raw))))
                slacks.append(np.full(len(s), prefix - counted, np.int32))
                rests.append(np.arange(len(s)) >= counted)
                grams.append(s)
            if keys:
                columns = [np.concatenate(keys), np.concatenate(names).view(np.int64), np.concatenate(slacks), np.concatenate(rests), np.concatenate(grams).view(np.int64)]
                out = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "name", "slack", "rest", "gram"])
                for i in range(0, out.num_rows, 1 << 16):
                    yield out.slice(i, 1 << 16)

    return run


def split_clusters(sets: DataFrame, num: int, den: int, halves: bool = False) -> DataFrame:
    """(key long, grams: sorted 64-bit elements) -> (key, cluster) of the sets that can meet the threshold with another.

    Elements are ordered by the number of the given sets that hold them, then by value. Sets linked at num/den have an
    element of both prefixes in common, so a set whose prefix nobody shares goes, and passages that many sets hold
    tie together only those of which they make the most. halves: count elements of the lower half of the hash space
    only; the others come after them in the order, by value. A key may stand for several sets.
    """
    rows = sets.mapInArrow(_elements(num, den, halves), "key long, name long, slack int, rest boolean, gram long")
    held = rows.withColumn("n", F.when(F.col("rest"), 0).otherwise(F.count("*").over(Window.partitionBy("gram")))).where("rest OR n > 1")
    listed = F.sort_array(F.collect_list(F.struct("rest", "n", "gram")))
    firsts = held.groupBy("key", "name").agg(listed.alias("held"), F.max("slack").alias("slack"), F.count_if(~F.col("rest")).alias("shared"))
    take = (F.col("slack") + F.col("shared")).cast("int")
    signs = firsts.where(take > 0).select("key", F.explode(F.slice("held", 1, take)).alias("sign")).select("key", "sign.gram")
    edges = signs.select(F.col("key").alias("a"), F.min("key").over(Window.partitionBy("gram")).alias("b"))
    found = connected_components(edges, "split")
    named = found.withColumnsRenamed({"node": "key", "component": "cluster"})
    named.staged = found.staged
    return named
