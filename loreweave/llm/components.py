"""Connected components over an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage, unstage


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) long pairs -> (node, component): the smallest node id that each node reaches, itself included.

    Every round is a partial minimum per node and an equi-join, so a hub of any degree stays splittable,
    and every round is written to the shared folder; the round before it goes then. Null ends and self-loops are ignored.
    """
    pairs = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    pairs = stage(pairs, name)
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        done, pairs = pairs, stage(small.where("u <> v").distinct(), name)
        unstage(done)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    found.staged = pairs
    return found
