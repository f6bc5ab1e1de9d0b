"""Evaluation: matching, precision and recall, paired statistics, rollups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..staging import stage, unstage
from .scans import P, with_ends


def eval_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(schema.CONTENT_STOP)))


def match_gold(gold: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(section, id, label) against (section, id, label, description): greedy one-to-one in gold order, best score first (ties: the smaller id).

    In rounds of joins, no section in one task: a pair is settled when the found one is the best left for its gold and the gold is the first of those
    that could still have it; then both go. That is what the walk in gold order gives. Golds of equal words want the same, so the n-th of them
    starts at its n-th best. Each round settles the first gold left of every section at least.
    """
    tokens = lambda d, name, text: d.select("section", F.col("id").alias(name), eval_tokens(text).alias(f"{name}_t"))
    g = tokens(gold, "gold", F.col("label"))
    f = tokens(found, "found", F.col("label")).union(tokens(found, "found", F.concat_ws(" ", "label", "description")))
    hits = g.select("*", F.explode("gold_t").alias("t")).join(f.select("*", F.explode("found_t").alias("t")), ["section", "t"]).drop("t").distinct()
    scored = hits.groupBy("section", "gold", "found").agg(F.max(tx.containment(F.col("gold_t"), F.col("found_t"))).alias("score")).where(F.col("score") >= threshold)
    want = F.row_number().over(Window.partitionBy("section", "gold").orderBy(F.desc("score"), "found"))
    equal = g.select("section", "gold", (F.row_number().over(Window.partitionBy("section", F.array_sort("gold_t")).orderBy("gold"))).alias("place"))
    left = scored.withColumn("want", want).join(equal, ["section", "gold"]).where("want >= place").select("section", "gold", "found", "score")
    return settled(left)


def settled(pairs: DataFrame) -> DataFrame:
    """(section, gold, found, score) -> the pairs of the walk in gold order, each gold taking the best found one that is free."""
    left, done = stage(pairs, "pairs"), None
    while not left.isEmpty():
        best = left.groupBy("section", "gold").agg(F.min(F.struct((-F.col("score")).alias("o"), "found")).alias("b")).select("section", "gold", "b.found", (-F.col("b.o")).alias("score"))
        first = left.groupBy("section", "found").agg(F.min("gold").alias("gold"))
        taken = stage(best.join(first, ["section", "gold", "found"]), "taken")
        done = taken if done is None else done.union(taken)
        rest = left.join(taken.select("section", "gold"), ["section", "gold"], "left_anti").join(taken.select("section", "found"), ["section", "found"], "left_anti")
        after = stage(rest.select("section", "gold", "found", "score"), "pairs")
        unstage(left)
        left = after
    return (left if done is None else done).select("section", "gold", "found", "score")


#: The words of a set as marks among 128 places, in two numbers.
_MARKS = [f"aggregate(t, 0L, (x, w) -> x | if(pmod(xxhash64(w), 128) div 64 = {k}, shiftleft(1L, cast(pmod(xxhash64(w), 64) AS int)), 0L)) AS {name}" for k, name in enumerate(("low", "high"))]


def _pairs(asked: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(end_id, id, set) of pairs that may share the words the threshold asks of the smaller set, from (end_id, word, place, n, low, high) and (id, set, word,
    place, m, low, high), places by rarity: the smaller set then has a shared word among its rarest, all but the needed ones and one more, and no more marks
    that the other lacks than it may lack words."""
    spare = lambda size: F.col(size) - F.ceil(threshold * F.col(size) - 1e-9)
    first = lambda size: F.col("place") <= spare(size) + 1
    a = asked.select("end_id", "word", "n", first("n").alias("a_first"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    b = held.select("id", "set", "word", "m", first("m").alias("b_first"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    lacks = lambda x, y: sum(F.bit_count(F.col(f"{x}_{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{k}")))) for k in ("low", "high"))
    found = a.where("a_first").join(b, "word").where((F.col("m") >= F.col("n")) & (lacks("a", "b") <= spare("n"))).select("end_id", "id", "set")
    return found.union(a.join(b.where("b_first"), "word").where((F.col("m") < F.col("n")) & (lacks("b", "a") <= spare("m"))).select("end_id", "id", "set")).distinct()


def best_nodes(ends: DataFrame, nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(end_id, label) -> (end_id, id): the node whose label, or label and description, contains the end's words most, if enough of them;
    first inserted first among equals.

    Exact, without a row for each shared word: sets meet in their rarest words. First those of which one holds all of the other, as nothing scores
    higher; then the ends left, down to the threshold. Nodes of equal words are one, the first of them.
    """
    words = lambda text: F.array_sort(eval_tokens(text)).alias("t")
    asked = stage(ends.select("end_id", words(F.col("label"))).where("size(t) > 0").selectExpr("*", *_MARKS), "asked")
    found = nodes.select("id", "seq", words(F.col("label"))).union(nodes.select("id", "seq", words(F.concat_ws(" ", "label", "description"))))
    held = found.where("size(t) > 0").groupBy("t").agg(F.max(F.struct((-F.col("seq")).alias("o"), "id")).alias("first"))
    held = stage(held.select("first.id", "first.o", F.xxhash64("t").alias("set"), "t").selectExpr("*", *_MARKS), "held")
    rare = held.select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("df"))

    def ranked(rows: DataFrame, key: list[str], size: str) -> DataFrame:
        each = rows.select(*key, "low", "high", F.size("t").alias(size), F.explode("t").alias("word"))
        place = F.row_number().over(Window.partitionBy(*key).orderBy(F.coalesce("df", F.lit(0)), "word"))
        return each.join(rare, "word", "left").withColumn("place", place)

    asks, has = stage(ranked(asked, ["end_id"], "n"), "asks"), stage(ranked(held, ["id", "set"], "m"), "has")

    def best(asks: DataFrame, least: float) -> DataFrame:
        both = _pairs(asks, has, least).join(asked.select("end_id", F.col("t").alias("asked_t")), "end_id").join(held.select("id", "set", "o", "t"), ["id", "set"])
        scored = both.select("end_id", "id", "o", tx.containment(F.col("asked_t"), F.col("t")).alias("score")).where(F.col("score") >= least)
        return scored.groupBy("end_id").agg(F.max(F.struct("score", "o", "id")).alias("best")).select("end_id", "best.id")

    whole = stage(best(asks, 1.0), "whole")
    left = stage(asks.join(whole, "end_id", "left_anti"), "asks")
    return whole if threshold >= 1 or left.isEmpty() else whole.union(best(left, threshold))


def relation_prf(relations: DataFrame, nodes: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(relation_id, source_label, target_label, edge_type) against a graph -> gold, edges, tp, fp, fn, P, R, F1 (one row): a relation is found
    when the nodes that match its ends best are joined by an edge of its type; edges that no relation uses are false."""
    labels = relations.select(F.explode(F.array("source_label", "target_label")).alias("label")).distinct()
    best = stage(best_nodes(labels.select(F.col("label").alias("end_id"), "label"), nodes, threshold), "best")
    keys = edges.select("source_node_id", "target_node_id", "edge_type").distinct()
    end = lambda label, name: best.select(F.col("end_id").alias(label), F.col("id").alias(name))
    of = relations.select("source_label", "target_label", "edge_type")
    hits = of.join(end("source_label", "source_node_id"), "source_label").join(end("target_label", "target_node_id"), "target_label").join(keys, ["source_node_id", "target_node_id", "edge_type"], "left_semi")
    tp = hits.agg(F.count("*").alias("tp"), F.count_distinct("source_node_id", "target_node_id", "edge_type").alias("used"))
    counts = tp.crossJoin(relations.agg(F.count("*").alias("gold"))).crossJoin(keys.agg(F.count("*").alias("n_edges")))
    counts = counts.withColumn("fp", F.col("n_edges") - F.col("used")).withColumn("fn", F.col("gold") - F.col("tp"))
    return counts.select("gold", "n_edges", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return [F.round(x, 3).alias(n) for x, n in ((p, "p"), (r, "r"), (f1, "f1"))]


def prf_report(judged: DataFrame) -> DataFrame:
    """(section, gold, predicted: booleans) -> tp, fp, fn, P, R, F1 per section and overall."""
    count = lambda c: F.count(F.when(c, 1))
    g, p = F.col("gold"), F.col("predicted")
    sums = judged.rollup("section").agg(count(g & p).alias("tp"), count(~g & p).alias("fp"), count(g & ~p).alias("fn"))
    return sums.select(F.coalesce("section", F.lit("overall")).alias("section"), "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_curve(scored: DataFrame, gates: list[float]) -> DataFrame:
    """(gold boolean, probability) -> F1 at each gate, one aggregation."""
    rows = scored.withColumn("gate", F.explode(F.array(*(F.lit(float(g)) for g in gates))))
    p = F.col("probability") >= F.col("gate")
    count = lambda c: F.count(F.when(c, 1))
    sums = rows.groupBy("gate").agg(count(F.col("gold") & p).alias("tp"), count(~F.col("gold") & p).alias("fp"), count(F.col("gold") & ~p).alias("fn"))
    return sums.select("gate", prf(F.col("tp"), F.col("fp"), F.col("fn"))[2])


def paired_study(arms: DataFrame) -> DataFrame:
    """(pair, a, b: booleans) -> rates, mean delta and discordant counts."""
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    return arms.agg(
        F.count("*").alias("pairs"), F.round(F.avg(a), 6).alias("rate_a"), F.round(F.avg(b), 6).alias("rate_b"), F.round(F.avg(a - b), 6).alias("mean_delta"),
        F.count(F.when(a > b, 1)).alias("a_only"), F.count(F.when(a < b, 1)).alias("b_only"),
    )


def bootstrap_ci(deltas: DataFrame, replicates: int = 10_000, seed: int = 7, bucket_values: int = 50_000) -> DataFrame:
    """(delta) -> 2.5 and 97.5 percentiles of the resampled mean, and the number of deltas.

    A resample of all rows is a multinomial draw of how often each comes up. Equal deltas are one value that comes up in proportion to
    its rows; values are dealt to buckets, the draw is made between the buckets and then inside each, which is the same draw, and the
    buckets' sums are added.
    """
    values = deltas.where("delta IS NOT NULL").groupBy("delta").agg(F.count("*").alias("n"))
    buckets = max(1, -(-values.count() // bucket_values))
    values = values.withColumn("bucket", F.pmod(F.xxhash64("delta"), F.lit(buckets)).cast("int"))
    sizes = {r.bucket: r.n for r in values.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    names, total = sorted(sizes), sum(sizes.values())

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        own, sums = names.index(int(pdf["bucket"].iloc[0])), []
        pdf = pdf.sort_values("delta")
        share, delta = (pdf["n"] / pdf["n"].sum()).to_numpy(float), pdf["delta"].to_numpy(float)
        for replicate in range(replicates):
            between = np.random.default_rng([seed, replicate]).multinomial(total, [sizes[b] / total for b in names])
            inside = np.random.default_rng([seed, replicate, 1 + names[own]]).multinomial(between[own], share)
            sums.append(float(inside @ delta))
        return pd.DataFrame({"replicate": range(replicates), "part": sums})

    means = values.groupBy("bucket").applyInPandas(draw, "replicate int, part double").groupBy("replicate").agg((F.sum("part") / F.lit(max(1, total))).alias("mean"))
    return means.agg(F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.975), 6).alias("high"), F.lit(total).cast("long").alias("total"))


def sign_test(counts: DataFrame) -> DataFrame:
    """(a_only, b_only) -> exact two-sided binomial p."""

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: int, y: int) -> float:
            n = x + y
            if not n:
                return 1.0
            log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
            return min(1.0, 2 * sum(math.exp(log(k)) for k in range(min(x, y) + 1)))

        return pd.Series([one(int(x), int(y)) for x, y in zip(a, b)])

    return counts.select("*", F.round(p_value("a_only", "b_only"), 6).alias("p"))


def verdict_policy(nodes: DataFrame, verdicts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project_id, id, grounded, choice, confidence) over nodes -> (kept nodes with action, edges between kept nodes)."""
    rows = nodes.join(verdicts.select(P, "id", "grounded", "choice", F.col("confidence").alias("sure")), [P, "id"], "left")
    sure = F.col("sure") >= 0.8
    action = (
        F.when(F.col("grounded") < 0.3, "drop").when((F.col("choice") == "noise") & sure, "drop").when((F.col("choice") != F.col("node_type")) & (F.col("choice") != "noise") & sure, "relabel")
        .when(F.col("choice") != F.col("node_type"), "report").otherwise("keep")
    )
    kept = rows.withColumn("action", action).where("action <> 'drop'").withColumn("node_type", F.when(F.col("action") == "relabel", F.col("choice")).otherwise(F.col("node_type")))
    return kept, with_ends(edges, kept)


def assumption_sweep(scored: DataFrame, gate: float = 0.6, most: int = 3) -> DataFrame:
    """(project_id, event_id, idx, noul): the best sentences of each event."""
    place = F.row_number().over(Window.partitionBy(P, "event_id").orderBy(F.col("noul").desc(), "idx"))
    return scored.where(F.col("noul") >= gate).withColumn("place", place).where(F.col("place") <= most)


def scan_stats(judged: DataFrame, gate: float = 0.65) -> DataFrame:
    kept = (F.col("choice") != "noise") & (F.col("probability") >= gate)
    count = lambda c: F.count(F.when(c, 1))
    return judged.groupBy(P).agg(F.count("*").alias("sentences"), count(kept).alias("kept"), count(F.col("choice") == "noise").alias("noise"), count((F.col("choice") != "noise") & ~kept).alias("below"))


def pipeline_metrics(tool_events: DataFrame, prose: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = [(tool_events, "tool_events"), (prose, "prose_events"), (nodes, "nodes"), (edges, "edges")]
    rows = None
    for d, name in kinds:
        part = d.groupBy(P).agg(F.count("*").alias("n")).withColumn("metric", F.lit(name))
        rows = part if rows is None else rows.union(part)
    return rows.select(P, "metric", "n")


def usage_meter(bodies: DataFrame) -> DataFrame:
    """(body: JSON) in either response shape -> total input and output tokens."""
    pick = lambda *paths: F.coalesce(*(F.get_json_object("body", p).cast("long") for p in paths), F.lit(0))
    return bodies.agg(F.sum(pick("$.usage.input_tokens", "$.usage.prompt_tokens")).alias("input_tokens"), F.sum(pick("$.usage.output_tokens", "$.usage.completion_tokens")).alias("output_tokens"))


def timeline_layout(nodes: DataFrame, buckets: int = 40) -> DataFrame:
    """x in 0..1 by time, lane by type, offsets 0, -1, +1, -2, ... inside a bucket."""
    bounds = nodes.groupBy(P).agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
    x = (F.col("timestamp") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    rows = nodes.join(bounds, P).withColumn("x", F.round(x, 6)).withColumn("bucket", F.floor(F.col("x") * buckets))
    k = F.row_number().over(Window.partitionBy(P, "node_type", "bucket").orderBy("seq", "id")) - 1
    rows = rows.withColumn("k", k)
    offset = F.when(F.col("k") % 2 == 1, -((F.col("k") + 1) / 2)).otherwise(F.col("k") / 2)
    lane = F.when(F.col("node_type") == "Decision", 0).when(F.col("node_type") == "Rule", 1).otherwise(2)
    return rows.select(P, "id", "session_id", "x", lane.alias("lane"), offset.cast("int").alias("offset"))


def session_bands(layout: DataFrame) -> DataFrame:
    return layout.groupBy(P, "session_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"))


def org_rollup(nodes: DataFrame) -> DataFrame:
    """Counts per project and session, per project, and overall."""
    return nodes.rollup(P, "session_id").agg(F.count("*").alias("n_nodes"), F.count(F.when(F.col("node_type") == "Decision", 1)).alias("n_decisions"), F.count(F.when(F.col("status") == "Invalidated", 1)).alias("n_invalidated"))
