"""Extraction policy: sentences, judged nodes and edges, validation gates, grounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..staging import stage
from .scans import P, numbered


def sentence_table(events: DataFrame) -> DataFrame:
    """(project_id, event_id, idx, sentence) to be judged."""
    return events.select(P, F.col("id").alias("event_id"), "session_id", "agent_role", "end_time", "seq", F.posexplode(tx.sentences(F.col("text"))).alias("idx", "sentence"))


def judged_nodes(sentences: DataFrame, judgments: DataFrame, gate: float = 0.65) -> DataFrame:
    """Nodes of the judged sentences: no noise, at or above the gate, then one per normalized sentence and session batch."""
    rows = sentences.join(judgments, [P, "event_id", "idx"]).where(F.col("choice").isin("Decision", "Rule", "OpenItem") & (F.col("probability") >= gate))
    first = F.row_number().over(Window.partitionBy(P, "session_id", tx.normalized(F.col("sentence"))).orderBy("seq", "idx"))
    rows = rows.withColumn("copy", first).where("copy = 1")
    return rows.select(
        P, F.concat(F.lit(schema.JUDGED_ID), "event_id", F.lit("-s"), "idx").alias("id"), F.col("choice").alias("node_type"), tx.label(F.col("sentence")).alias("label"),
        tx.truncated(F.col("sentence"), 400).alias("description"), F.round(F.greatest(F.least("probability", F.lit(0.95)), F.lit(0.1)), 6).alias("confidence"),
        F.col("end_time").alias("timestamp"), "session_id", "seq",
    )


def lexical_judgments(sentences: DataFrame) -> DataFrame:
    """Stand-in judgments by the marker lists, so that the flow runs without a model."""
    low = F.lower("sentence")
    kind = F.when(low.contains("?"), "OpenItem").when(tx.has_any(low, schema.DECISION_MARKERS), "Decision").when(tx.has_any(low, schema.RULE_MARKERS), "Rule").otherwise("noise")
    return sentences.select(P, "event_id", "idx", kind.alias("choice"), F.lit(0.7).alias("probability"))


def dedup_mentions(nodes: DataFrame) -> DataFrame:
    """(project_id, text, mention_count): events that say the same."""
    return nodes.groupBy(P, tx.normalized(F.col("description")).alias("text")).agg(F.count("*").alias("mention_count"))


def candidate_pairs(fresh: DataFrame, known: DataFrame, least: int = 1, salt: int = 16) -> DataFrame:
    """(project_id, earlier_id, later_id, shared): pairs with enough shared content tokens, one of them fresh at least.

    Inverted index on tokens; the known side is copied to `salt` parts so that a frequent token is not one task.
    """
    tokens = lambda d, name: d.select(P, F.col("id").alias(name), F.col("timestamp").alias(f"{name}_t"), F.explode(tx.content_tokens(F.col("description"))).alias("token"))
    a = tokens(fresh, "a").withColumn("part", F.pmod(F.xxhash64("a"), F.lit(salt)).cast("int"))
    b = tokens(known.union(fresh), "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    pairs = a.join(b, [P, "token", "part"]).where("a <> b")
    early = F.struct(F.col("a_t").alias("t"), F.col("a").alias("i")) < F.struct(F.col("b_t").alias("t"), F.col("b").alias("i"))
    pairs = pairs.select(P, "token", F.when(early, F.col("a")).otherwise(F.col("b")).alias("earlier_id"), F.when(early, F.col("b")).otherwise(F.col("a")).alias("later_id")).distinct()
    return pairs.groupBy(P, "earlier_id", "later_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def judged_edges(judgments: DataFrame, nodes: DataFrame, gate: float = 0.7) -> DataFrame:
    """(project_id, earlier_id, later_id, choice, probability) -> edges, the first per source, target and type."""
    kind, forward = F.lit(None).cast("string"), F.lit(True)
    for choice, (edge_type, source, _) in schema.RELATIONS.items():
        kind = F.when(F.col("choice") == choice, edge_type).otherwise(kind)
        forward = F.when(F.col("choice") == choice, source == "later").otherwise(forward)
    rows = judgments.where(F.col("probability") >= gate).withColumn("edge_type", kind).where("edge_type IS NOT NULL")
    time = nodes.select(P, F.col("id"), "timestamp")
    rows = rows.join(time.select(P, F.col("id").alias("earlier_id"), F.col("timestamp").alias("t1")), [P, "earlier_id"]).join(time.select(P, F.col("id").alias("later_id"), F.col("timestamp").alias("t2")), [P, "later_id"])
    rows = rows.withColumn("source_node_id", F.when(forward, F.col("later_id")).otherwise(F.col("earlier_id"))).withColumn("target_node_id", F.when(forward, F.col("earlier_id")).otherwise(F.col("later_id")))
    one = F.row_number().over(Window.partitionBy(P, "source_node_id", "target_node_id", "edge_type").orderBy(F.col("probability").desc(), "choice"))
    reason = F.concat(F.lit(schema.JUDGED_REASON), "choice", F.format_string(" (p=%.2f)", "probability"))
    kept = rows.withColumn("copy", one).where("copy = 1")
    return kept.select(P, "edge_type", "source_node_id", "target_node_id", reason.alias("reasoning"), F.greatest("t1", "t2").alias("timestamp"), F.when(F.col("probability") >= 0.8, "EXTRACTED").otherwise("INFERRED").alias("provenance"))


def validate_nodes(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Confidence clamped to 0.1..0.95; the event must be in the batch."""
    kept = nodes.join(events.select(P, F.col("id").alias("event_id")), [P, "event_id"], "left_semi")
    return kept.withColumn("confidence", F.greatest(F.least("confidence", F.lit(0.95)), F.lit(0.1)))


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a reject_reason, null where they pass."""
    end = lambda c, name: nodes.select(P, F.col("id").alias(c), F.col("label").alias(name))
    rows = edges.join(end("source_node_id", "a"), [P, "source_node_id"], "left").join(end("target_node_id", "b"), [P, "target_node_id"], "left")
    text, a, b = F.trim("reasoning"), F.col("a"), F.col("b")
    echo = (F.octet_length(a) >= 3) & (F.octet_length(b) >= 3) & text.contains(a) & text.contains(b) & (F.octet_length(text) <= F.octet_length(a) + F.octet_length(b) + 10)
    reason = (
        F.when(F.col("source_node_id") == F.col("target_node_id"), "self edge").when(a.isNull() | b.isNull(), "unknown endpoint").when(F.octet_length(text) < 10, "short reasoning")
        .when((text == a) | (text == b), "reasoning is a label").when(echo, "reasoning repeats labels")
    )
    return rows.withColumn("reject_reason", reason).drop("a", "b")


def link_resolutions(links: DataFrame, fresh: DataFrame, open_items: DataFrame) -> DataFrame:
    """Proposed Resolves links from a fresh node to one of the open items."""
    kept = links.where("edge_type = 'Resolves'").join(fresh.select(P, F.col("id").alias("source_node_id")), [P, "source_node_id"], "left_semi")
    return kept.join(open_items.select(P, F.col("id").alias("target_node_id")), [P, "target_node_id"], "left_semi")


def grounding_queries(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    end = lambda c, name: nodes.select(P, F.col("id").alias(c), F.col("label").alias(name))
    rows = edges.join(end("source_node_id", "a"), [P, "source_node_id"], "left").join(end("target_node_id", "b"), [P, "target_node_id"], "left")
    unknown = F.lit("unknown")
    return rows.select(P, F.col("id").alias("edge_id"), F.concat_ws(" ", F.coalesce("a", unknown), "reasoning", F.coalesce("b", unknown), F.lit("evidence")).alias("query"))


def evidence_score(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """(edge_id, score): half relevance, half credibility per source; the best three weighted."""
    words = F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.octet_length(w) > 3))
    body = F.lower(F.concat_ws(" ", "title", "snippet"))
    rows = evidence.join(queries.select("edge_id", words.alias("words")), "edge_id").withColumn("body", body)
    hits = F.size(F.filter("words", lambda w: F.col("body").contains(w)))
    relevance = F.when(F.size("words") > 0, hits / F.size("words")).otherwise(0.5)
    rows = rows.withColumn("s", 0.5 * relevance + 0.5 * tx.domain_credibility(F.col("url")))
    place = F.row_number().over(Window.partitionBy("edge_id").orderBy(F.col("s").desc(), "url"))
    best = rows.withColumn("place", place).where("place <= 3").withColumn("n", F.count("*").over(Window.partitionBy("edge_id")))
    weight = F.when(F.col("n") == 1, 1.0).when(F.col("n") == 2, F.get(F.array(F.lit(0.6), F.lit(0.4)), F.col("place") - 1)).otherwise(F.get(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), F.col("place") - 1))
    return best.groupBy("edge_id").agg(F.round(F.sum(F.col("s") * weight), 6).alias("score"))


def clamp_provenance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between new nodes of one event count as EXTRACTED; reasons under 20 bytes make any edge AMBIGUOUS."""
    end = lambda c, name: nodes.select(P, F.col("id").alias(c), F.col("event_id").alias(name))
    rows = edges.join(end("source_node_id", "a"), [P, "source_node_id"], "left").join(end("target_node_id", "b"), [P, "target_node_id"], "left")
    short = F.octet_length(F.trim("reasoning")) < 20
    return rows.withColumn("provenance", F.when(short, "AMBIGUOUS").when(F.col("a") == F.col("b"), "EXTRACTED").otherwise(F.col("provenance"))).drop("a", "b")


def attribute_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project_id, batch, ...) edges and new nodes with their event's position -> edges with the position of the earliest
    event that owns an end, else of the batch's first event with a node; edges of batches without nodes go."""
    keys = [P, "batch"]
    end = lambda c, name: nodes.select(*keys, F.col("id").alias(c), F.col("position").alias(name))
    first = nodes.groupBy(*keys).agg(F.min("position").alias("first"))
    rows = edges.join(end("source_node_id", "a"), [*keys, "source_node_id"], "left").join(end("target_node_id", "b"), [*keys, "target_node_id"], "left")
    return rows.join(first, keys).withColumn("position", F.coalesce(F.least("a", "b"), "first")).drop("a", "b", "first")


def split_sentences_eval(text: Column, least: int = 6, most: int = 12) -> Column:
    """The first sentences of six words or more; line feeds count as spaces."""
    parts = F.transform(F.split(F.regexp_replace(text, "\n", " "), r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.slice(F.filter(parts, lambda s: F.size(F.split(s, r"\s+")) >= least), 1, most)


def _next_starts(at: np.ndarray, most: int, wait: float) -> np.ndarray:
    """For each event, how many events on the next batch would start if one started here."""
    out = np.full(len(at), most)
    for k in range(most - 1, 0, -1):
        out[:-k][at[k:] > at[:-k] + wait] = k
    return out


def _leaps(most: int, wait: float, block: int):
    """Rows of blocks in order, each with up to `most` rows of the next -> (project_id, block, leaps): for a batch that starts at each of the block's
    first rows, where in the next block the first batch starts and how many started here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (project, number), pdf in _blocks(batches):
            inside = int((pdf["place"] < (number + 1) * block).sum())
            step = _next_starts(pdf["at"].to_numpy(float), most, wait)
            to, count = np.zeros(inside, np.int64), np.zeros(inside, np.int64)
            for i in range(inside - 1, -1, -1):
                j = i + step[i]
                to[i], count[i] = (j - inside, 1) if j >= inside else (to[j], count[j] + 1)
            leaps = [{"to": int(to[i]), "n": int(count[i])} if i < inside else {"to": 0, "n": 0} for i in range(most)]
            yield pd.DataFrame({P: [project], "block": [number], "leaps": [leaps]})

    return run


def _walked(most: int, wait: float, block: int):
    """The same rows with the block's first start and the batches before it -> (project_id, id, seq, batch) of the block's own rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, number), pdf in _blocks(batches):
            inside = int((pdf["place"] < (number + 1) * block).sum())
            step = _next_starts(pdf["at"].to_numpy(float), most, wait)
            i, starts = int(pdf["to"].iloc[0]), np.zeros(inside, np.int64)
            while i < inside:
                starts[i] = 1
                i += step[i]
            own = pdf.iloc[:inside]
            yield own[[P, "id", "seq"]].assign(batch=int(pdf["n"].iloc[0]) - 1 + np.cumsum(starts))

    return run


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    key, held = None, []
    for pdf in batches:
        for own, rows in pdf.groupby([P, "block"], sort=False, dropna=False):
            if own != key and held:
                yield key, pd.concat(held)
                held = []
            key = own
            held.append(rows)
    if held:
        yield key, pd.concat(held)


def extraction_batches(events: DataFrame, most: int = 10, wait: float = 15.0, block: int = 50_000) -> DataFrame:
    """(project_id, id, seq, batch): a batch opens at its first event and closes when it has `most` events, or `wait` seconds after the first.
    Numbers start at 0 in each project.

    Where the next batch would start depends on the next `most` events alone, whichever batch an event is in. So a project's events are cut into
    blocks; each block tells, for every place at which its first batch could start, where the block after it would go on; these leaps are joined
    to ever longer ones in a logarithm of rounds, and then each block numbers its own events. No task holds more than a block.
    """
    if block < most:
        raise ValueError("a block must hold a batch")
    rows = numbered(events.select(P, "id", "seq", F.col("start_time").cast("double").alias("at")))
    own = F.floor(F.col("place") / block)
    first = (F.col("place") % block < most) & (own > 0)
    cut = stage(rows.withColumn("block", F.explode(F.when(first, F.array(own, own - 1)).otherwise(F.array(own)))), "blocks")
    ordered = lambda d: d.repartition(P, "block").sortWithinPartitions(P, "block", "place")
    leaps = stage(ordered(cut).mapInPandas(_leaps(most, wait, block), f"{P} string, block long, leaps array<struct<to:long,n:long>>"), "leaps")
    last, span = leaps.agg(F.max("block")).first()[0] or 0, 1
    while span <= last:  # after each round a leap is that of twice as many blocks, as far as there are
        before = leaps.select(P, (F.col("block") + span).alias("block"), F.col("leaps").alias("earlier"))
        on = F.transform("earlier", lambda x: F.struct(F.get("leaps", x["to"].cast("int"))["to"].alias("to"), (x["n"] + F.get("leaps", x["to"].cast("int"))["n"]).alias("n")))
        leaps = stage(leaps.join(before, [P, "block"], "left").select(P, "block", F.when(F.col("earlier").isNotNull(), on).otherwise(F.col("leaps")).alias("leaps")), "leaps")
        span *= 2
    starts = leaps.select(P, (F.col("block") + 1).alias("block"), F.get("leaps", F.lit(0)).alias("s")).select(P, "block", "s.*")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    given = cut.join(starts, [P, "block"], "left").select(*cut.columns, zero("to"), zero("n"))
    return ordered(given).mapInPandas(_walked(most, wait, block), f"{P} string, id string, seq long, batch long")
