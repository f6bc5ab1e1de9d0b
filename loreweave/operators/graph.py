"""Traversals keyed by question: frontier loops that end on an empty frontier, each hop written out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..staging import stage
from .scans import P, numbered

_KEY = ["question_id", P]


def _grow(seeds: DataFrame, steps: DataFrame, depth: int | None, keys: list[str]) -> DataFrame:
    """seeds (question_id, project_id, id) along steps (keys, at, next); depth None: until nothing is new."""
    seen = front = stage(seeds.select(*_KEY, "id").distinct(), "seeds")
    hop = 0
    while depth is None or hop < depth:
        new = front.withColumnRenamed("id", "at").join(steps, [*keys, "at"]).select(*_KEY, F.col("next").alias("id")).distinct()
        front = stage(new.join(seen, [*_KEY, "id"], "left_anti"), "hop")
        if front.isEmpty():
            break
        seen = seen.union(front)
        hop += 1
    return seen


def bfs_nodes(seeds: DataFrame, edges: DataFrame, depth: int = 3, cap: int = 10) -> DataFrame:
    """(question_id, project_id, id): nodes within depth hops of the seeds in either direction.

    All questions search at once: a node carries a bitmap of the questions that have seen it, 64 in a row, in place of a row for each, so that a hop
    joins and shuffles at most nodes x questions / 64 rows, summed by bit_or before the shuffle. A node goes on only with bits new to it.
    """
    seeds = stage(seeds.select(*_KEY, "id"), "first")
    steps = edges.select(P, F.col("source_node_id").alias("at"), F.col("target_node_id").alias("next"))
    steps = stage(steps.union(edges.select(P, "target_node_id", "source_node_id")).where("at <> next").distinct(), "steps")
    asked = seeds.select(*_KEY).distinct().select(P, F.col("question_id").alias("id"), F.lit(0).alias("seq"))
    asked = stage(numbered(asked, "number").select(P, F.col("id").alias("question_id"), "number"), "questions")
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(number % 64 AS INT))")
    first = seeds.select(*_KEY, "id").join(asked, _KEY).select(P, "id", F.floor(F.col("number") / 64).alias("word"), bit.alias("bits"))
    merged = lambda d: d.groupBy(P, "id", "word").agg(F.bit_or("bits").alias("bits"))
    seen = front = stage(merged(first), "seeds")
    for _ in range(min(depth, cap)):
        reached = merged(front.withColumnRenamed("id", "at").join(steps, [P, "at"]).select(P, F.col("next").alias("id"), "word", "bits"))
        both = reached.join(seen.withColumnRenamed("bits", "known"), [P, "id", "word"], "left")
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        front = stage(both.select(P, "id", "word", fresh.alias("bits")).where("bits <> 0"), "hop")
        if front.isEmpty():
            break
        seen = stage(merged(seen.union(front)), "seen")
    numbers = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)
    each = seen.select(P, "id", F.explode(F.transform(numbers, lambda k: F.col("word") * 64 + k)).alias("number"))
    return each.join(asked, [P, "number"]).select(*_KEY, "id")


def induced_edges(seen: DataFrame, edges: DataFrame) -> DataFrame:
    """(question_id, edge columns): edges with both ends among a question's nodes."""
    source = seen.withColumnRenamed("id", "source_node_id")
    target = seen.withColumnRenamed("id", "target_node_id")
    return edges.join(source, [P, "source_node_id"]).join(target, [*_KEY, "target_node_id"], "left_semi")


def reverse_trace_set(seeds: DataFrame, inside: DataFrame) -> DataFrame:
    """Nodes that reach a seed along the question's induced edges, the seeds included."""
    steps = inside.select(*_KEY, F.col("target_node_id").alias("at"), F.col("source_node_id").alias("next")).distinct()
    return _grow(seeds, steps, None, _KEY)


def reverse_trace_order(seeds: DataFrame, inside: DataFrame) -> DataFrame:
    """(question_id, project_id, id, place): depth-first visits against the edges, Supersedes first; seeds in rank order.

    The subgraph of a question is bounded by its seeds and depth; the walk itself is sequential.
    """
    order = {k: v[0] for k, v in schema.EDGE_TYPES.items()}
    rows = inside.select(*_KEY, F.col("target_node_id").alias("at"), F.col("source_node_id").alias("next"), "edge_type", F.col("seq").cast("long").alias("n"))
    rows = rows.unionByName(seeds.select(*_KEY, F.lit(None).cast("string").alias("at"), F.col("id").alias("next"), F.lit(None).cast("string").alias("edge_type"), F.col("rank").cast("long").alias("n")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        into: dict[str, list] = {}
        for at, nxt, kind, n in pdf[pdf["at"].notna()][["at", "next", "edge_type", "n"]].itertuples(index=False):
            into.setdefault(at, []).append((order[kind], n, nxt))
        visited: dict[str, int] = {}
        for seed in pdf[pdf["at"].isna()].sort_values("n")["next"]:
            stack = [seed]
            while stack:
                x = stack.pop()
                if x not in visited:
                    visited[x] = len(visited)
                    stack += [y for _, _, y in sorted(into.get(x, [])) if y not in visited]
        return pd.DataFrame({"question_id": pdf["question_id"].iloc[0], P: pdf[P].iloc[0], "id": list(visited), "place": list(visited.values())})

    kind = dict(seeds.dtypes)["question_id"]
    return rows.groupBy(*_KEY).applyInPandas(walk, f"question_id {kind}, project_id string, id string, place long")


def reasoning_chains(trace: DataFrame, inside: DataFrame, most: int = 5, longest: int = 6) -> DataFrame:
    """(question_id, project_id, chain_no, chain, verbs): greedy walks from the trace's roots, each step along the newest edge to a
    node of the trace that no walk has visited; those of two to six nodes, the first five. verbs: the edge type that led to each
    node, null for the first. A trace is short (the answer takes its first twelve), so a question's group is bounded."""
    ids = trace.select(*_KEY, "id", "place")
    kept = inside.join(ids.select(*_KEY, F.col("id").alias("source_node_id")), [*_KEY, "source_node_id"], "left_semi").join(
        ids.select(*_KEY, F.col("id").alias("target_node_id")), [*_KEY, "target_node_id"], "left_semi"
    )
    rows = ids.select(*_KEY, F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("place").alias("n"), F.lit(None).cast("string").alias("kind"))
    rows = rows.union(kept.select(*_KEY, "source_node_id", "target_node_id", F.col("seq").cast("long"), "edge_type"))

    def chains(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {}
        targets = set()
        for a, b, kind in pdf[pdf["b"].notna()].sort_values(["n", "b"], ascending=[False, True])[["a", "b", "kind"]].itertuples(index=False):
            out.setdefault(a, []).append((b, kind))
            targets.add(b)
        found, visited = [], set()
        for root in pdf[pdf["b"].isna()].sort_values("n")["a"]:
            if root in targets or root in visited:
                continue
            chain = [(root, None)]
            while chain[-1][0] not in visited:
                visited.add(chain[-1][0])
                step = next((x for x in out.get(chain[-1][0], []) if x[0] not in visited), None)
                if step is None:
                    break
                chain.append(step)
            if 2 <= len(chain) <= longest:
                found.append(chain)
        found = found[:most]
        chains, verbs = (pd.Series([[x[i] for x in c] for c in found], dtype=object) for i in (0, 1))  # an empty list of lists has no type of its own
        return pd.DataFrame({"question_id": pdf["question_id"].iloc[0], P: pdf[P].iloc[0], "chain_no": range(len(found)), "chain": chains, "verbs": verbs})

    kind = dict(trace.dtypes)["question_id"]
    return rows.groupBy(*_KEY).applyInPandas(chains, f"question_id {kind}, project_id string, chain_no long, chain array<string>, verbs array<string>")
