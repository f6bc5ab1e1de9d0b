"""Communities: weighted adjacency, local moving in rounds and levels, descriptors and cross links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import schema
from ..staging import stage, unstage
from .scans import P


def edge_weight(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, (_, weight, _) in schema.EDGE_TYPES.items():
        out = F.when(kind == name, F.lit(weight)).otherwise(out)
    return out


def community_adjacency(edges: DataFrame) -> DataFrame:
    """(project_id, a, b, weight) with a < b: no self-loops, parallel and opposite edges summed."""
    pairs = edges.where("source_node_id <> target_node_id")
    pairs = pairs.groupBy(P, F.least("source_node_id", "target_node_id").alias("a"), F.greatest("source_node_id", "target_node_id").alias("b"))
    return pairs.agg(F.sum(edge_weight(F.col("edge_type"))).alias("weight"))


def weighted_degree(adjacency: DataFrame) -> DataFrame:
    ends = adjacency.select(P, F.explode(F.array("a", "b")).alias("id"), "weight")
    return ends.groupBy(P, "id").agg(F.sum("weight").alias("k"))


def modularity(adjacency: DataFrame, assignment: DataFrame) -> DataFrame:
    """(project_id, modularity) of (project_id, id, community)."""
    side = lambda c: assignment.select(P, F.col("id").alias(c), F.col("community").alias(f"c{c}"))
    inside = adjacency.join(side("a"), [P, "a"]).join(side("b"), [P, "b"]).where("ca = cb").groupBy(P, F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    tot = weighted_degree(adjacency).join(assignment, [P, "id"]).groupBy(P, "community").agg(F.sum("k").alias("tot"))
    m = adjacency.groupBy(P).agg(F.sum("weight").alias("m"))
    part = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("tot") / (2 * F.col("m")), 2)
    return tot.join(inside, [P, "community"], "left").join(m, P).groupBy(P).agg(F.round(F.sum(part), 6).alias("modularity"))


def _local_moves(links: DataFrame, start: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """start (n, id, k, m, community, tot) after rounds of moves to the neighbouring community of the largest gain, and whether any was made. Nodes
    and communities go by their numbers n; links (a, b, weight) hold each pair once; tot is the sum of k in the community.

    A round makes the moves that are the best of both communities they touch, so that each gain is what it would be alone and modularity
    rises with every round; among equal gains a hash that changes with the round decides. The largest claim of all is always made, so a round
    without a move is one without a wish to move. A community takes part in one move at most, which gives its new total. One table is written a round.
    """
    both = stage(links.select(F.col("a").alias("n"), F.col("b").alias("other"), "weight").union(links.select("b", "a", "weight")), "neighbours")
    now, moved = start, False
    for i in range(rounds):
        near = both.join(now.select(F.col("n").alias("other"), F.col("community").alias("to"), F.col("tot").alias("tot_to")), "other")
        near = near.select("n", "to", "tot_to", "weight").repartition("n").groupBy("n", "to").agg(F.sum("weight").alias("w"), F.max("tot_to").alias("tot_to"))
        w_own = F.max(F.when(F.col("to") == F.col("community"), F.col("w"))).over(Window.partitionBy("n"))
        options = near.join(now, "n").withColumn("w_own", F.coalesce(w_own, F.lit(0.0))).where("to <> community")
        gain = 2 * F.col("m") * (F.col("w") - F.col("w_own")) + F.col("k") * (F.col("tot") - F.col("tot_to") - F.col("k"))  # times 2 m^2
        side = lambda c, tot: F.struct(F.col(c).alias("c"), tot.alias("tot"))
        sides = F.array(side("community", F.col("tot") - F.col("k")), side("to", F.col("tot_to") + F.col("k")))
        best = options.withColumn("gain", gain).where("gain > 0").groupBy("n").agg(F.max(F.struct("gain", "to", "id", sides.alias("sides"))).alias("b"))
        claim = F.struct(F.col("b.gain").alias("gain"), F.xxhash64("b.id", F.lit(i)).alias("draw"), F.col("n").alias("by"))
        claims = best.select("n", "b.to", "b.sides", claim.alias("claim"), F.explode("b.sides.c").alias("c"))
        firsts = claims.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("claim")))).where("place = 1")
        made = firsts.groupBy("n").agg(F.count("*").alias("won"), F.max("to").alias("to"), F.max("sides").alias("sides")).where("won = 2")
        grown = made.select(F.inline("sides").alias("community", "grown"))
        after = now.join(made.select("n", "to"), "n", "left").select("n", "id", "k", "m", F.coalesce("to", "community").alias("community"), "tot", "to")
        after = after.join(grown, "community", "left").select("n", "id", "k", "m", "community", F.coalesce("grown", "tot").alias("tot"), "to")
        moves = Observation()
        after = stage(after.observe(moves, F.count("to").alias("made")).drop("to"), "assignment")
        if not moves.get["made"]:
            unstage(after)
            break
        if moved:
            unstage(now)
        now, moved = after, True
    unstage(both)
    return now, moved


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = 60, cycles: int = 2) -> DataFrame:
    """(project_id, id, community): local moving from singletons, then of whole communities, level by level until none moves; then once more from
    the nodes. Communities are named by one of their nodes; a node without edges is its own. In rounds of moves that do not touch each other,
    the result is at least as modular as that of a walk over the nodes one by one (a test compares them).

    The rounds join on numbers that keep the order of the ids in all projects; ids come back at the end. Weights are whole thousandths, so that
    sums do not depend on their order and reruns agree."""
    adjacency = stage(community_adjacency(edges).withColumn("weight", F.round(F.col("weight") * 1000)), "adjacency")
    degree = stage(weighted_degree(adjacency).join(adjacency.groupBy(P).agg(F.sum("weight").alias("m")), P), "degree")
    named = stage(degree.repartitionByRange(P, "id").sortWithinPartitions(P, "id").withColumn("n", F.monotonically_increasing_id()), "named")
    number = lambda c: named.select(P, F.col("id").alias(c), F.col("n").alias(f"n{c}"))
    links = stage(adjacency.join(number("a"), [P, "a"]).join(number("b"), [P, "b"]).select(F.col("na").alias("a"), F.col("nb").alias("b"), "weight"), "links")
    unstage(adjacency, degree)
    found = named.select("n", "id", "k", "m", F.col("n").alias("community"), F.col("k").alias("tot"))
    for _ in range(cycles):
        found, moved = _local_moves(links, found, rounds)
        if not moved:
            break
        while True:
            side = lambda c: found.select(F.col("n").alias(c), F.col("community").alias(f"c{c}"))
            pairs = links.join(side("a"), "a").join(side("b"), "b").where("ca <> cb")
            between = stage(pairs.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")), "between")
            whole = found.groupBy("community").agg(F.sum("k").alias("k"), F.max("m").alias("m")).join(named.select(F.col("n").alias("community"), "id"), "community")
            whole = stage(whole.select(F.col("community").alias("n"), "id", "k", "m", "community", F.col("k").alias("tot")), "whole")
            merged, moved = _local_moves(between, whole, rounds)
            if not moved:
                unstage(between, whole)
                break
            up = merged.select(F.col("n").alias("community"), F.col("community").alias("up"), "tot")
            lifted = stage(found.drop("tot").join(up, "community").select("n", "id", "k", "m", F.col("up").alias("community"), "tot"), "assignment")
            unstage(between, whole, merged, found)
            found = lifted
    name = named.select(F.col("n").alias("community"), F.col("id").alias("name"))
    found = found.select("n", "community").join(named.select(P, "id", "n"), "n").join(name, "community").select(P, "id", F.col("name").alias("community"))
    rows = nodes.select(P, "id").distinct().join(found, [P, "id"], "left")
    return rows.select(P, "id", F.coalesce("community", "id").alias("community"))


def community_descriptors(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """(project_id, community, size, top_node_types, top_agents, session_distribution): node types and agents by count, sessions -> counts.
    The members are the rows of the assignment."""
    rows = nodes.join(assignment, [P, "id"])

    def ranked(column: str, name: str) -> DataFrame:
        n = rows.groupBy(P, "community", column).agg(F.count("*").alias("n"))
        listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(column).alias("v"), "n")))
        return n.groupBy(P, "community").agg(F.transform(listed, lambda x: F.concat_ws(":", x["v"], x["n"])).alias(name))

    out = rows.groupBy(P, "community").agg(F.count("*").alias("size"))
    sessions = rows.groupBy(P, "community", "session_id").agg(F.count("*").alias("n")).groupBy(P, "community").agg(F.map_from_entries(F.collect_list(F.struct("session_id", "n"))).alias("session_distribution"))
    return out.join(ranked("node_type", "top_node_types"), [P, "community"]).join(ranked("agent_id", "top_agents"), [P, "community"]).join(sessions, [P, "community"])


def community_label(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """The three most frequent label words of more than two bytes that are no stop words; ties by word."""
    kept = F.filter(F.split(F.lower("label"), r"\s+"), lambda w: (F.octet_length(w) > 2) & ~w.isin(schema.COMMUNITY_STOP))
    words = nodes.join(assignment, [P, "id"]).select(P, "community", F.explode(kept).alias("word"))
    counts = words.groupBy(P, "community", "word").agg(F.count("*").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy(P, "community").orderBy(F.col("n").desc(), "word"))).where("place <= 3")
    named = top.groupBy(P, "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " · ").alias("community_label"))
    every = assignment.select(P, "community").distinct()
    return every.join(named, [P, "community"], "left").select(P, "community", F.coalesce("community_label", F.concat(F.lit("Community "), "community")).alias("community_label"))


def surprising_connections(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges between communities: links between the pair over what their degrees would give."""
    adjacency = community_adjacency(edges)
    tot = weighted_degree(adjacency).join(assignment, [P, "id"]).groupBy(P, "community").agg(F.sum("k").alias("tot"))
    m = adjacency.groupBy(P).agg(F.sum("weight").alias("m"))
    side = lambda c, name: assignment.select(P, F.col("id").alias(c), F.col("community").alias(name))
    cross = edges.join(side("source_node_id", "cs"), [P, "source_node_id"]).join(side("target_node_id", "ct"), [P, "target_node_id"]).where("cs <> ct")
    cross = cross.select(P, "id", F.least("cs", "ct").alias("community_a"), F.greatest("cs", "ct").alias("community_b"))
    pairs = cross.groupBy(P, "community_a", "community_b").agg(F.count("*").alias("n"))
    pairs = pairs.join(tot.select(P, F.col("community").alias("community_a"), F.col("tot").alias("ta")), [P, "community_a"]).join(tot.select(P, F.col("community").alias("community_b"), F.col("tot").alias("tb")), [P, "community_b"]).join(m, P)
    value = F.col("n") / (F.col("ta") * F.col("tb") / (2 * F.col("m")))
    return cross.join(pairs.select(P, "community_a", "community_b", F.round(value, 6).alias("unexpectedness")), [P, "community_a", "community_b"])
