"""A stored BM25 index: postings in blocks with the best that a block can give, in segments that take changes, and a search that ends early.

A segment holds what one commit changed: the nodes with their words (which also take old words back), blocks of postings of one term with
like term frequency, and signed counts of documents per term. A posting counts while its segment is the node's latest. For a question, a few
blocks that promise most give a score that its n-th answer reaches at least. A node with a posting in a block whose best, with the best
of the question's other terms and the highest degree, stays below that score is no answer, so such blocks are left out. Terms too weak to bring
an answer by themselves are read only where nodes of the other terms can lie. What is left scores every possible answer exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage, unstage, write
from .retrieval import B, DEGREE, K1, _asked, _tokens, _top, best_in_part, node_degree, whole
from .scans import P

_NODES = f"{P} string, id string, terms array<struct<term:string,tf:long>>, length long, alive boolean, segment long"
_BLOCKS = f"{P} string, term string, class int, splits int, split int, n long, max_tf long, min_length long, entries array<struct<id:string,tf:long>>, segment long"
_TERMS = f"{P} string, term string, df long, segment long"
_BLOCK = [P, "term", "class", "splits", "split", "segment"]


def _split(splits: Column, id: Column | str = "id") -> Column:
    """Which of so many parts a node is in, a power of two; a part of fewer holds whole parts of more."""
    return F.floor(F.pmod(F.xxhash64(id), F.lit(1 << 30)) * splits / (1 << 30)).cast("int")


def _splits(n: Column, size: int) -> Column:
    """The power of two that leaves at most about size of n in a part."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n / size, F.lit(1.0))))).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(project_id, id, tokens) -> (project_id, id, terms, length): each word once, with its count."""
    for batch in batches:
        tokens = batch.column("tokens")
        words, length = tokens.flatten().dictionary_encode(), pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        kinds = max(1, len(words.dictionary))
        pair, tf = np.unique(np.repeat(np.arange(batch.num_rows), length) * kinds + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        counts = pa.StructArray.from_arrays([words.dictionary.take(pa.array(pair % kinds)), pa.array(tf.astype(np.int64))], ["term", "tf"])
        terms = pa.ListArray.from_arrays(pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * kinds), pa.int32()), counts)
        yield pa.RecordBatch.from_arrays([batch.column(P), batch.column("id"), terms, pa.array(length)], [P, "id", "terms", "length"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of their blocks' hashes -> a row a block."""

    def turns(batch: pa.RecordBatch, *columns: str) -> np.ndarray:
        found = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            found |= pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        return found

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        if (turns(batch, *_BLOCK[:3], "split") & ~turns(batch, "block")).any():  # two blocks of one hash
            batch = batch.take(pc.sort_indices(batch, [(c, "ascending") for c in ("block", *_BLOCK[:5])]))
        first = np.append(0, np.flatnonzero(turns(batch, "block", *_BLOCK[:3], "split")) + 1)
        heads, tf, length = batch.take(pa.array(first)), batch.column("tf"), batch.column("length")
        bounds = np.append(first, batch.num_rows)
        entries = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([batch.column("id"), tf], ["id", "tf"]))
        sums = [np.diff(bounds).astype(np.int64), np.maximum.reduceat(tf.to_numpy(), first), np.minimum.reduceat(length.to_numpy(), first)]
        return pa.RecordBatch.from_arrays([*(heads.column(c) for c in _BLOCK[:5]), *map(pa.array, sums), entries], [*_BLOCK[:5], "n", "max_tf", "min_length", "entries"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        ends = np.flatnonzero(turns(held, "block")) + 1
        if len(ends):
            yield rows(held.slice(0, ends[-1]))
            held = held.slice(ends[-1])
    if held is not None:
        yield rows(held)


def _scored_part(n: int):
    """(nodes of a part, blocks of postings with the questions that ask for them) -> each question's n best of the part."""

    def run(key: tuple, nodes: pa.Table, blocks: pa.Table) -> pa.Table:
        nodes = nodes.take(pc.sort_indices(nodes["id"]))
        ids, asks, entries = whole(nodes["id"]), whole(blocks["asks"]), whole(blocks["entries"])
        asked, postings, size = asks.flatten(), entries.flatten(), pc.list_value_length(entries).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(ids) or not len(asked):
            none = asked.field("question_id").slice(0, 0)
            return pa.table([none, pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], ["question_id", P, "id", "score"])
        place = pc.index_in(postings.field("id"), ids).fill_null(-1).to_numpy().astype(np.int64)
        # A posting counts while its segment is the node's latest.
        fine = (place >= 0) & (whole(nodes["segment"]).to_numpy()[place] == np.repeat(whole(blocks["segment"]).to_numpy(), size))
        tf, length, mean = postings.field("tf").to_numpy(), whole(nodes["length"]).to_numpy()[place], blocks["mean"][0].as_py()
        gain = np.where(fine, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)), 0.0)
        row = np.repeat(np.arange(len(asks)), pc.list_value_length(asks).to_numpy(zero_copy_only=False))
        question, at, score = best_in_part(
            asked.field("question_id"), row, asked.field("weight").to_numpy(), np.cumsum(size) - size, size, np.where(fine, place, 0), gain, whole(nodes["degree"]).to_numpy(), n
        )
        return pa.table([question, pa.array([key[0].as_py()] * len(at), pa.string()), ids.take(pa.array(at)), pa.array(score)], ["question_id", P, "id", "score"])

    return run


class Bm25Store:
    """An index (project_id, id, label, description, seq) in a folder that driver and executors share.

    Commits have rising numbers and appear with one rename; one at or below the last changes nothing. A node that is committed again replaces what was there, a
    removed one goes. Ids are unique in a commit (the row of the largest seq counts). Blocks hold about `block` postings; a term that most
    nodes have is dealt to blocks by hash, not gathered.
    """

    def __init__(self, spark: SparkSession, path: str, block: int = 128):
        self.spark, self.path, self.block = spark, path.rstrip("/"), block
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _folders(self) -> tuple[list[str], list[str]]:
        """(folders in effect, in order; folders that a base took in). A base, named like 12-base, stands for all segments up to its number."""
        at = self._at(f"{self.path}/segments")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        keys = sorted((int(x.removesuffix("-base")), x.endswith("-base"), x) for x in names)
        base = max((k[:2] for k in keys if k[1]), default=(-1, False))
        return [k[2] for k in keys if k[:2] >= base], [k[2] for k in keys if k[:2] < base]

    def segments(self) -> list[int]:
        return [int(x.removesuffix("-base")) for x in self._folders()[0]]

    def _read(self, table: str, schema: str) -> DataFrame:
        found = [f"{self.path}/segments/{name}/{table}" for name in self._folders()[0]]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _live(self) -> DataFrame:
        """The latest row of every node that is there."""
        rows = self._read("nodes", _NODES)
        last = rows.groupBy(P, "id").agg(F.max("segment").alias("segment"))
        return rows.join(last, [P, "id", "segment"], "left_semi").where("alive")

    def commit(self, number: int, changed: DataFrame, removed: DataFrame | None = None) -> bool:
        """Whether it was new."""
        have = self.segments()
        if number in have or (have and number < have[-1]):
            return False
        aside = self._written(number, changed, removed)
        self._fs.mkdirs(self._at(f"{self.path}/segments"))
        final = self._at(f"{self.path}/segments/{number}")
        if self._fs.exists(final) or not self._fs.rename(self._at(aside), final):
            self._fs.delete(self._at(aside), True)
            return False
        return True

    def _written(self, number: int, changed: DataFrame, removed: DataFrame | None) -> str:
        """A segment in a folder aside."""
        mark = F.lit(number).cast("long").alias("segment")
        latest = changed.select(P, "id", "seq", "label", "description").withColumn("place", F.row_number().over(Window.partitionBy(P, "id").orderBy(F.desc("seq")))).where("place = 1")
        counted = _tokens(latest).select(P, "id", "tokens").mapInArrow(_counted, f"{P} string, id string, terms array<struct<term:string,tf:long>>, length long")
        none = F.array().cast("array<struct<term:string,tf:long>>")
        fresh = counted.select("*", F.lit(True).alias("alive"), mark)
        if removed is not None:
            gone = removed.select(P, "id").distinct().join(changed.select(P, "id"), [P, "id"], "left_anti")
            fresh = fresh.union(gone.select(P, "id", none, F.lit(0).cast("long"), F.lit(False), mark))
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        write(fresh, f"{aside}/nodes")
        fresh = self.spark.read.schema(_NODES).parquet(f"{aside}/nodes")
        old = self._live().join(fresh.select(P, "id"), [P, "id"], "left_semi")
        signed = fresh.select(P, F.explode("terms.term").alias("term"), F.lit(1).alias("s")).union(old.select(P, F.explode("terms.term"), F.lit(-1)))
        signed.groupBy(P, "term").agg(F.sum("s").cast("long").alias("df")).where("df <> 0").select("*", mark).write.parquet(f"{aside}/terms")
        each = fresh.select(P, "id", "length", F.explode("terms").alias("t")).select(P, "id", "length", "t.*")
        each = each.withColumn("class", (4 * F.floor(F.log2(F.col("tf") + F.lit(0.0))) + F.least(F.floor(F.log2(F.col("length") + F.lit(0.0)) / 3), F.lit(3))).cast("int"))
        sizes = each.groupBy(P, "term", "class").agg(F.count("*").alias("n")).where(F.col("n") > self.block)
        sizes = stage(sizes.select(P, "term", "class", _splits(F.col("n"), self.block).alias("splits")), "sizes")
        dealt = each.join(sizes, [P, "term", "class"], "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
        dealt = dealt.withColumn("split", _split(F.col("splits"))).withColumn("block", F.xxhash64(P, "term", "class", "split"))
        dealt = dealt.select("block", *_BLOCK[:5], "id", "tf", "length").repartition("block").sortWithinPartitions("block")
        write(dealt.mapInArrow(_gathered, _BLOCKS.removesuffix(", segment long")).select("*", mark), f"{aside}/blocks")
        unstage(sizes)
        return aside

    def topk(self, questions: DataFrame, edges: DataFrame, n: int = 5, first_blocks: int = 8, part_rows: int = 16_384, part_questions: int = 4096) -> tuple[DataFrame, DataFrame]:
        """((question_id, project_id, id, score, rank) as bm25_topk() gives, (question_id, project_id, postings, scored): how many postings the question's
        terms have and how many were scored)."""
        live = stage(self._live().select(P, "id", "length", "segment"), "live")
        asked = stage(_asked(questions), "asked")
        totals = live.groupBy(P).agg(F.count("*").alias("n_nodes"), F.sum("length").alias("total"))
        degree = stage(node_degree(live, edges), "degree")
        top_degree = degree.groupBy(P).agg(F.max("degree").alias("top_degree"))
        wanted = asked.select(P, "term").distinct()
        df = self._read("terms", _TERMS).join(wanted, [P, "term"], "left_semi").groupBy(P, "term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.ln((F.col("n_nodes") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        mean = F.greatest(F.col("total") / F.col("n_nodes"), F.lit(1.0))
        gain = lambda tf, length: F.col("weight") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("mean")))
        weights = asked.join(df, [P, "term"]).join(totals, P).select("question_id", P, "term", (F.col("times") * idf).alias("weight"), mean.alias("mean"))
        weights = stage(weights, "weights")
        blocks = self._read("blocks", _BLOCKS).join(wanted, [P, "term"], "left_semi")
        promised = stage(blocks.drop("entries").join(weights, [P, "term"]).withColumn("best", gain(F.col("max_tf"), F.col("min_length"))), "promised")

        def best(parts: DataFrame) -> DataFrame:
            return _top(parts.groupBy("question_id", P, "id").agg(F.max("score").alias("score")).withColumn("score", F.round("score", 6)), n)

        def scored(some: DataFrame) -> DataFrame:
            hits = some.select("question_id", *_BLOCK, "weight", "mean").join(blocks.select(*_BLOCK, "entries"), _BLOCK)
            hits = hits.select("question_id", P, "segment", "weight", "mean", F.explode("entries").alias("e")).select("question_id", P, "segment", "weight", "mean", "e.*")
            fine = hits.join(live, [P, "id", "segment"])
            return fine.groupBy("question_id", P, "id").agg(F.sum(gain(F.col("tf"), F.col("length"))).alias("part"))

        place = F.row_number().over(Window.partitionBy("question_id", P).orderBy(F.desc("best"), *_BLOCK[1:]))
        firsts = stage(promised.withColumn("place", place).where(F.col("place") <= first_blocks), "firsts")
        reached = best(scored(firsts).join(degree, [P, "id"]).withColumn("score", F.col("part") + DEGREE * F.col("degree")))
        bar = reached.where(F.col("rank") == n).select("question_id", P, F.col("score").alias("bar"))
        most = promised.groupBy("question_id", P, "term").agg(F.max("best").alias("of_term"))
        whole = most.groupBy("question_id", P).agg(F.sum("of_term").alias("of_all"))
        # A question's least terms that together stay below the bar bring no answer of their own.
        together = F.sum("of_term").over(Window.partitionBy("question_id", P).orderBy("of_term", "term"))
        terms = most.withColumn("together", together).join(whole, ["question_id", P]).join(top_degree, P).join(bar, ["question_id", P], "left")
        reachable = lambda c: F.col("bar").isNull() | (c + DEGREE * F.col("top_degree") >= F.col("bar") - 1e-6)
        rows = promised.join(terms.withColumn("leads", reachable(F.col("together"))), ["question_id", P, "term"])
        rows = stage(rows.withColumn("kept", F.col("leads") & reachable(F.col("best") + F.col("of_all") - F.col("of_term"))), "bounds")
        # Of those terms only the blocks that may hold a node of the other terms' blocks are of use: nearly all, where these have four nodes a part.
        few = rows.groupBy("question_id", P).agg(F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("led"), F.max(F.when(~F.col("leads"), F.col("splits"))).alias("most"))
        few = stage(few.where("led < 4 * most").select("question_id", P), "few")
        leading = rows.where("kept").join(few, ["question_id", P], "left_semi").select("question_id", *_BLOCK).join(blocks.select(*_BLOCK, "entries"), _BLOCK)
        nodes = leading.select("question_id", P, F.explode("entries.id").alias("id")).distinct()
        sizes = rows.where("NOT leads").select("question_id", P, "splits").distinct()
        parts = nodes.join(sizes, ["question_id", P]).select("question_id", P, "splits", _split(F.col("splits")).alias("split")).distinct()
        follow = rows.where("NOT leads").drop("kept").join(parts.withColumn("kept", F.lit(True)), ["question_id", P, "splits", "split"], "left")
        follow = follow.join(few.withColumn("few", F.lit(True)), ["question_id", P], "left").withColumn("kept", F.col("few").isNull() | F.coalesce("kept", F.lit(False))).drop("few")
        before, rows = rows, stage(rows.where("leads").unionByName(follow), "kept")
        unstage(before)
        hubs = degree.withColumn("place", F.row_number().over(Window.partitionBy(P).orderBy(F.desc("degree"), "id"))).where(F.col("place") <= n)
        spare = asked.select("question_id", P).distinct().join(hubs, P).select("question_id", P, "id", (DEGREE * F.col("degree")).alias("score"))
        # Nodes are dealt to parts, and to each the blocks of it with the questions that ask for them (beyond part_questions, copies of the parts).
        groups = asked.groupBy(P).agg(F.ceil(F.approx_count_distinct("question_id") / part_questions).cast("int").alias("groups"))
        sizes = stage(totals.join(groups, P).select(P, "groups", _splits(F.col("n_nodes"), part_rows).alias("parts")), "sizes")
        copies = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("copy")
        held = degree.join(live, [P, "id"]).join(sizes, P).select(P, _split(F.col("parts")).alias("part"), copies, "id", "length", "degree", "segment")
        asks = rows.where("kept").join(sizes, P).withColumn("copy", F.pmod(F.xxhash64("question_id"), "groups").cast("int"))
        asks = asks.groupBy(*_BLOCK, "copy", "parts").agg(F.first("mean").alias("mean"), F.collect_list(F.struct("question_id", "weight")).alias("asks"))
        low, high = F.floor(F.col("split") * F.col("parts") / F.col("splits")).cast("int"), (F.col("split") + 1) * F.col("parts") / F.col("splits") - 1
        wide = asks.join(blocks.select(*_BLOCK, "entries"), _BLOCK).withColumn("part", F.explode(F.sequence(low, F.greatest(low, high.cast("int")))))
        inside = F.filter("entries", lambda e: _split(F.col("parts"), e["id"]) == F.col("part"))
        wide = wide.withColumn("entries", F.when(F.col("splits") >= F.col("parts"), F.col("entries")).otherwise(inside)).where(F.size("entries") > 0).select(P, "part", "copy", "segment", "mean", "asks", "entries")
        keys = [P, "part", "copy"]
        near = held.groupBy(*keys).cogroup(wide.groupBy(*keys)).applyInArrow(_scored_part(n), f"question_id {dict(asked.dtypes)['question_id']}, {P} string, id string, score double")
        found = stage(best(near.unionByName(spare)), "answers")
        counts = rows.groupBy("question_id", P).agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("scored"))
        counts = stage(counts, "counts")
        unstage(live, asked, degree, weights, promised, firsts, few, sizes, rows)
        return found, counts

    def compact(self) -> None:
        """Write all segments as one base, in effect with one rename, and remove what the base before it took in: a search that began before this
        compaction can end."""
        have, gone = self._folders()
        if len(have) < 2:
            return
        number = int(have[-1].removesuffix("-base"))
        words = F.flatten(F.transform("terms", lambda t: F.array_repeat(t["term"], t["tf"].cast("int"))))
        # Stored words are cut already: joined by spaces they come out of the tokenizer as they are.
        rows = self._live().select(P, "id", F.array_join(words, " ").alias("label"), F.lit(None).cast("string").alias("description"), F.col("segment").alias("seq"))
        empty = Bm25Store(self.spark, f"{self.path}/aside/{uuid.uuid4().hex}", self.block)
        self._fs.rename(self._at(empty._written(number, rows, None)), self._at(f"{self.path}/segments/{number}-base"))
        for name in gone:
            self._fs.delete(self._at(f"{self.path}/segments/{name}"), True)
