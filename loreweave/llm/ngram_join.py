"""N-gram Jaccard join by T-occurrence search.

The search itself is DivideSkip: inside a block of documents the short inverted lists of a query, each in order, are merged
by a sort that joins ordered runs, and counted; the long ones are probed by binary search for what the merge left, and documents
that reach the overlap which the Jaccard threshold requires are linked. A query that one probe of the largest group so far
ties to all documents in reach is not searched.

Blocks are found exactly and without pairs. Two sets that meet the threshold share an element of their
prefixes of rarest shingles (by_rarity); or else, as they differ in at most d elements,
all but d of the ranges of the hash space hold the same elements in both: a document's ranges are its
signatures, and documents that share one fall into the same candidate cluster. d depends on a size class; a set also
signs for larger classes which it could still reach. A cluster above block_docs or block_shingles is split into hashed blocks:
each block holds the cluster's pivot, and documents that the pivot's component leaves out are searched against
all other blocks (by_rarity splits it before by how many of its sets hold a shingle), so no link is lost and no group has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .rarest import split_clusters
from .scratch import least_by_key, slices, stage, trim, unstage
from .words import MIX, ODD, mixed, word_hashes

BUCKETS = 1 << 16


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, 0, 4 << 20):
        texts = [t for t in batch.column(0).cast(pa.binary()).to_pylist() if t]
        h, _ = word_hashes(b"\n".join(texts).lower())
        total += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])


def word_rarity(docs: DataFrame) -> np.ndarray:
    """Weight (bits of the count, at most 31) of each of 65,536 hash buckets of words, counted over all documents.
    The table is what is broadcast; words that share a bucket only change the order of shingles, never a result."""
    counts = docs.select("text").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    weights = np.zeros(BUCKETS, np.uint8)
    weights[counts["bucket"].to_numpy(np.int64)] = np.minimum(31, np.ceil(np.log2(counts["n"].to_numpy(np.float64) + 1)))
    return weights


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; fewer words: the whole sequence as one."""
    return np.unique(_shingles(_text_words(text), words))


def _text_words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass").lower())[0]


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    k = min(words, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = mixed(acc + h[j : n - k + 1 + j])
    return acc


def rare_prefix(text: str | None, words: int, num: int, den: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's set and its prefix in order of rarity; sets linked at num/den have a shingle of both prefixes in common."""
    h = _text_words(text)
    s, at = np.unique(_shingles(h, words), return_index=True)
    n, k = len(s), min(words, len(h))
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(weights[h & np.uint64(BUCKETS - 1)], dtype=np.int64)])
    order = np.argsort(sums[at + k] - sums[at], kind="stable")  # ties by value
    return s, s[order[: n - -(-num * n // den) + 1]] if n else s


@lru_cache(maxsize=None)
def _classes(num: int, den: int) -> np.ndarray:
    """Lower ends of the size classes, each half as large again as the one before."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * 3 // 2))
    return np.array(ends, dtype=np.int64)


@lru_cache(maxsize=256)
def _cuts(top: int, num: int, den: int) -> tuple[int, np.ndarray]:
    """For sets of at most top elements: d, the most elements that two linked ones differ in, and the lower ends of
    d + 3 ranges of the hash space."""
    d = 2 * top * (den - num) // (den + num)
    return d, np.array([(j << 64) // (d + 3) for j in range(d + 3)], dtype=np.uint64)


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """One hash per range and size class; sets linked at num/den share at least one.

    Of d + 3 ranges at least 3 are the same in both sets. If all of those are empty, both sets fill d ranges at
    most; only such sets sign for their empty ranges.
    """
    n = len(s)
    if not n:
        return np.empty(0, np.uint64)
    ends = _classes(num, den)
    c = int(np.searchsorted(ends, n, "right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s), dtype=np.uint64)])
    out = []
    while c == 0 or ends[c] <= n or den * n >= num * int(ends[c]):
        d, cuts = _cuts(int(ends[c + 1]) - 1, num, den)
        at = np.append(np.searchsorted(s, cuts), n)
        full = np.flatnonzero(at[1:] > at[:-1])
        kept = full if len(full) > d else np.arange(len(cuts))
        held = sums[at[kept + 1]] - sums[at[kept]]
        out.append(mixed(held + kept.astype(np.uint64) * MIX + np.array([c + 1], np.uint64) * ODD))
        c += 1
    return np.concatenate(out)


def _signed(words: int, num: int, den: int, sent: Broadcast | None):
    """Arrow batches of (doc_id, text) -> a row each: set size, digest, signatures it is first to hold in its
    batch, and the documents of the batch that hold its other signatures already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            ids = batch.column(0)
            keys = ids.to_numpy(zero_copy_only=False) if not ids.null_count else np.array([x or 0 for x in ids.to_pylist()])
            keys, live = keys.astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False)
            sizes, digests, signs = [], [], []
            for text, ok in zip(batch.column(1), live):
                if sent is None:
                    s = shingle_set(text.as_py(), words)
                    own = signatures(s, num, den)
                else:
                    s, own = rare_prefix(text.as_py(), words, num, den, sent.value)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signs.append(own if ok else np.empty(0, np.uint64))
            held = np.repeat(np.arange(len(signs)), [len(x) for x in signs])
            flat = np.concatenate([*signs, np.empty(0, np.uint64)])
            _, first, back = np.unique(flat, return_index=True, return_inverse=True)
            owner = held[first]
            mine = np.zeros(len(flat), bool)
            mine[first] = True
            counts = np.bincount(held[mine], minlength=len(signs))
            links = np.unique(np.stack([held, owner[back]], 1)[keys[held] != keys[owner[back]]], axis=0)
            link_counts = np.bincount(links[:, 0], minlength=len(signs)) if len(links) else np.zeros(len(signs), int)
            offsets = lambda c: pa.array(np.concatenate([[0], np.cumsum(c)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(offsets(counts), pa.array(flat[mine].view(np.int64))),
                    pa.ListArray.from_arrays(offsets(link_counts), pa.array(keys[links[:, 1]] if len(links) else np.empty(0, np.int64))),
                ],
                ["doc_id", "n_shingles", "digest", "signs", "roots"],
            )

    return run


def _sets(words: int):
    """Arrow batches of candidates with their texts -> the same rows with the set instead; rows whose text is
    not the one that the digest names (another row under the same id) go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            sets = [shingle_set(t.as_py(), words).tobytes() for t in batch.column("text")]
            keep = [xxhash.xxh3_128_digest(s) == d.as_py() for s, d in zip(sets, batch.column("digest"))]
            names = [x for x in batch.schema.names if x not in ("text", "digest")]
            out = pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sets, pa.binary())], [*names, "grams"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


class _Index:
    """Inverted lists over the sets of one block, documents in ascending order of size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.grams, self.start, self.length = np.unique(flat[order], return_index=True, return_counts=True)
        self.keys = np.repeat(np.arange(len(self.grams)), self.length) * len(sets) + self.owner  # sorted: list by list
        self.docs = len(sets)

    def search(self, s: np.ndarray, num: int, den: int, low: int, high: int, skip: np.ndarray) -> np.ndarray:
        """Documents low..high-1 linked with s by DivideSkip; those where skip holds are left out."""
        at = np.searchsorted(self.grams, s)
        at = at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == s)] if len(self.grams) else at[:0]
        if not len(at) or low >= high:
            return np.empty(0, np.int64)
        need = -(-num * (len(s) + int(self.sizes[low])) // (num + den))  # overlap with the smallest document in reach
        if len(at) < need:
            return np.empty(0, np.int64)
        at = at[np.argsort(self.length[at], kind="stable")]
        longest = int(self.length[at[-1]])
        n_long = min(need - 1, int(need / (0.0085 * np.log2(longest + 1) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        merged = np.concatenate([self.owner[self.start[x] : self.start[x] + self.length[x]] for x in short])
        merged = np.sort(merged[(merged >= low) & (merged < high) & ~skip[merged]], kind="stable")  # merges the runs
        ends = np.flatnonzero(np.append(merged[1:] != merged[:-1], True)) if len(merged) else merged
        found, count = merged[ends], np.diff(ends, prepend=-1)
        near = count >= need - n_long
        found, count = found[near], count[near]
        if not len(found):
            return found
        if n_long:
            probes = (long[None, :] * self.docs + found[:, None]).ravel()
            where = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            count = count + (self.keys[where] == probes).reshape(len(found), n_long).sum(1)
        return found[(num + den) * count >= num * (len(s) + self.sizes[found])]


def link_block(ids: list[int], sets: list[np.ndarray], queries: list[bool] | None, num: int, den: int) -> np.ndarray:
    """Smallest id in the component of each document of one block. queries: search only these, against the rest."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    asks = np.array([bool(queries and queries[i]) for i in order])
    index = _Index([sets[i] for i in order])
    part = np.arange(len(order))
    members = np.ones(len(order), np.int64)
    hub = 0  # a document of the largest part

    def tie(q: int, x: int) -> None:
        nonlocal hub
        if part[x] != part[q]:
            members[part[q]] += members[part[x]]
            part[part == part[x]] = part[q]
            if members[part[q]] > members[part[hub]]:
                hub = q

    for q in range(len(order)) if queries is None else np.flatnonzero(asks):
        own = sets[order[q]]
        n = int(index.sizes[q])
        low = int(np.searchsorted(index.sizes, -(-num * n // den)))
        high = q if queries is None else int(np.searchsorted(index.sizes, den * n // num, "right"))
        if low <= hub < high and not asks[hub]:
            other = sets[order[hub]]
            both = int(np.isin(own, other, assume_unique=True).sum()) if own is not other else n
            if (num + den) * both >= num * (n + len(other)):
                tie(q, hub)
        done = (part == part[q]) | asks
        if not done[low:high].all():
            for x in index.search(own, num, den, low, high, done):
                tie(q, x)
    keys = np.array([ids[i] for i in order], np.int64)
    least = np.full(len(order), np.iinfo(np.int64).max)
    np.minimum.at(least, part, keys)
    out = np.empty(len(order), np.int64)
    out[order] = least[part]
    return out


_KEYS = ("cluster", "block", "chunk")
_GRAMS = 5  # the place of the sets among the columns that _search sends


def _linked(num: int, den: int):
    """Arrow batches sorted by (cluster, block, chunk) -> (cluster, blocks, block, doc_id, root) of each set."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        ids, grams = table.column("doc_id").to_numpy(), table.column("grams")
        rows = sorted({(d, xxhash.xxh3_128_digest(g.as_buffer())): i for i, (d, g) in enumerate(zip(ids.tolist(), grams))}.values())
        sets = [np.frombuffer(grams[i].as_buffer(), np.uint64) for i in rows]
        asks = table.column("asks").to_numpy()[rows]
        roots = link_block(ids[rows].tolist(), sets, asks.tolist() if asks.any() else None, num, den)
        kept = table.select(["cluster", "blocks", "block", "doc_id"]).take(pa.array(rows))
        return kept.append_column("root", pa.array(roots)).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done: list[pa.RecordBatch] = []
        for batch in slices(batches, _GRAMS, 4 << 20):
            keys = np.stack([batch.column(k).to_numpy() for k in _KEYS])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
            for low, high in zip(cuts, [*cuts[1:], batch.num_rows]):
                if held and any(held[-1].column(k)[0].as_py() != int(x) for k, x in zip(_KEYS, keys[:, low])):
                    done.append(flush(pa.Table.from_batches(held)))
                    held = []
                held.append(batch.slice(low, high - low))
            if sum(b.num_rows for b in done) > 4096:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if held:
            done.append(flush(pa.Table.from_batches(held)))
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        trim()

    return run


def ngram_components(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, block_docs: int = 2048,
    block_shingles: int = 1 << 20, by_rarity: bool = False,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when den * |A and B| >= num * |A or B|.

    Words are runs of `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a set holds the distinct `words`-grams, or
    the whole sequence where the text is shorter. component_id is the smallest id reachable by links.
    Null and empty texts: an empty set, linked with nothing. Null ids: a row with a null component. Repeated
    rows: one row each, ids that occur twice are one node. Ties do not matter: components are unique. An empty
    table gives no rows; other columns are ignored. Shingles are compared by 64-bit hashes.
    by_rarity: find blocks by prefixes of the rarest shingles, for one more pass over the texts, instead of by hash
    ranges; the result is the same, and low thresholds bring fewer unlike documents together.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold num / den must lie in (0, 1]")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(word_rarity(docs)) if by_rarity else None
    signed = stage(
        docs.mapInArrow(_signed(words, num, den, sent), "doc_id long, n_shingles long, digest binary, signs array<long>, roots array<long>"), "signed"
    )
    held = signed.select("doc_id", F.explode("signs").alias("sign"))
    edges, firsts = least_by_key(held, "sign", "doc_id", "sign-firsts")
    clusters = connected_components(edges.union(signed.select("doc_id", F.explode("roots"))), "clusters")
    unstage(*firsts)
    named = clusters.withColumnsRenamed({"node": "doc_id", "component": "cluster"})
    every = stage(signed.select("doc_id", "n_shingles", "digest").join(named, "doc_id", "left"), "members")
    unstage(signed, clusters.staged)

    # Equal sets are one document from here on.
    members = every.where("digest IS NOT NULL AND cluster IS NOT NULL")
    reps = members.groupBy("cluster", "digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    reps = _in_blocks(reps, block_docs, block_shingles)
    sets = stage(
        docs.join(reps.hint("shuffle_hash"), "doc_id").mapInArrow(_sets(words), "doc_id long, cluster long, n long, blocks long, is_pivot boolean, block long, grams binary"),
        "sets",
    )
    if by_rarity:
        wide = sets.where("blocks > 1")
        if not wide.isEmpty():
            parts = split_clusters(wide.select(F.col("doc_id").alias("key"), "grams"), num, den, halves=True)
            split = _in_blocks(wide.select("doc_id", "n", "grams").join(parts.withColumnRenamed("key", "doc_id"), "doc_id"), block_docs, block_shingles)
            before, sets = sets, stage(sets.where("blocks = 1").union(split.select(*sets.columns)), "parts")
            unstage(before, parts.staged)
    plain = sets.select("cluster", "blocks", "block", F.lit(0).cast("long").alias("chunk"), "doc_id", "grams", F.lit(False).alias("asks"), "is_pivot")
    pivots = plain.where("is_pivot AND blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    blocks = plain.where("NOT (is_pivot AND blocks > 1)").union(pivots)
    linked = stage(_search(blocks, num, den), "linked")
    roots = linked.where("blocks = 1").select("doc_id", "root")
    wide = linked.where("blocks > 1")
    if not wide.isEmpty():
        roots = roots.union(_across(wide, plain.where("blocks > 1"), num, den, block_docs))
    found = members.join(
        members.groupBy("cluster", "digest").agg(F.min("doc_id").alias("rep")), ["cluster", "digest"]
    ).join(roots.select(F.col("doc_id").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    # An id that stands for several texts joins their components.
    found = stage(found.distinct(), "roots")
    unstage(sets)
    several = found.groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    ties = found.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("root").alias("b"))
    found = found.groupBy("doc_id").agg(F.min("root").alias("root"))
    if not ties.isEmpty():
        joined = connected_components(ties, "ties").withColumnsRenamed({"node": "root", "component": "least"})
        found = found.join(joined, "root", "left").select("doc_id", F.coalesce("least", "root").alias("root"))
    return every.select("doc_id", "n_shingles").join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _in_blocks(reps: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """(doc_id, n, cluster, ...) of clusters of several sets, with the number of the cluster's blocks, the set's block and
    whether it is the pivot's."""
    blocks = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles))
    sizes = reps.groupBy("cluster").agg(F.count("*").alias("m"), F.min("doc_id").alias("pivot"), blocks.alias("blocks")).where("m > 1")
    reps = reps.join(sizes, "cluster").withColumn("is_pivot", F.col("doc_id") == F.col("pivot"))
    return reps.drop("m", "pivot").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))


def _search(blocks: DataFrame, num: int, den: int) -> DataFrame:
    rows = blocks.select("cluster", "blocks", "block", "chunk", "doc_id", "grams", "asks").repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return rows.mapInArrow(_linked(num, den), "cluster long, blocks long, block long, doc_id long, root long")


def _across(wide: DataFrame, sets: DataFrame, num: int, den: int, block_docs: int) -> DataFrame:
    """Components of clusters that have several blocks: the pivot ties the blocks together, and what its component
    leaves out is searched against every other block, in chunks."""
    pivots = sets.where("is_pivot").select("cluster", F.col("doc_id").alias("pivot"))
    own = wide.join(pivots, "cluster").where("doc_id = pivot").select("cluster", "block", F.col("root").alias("pivot_root"))
    out = wide.join(own, ["cluster", "block"]).where("root <> pivot_root").select("cluster", "doc_id")
    chunks = out.groupBy("cluster").agg(F.ceil(F.count("*") / block_docs).alias("chunks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    asks = (
        sets.join(out, ["cluster", "doc_id"]).join(chunks, "cluster").withColumn("home", F.col("block")).withColumn("block", F.explode(every))
        .where("block <> home").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(7)), "chunks")).withColumn("asks", F.lit(True))
    )
    rest = sets.join(chunks, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    found = _search(asks.select(*sets.columns).union(rest.select(*sets.columns)), num, den)
    edges = wide.select(F.col("doc_id").alias("a"), F.col("root").alias("b")).union(found.select("doc_id", "root"))
    every_doc = wide.select("doc_id").distinct()
    done = connected_components(edges).withColumnsRenamed({"node": "doc_id", "component": "root"})
    return every_doc.join(done, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))
