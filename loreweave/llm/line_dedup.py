"""Line dedup as an exact set-similarity join: later lines that match an earlier one are removed.

A line is the set of its 5-word shingles (a shorter one, of its whole word sequence). Equal sets are collapsed to their first place. Shingles are ordered by
rarity, the sum of their words' rarities: counts over all documents by hash bucket, a table of fixed size. Lines that meet the threshold share a shingle of their
prefixes in that order; lines that share one fall into the same candidate cluster. Inside a block of lines the join
is PPJoin: tokens ordered by rarity in the block, an inverted index on prefixes, length and positional filters, then
the Jaccard similarity itself. Clusters above block_lines are first split by prefixes in the order of how many of
their lines hold a shingle; those still above it, into hashed blocks that all hold the cluster's
first line; lines still without a match are then searched against the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .ngram_join import BUCKETS, word_rarity
from .rarest import split_clusters
from .scratch import by_hot_key, slices, stage, trim, unstage
from .words import ODD, mixed, word_hashes

SHINGLE = 5
_LINES = 4096


def _line_grams(text: bytes, weights: np.ndarray | None, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line of each distinct shingle, shingle, True for lines that take part) of a lower-cased text; in each line
    rarest first, or by value where no weights are given. With short, a line of one to four words has one shingle, its
    whole word sequence."""
    h, starts = word_hashes(text)
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    line_of = np.searchsorted(ends, starts)
    n_lines = len(ends) + 1
    lengths = np.bincount(line_of, minlength=n_lines)
    n = max(0, len(h) - SHINGLE + 1)
    whole = np.flatnonzero(line_of[:n] == line_of[SHINGLE - 1 :]) if n else np.zeros(0, np.int64)
    grams = np.zeros(len(whole), np.uint64)
    for j in range(SHINGLE):
        grams = mixed(grams + h[whole + j])
    few = np.flatnonzero((lengths > 0) & (lengths < SHINGLE)) if short else np.zeros(0, np.int64)
    begin, n_few = (np.cumsum(lengths) - lengths)[few], lengths[few]
    alone = n_few.astype(np.uint64)
    for j in range(SHINGLE - 1):
        more = n_few > j
        alone[more] = mixed(alone[more] + h[begin[more] + j])
    line_of = line_of[whole]
    key = grams >> np.uint64(28)
    if weights is not None:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights[(h & np.uint64(BUCKETS - 1)).astype(np.int64)], dtype=np.uint64)])
        key |= (sums[whole + SHINGLE] - sums[whole]) << np.uint64(36)
    grams, line_of, key = np.concatenate([grams, alone]), np.concatenate([line_of, few]), np.concatenate([key, alone >> np.uint64(28)])
    if n_lines < 1 << 20:
        order = np.argsort(key | (line_of.astype(np.uint64) << np.uint64(44)))
    else:
        order = np.lexsort((key, line_of))
    grams, line_of, key = grams[order], line_of[order], key[order]
    alike = np.flatnonzero((key[1:] == key[:-1]) & (line_of[1:] == line_of[:-1]) & (grams[1:] != grams[:-1])) if len(key) else key
    if len(alike):  # different shingles with the same upper bits: by the whole value
        order = np.lexsort((grams, key, line_of))
        grams, line_of = grams[order], line_of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (line_of[1:] != line_of[:-1])
    return line_of[new], grams[new], lengths >= (1 if short else SHINGLE)


def _prefixes(line_of: np.ndarray, n_lines: int, num: int, den: int) -> np.ndarray:
    """True for the shingles of each line's prefix."""
    sizes = np.bincount(line_of, minlength=n_lines)
    place = np.arange(len(line_of)) - np.concatenate([[0], np.cumsum(sizes)[:-1]])[line_of]
    return place < (sizes + (-num * sizes // den) + 1)[line_of]


_SIGNED = "doc_id long, lines array<long>, node long, signs array<long>, roots array<long>"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("lines", pa.list_(pa.int64())), ("node", pa.int64()), ("signs", pa.list_(pa.int64())), ("roots", pa.list_(pa.int64()))])


def _line_nodes(line_of: np.ndarray, grams: np.ndarray, n_lines: int) -> np.ndarray:
    """A 64-bit hash of each line's set; lines without a shingle: 0."""
    nodes = np.zeros(n_lines, np.uint64)
    if len(grams):
        first = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]]))
        nodes[line_of[first]] = mixed(np.add.reduceat(mixed(grams ^ ODD), first)) | np.uint64(1)
    return nodes


def _signed(num: int, den: int, sent: Broadcast, short: bool):
    """(doc_id, text) -> a row a document with its lines' nodes (null where a line takes no part), and a row for
    each line set that is new in the batch: the shingles of its prefix which it is first to hold there, and the sets
    of the batch that hold the others already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            lines = [0 if t is None else t.count(b"\n") + 1 for t in texts]
            line_of, grams, live = _line_grams(b"\n".join(t for t in texts if t is not None).lower(), sent.value, short)
            live = live[: sum(lines)]
            nodes = _line_nodes(line_of, grams, len(live))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lines)]), pa.int32())
            of_doc = pa.ListArray.from_arrays(offsets, pa.array(nodes.view(np.int64), mask=~live))
            null = lambda kind: pa.nulls(batch.num_rows, kind)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), of_doc, null(pa.int64()), null(longs), null(longs)], schema=_SIGNED_ARROW)

            ids = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            usable = live & np.repeat(ids, lines)
            own, first = np.unique(nodes[usable], return_index=True)
            keep = np.sort(np.flatnonzero(usable)[first])
            if not len(keep):
                continue
            place = np.full(len(live), -1)
            place[keep] = np.arange(len(keep))
            mine = (place[line_of] >= 0) & _prefixes(line_of, len(live), num, den)
            rows, signs = place[line_of[mine]], grams[mine]
            _, at, back = np.unique(signs, return_index=True, return_inverse=True)
            holder = rows[at]
            new = np.zeros(len(signs), bool)
            new[at] = True
            key = nodes[keep].view(np.int64)
            links = np.unique(np.stack([rows, holder[back]], 1)[rows != holder[back]], axis=0)
            listed = lambda c, v: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(c)]), pa.int32()), pa.array(v, pa.int64()))
            out_signs = listed(np.bincount(rows[new], minlength=len(keep)), signs[new].view(np.int64))
            out_roots = listed(np.bincount(links[:, 0], minlength=len(keep)) if len(links) else np.zeros(len(keep), int), key[links[:, 1]] if len(links) else np.zeros(0, np.int64))
            empty = len(keep)
            yield pa.RecordBatch.from_arrays([pa.nulls(empty, pa.int64()), pa.nulls(empty, longs), pa.array(key), out_signs, out_roots], schema=_SIGNED_ARROW)

    return run


_SETS = "cluster long, blocks long, block long, is_pivot boolean, doc_id long, line_no int, node long, grams binary"


def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, wanted: list of lines with their cluster and block) -> the lines' columns and their sets."""
    for batch in slices(batches, 1, 4 << 20):
        lines, wanted = [], []
        for text, asked in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist()):
            own = [] if text is None else text.split(b"\n")
            for w in asked:
                if w["line_no"] < len(own):
                    lines.append(own[w["line_no"]])
                    wanted.append(w)
        line_of, grams, live = _line_grams(b"\n".join(lines).lower(), None, True)
        live = live[: len(lines)]
        nodes = _line_nodes(line_of, grams, len(live)).view(np.int64)
        ends = np.searchsorted(line_of, np.arange(len(live) + 1))
        kept = [i for i, w in enumerate(wanted) if nodes[i] == w["node"]]  # else another text under the same id
        columns = {k: [wanted[i][k] for i in kept] for k in ("cluster", "blocks", "block", "is_pivot", "doc_id", "line_no", "node")}
        columns["grams"] = [grams[ends[i] : ends[i + 1]].tobytes() for i in kept]
        kinds = {"is_pivot": pa.bool_(), "line_no": pa.int32(), "grams": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()], list(columns))


_PROBES = 1 << 20


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i, counts[i] of them."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _portions(costs: np.ndarray) -> list[np.ndarray]:
    """The indexes, in portions of about _PROBES together, one at least."""
    return np.split(np.arange(len(costs)), np.flatnonzero(np.diff(np.cumsum(costs) // _PROBES)) + 1) if len(costs) else []


def match_blocks(group: np.ndarray, places: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, num: int, den: int) -> np.ndarray:
    """PPJoin over many blocks at once: for each line whether one of its group at a smaller place is as similar as
    num / den. In a group in which some ask, only those are searched, against the rest.

    The group's first line is compared with all others before; what it matches is decided. places: ranks, all different.
    """
    n_rows = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n_rows), size)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    asked = np.zeros(int(group.max(initial=0)) + 1, bool)
    asked[group[asks]] = True
    seeks = asks | ~asked[group]

    order = np.lexsort((flat, group[row]))
    new = np.ones(len(flat), bool)
    new[1:] = (flat[order][1:] != flat[order][:-1]) | (np.diff(group[row[order]]) != 0)
    token = np.empty(len(flat), np.int64)
    token[order] = np.cumsum(new) - 1  # of its group
    seen = np.bincount(token)
    begin = np.cumsum(size) - size
    held = np.sort(row * np.int64(len(seen)) + token)

    def overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for part in _portions(size[x]):
            probe = y[part].repeat(size[x[part]]) * np.int64(len(seen)) + token[_runs(begin[x[part]], size[x[part]])]
            at = np.minimum(np.searchsorted(held, probe), len(held) - 1)
            out[part] = np.bincount(np.repeat(np.arange(len(part)), size[x[part]])[held[at] == probe], minlength=len(part))
        return out

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (num + den) * overlap(x, y) >= num * (size[x] + size[y])

    matched = np.zeros(n_rows, bool)
    by_place = np.lexsort((places, asks, group))
    head = by_place[np.concatenate([[True], np.diff(group[by_place]) != 0])] if n_rows else by_place
    first = np.zeros(len(asked), np.int64)
    first[group[head]] = head
    first = first[group]
    x = np.flatnonzero(seeks & ~asks[first] & (places > places[first]))
    matched[x] = alike(x, first[x])

    order = np.lexsort((token, seen[token], row))
    token, place_in = token[order], np.arange(len(row)) - begin[row]
    prefix = place_in < (size - -(-num * size // den) + 1)[row]
    p_row, p_token, p_at = row[prefix], token[prefix], place_in[prefix]
    index = np.argsort(p_token[~asks[p_row]], kind="stable")
    listed = np.flatnonzero(~asks[p_row])[index]
    low = np.searchsorted(p_token[listed], p_token)
    length = np.searchsorted(p_token[listed], p_token, "right") - low
    probing = np.flatnonzero((seeks & ~matched)[p_row])
    for part in _portions(length[probing]):
        mine = probing[part]
        other = listed[_runs(low[mine], length[mine])]
        mine = np.repeat(mine, length[mine])
        x, y = p_row[mine], p_row[other]
        rest = np.minimum(size[x] - p_at[mine], size[y] - p_at[other]) + np.minimum(p_at[mine], p_at[other])  # positional filter
        near = (places[y] < places[x]) & (den * np.minimum(size[x], size[y]) >= num * np.maximum(size[x], size[y])) & ~matched[x]
        near &= (num + den) * rest >= num * (size[x] + size[y])
        pairs = np.unique(x[near] * np.int64(n_rows) + y[near])
        x, y = pairs // max(1, n_rows), pairs % max(1, n_rows)
        matched[x[alike(x, y)]] = True
    return matched


_KEYS = ("cluster", "block", "chunk")


def _matched(num: int, den: int):
    """Batches sorted by block -> whether each line is matched in its block. Blocks are searched some thousand lines at once."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        column = lambda k: table.column(k).to_numpy()
        keys = np.stack([column(k) for k in _KEYS])
        group = np.cumsum(np.concatenate([[0], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        places = np.empty(table.num_rows, np.int64)
        places[np.lexsort((column("line_no"), column("doc_id")))] = np.arange(table.num_rows)
        order = np.lexsort((places, column("node"), group))  # a line set once in each block
        node = column("node")[order]
        keep = np.sort(order[np.concatenate([[True], (np.diff(node) != 0) | (np.diff(group[order]) != 0)])])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams").take(pa.array(keep))]
        asks = column("asks").astype(bool)[keep]
        found = match_blocks(group[keep], places[keep], sets, asks, num, den)
        return pa.RecordBatch.from_arrays([pa.array(column("node")[keep]), pa.array(found)], ["node", "matched"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _LINES:
                table = pa.Table.from_batches(held)
                keys = np.stack([table.column(k).to_numpy() for k in _KEYS])
                ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))
                if len(ends):  # all but the last block are whole
                    cut = int(ends[-1]) + 1
                    yield flush(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows -= cut
        if rows:
            yield flush(pa.Table.from_batches(held))
        trim()

    return run


def _search(rows: DataFrame, num: int, den: int) -> DataFrame:
    keys = list(_KEYS)
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_matched(num, den), "node long, matched boolean")
    return found.groupBy("node").agg(F.max("matched").alias("matched"))


def _in_blocks(lines: DataFrame, block_lines: int) -> DataFrame:
    """(node, cluster, doc_id, line_no, ...) with the number of the cluster's blocks, the line's block and whether it is the first line."""
    sizes = lines.groupBy("cluster").agg(F.ceil(F.count("*") / block_lines).alias("blocks"), F.min(F.struct("doc_id", "line_no", "node")).alias("pivot"))
    return lines.join(sizes, "cluster").withColumns({"block": F.pmod(F.xxhash64("node"), "blocks"), "is_pivot": F.col("node") == F.col("pivot.node")})


def repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, block_lines: int = 2048, short: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every document; removed holds line numbers from 0, ascending.

    Lines are split at line feeds; a line's set holds its distinct 5-word shingles (words: runs of
    `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased). A line is removed when a line at an earlier place, in the order of
    (doc_id, line number), has den * |A and B| >= num * |A or B|; whether that one is removed itself plays no part.
    With short, a line of one to four words has its whole word sequence as its one element; without, it takes no part.
    Lines without a word never do, nor do documents with a null id. Null texts have no lines, empty
    ones one. Rows that repeat an id share its places: the first occurrence of a line there stays in each of
    them. An empty table gives no rows; other columns are ignored. Shingles and sets are compared by 64-bit hashes.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = documents.sparkSession.sparkContext.broadcast(word_rarity(docs))
    signed = stage(docs.mapInArrow(_signed(num, den, sent, short), _SIGNED), "line-signs")
    of_docs, sets = stage(signed.where("node IS NULL").select("doc_id", "lines"), "line-nodes"), signed.where("node IS NOT NULL")
    places = of_docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode("lines").alias("line_no", "node")).where("node IS NOT NULL")
    first = stage(places.groupBy("node").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("n")), "line-places")

    held = sets.select("node", F.explode("signs").alias("sign"))
    edges = held.select(F.col("node").alias("a"), F.min("node").over(Window.partitionBy("sign")).alias("b"))
    clusters = connected_components(edges.union(sets.select("node", F.explode("roots"))), "line-clusters")
    unstage(signed)
    members = stage(clusters.withColumnRenamed("component", "cluster").join(first, "node").select("node", "cluster", "at.doc_id", "at.line_no"), "line-members")
    unstage(clusters.staged)
    wanted = _in_blocks(members, block_lines)
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("cluster", "blocks", "block", "is_pivot", "doc_id", "line_no", "node")).alias("wanted"))
    texts = docs.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "wanted")
    lines = stage(texts.mapInArrow(_wanted_sets, _SETS), "line-sets")
    unstage(members)
    wide = lines.where("blocks > 1").drop("cluster", "blocks", "block", "is_pivot")
    if not wide.isEmpty():
        parts = split_clusters(wide.select(F.col("node").alias("key"), "grams"), num, den)
        split = _in_blocks(wide.join(parts.withColumnRenamed("key", "node"), "node"), block_lines)
        before, lines = lines, stage(lines.where("blocks = 1").union(split.select(*lines.columns)), "line-parts")
        unstage(before, parts.staged)
    zero = F.lit(0).cast("long")
    plain = lines.select("cluster", "block", zero.alias("chunk"), "node", "doc_id", "line_no", "grams", F.lit(False).alias("asks"), "blocks", "is_pivot")
    every = F.explode(F.sequence(zero, F.col("blocks") - 1))
    spread = plain.where("is_pivot AND blocks > 1").withColumn("block", every)
    matched = stage(_search(plain.where("NOT (is_pivot AND blocks > 1)").union(spread).drop("blocks", "is_pivot"), num, den), "line-matches").where("matched")
    wide = plain.where("blocks > 1")
    if not wide.isEmpty():
        open_ = wide.join(matched, "node", "left_anti")
        chunks = open_.groupBy("cluster").agg(F.ceil(F.count("*") / block_lines).alias("chunks"))
        asks = (
            open_.join(chunks, "cluster").withColumn("home", F.col("block")).withColumn("block", every).where("block <> home")
            .withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), "chunks")).withColumn("asks", F.lit(True))
        )
        rest = wide.join(chunks, "cluster").withColumn("chunk", F.explode(F.sequence(zero, F.col("chunks") - 1)))
        columns = [c for c in plain.columns if c not in ("blocks", "is_pivot")]
        matched = matched.union(stage(_search(asks.select(columns).union(rest.select(columns)), num, den), "line-matches").where("matched"))

    decided = stage(first.join(matched.select("node").distinct().withColumn("near", F.lit(True)), "node", "left").where("n > 1 OR near"), "line-decided")
    gone = by_hot_key(places, decided, "node", "n").where("near OR at <> struct(doc_id, line_no)")
    gone = gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    none = F.array().cast("array<int>")
    rows = of_docs.select("doc_id", F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines")).join(gone, "doc_id", "left")
    removed = F.filter(F.coalesce("removed", none), lambda i: i < F.col("n_lines"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with their repeated lines taken out. Documents of which no line is left go; those without a
    repeated line stay as they are, null texts and ids included."""
    found = repeated_lines(documents, id_col, text_col, **options).where("n_removed > 0")
    found = found.groupBy(F.col("doc_id").alias("__id")).agg(F.min("removed").alias("__removed"))
    rows = documents.join(found.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col("__id"), "left")
    # Removed numbers rise, so the lines between two of them are one slice: linear in a document's lines.
    ends = F.concat("__removed", F.array(F.size("__lines")))
    gaps = F.transform(ends, lambda e, i: F.struct(F.coalesce(F.get("__removed", i - 1) + 1, F.lit(0)).alias("low"), e.alias("high")))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice("__lines", g["low"] + 1, g["high"] - g["low"])))
    rows = rows.withColumn("__lines", F.when(F.col("__removed").isNotNull(), F.split(F.col(text_col), "\n", -1)))
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    left = F.col("__removed").isNull() | (F.size("__lines") > F.size("__removed"))
    rows = rows.where(left).withColumn("__text", text)
    return rows.select(*(F.col("__text").alias(c) if c == text_col else documents[c] for c in documents.columns))
