"""Phrase collocations: frequent word n-grams by Misra-Gries summaries, then exact counts and scores.

First pass: each task sums the n-grams of its texts and deals the sums by hash to partitions of all n-grams. A partition merges what comes
to it in a Misra-Gries summary of more counters than its mass (all occurrences dealt to it, which come first) over the threshold, so every
n-gram that reaches the threshold keeps a counter, whatever the order. Hashes that meet only add candidates. Second pass: the texts again, exactly,
by words: n-grams whose hash has a counter are summed with their text. What tells tasks the counters is a bit table of fixed size,
which lets a few others through that the threshold then drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import slices, stage, trim, unstage
from .words import MIX, mixed

_CHUNK = 1 << 19  # words summed at once
_WORDS = 1 << 18  # different ones
_BITS = np.int64(21)  # of a word's, or n-gram's, number in a chunk
_SLICE = 1 << 20
_HELD = 1 << 20  # sums held by a task in the first pass
_ROW = 4096  # sums in one row
_KEY_BITS = np.uint64(28)  # of a hash within its cell
_LOW = np.uint64((1 << 28) - 1)
_STEP = 65535
_WIDTHS = ("u1", "<u2", "<i8")
# A-Z become lower case; a piece ends at any of . , ; : ! ? and the characters 10 to 13, which all become a full stop.
_TABLE = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    """Numbers of a language's words, given out in order; all languages of a chunk share the numbers."""

    def __init__(self, lang: str, words: list[bytes], hashes: list[int]):
        self.seed, self.words, self.hashes = xxhash.xxh3_64_intdigest(lang.encode()), words, hashes

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return found


class _Chunk:
    """Some texts as one array of word numbers, 0 between pieces."""

    def __init__(self, longest: int):
        self.longest, self.words, self.hashes, self.langs = longest, [b"."], [0], {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        if (known := self.langs.get(lang)) is None:
            known = self.langs[lang] = _Words(lang, self.words, self.hashes)
            known[b"."] = 0
        self.parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    @property
    def full(self) -> bool:
        return self.size >= _CHUNK or len(self.words) >= _WORDS

    def grams(self, seen: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1, 2, ...: n, counts of the different n-grams that end after the first `seen` words, their hashes, and where in the
        chunk each stands. Equality is that of the words, not of hashes."""
        a = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        hashes = np.array(self.hashes, np.uint64)
        counts = np.bincount(a[seen:], minlength=len(self.words))
        counts[0] = 0
        place = np.zeros(len(self.words), np.int64)
        place[a[::-1]] = np.arange(len(a) - 1, -1, -1)
        known = np.flatnonzero(counts)
        yield 1, counts[known], hashes[known], place[known], a
        at, rank, of = np.flatnonzero(a), a[a != 0], hashes
        for n in range(2, self.longest + 1):
            rest = at + n - 1 < len(a)
            at, rank = at[rest], rank[rest]
            last = a[at + n - 1]
            whole = last != 0
            at, rank, last = at[whole], rank[whole], last[whole]
            found, first, rank, counts = np.unique(rank << _BITS | last, return_index=True, return_inverse=True, return_counts=True)
            before, last = found >> _BITS, found & (1 << _BITS) - 1
            of = mixed(of[before] * MIX + hashes[last] + np.uint64(n))
            old = (at + n - 1 < seen) if seen else None
            if seen and old.any():
                counts = counts - np.bincount(rank[old], minlength=len(found))
                keep = counts > 0
                yield n, counts[keep], of[keep], at[first][keep], a
            else:
                yield n, counts, of, at[first], a


def _chunks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[_Chunk, int]]:
    """(chunk, words at its start that the chunk before held too). Long texts run on from chunk to chunk with their last words."""
    chunk, seen = _Chunk(longest), 0
    for batch in slices(batches, 1, _SLICE):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if not text.is_valid:
                continue
            lang, text, at, tail = "und" if lang is None else lang, text.as_buffer().to_pybytes().translate(_TABLE), 0, []
            while at < len(text):
                cut = text.find(b" ", at + _SLICE) if len(text) - at > _SLICE else -1
                cut = len(text) if cut < 0 else cut
                words = text[at:cut].replace(b".", b" . ").split()
                at = cut
                if at == len(text):
                    words.append(b".")
                chunk.add(lang, words)
                tail = [] if longest < 2 else [*tail, *words[1 - longest :]][1 - longest :]
                tail = tail[max((i + 1 for i, w in enumerate(tail) if w == b"."), default=0) :]
                if chunk.full:
                    yield chunk, seen
                    chunk, seen = _Chunk(longest), len(tail)
                    chunk.add(lang, tail)
    yield chunk, seen


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _dealt(cells: int, longest: int):
    """First pass: for all the n-grams of some chunks, rows (cell, mass, null, null) and (cell, null, keys, counts)."""

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cell = (keys >> _KEY_BITS).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]]) if len(cell) else np.zeros(1, np.int64)
        out: list[tuple] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            out.append((int(cell[a]), int(counts[a:b].sum()), None, None))
            for at in range(a, b, _ROW):
                end = min(at + _ROW, b)
                out.append((int(cell[a]), None, *squeezed(keys[at:end] & _LOW, counts[at:end])))
        columns = list(zip(*out)) if out else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["cell", "mass", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for chunk, seen in _chunks(batches, longest):
            for _, counts, hashes, _, _ in chunk.grams(seen):
                held.append((_keys(hashes, cells), counts))
                size += len(counts)
            if size > _HELD:
                yield rows(held)
                held, size = [], 0
        yield rows(held)
        trim()

    return run


def _keys(hashes: np.ndarray, cells: int) -> np.ndarray:
    """The cell, then the bits of the key, which are others of the hash; there are at most 2 ** 31 cells."""
    high = hashes >> np.uint64(32)
    return (high * np.uint64(cells) >> np.uint64(32)) << _KEY_BITS | hashes & _LOW


def squeezed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Rising keys and their counts as bytes. Keys go by their 16-bit gaps, wider gaps in steps that count 0, unless those would be many."""
    gaps = np.diff(keys.astype(np.int64))
    steps = (gaps - 1) // _STEP
    if steps.sum() > len(keys) // 2:
        packed = b"\0" + keys.astype("<u4").tobytes()
    else:
        ends = np.cumsum(steps + 1) - 1
        wide = np.full(int(ends[-1]) + 1 if len(ends) else 0, _STEP, "<u2")
        wide[ends] = gaps - steps * _STEP
        packed = b"\1" + keys[:1].astype("<u4").tobytes() + wide.tobytes()
        all_counts = np.zeros(len(wide) + 1, np.int64)
        all_counts[0], all_counts[ends + 1] = counts[0], counts[1:]
        counts = all_counts
    width = int(np.searchsorted([255, 65535], counts.max()))
    return packed, bytes([width]) + counts.astype(_WIDTHS[width]).tobytes()


def unsqueezed(packed: bytes, amounts: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(amounts, _WIDTHS[amounts[0]], offset=1).astype(np.int64)
    if not packed[0]:
        return np.frombuffer(packed, "<u4", offset=1), counts
    keys = np.cumsum(np.concatenate([np.frombuffer(packed, "<u4", 1, 1), np.frombuffer(packed, "<u2", offset=5)]).astype(np.int64)).astype("<u4")
    return keys[counts > 0], counts[counts > 0]


def merge_summaries(kept: tuple[np.ndarray, np.ndarray], more: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries: the sum of summaries with at most `capacity` counters, and what was taken from each counter to get there (no count is now
    too low by more than all that was taken)."""
    keys, counts = _summed(np.concatenate([kept[0], *(k for k, _ in more)]), np.concatenate([kept[1], *(c for _, c in more)]))
    if len(keys) <= capacity:
        return keys, counts, 0
    taken = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])  # the largest that must go
    stays = counts > taken
    return keys[stays], counts[stays] - taken, taken


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a cell's part of the bit table for a key."""
    wide = keys.astype(np.uint64)
    other = mixed(wide + MIX) >> np.uint64(32)
    return (wide * np.uint64(bits) >> _KEY_BITS).astype(np.int64), (other * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def _survivors(threshold: int, bits: int):
    """For each cell, from its rows together, those of its mass first: the bits of the counters that can stand for an n-gram at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, mass, lost, pending = None, 0, 0, 0
        kept, more = (np.zeros(0, "<u4"), np.zeros(0, np.int64)), []

        def row() -> pa.RecordBatch:
            keys, counts, taken = merge_summaries(kept, more, mass // threshold + 1)
            table = np.zeros(bits, bool)
            for place in _places(keys[counts + lost + taken >= threshold], bits):
                table[place] = True
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([np.packbits(table).tobytes()], pa.binary())], names=["cell", "bits"])

        for batch in batches:
            for i in range(batch.num_rows):
                here, weight = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if here != cell:
                    if cell is not None:
                        yield row()
                    kept, more, pending, lost = (np.zeros(0, "<u4"), np.zeros(0, np.int64)), [], 0, 0
                    cell, mass = here, 0
                if weight is not None:
                    mass += weight
                    continue
                more.append(unsqueezed(batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
                pending += len(more[-1][0])
                if pending > max(1 << 19, len(kept[0])):
                    *kept, taken = merge_summaries(kept, more, mass // threshold + 1)
                    lost, more, pending = lost + taken, [], 0
        if cell is not None:
            yield row()
        trim()

    return run


def _counted(table, cells: int, bits: int, longest: int):
    """Second pass: (lang, words, phrase, count) of the n-grams that the bit table knows; with no phrase: a language's words in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        total: dict[str, int] = {}
        for chunk, seen in _chunks(batches, longest):
            texts, langs = chunk.words, np.zeros(len(chunk.words), np.int64)
            names = list(chunk.langs)
            for i, lang in enumerate(names):
                langs[np.fromiter(chunk.langs[lang].values(), np.int64)] = i
            for n, counts, hashes, places, a in chunk.grams(seen):
                if n == 1:
                    for lang, words in zip(names, np.bincount(langs[a[places]], counts, len(names)).tolist()):
                        total[lang] = total.get(lang, 0) + int(words)
                keys = _keys(hashes, cells)
                cell, low = (keys >> _KEY_BITS).astype(np.int64), keys & _LOW
                base, passes = cell * bits, np.ones(len(keys), bool)
                for place in _places(low, bits):
                    at = base + place
                    passes &= (known[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                places, counts = places[passes], counts[passes]
                words = a[places[:, None] + np.arange(n)] if len(places) else np.zeros((0, n), np.int64)
                phrases = [b" ".join([texts[i] for i in row]) for row in words.tolist()]
                yield _row_batch([names[i] for i in langs[words[:, 0]]], n, phrases, counts)
        for lang, words in total.items():
            if words:
                yield _row_batch([lang], 0, [None], np.array([words]))
        trim()

    return run


def _row_batch(langs: list[str], n: int, phrases: list[bytes | None], counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(langs, pa.string()), pa.array([n] * len(langs), pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "f"])


def frequent_grams(
    documents: DataFrame, threshold: int, longest: int, text_col: str, lang_col: str, counters: int, filter_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """Staged tables: (lang, words, phrase, f) of all n-grams of up to `longest` words with f >= threshold, and (lang, n)."""
    spark = documents.sparkSession
    docs = documents.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # A word and what follows it take two characters at least: a bound on all occurrences, and so on the counters in all.
    bound = (docs.agg(F.sum(F.length("text").cast("decimal(38,0)"))).first()[0] or 0) * longest // 2
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = min(1 << 24, max(parts, int(bound) // (threshold * counters) + 1))
    bits = 8 * max(1, filter_bytes // cells)
    dealt = docs.mapInArrow(_dealt(cells, longest), "cell long, mass long, keys binary, counts binary")
    by_cell = dealt.repartition(parts, "cell").sortWithinPartitions("cell", F.col("mass").isNull())
    marked = stage(by_cell.mapInArrow(_survivors(threshold, bits), "cell long, bits binary"), "marked")
    table = np.zeros(cells * bits // 8, np.uint8)
    for r in marked.toLocalIterator():
        table[r["cell"] * bits // 8 : (r["cell"] + 1) * bits // 8] = np.frombuffer(r["bits"], np.uint8)
    unstage(marked)
    shared = spark.sparkContext.broadcast(table)
    found = docs.mapInArrow(_counted(shared, cells, bits, longest), "lang string, words int, phrase string, f long")
    grams = stage(found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(f"f >= {threshold} OR words = 0"), "grams")
    shared.destroy()
    return grams.where("words > 0"), grams.where("words = 0").select("lang", F.col("f").alias("n"))


def collocations(
    documents: DataFrame,
    threshold: int = 30,
    longest: int = 4,
    top: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    counters: int = 1 << 22,
    filter_bytes: int = 16 << 20,
) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at . , ; : ! ? and the characters 10 to 13 into pieces and these at spaces and tabs into words. A
    phrase of 2 to `longest` words that occurs a >= threshold times scores floor(2000000 * a / (l + r)) at its weakest cut into parts
    that occur l and r times (ties: the shortest first part); it goes if a longer such phrase that holds it occurs 0.8 times as often.
    Order: score and a falling, then the phrase's bytes. Null texts are empty, a null language is `und`; repeated rows count each; an
    empty table gives no rows; other columns are ignored. All counts are exact.

    `counters` bounds the summary that one task holds, `filter_bytes` the bit table that tasks share; a fuller table costs rows in the
    second shuffle, no results.
    """
    grams, sizes = frequent_grams(documents, threshold, longest, text_col, lang_col, counters, filter_bytes)
    words = F.split("phrase", " ")
    some = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    longer = grams.where("words > 1").withColumn("w", words)
    # Every part of a frequent phrase is frequent, so the inner joins lose nothing.
    cut = longer.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", some(F.lit(1), F.col("k")).alias("first"), some(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left = grams.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = grams.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("s")
    ).select("lang", "phrase", "s.a", "s.l", "s.r", "s.score")
    inner = longer.where("words > 2").select("lang", "words", "w", F.col("f").alias("over"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "over", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    held = inner.groupBy("lang", some(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("over").alias("over"))
    exact = "CAST({} AS DECIMAL(20,0)) * {}"
    kept = weakest.join(held, ["lang", "phrase"], "left").where(f"over IS NULL OR {exact.format('over', 100)} < {exact.format('a', 80)}").drop("over")
    kept = stage(kept, "kept")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Two steps: no task ranks all phrases of a language.
    dealt = kept.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    longs = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return ranked.join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *longs)
