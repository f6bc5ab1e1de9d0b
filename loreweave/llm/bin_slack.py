"""Best-fit packing by minimum bin slack: whole documents into as few sequences as possible.

Only the number of pieces of each length matters to a bin, and there are at most `size` lengths, so the bins are found over that
histogram: a subset-sum dynamic programme over the available lengths, with a big integer as its bitset, gives the fullest feasible
combination, which is then removed, as many times at once as the lengths that are left allow (the same programme would find it
again). Pieces are numbered within their length, over all partitions, and those numbers tell each its sequence and place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import tokenizer
from .scratch import slices, stage

_RANK = 44  # bits of a piece's number within its length


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination (length: uses) with the largest sum up to room, of lengths in descending order with these counts; among equally
    full ones, one of the longest lengths. Bit s of a bitset tells that s is a sum of the lengths so far."""
    mask, reach, seen = (1 << room + 1) - 1, 1, [1]
    used: list[int] = []
    for length in lengths:
        if length > room or not counts[length]:
            continue
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reach |= reach << step * length & mask
            left -= step
            step *= 2
        seen.append(reach)
        used.append(length)
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, {}
    for length, before in zip(reversed(used), reversed(seen[:-1])):
        while not before >> at & 1:
            at -= length
            out[length] = out.get(length, 0) + 1
    return out


def combinations(counts: dict[int, int], size: int, seeded: bool) -> list[tuple[int, dict[int, int]]]:
    """(times, combination) until no length is left. Seeded: the longest length left opens each bin, and the fullest combination of the
    others fills it; else long lengths that nothing completes could stay to the end."""
    counts = {k: counts[k] for k in sorted(counts, reverse=True) if counts[k]}
    out = []
    while counts:
        lengths = list(counts)
        if seeded:
            first = lengths[0]
            found = fullest(lengths, counts | {first: counts[first] - 1}, size - first)
            found[first] = found.get(first, 0) + 1
        else:
            found = fullest(lengths, counts, size)
        times = min(counts[k] // n for k, n in found.items())
        out.append((times, found))
        for k, n in found.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return out


def minimum_bin_slack(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """The better of the plain and the seeded heuristic; the plain one where they are equal."""
    return min((combinations(counts, size, seeded) for seeded in (False, True)), key=lambda plan: sum(n for n, _ in plan))


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
_PIECES_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32()}[t]) for n, t in (x.split() for x in _PIECES.split(", "))])
_FLUSH = 20_000


def _cut(path: str, size: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen, rows = tokenizer(path), TaskContext.get().partitionId(), [0] * (size + 1), []
        for batch in slices(batches, 1, 4 << 20):
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, text = doc.as_py(), text.as_py()
                ids = memoryview((bpe.ids(text) if text else b"") + end)
                total, start, piece = len(ids) // 4, 0, 0
                while start < total:
                    stop = start + ((total - start - 1) % size + 1)  # what is left over comes first
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), part, seen[stop - start]))
                    seen[stop - start] += 1
                    start, piece = stop, piece + 1
                if len(rows) >= _FLUSH:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_PIECES_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES_ARROW)], schema=_PIECES_ARROW)


def intervals(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Sorted columns (length and first number, uses in a bin, first bin, place in the bin): for each length and combination."""
    rows, taken, bins = [], {}, 0
    for times, found in plan:
        place = 0
        for length, uses in found.items():
            first = taken.get(length, 0)
            rows.append((length << _RANK | first, uses, bins, place))
            taken[length] = first + times * uses
            place += uses * length
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _placed(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            key, uses, bins, place = table[np.searchsorted(table[:, 0], length << _RANK | number, "right") - 1].T
            at = number - (key & (1 << _RANK) - 1)
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bins + at // uses), pa.array(place + at % uses * length)], names=[x.split()[0] for x in _OUT.split(", ")]
            )

    return run


def pack_whole(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are its text's followed by end_id, so null and empty texts have one id. Documents of up to `size` ids lie whole in
    one sequence; longer ones are cut into pieces of `size`, the first of which may be shorter. Null ids pass through; repeated rows
    are packed once each; among equally full combinations that of the longest lengths is taken; an empty table gives no rows. Other
    columns are ignored. Sequences are numbered from 0 by combination; equal input partitions give equal numbers.

    The driver holds the histogram (at most `size` counts) and the combinations (each uses up a length, or most of it); a length that
    most pieces share is numbered by partition, so no task holds all of them.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stage(docs.mapInArrow(_cut(vocabulary, size, end_id), _PIECES), "pieces")
    cells = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = intervals(minimum_bin_slack(counts, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("local")).alias("number")
    )
    return numbered.mapInArrow(_placed(table), _OUT)
