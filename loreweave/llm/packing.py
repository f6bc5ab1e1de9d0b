"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document's remainder (after its full windows) goes
where it fits best; when none fits, the fullest window is emitted, topped up from the remainder when its gap is
larger than `slack`. Windows left open at the end of the partitions are merged in bounded groups of partitions.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import slices, stage

_SLICE = 1 << 20
# Where a single space or line feed stands between two non-space characters, the tokenizer always cuts before it.
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")


class ByteBpe:
    """Ids of the byte-level BPE as little-endian unsigned 32-bit bytes, a slice of the text at a time.

    Reads the vocabulary as ranks beside the given .json file (the same vocabulary), which encodes several times
    faster. A text is first cut at the added tokens that the .json file names, such as `<|endoftext|>`; they have ids of their own.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.added = {k: np.array([v], dtype="<u4").tobytes() for k, v in added.items()}
        self.cuts = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.cuts is None or not (found := list(self.cuts.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in found:
            out += [self._plain(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        out, at = [], 0
        while len(text) - at > _SLICE and (cut := _CUT.search(text, at + _SLICE)):
            out.append(self._encode(text[at : cut.start()]))
            at = cut.start()
        return b"".join([*out, self._encode(text[at:] if at else text)])

    def _encode(self, text: str) -> bytes:
        return np.array(self.own.encode_ordinary(text), dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


class _Packer:
    """Open windows of one partition; a piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int, windows: int, slack: int, first_id: int):
        self.size, self.windows, self.slack, self.next_id = size, windows, slack, first_id
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)
        self.rows: list[tuple] = []

    def emit(self, pieces: list, leftover: bool = False) -> None:  # ids: bytes, or a view of them where full
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset, ids if leftover else None))
            offset += n
        self.next_id += 1

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        full = len(ids) // (4 * self.size) * self.size
        if full:
            whole = memoryview(ids)
            for at in range(0, full, self.size):
                self.emit([(doc, start + at, whole[4 * at : 4 * (at + self.size)], total)])
            start, ids = start + full, ids[4 * full :]
        while ids:
            n = len(ids) // 4
            fits = [i for i, (used, _) in enumerate(self.open) if used + n <= self.size]
            if fits:
                best = max(fits, key=lambda i: (self.open[i][0], -i))
                used, pieces = self.open[best]
                pieces.append((doc, start, ids, total))
                if used + n == self.size:
                    self.emit(pieces)
                    del self.open[best]
                else:
                    self.open[best] = (used + n, pieces)
                return
            if len(self.open) < self.windows:
                self.open.append((n, [(doc, start, ids, total)]))
                return
            fullest = max(range(len(self.open)), key=lambda i: (self.open[i][0], -i))
            used, pieces = self.open.pop(fullest)
            gap = self.size - used
            if gap > self.slack:
                pieces.append((doc, start, ids[: 4 * gap], total))
                start, ids = start + gap, ids[4 * gap :]
            self.emit(pieces)

    def close(self, leftover: bool) -> None:
        for _, pieces in self.open:
            self.emit(pieces, leftover)
        self.open = []


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _SCHEMA.split(", ")] + [("ids", pa.binary())])
_FLUSH = 20_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _packed(path: str, size: int, windows: int, slack: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = tokenizer(path), _Packer(size, windows, slack, TaskContext.get().partitionId() << 32)
        for batch in slices(batches, 1, 4 << 20):
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                ids = (bpe.ids(text) if text else b"") + end
                packer.add(doc.as_py(), 0, ids, len(ids) // 4)
                if len(packer.rows) >= _FLUSH:
                    yield _batch(packer.rows)
                    packer.rows = []
        packer.close(leftover=True)
        yield _batch(packer.rows)

    return run


def _merged(size: int):
    """Leftover windows of one group of partitions, sorted by (group, window, offset): full windows and one rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != group:
                    if packer:
                        packer.close(leftover=False)
                        yield _batch(packer.rows)
                    group, packer = r["group"], _Packer(size, 1, 0, ((1 << 30) + r["group"]) << 32)
                packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        if packer:
            packer.close(leftover=False)
            yield _batch(packer.rows)

    return run


def pack(
    documents: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    windows: int = 64,
    slack: int = 16,
    end_id: int = 1,
    merge_partitions: int = 32,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's followed by end_id, so null and empty texts have one id. Every id lies in
    exactly one piece; sequences hold at most `size` ids and offsets in them have no gaps. Null ids pass
    through; repeated rows are packed once each; ties go to the oldest window; an empty table gives no rows.
    Other columns are ignored. sequence_id is the partition and a running number, so equal partitions give
    equal ids.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stage(docs.mapInArrow(_packed(vocabulary, size, windows, slack, end_id), f"{_SCHEMA}, ids binary"), "pieces")
    group = F.floor(F.shiftright("sequence_id", 32) / merge_partitions).cast("long").alias("group")
    rest = pieces.where("ids IS NOT NULL").select("*", group).repartition("group").sortWithinPartitions("group", "sequence_id", "offset")
    merged = rest.mapInArrow(_merged(size), f"{_SCHEMA}, ids binary")
    return pieces.where("ids IS NULL").drop("ids").union(merged.drop("ids"))
