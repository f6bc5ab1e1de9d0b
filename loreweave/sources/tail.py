"""Lines appended to files, as a streaming source whose offsets are a byte place in each file.

Spark's own file source takes a file once. This one reads on where it stopped: only whole lines, so a half written last line waits for
its end, and a file that is shorter than what was read of it (replaced) is read anew from its start. The places are in the query's
checkpoint, so each line comes once over restarts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "appended_lines"
SCHEMA = "file string, place long, reset boolean, value string"
_BLOCK = 1 << 16
_BATCH_BYTES = 1 << 22


@dataclass
class Piece(InputPartition):
    """Lines of a file that start in [low, high); first: there is a line start at low; end: where the last of all lines ends."""

    file: str
    low: int
    high: int
    end: int
    first: bool
    reset: bool


def _files(path: str, suffix: str) -> dict[str, int]:
    """Sizes of a file, or of the files below a folder whose names end so, by their path."""
    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return {root: info.size}
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(root) :].split("/"))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not hidden(f.path)}


def _last_line_end(path: str, file: str, size: int) -> int:
    """The place after the last line feed, read from the end."""
    with fs.FileSystem.from_uri(path)[0].open_input_file(file) as f:
        at = min(size, f.size())
        while at:
            low = max(0, at - _BLOCK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


def _read(path: str, piece: Piece) -> Iterator[pa.RecordBatch]:
    """Lines as Arrow batches of bounded bytes; bytes that are no UTF-8 are replaced."""
    files, places, values, held = [], [], [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array([piece.reset] * len(files), pa.bool_()), pa.array(values, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    with fs.FileSystem.from_uri(path)[0].open_input_stream(piece.file, buffer_size=_BLOCK * 16) as raw:
        at = piece.low if piece.first else piece.low - 1  # a line that starts at low has its line feed before it
        left = at
        while left:
            left -= len(raw.read(min(left, 1 << 24)) or b"x" * left)
        skip, rest = not piece.first, b""
        while at < piece.high and (block := raw.read(min(1 << 20, piece.end - at - len(rest)))):
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                start, at = at, at + len(line) + 1
                if skip:
                    skip = False
                    continue
                if start >= piece.high:
                    break
                files.append(piece.file)
                places.append(start)
                values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                held += len(line)
            if held >= _BATCH_BYTES:
                yield batch()
                files, places, values, held = [], [], [], 0
    yield batch()


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the source needs a path")
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.most, self.piece = int(options.get("maxbytespertrigger", 1 << 40)), int(options.get("bytesperpartition", 1 << 27))
        self.known: dict[str, tuple[int, int]] = {}  # size and end of the last line when last seen
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return {"places": "{}"}

    def _ends(self) -> dict[str, int]:
        now = {}
        for file, size in _files(self.path, self.suffix).items():
            held = self.known.get(file)
            now[file] = held if held and held[0] == size else (size, _last_line_end(self.path, file, size))
        self.known = now
        return {file: end for file, (_, end) in now.items() if end}

    def latestOffset(self) -> dict:
        """Ends of whole lines. Beyond maxBytesPerTrigger a file waits for the next trigger; one file at least goes on."""
        ends, held = self._ends(), self.at
        if held is not None:
            left, taken = self.most, {}
            for file in sorted(ends):
                low = held.get(file, 0)
                size = ends[file] - (low if low <= ends[file] else 0)
                if size <= left or left == self.most:
                    taken[file] = ends[file]
                    left -= min(left, size)
                elif low:
                    taken[file] = low
            ends = taken
        self.at = ends
        return {"places": json.dumps(ends, sort_keys=True)}

    def _pieces(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        out: list[InputPartition] = []
        for file, high in sorted(end.items()):
            reset = start.get(file, 0) > high
            low = 0 if reset else start.get(file, 0)
            for at in range(low, high, self.piece):
                out.append(Piece(file, at, min(at + self.piece, high), high, at == low, reset))
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = json.loads(end["places"])
        return self._pieces(json.loads(start["places"]), self.at)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class _Whole(DataSourceReader):
    """All whole lines that there are."""

    def __init__(self, options: dict[str, str]):
        self.tail = _Tail(options)

    def partitions(self) -> list[InputPartition]:
        return self.tail._pieces({}, self.tail._ends()) or [Piece("", 0, 0, 0, True, False)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from self.tail.read(partition)


class AppendedLines(DataSource):
    """Options: path (a file, or a folder searched to any depth), suffix (.jsonl), maxBytesPerTrigger, bytesPerPartition (128 MB)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Tail:
        return _Tail(dict(self.options))

    def reader(self, schema) -> _Whole:
        return _Whole(dict(self.options))


def appended_lines(spark: SparkSession, path: str, stream: bool = True, **options: str) -> DataFrame:
    """(file, place, reset, value): the lines of the files as they grow, or with stream=False those there are now. place is the byte at which a line
    starts; reset tells that it was read after the file had shrunk. Lines end at a line feed; what stands after the last one waits. Empty
    files and folders give no rows. A file that shrinks and grows past the old place between two triggers counts as appended to. After a
    restart the first trigger has no limit of bytes."""
    spark.dataSource.register(AppendedLines)
    reader = spark.readStream if stream else spark.read
    return reader.format(NAME).options(path=path, **options).load()
