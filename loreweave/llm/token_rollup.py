"""Token counts as delta-maintained rollups.

A change is a signed row: an insert adds a document's tokens, a delete takes them away, a revision does both. A batch is folded to one
row per source, language and tokenizer version, written aside and moved to its place under its name, so that readers see all of
it or nothing; a name that is there already, or in the ledger of the totals, commits nothing again. Every few batches the
deltas are folded into new totals, which name the batches they hold and are moved to their place in the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import tokenizer
from .scratch import slices

#: Tokenizer versions: the pattern whose matches are the tokens.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}

_KEYS = ["source", "lang", "version"]
_SCHEMA = "batch string, source string, lang string, version string, documents long, tokens long"


def token_count(text: Column, version: str) -> Column:
    """Null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def with_bpe_counts(documents: DataFrame, vocabulary: str, text_col: str = "text", name: str = "tokens") -> DataFrame:
    """The documents with the number of their texts' ids in a byte-level BPE vocabulary; null text: 0."""
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in slices(batches, at, 4 << 20):
            counts = [len(bpe.ids(t)) // 4 if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, name])

    return documents.mapInArrow(run, documents.select("*", F.lit(0).cast("long").alias(name)).schema)


def inserts(documents: DataFrame, version: str) -> DataFrame:
    """Documents -> change rows (source, lang, version, sign, tokens), one each; null source and lang stay null."""
    return documents.select("source", "lang", F.lit(version).alias("version"), F.lit(1).alias("sign"), token_count(F.col("text"), version).alias("tokens"))


def deletes(documents: DataFrame, version: str) -> DataFrame:
    return inserts(documents, version).withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame, old_version: str, new_version: str) -> DataFrame:
    """Counts that take the place of others: the old rows deleted, the new ones inserted."""
    return deletes(old, old_version).union(inserts(new, new_version))


class TokenRollup:
    """Totals by source, language and tokenizer version in a folder that all executors share: deltas/<batch> and totals/<number>.

    Null sources and languages are keys of their own; an empty batch commits nothing but its name. Repeated
    change rows count each; extra columns of a change are ignored. Batch names are 1 to 64 letters, digits, `-` or `_`.
    One writer at a time folds; batches of different names may be committed at once.
    """

    def __init__(self, spark: SparkSession, path: str, fold_after: int = 4):
        self.spark, self.path, self.fold_after = spark, path, fold_after
        self._root = self._hadoop(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _place(self, rows: DataFrame, folder: str, name: str) -> None:
        """Written aside, then moved: the name appears with all its rows or not at all."""
        aside, place = f"{self.path}/aside/{uuid.uuid4().hex}", self._hadoop(f"{self.path}/{folder}/{name}")
        rows.write.parquet(aside)
        self._fs.mkdirs(place.getParent())
        if self._fs.exists(place) or not self._fs.rename(self._hadoop(aside), place):
            self._fs.delete(self._hadoop(aside), True)

    def _totals(self) -> tuple[int, DataFrame]:
        """The number and rows of the newest totals: sums, and a row of zeros for each batch they hold."""
        found = self._names("totals")
        if not found:
            return 0, self.spark.createDataFrame([], _SCHEMA)
        return int(found[-1]), self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/totals/{found[-1]}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Idempotent: a batch that was committed before changes nothing. Whether it was new."""
        if not (0 < len(batch) <= 64 and all(c.isascii() and (c.isalnum() or c in "-_") for c in batch)):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self._names("deltas") or not self._totals()[1].where(F.col("batch") == batch).isEmpty():
            return False
        sums = changes.groupBy(*_KEYS).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        self._place(sums.where("documents <> 0 OR tokens <> 0").select(F.lit(batch).alias("batch"), *_KEYS, "documents", "tokens"), "deltas", batch)
        if len(self._names("deltas")) >= self.fold_after:
            self.fold()
        return True

    def _open(self, held: DataFrame) -> tuple[list[str], DataFrame]:
        """Batches that the totals do not hold yet, and their rows."""
        found = self._names("deltas")
        done = {r.batch for r in held.where(F.col("batch").isin(found)).select("batch").collect()} if found else set()
        names = [n for n in found if n not in done]
        if not names:
            return [], self.spark.createDataFrame([], _SCHEMA)
        return names, self.spark.read.schema(_SCHEMA).parquet(*(f"{self.path}/deltas/{n}" for n in names))

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        sums = rows.where("batch IS NULL OR documents <> 0 OR tokens <> 0").groupBy(*_KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")

    def fold(self) -> None:
        """Add the open deltas to new totals, then remove what the totals before held and what they took in."""
        number, held = self._totals()
        names, rows = self._open(held)
        ledger = held.where("batch IS NOT NULL")
        if names:
            ledger = ledger.union(self.spark.createDataFrame([(n, None, None, None, 0, 0) for n in names], _SCHEMA))
        sums = self._summed(held.where("batch IS NULL").union(rows)).select(F.lit(None).cast("string").alias("batch"), *_KEYS, "documents", "tokens")
        self._place(sums.union(ledger), "totals", f"{number + 1:012d}")
        for name in [x for x in self._names("totals") if int(x) < number]:  # a reader may still have the totals before
            self._fs.delete(self._hadoop(f"{self.path}/totals/{name}"), True)
        held = self._totals()[1]
        done = {r.batch for r in held.where(F.col("batch").isin(names)).select("batch").collect()} if names else set()
        for name in done:
            self._fs.delete(self._hadoop(f"{self.path}/deltas/{name}"), True)

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens): the maintained totals and the few open deltas; keys whose documents all went are
        left out."""
        held = self._totals()[1]
        return self._summed(held.where("batch IS NULL").union(self._open(held)[1]))
