"""Language identification by compression: the language whose zstandard raw-content dictionary compresses a text best."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import slices

_OTHER = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from: crc32 of the id as text, modulo 3, is 1. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def letters(text: str) -> bytes:
    """Lower case, every run of other characters than letters as one space. Numbers of any kind (fractions, circled, Roman) are none."""
    found = _OTHER.sub(" ", text.lower()).strip()
    if not found.replace(" ", "a").isalpha():
        found = " ".join("".join(c if c.isalpha() else " " for c in found).split())
    return found.encode("utf-8", "surrogatepass")


def dictionaries(labelled: DataFrame, dict_bytes: int = 131_072, excerpt: int = 1024) -> dict[str, bytes]:
    """(doc_id, text, lang) -> a dictionary of at most dict_bytes for each language.

    The bound of the sample: 8 * dict_bytes / excerpt documents a language, that of the least hash of the id and text in each of as many
    hash buckets, the first `excerpt` characters of each; they are taken in the order of the hash until the dictionary is full. Every
    task keeps one row a bucket before anything is shuffled. Rows without a language or a letter are no labels.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = rows.select("lang", F.xxhash64("doc_id", "text").alias("place"), F.substring("text", 1, excerpt).alias("text"))
    least = hashed.groupBy("lang", F.pmod("place", F.lit(8 * dict_bytes // excerpt)).alias("bucket")).agg(F.min(F.struct("place", "text")).alias("row"))
    rows = least.select("lang", "row.place", "row.text")
    out: dict[str, bytes] = {}
    for lang, text in rows.orderBy("lang", "place").select("lang", "text").toLocalIterator():
        out[lang] = (out.get(lang, b"") + letters(text) + b" ")[:dict_bytes]
    return out


@lru_cache(maxsize=64)
def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def classify(text: str | None, dicts: dict[str, bytes], level: int, chunk: int, margin: float) -> tuple[str, float, bool]:
    """(language, score, rejected). Whole text, in chunks that each see the dictionary afresh.

    The score is the best language's share of weights 2 ** (-3 * excess / sqrt(best)), excess being the bytes that a language needs more
    than the best: 1 / n where n languages compress alike, near 1 where the others need some multiples of sqrt(best) bytes more.
    """
    raw = letters(text) if text else b""
    if not raw or not dicts:
        return "und", 0.0, True
    parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
    cost = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in ((k, _compressor(v, level)) for k, v in dicts.items()))
    best = cost[0][0]
    score = 1 / sum(2 ** (-3 * (size - best) / best**0.5) for size, _ in cost)
    return cost[0][1], score, len(cost) > 1 and cost[1][0] - best <= margin * cost[1][0]


def _broadcast_dictionaries(docs: DataFrame, dict_bytes: int):
    learnt = dictionaries(docs.where(~held_out(F.col("doc_id"))), dict_bytes)
    return docs.sparkSession.sparkContext.broadcast(learnt)


def accepted(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = 131_072, level: int = 4, chunk: int = 4096, margin: float = 0.005
) -> DataFrame:
    """The rows of documents whose language identify() does not reject, all columns as they are, in one pass."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sent, text_at = _broadcast_dictionaries(docs, dict_bytes), documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at, 4 << 20):
            texts = batch.column(text_at)
            yield batch.filter(pa.array([not classify(t.as_py(), sent.value, level, chunk, margin)[2] for t in texts], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def identify(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    dict_bytes: int = 131_072,
    level: int = 4,
    chunk: int = 4096,
    margin: float = 0.005,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document.

    Dictionaries come from documents that held_out() leaves (see dictionaries() for the bound); predictions use
    the text alone. Null texts and texts without a letter, and all texts where nothing is labelled: `und`, score
    0, rejected. rejected also holds where the best language needs at least 1 - margin of the bytes of the
    second; ties go to the smaller name and are rejected. Rows keep their number, repeated or with null ids as
    they are; an empty table gives no rows; other columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sent = _broadcast_dictionaries(docs, dict_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            found = [classify(t.as_py(), sent.value, level, chunk, margin) for t in batch.column(1)]
            held = [zlib.crc32(b"" if x is None else str(x).encode()) % 3 == 1 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
