"""The subpackage's queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints as fp
from . import bin_slack, collocations, language_id, line_dedup, mixing, neighbours, ngram_join, packing, pii, token_rollup, url_filter, whitening
from .scratch import by_hot_key, new_path, stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document with the numbers of its removed lines, comma-joined."""
    found = line_dedup.repeated_lines(_table(spark, sf_dir, "documents"), short=True)
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.fingerprints(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document inserted under two tokenizer versions, the second with the counts of the first until a batch revises them, then
    exact copies deleted; the last batches are committed twice."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    words, pieces = token_rollup.VERSIONS
    counted = [token_rollup.token_count(F.col("text"), v).alias(v) for v in (words, pieces)]
    docs = stage(docs.select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), *counted), "counted")

    def change(rows: DataFrame, version: str, sign: int, counts: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).alias("sign"), F.col(counts).alias("tokens"))

    first = stage(docs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copied")
    copies = by_hot_key(docs, first, "digest", "n").where("doc_id <> first")
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "rollup"))
    rollup.commit("load-words", change(docs, words, 1, words))
    rollup.commit("load-pieces", change(docs, pieces, 1, words))
    for _ in range(2):
        rollup.commit("revise-pieces", change(docs, pieces, -1, words).union(change(docs, pieces, 1, pieces)))
        rollup.commit("retire-copies", change(copies, words, -1, words).union(change(copies, pieces, -1, pieces)))
    return rollup.totals()


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors.where("vec_id % 100 = 0"), vectors)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack_whole(_table(spark, sf_dir, "documents"), vocabulary())


OP9_SQL = r"""
WITH kept AS (
  SELECT source, lang, coalesce(text, '') AS text FROM documents
  QUALIFY doc_id = min(doc_id) OVER (PARTITION BY md5(coalesce(text, '')))
), counted AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'pieces-1', len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) FROM kept
)
SELECT source, lang, version, count(*)::BIGINT AS documents, sum(n)::BIGINT AS tokens FROM counted GROUP BY ALL
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM docs
), grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 5) AS sizes(m) WHERE len(w) >= m)
  GROUP BY ALL
), sizes AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang
), often AS (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f FROM grams WHERE f >= 30
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM often WHERE m > 1)
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.first JOIN often y ON y.lang = c.lang AND y.phrase = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(f) AS over
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM often WHERE m > 2))
  GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE h.over IS NULL OR 100::HUGEINT * h.over < 80::HUGEINT * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN sizes USING (lang)
QUALIFY rank <= 2000
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_language_id, op3_packing, op4_mixing, op5_pii, op6_line_dedup,
        op7_url_filter, op8_fingerprints, op9_token_counts, op10_nearest_neighbours, op11_whitening, op12_collocations, op13_bin_slack,
    )
}
ORACLES = {"op9_token_counts": OP9_SQL, "op12_collocations": OP12_SQL}
