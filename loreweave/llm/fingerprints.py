"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

Terms are lower-cased words, weighted by their counts. For each of `PLACES` places a term has r and c from Gamma(2, 1) and
b from U(0, 1), all from hashes of the term and the place, and t = floor(ln w / r + b), ln a = ln c - r (t - b + 1).
The term of least a, with its t, is the sample of the place. Two texts agree in a place with their generalised Jaccard
similarity, so the share of agreeing places estimates it.

The three are drawn in the order that makes most terms cheap. At weight 1, t is 0, a is exponential, y = exp(-r b) uniform and
z = y exp(r) is 1 + E / a, with a, y and E independent; so a, y and E are drawn, and r = ln(z / y), c = a z, b = -ln(y) / r
have the law above. A term of weight 1 needs no more than the hash that gives a; t stays 0 below the weight z, and
from there on t = floor(ln(w / y) / r), and a (y / z)^t takes the place of a.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage
from .words import MIX, mixed

PLACES = 128
_ROUNDS, _AT_ONCE = 4, 32  # a row draws for 32 places at a time: as many as compiled code takes well
_SEEDS = [int(x) for x in mixed(np.arange(1, _AT_ONCE + 1, dtype=np.uint64) * MIX).view(np.int64)]
_BITS = 52  # of the hash that give exp(-a); with one more, it could be 1


def weighted_terms(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A row for each distinct word of each row's lower-cased text, with the columns to keep: term (a hash) and w (its count). A text without a word
    has one row of nulls."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    terms = rows.select(*keep, F.sort_array(F.transform(words, lambda x: F.xxhash64(x))).alias("terms"))
    places = F.when(F.size("terms") > 0, F.sequence(F.lit(0), F.size("terms") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: ~F.get("terms", i).eqNullSafe(F.get("terms", i - 1)))
    runs = terms.select(*keep, "terms", starts.alias("starts")).select(*keep, "terms", "starts", F.posexplode_outer("starts").alias("i", "at"))
    return runs.select(*keep, F.get("terms", F.col("at")).alias("term"), (F.coalesce(F.get("starts", F.col("i") + 1), F.size("terms")) - F.col("at")).alias("w"))


def _unit(bits: str, n: int) -> str:
    """n bits as a number between 0 and 1."""
    return f"(({bits}) + 0.5D) * {2.0**-n!r}D"


def _hash(k: int) -> str:
    """Of the term and place 32 q + k; tq is a hash of the term and q."""
    return f"xxhash64(tq ^ {_SEEDS[k]}L)"


def _u(k: int) -> str:
    """exp(-a) at weight 1."""
    return _unit(f"shiftrightunsigned({_hash(k)}, {64 - _BITS})", _BITS)


def _e(k: int) -> str:
    """exp(-E)."""
    return _unit(f"shiftrightunsigned(xxhash64({_hash(k)}), 32)", 32)


def _y(k: int) -> str:
    return _unit(f"xxhash64({_hash(k)}) & {(1 << 32) - 1}L", 32)


def _least(k: int) -> str:
    """exp(-a) at weight 1 as 63 bits, which also name the sample."""
    return f"shiftrightunsigned({_hash(k)}, 1)"


def _grown(k: int) -> str:
    """exp(-a) at weight w > 1 in the same form, a function of the term and its t; null where it cannot exceed m, the greatest at weight 1,
    or t is 0. As y <= z_t <= w z / y for every t, a is at least (1 - u) y / w, and that of m at most (1 - m) / m: no logarithm is needed
    for most. z <= w just where E <= a (w - 1)."""
    m = f"((m{k} + 0.5D) * {2.0**-63!r}D)"
    z = f"(1 + ln({_e(k)}) / ln({_u(k)}))"
    t = f"greatest(floor(ln(w / ({_y(k)})) / ln({z} / ({_y(k)}))), 1)"
    value = f"shiftleft(least(floor(exp(ln({_u(k)}) * pow(({_y(k)}) / {z}, {t})) * {2.0**53!r}D), {(1 << 53) - 1}L), 10)"
    return f"if((1 - {_u(k)}) * ({_y(k)}) * {m} <= (1 - {m}) * w AND if(w = 2, {_e(k)} >= {_u(k)}, {_e(k)} >= pow({_u(k)}, w - 1)), {value}, NULL)"


def sampled(terms: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(key, keys, term, w) -> (key, keys, q, fp): place << 16 | sample of each of 32 places in order, the one of least a, in a row for each
    q; no terms: empty. Rows that agree in all keys are one text, and those of one key lie in one partition.

    First the least a at weight 1 of every place, a hash a term; then the terms of more weight, which can only gain, meet it again.
    The expressions are SQL texts, as the places share their form.
    """
    every = range(_AT_ONCE)
    tq = "if(term IS NOT NULL, xxhash64(term, q), NULL) AS tq"
    rounds = terms.select("*", F.explode(F.array(*(F.lit(q) for q in range(_ROUNDS)))).alias("q")).selectExpr(key, *keys, "q", tq)
    first = rounds.groupBy(key, *keys, "q").agg(*(F.expr(f"max(if(tq IS NOT NULL, {_least(k)}, NULL)) AS m{k}") for k in every))
    heavy = terms.where("w > 1").select(F.col(key).alias("of"), F.xxhash64(*keys).alias("same"), "term", "w")
    # Joined by the key alone, by which both sides lie already; the rest is compared.
    both = heavy.join(first.hint("shuffle_hash"), (F.col("of") == F.col(key)) & (F.col("same").bitwiseXOR(F.xxhash64(*keys)) == 0), "right")
    both = both.selectExpr(key, *keys, "q", tq, "w", *(f"m{k}" for k in every))
    last = both.groupBy(key, *keys, "q").agg(*(F.expr(f"max(greatest(m{k}, if(tq IS NOT NULL, {_grown(k)}, NULL))) AS v{k}") for k in every))
    places = ", ".join(f"cast((shiftright(v{k}, 10) & 65535) + ((q * {_AT_ONCE} + {k}) << 16) AS int)" for k in every)
    return last.selectExpr(key, *keys, "q", f"if(v0 IS NOT NULL, array({places}), cast(array() AS array<int>)) AS fp")


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing places; two empty fingerprints are alike, an empty one and another are not."""
    filled = F.greatest(F.size(a), F.size(b))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.lower(F.hex(v)), 6, "0")), "")


def next_documents(sizes: DataFrame) -> DataFrame:
    """(doc_id, half) with distinct ids -> (doc_id, next_id, prev_id, prev_half): neighbours in ascending order, as a ring.

    Ids are dealt out by range; only the first and last id of each range meet in one place.
    """
    ranged = stage(sizes.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("part").orderBy("doc_id")
    ends = Window.orderBy("part")
    bound = ranged.groupBy("part").agg(F.min("doc_id").alias("low"), F.max(F.struct("doc_id", "half")).alias("high"))
    after = F.coalesce(F.lead("low").over(ends), F.first("low").over(ends))
    before = F.coalesce(F.lag("high").over(ends), F.last("high").over(ends.rowsBetween(0, Window.unboundedFollowing)))
    bound = bound.select("part", after.alias("after"), before.alias("before"))
    near = ranged.withColumn("next", F.lead("doc_id").over(own)).withColumn("prev", F.lag(F.struct("doc_id", "half")).over(own))
    near = near.join(bound, "part").withColumn("prev", F.coalesce("prev", "before"))
    return near.select("doc_id", F.coalesce("next", "after").alias("next_id"), F.col("prev.doc_id").alias("prev_id"), F.col("prev.half").alias("prev_half"))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document in ascending id, the first after the last. Null texts are empty; empty texts have empty
    fingerprints, alike among themselves. Repeated rows keep their number; where an id has several texts, the
    document before it takes the smallest of their beginnings and of their fingerprints. A null id has no next
    document: nothing is put in, and near_next compares with the empty text. An empty table gives no rows; other
    columns are ignored. Equal texts have equal fingerprints.
    """
    # Rows without an id lie under one of their own and say so, as a null would meet nothing in a join.
    no_id = F.col(id_col).cast("long").isNull()
    docs = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), no_id.alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    sizes = docs.where("NOT no_id").groupBy("doc_id").agg(F.max(half).alias("half"))
    ring = stage(next_documents(sizes), "ring")
    placed = docs.join(ring.hint("shuffle_hash"), "doc_id", "left")
    placed = placed.select("doc_id", "no_id", "text", *(F.when(~F.col("no_id"), F.col(c)).alias(c) for c in ("next_id", "prev_id", "prev_half")))
    given = placed.groupBy(F.col("prev_id").alias("for_id")).agg(F.min(F.expr("left(text, prev_half)")).alias("given"))
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) AS int))"), F.coalesce(F.expr("left(if(no_id, NULL, given), cast(floor(length(text) / 2) AS int))"), F.lit("")))
    both = placed.join(given.hint("shuffle_hash"), F.col("doc_id") == F.col("for_id"), "left").select("doc_id", "no_id", "next_id", "text", edited.alias("edited"))
    # All of a document is in one partition from here on, so that neither its terms nor its samples are shuffled.
    same = both.groupBy("doc_id", "no_id", "next_id", "text", "edited").agg(F.count("*").alias("n"))
    row = ["no_id", "next_id", "n", "n_chars", "digest", "of_text"]
    plain = same.select(
        "doc_id", "no_id", "next_id", "n", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("digest"), F.xxhash64("text").alias("of_text"),
        F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.lower("text").alias("text")), F.struct(F.lit(True).alias("is_edited"), F.lower("edited").alias("text")))).alias("side"),
    )
    sides = [*row, "is_edited"]
    terms = weighted_terms(plain.select("doc_id", *row, "side.is_edited", "side.text"), "text", ["doc_id", *sides])
    signed = sampled(terms, "doc_id", sides)
    part = lambda edited, q: F.first(F.when((F.col("is_edited") == edited) & (F.col("q") == q), F.col("fp")), ignorenulls=True)
    of = lambda edited: F.concat(*(part(edited, q) for q in range(_ROUNDS)))
    marked = signed.groupBy("doc_id", *row).agg(of(False).alias("fp"), of(True).alias("edited_fp"))
    marked = marked.select("doc_id", "no_id", "next_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), "fp", "edited_fp", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("again"))
    marked = stage(marked.drop("again"), "fingerprints")
    others = marked.where("NOT no_id").groupBy(F.col("doc_id").alias("of_id")).agg(F.min("fp").alias("next_fp"))
    none = F.array().cast("array<int>")
    return marked.join(others, F.col("next_id") == F.col("of_id"), "left").select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.coalesce("next_fp", none)).alias("near_next"),
    )
