"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

Every document of a source has the same expected number of copies, target / source size. Its whole part is
certain; the fractional parts are rounded in pairs: words are moved between the two documents, in a direction
drawn at random so that both expectations stay, until one of the parts is 0 or 1. Hashed groups of a source
are folded so, each leaves one residual at most, and the residuals are folded again, level by level, until a
source has one, which goes to the nearer whole number. What a source is then off its target, half of that document at most, is set right
by turning some smaller documents of the source to the other side, as far as their sizes fit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage

_ITEM = "struct<doc_id:bigint,size:bigint,n:bigint,mass:double,p:double>"
_EPS = 1e-9


def word_count(text: Column) -> Column:
    """Runs of `[^\\x20\\x09-\\x0D]+` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, size) -> one row per source: sid, source, rows, source_size, target.

    Sources in code point order, null last, have the weights in turn and share the sum of all sizes. A target
    stops at cap times its source's size and the excess is shared out again by weight. That is water-filling:
    in order of cap / weight, the first source that its share does not fill sets the level for the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(every).cast("long"))
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    filling = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    below = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    share = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(below), F.lit(0.0))
    per = per.withColumn("level", left / share).withColumn("place", F.row_number().over(filling))
    holds = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))
    level = F.coalesce(F.min(holds).over(Window.partitionBy())["level"], F.lit(float("inf")))
    return per.select("sid", "source", "rows", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def _pivot(items: Column, seed: int) -> Column:
    """Fold items -> struct(rest: the one item still fractional or null, done: items with p 0 or 1)."""

    def step(acc: Column, x: Column) -> Column:
        r = acc["rest"]

        def moved(v: Column) -> Column:
            # a: words that r can gain from x; b: words that x can gain from r
            a, b = F.least(v["r_up"], v["x_down"]), F.least(v["r_down"], v["x_up"])
            return _let(F.struct((v["u"] * (a + b) < b).alias("up"), a.alias("a"), b.alias("b")), lambda m: settle(v, m))

        def settle(v: Column, m: Column) -> Column:
            r_done = F.when(m["up"], v["r_up"] <= v["x_down"]).otherwise(v["r_down"] <= v["x_up"])
            x_done = F.when(m["up"], v["x_down"] <= v["r_up"]).otherwise(v["x_up"] <= v["r_down"])
            r_p = F.when(r_done, m["up"].cast("double")).otherwise(r["p"] + F.when(m["up"], m["a"]).otherwise(-m["b"]) / r["mass"])
            x_p = F.when(x_done, (~m["up"]).cast("double")).otherwise(x["p"] + F.when(m["up"], -m["a"]).otherwise(m["b"]) / x["mass"])
            new_r, new_x = r.withField("p", r_p), x.withField("p", x_p)
            rest = F.when(~r_done, new_r).when(~x_done, new_x)
            done = F.when(r_done & x_done, F.array(new_r, new_x)).when(r_done, F.array(new_r)).otherwise(F.array(new_x))
            return F.struct(rest.cast(_ITEM).alias("rest"), F.concat(acc["done"], done).cast(f"array<{_ITEM}>").alias("done"))

        reach = F.struct(
            ((1 - r["p"]) * r["mass"]).alias("r_up"), (r["p"] * r["mass"]).alias("r_down"),
            ((1 - x["p"]) * x["mass"]).alias("x_up"), (x["p"] * x["mass"]).alias("x_down"),
            (F.pmod(F.xxhash64(F.lit(seed), r["doc_id"], r["size"], x["doc_id"], x["size"]), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("u"),
        )
        first = F.struct(x.cast(_ITEM).alias("rest"), acc["done"].cast(f"array<{_ITEM}>").alias("done"))
        return F.when(r.isNull(), first).otherwise(_let(reach, moved))

    start = F.struct(F.lit(None).cast(_ITEM).alias("rest"), F.array().cast(f"array<{_ITEM}>").alias("done"))
    return F.aggregate(items, start, step)


def _fold(rows: DataFrame, seed: int) -> DataFrame:
    """(sid, g, item) -> (sid, g, rest, done): largest documents first, so that a small one is left over."""
    largest_first = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("item.mass").alias("mass"), F.col("item.doc_id").alias("doc_id"), "item"))))
    folded = rows.groupBy("sid", "g").agg(_pivot(F.transform(largest_first, lambda t: t["item"]), seed).alias("f"))
    return folded.select("sid", "g", "f.rest", "f.done")


def _turned(decided: DataFrame, last: DataFrame, each: int = 4) -> DataFrame:
    """(sid, doc_id, size) of the documents whose turn to the other side brings their source nearest to its target: of those rounded up where it
    takes too much, else of those rounded down, largest first, each that the words left over have room for. `each` documents of every
    doubling of size stand for all, so a source has a bounded list."""
    off = last.where("over <> 0").select("sid", "over")
    fits = decided.join(off, "sid").where((F.col("item.mass") <= F.abs("over")) & (F.col("item.p") == (F.col("over") > 0).cast("double")))
    place = F.row_number().over(Window.partitionBy("sid", F.floor(F.log2("item.mass"))).orderBy(F.col("item.mass").desc(), "item.doc_id"))
    listed = fits.withColumn("place", place).where(F.col("place") <= each)
    some = F.struct(F.col("item.mass").alias("mass"), F.col("item.doc_id").alias("doc_id"), F.col("item.size").alias("size"))
    lists = listed.groupBy("sid").agg(F.abs(F.first("over")).alias("left"), F.reverse(F.array_sort(F.collect_list(some))).alias("items"))
    none = F.array().cast("array<struct<mass:double,doc_id:bigint,size:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        return F.when(x["mass"] <= acc["left"], F.struct((acc["left"] - x["mass"]).alias("left"), F.concat(acc["picked"], F.array(x)).alias("picked"))).otherwise(acc)

    picked = F.aggregate("items", F.struct(F.col("left"), none.alias("picked")), step, lambda acc: acc["picked"])
    return lists.select("sid", F.explode(picked).alias("x")).select("sid", "x.doc_id", "x.size")


def mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    cap: float = 3.0,
    seed: int = 17,
    fan_in: int = 32,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    copies is a whole number from 0 to cap; taken = size * copies. Null texts have size 0 and null sources are a
    source of their own. Repeated rows (equal id, source and size) take the same number of copies, as one unit;
    ties in size go by id. An empty table gives no rows; other columns are ignored. Draws are hashes of seed and
    ids, so reruns agree.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = stage(docs, "sizes")
    targets = stage(source_targets(sizes, weights, cap), "targets")
    units = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        units.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("base", F.floor(rate + _EPS)).withColumn("p", F.greatest(rate - F.col("base"), F.lit(0.0)))
        .withColumn("item", F.struct("doc_id", "size", "n", (F.col("size") * F.col("n")).cast("double").alias("mass"), F.col("p").cast("double").alias("p")))
    )
    split = (F.col("p") > _EPS) & (F.col("size") > 0)
    certain = units.where(~split).select("sid", F.col("item").withField("p", F.lit(0.0)).alias("item"))
    drawn = units.where(split)
    # A source's groups go by the number of its rows, which its target came with: nothing is dealt by source alone.
    leaves = drawn.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.ceil(F.col("rows") / fan_in))).select("sid", "g", "item")
    most = -(-(targets.agg(F.max("rows")).first()[0] or 1) // fan_in)
    level = stage(_fold(leaves, seed), "fold")
    done = [level.select("sid", F.explode("done").alias("item"))]
    while most > 1:
        most = -(-most // fan_in)
        above = level.where("rest IS NOT NULL").select("sid", F.floor(F.col("g") / fan_in).alias("g"), F.col("rest").alias("item"))
        level = stage(_fold(above, seed), "fold")
        done.append(level.select("sid", F.explode("done").alias("item")))
    last = level.where("rest IS NOT NULL").select("sid", F.col("rest").withField("p", F.round("rest.p")).alias("item"), ((F.round("rest.p") - F.col("rest.p")) * F.col("rest.mass")).alias("over"))
    decided = done[0]
    for more in done[1:]:
        decided = decided.union(more)
    turned = _turned(decided, last).select(F.col("sid").alias("of"), F.col("doc_id").alias("turned_id"), F.col("size").alias("turned_size"))
    same = (F.col("sid") == F.col("of")) & F.col("item.doc_id").eqNullSafe(F.col("turned_id")) & (F.col("item.size") == F.col("turned_size"))
    item = F.when(F.col("of").isNotNull(), F.col("item").withField("p", 1 - F.col("item.p"))).otherwise(F.col("item"))
    decided = decided.join(turned, same, "left").select("sid", item.alias("item"))
    out = certain.union(decided).union(last.select("sid", "item"))
    copies = (F.floor(rate + _EPS) + F.round("item.p")).cast("long")
    return (
        out.join(targets.drop("rows"), "sid").withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("item.n").cast("int"))))
        .select("item.doc_id", "source", "item.size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents themselves, each as many times as mix() takes it, columns as they are. Rows that share an id, or have none, are taken as often as the most taken of them."""
    taken = mix(documents, id_col=id_col, **options).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies")).where("__copies > 0")
    rows = documents.join(taken.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col("__id")))
    return rows.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*(documents[c] for c in documents.columns))
