"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame
operations only.

Sources in code point order (null last) get weights 3, 1, 2, 3, ...; together
they are to give `share` times all words, none more than `most` times its own,
the excess shared again by weight. Every document of a source then has the
same expected number of copies, target / source_size. Its whole part is taken;
the fractional parts are rounded pivotally: two documents of a source trade
probability, weighted by their words so that the expected words stay the same,
until one of the two is integral; which way is drawn by a seeded hash. Leaves
of a reduction tree hold bounded numbers of documents; what is left over from
each leaf (one document at most) is combined level by level up to one per
source, and that last one is drawn. So a source's words miss its target by
less than one document.

A null text has size 0 and is never taken. A null source is a source of its
own, after the others. Repeated rows are rounded separately; where keys repeat, a
row's number joins its key, so that copies of one row spread over all leaves
(which of them is taken then hangs on the order of the input). An empty table
gives an empty result. Columns other than those named are not read. Targets are
found from one row per source, in one task; the rounding isn't.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.llm.common import WORD_PATTERN, cut, documents

SEED = 77
FAN_IN = 64
SOURCES_BROADCAST = 20_000
# The weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    The sharing again ends where all sources below their limit have the same
    words per weight; with the sources in order of limit per weight that level
    is found by running sums, over one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1)
    )
    ranked = ranked.withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = ranked.select(
        "*",
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
        (share * F.sum("source_size").over(everything)).alias("wanted"),
    ).withColumn("each", (F.col("wanted") - F.col("full")) / F.col("open"))
    level = level.withColumn("found", F.min(F.when(F.col("each") <= F.col("ratio"), F.struct("ratio", "rank", "each"))).over(everything)["each"])
    target = F.when(F.col("found").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("found") * F.col("weight")))
    return level.select("source", "source_size", target.alias("target"))


def _settle(items: Column, seed: int) -> Column:
    """Fold an array of (size, key, tie, p) with 0 < p < 1: what became integral, and the one item left, if any."""
    item = "struct<size:bigint,key:string,tie:bigint,p:double>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("left"))

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["key"].alias("key"), x["tie"].alias("tie"), p.alias("p"))

    def trade(a: Column, b: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), a["key"], a["tie"], b["key"], b["tie"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])  # words from b to a
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        moved = F.when(u * (up + down) < down, up).otherwise(-down)
        snap = lambda p: F.when(p < 1e-9, F.lit(0.0)).when(p > 1 - 1e-9, F.lit(1.0)).otherwise(p)
        return F.struct(with_p(a, snap(a["p"] + moved / a["size"])).alias("a"), with_p(b, snap(b["p"] - moved / b["size"])).alias("b"))

    def step(state: Column, x: Column) -> Column:
        pair = F.transform(F.array(trade(state["left"], x)), lambda t: F.when(t["a"]["p"].isin(0.0, 1.0), F.struct(t["a"].alias("out"), t["b"].alias("left"))).otherwise(F.struct(t["b"].alias("out"), t["a"].alias("left"))))
        return F.when(state["left"].isNull(), F.struct(state["done"].alias("done"), x.alias("left"))).otherwise(
            F.element_at(F.transform(pair, lambda r: F.struct(F.concat(state["done"], F.array(r["out"])).alias("done"), r["left"].alias("left"))), 1)
        )

    return F.aggregate(items, start, step)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """key, size, source_size, target, copies and taken for each row of df."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    rows = cut(df.select(df[key].alias("_key"), df[source].alias("source"), words(df[text]).alias("size")))
    repeats = rows.groupBy("_key").count().filter("count > 1").limit(1).count()
    rows = rows.withColumn("_row", F.monotonically_increasing_id() if repeats else F.lit(0).cast("long"))
    targets = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    small = targets.count() <= SOURCES_BROADCAST
    t = targets.withColumnRenamed("source", "_source")
    rows = rows.join(F.broadcast(t) if small else t, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)).withColumn("whole", F.floor("rate").cast("int"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(F.lit(0.0)))
    group = ["source", "source_size", "target", "whole"]
    settled = rows.filter("p = 0").select(*group, F.col("_key").cast("string").alias("key"), "size", F.col("p"))
    open_rows = rows.filter("p > 0").select(*group, F.struct("size", F.col("_key").cast("string").alias("key"), F.xxhash64(F.lit(seed), "_key", "size", "_row").alias("tie"), "p").alias("item"))
    n = rows.count()
    depth = max(1, math.ceil(math.log(max(n, 2)) / math.log(FAN_IN)))
    left = open_rows
    for level in range(depth, -1, -1):
        leaves = FAN_IN ** max(level - 1, 0)
        slot = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("item.key"), F.col("item.size"), F.col("item.tie")), F.lit(leaves))
        folded = left.groupBy(*group, slot.alias("slot")).agg(F.collect_list("item").alias("items"))
        folded = folded.select(*group, _settle(F.sort_array("items", asc=False), seed + level).alias("r"))
        folded = cut(folded)
        settled = settled.unionByName(folded.select(*group, F.explode("r.done").alias("x")).select(*group, "x.key", "x.size", "x.p"))
        left = folded.filter("r.left is not null and r.left.p > 0 and r.left.p < 1").select(*group, F.col("r.left").alias("item"))
        whole = folded.filter("r.left is not null and (r.left.p = 0 or r.left.p = 1)").select(*group, "r.left.key", "r.left.size", "r.left.p")
        settled = settled.unionByName(whole)
        if leaves == 1:
            break
    draw = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("item.key"), F.col("item.size")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    last = left.select(*group, F.col("item.key").alias("key"), F.col("item.size").alias("size"), F.when(draw < F.col("item.p"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("p"))
    return settled.unionByName(last).select(
        F.col("key").cast(kind).alias(key), "size", "source", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
