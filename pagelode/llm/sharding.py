"""Two-pass external shuffle of whole records into shards, in DataFrame operations only.

Pass one scatters every record with its text: a rendezvous hash of its key
picks the shard (so one more shard takes records only into itself) and a seeded
hash picks one of the shard's memory-sized buckets, whose number follows from
the bytes of the texts. Pass two reads each bucket into one array, sorts it (so
that the outcome does not hang on arrival order), applies the built-in
Fisher-Yates `shuffle` and writes the bucket. Sizes, checksums and slots are
read from the written shards; slots go on from the buckets before.

A null key is a key like any other. A null text stays null and has no bytes.
Repeated rows are shuffled like others and keep separate slots; their order
among themselves can't be told apart; exact repeats are in one bucket. An empty
table gives an empty result. A text is never split, so the array of its bucket
is at least as large. The number of tasks follows from the records, too, as
their numbers seed the shuffle: the order hangs on the records and the seed, not
on the session's settings. Columns
other than the key, the text and those asked for in `carry` are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.llm.common import documents, drop_table, write_table

SEED = 20241
BUCKET_BYTES = 64 << 20
BUCKET_ROWS = 1 << 13
LEAST_TASKS, MOST_TASKS = 64, 1 << 15


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is the largest."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("score"), F.lit(i).alias("shard")) for i in range(shards)]
    return F.greatest(*scores)["shard"] if shards > 1 else F.lit(0)


def shuffled_buckets(df: DataFrame, key: str, text: str, shards: int, seed: int, bucket_bytes: int, bucket_rows: int, carry: tuple[str, ...]) -> DataFrame:
    """The written records in shuffled order: _shard, _bucket, _pos in the bucket, _key, _text and _c0, _c1 ... for carry."""
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1), F.lit(0)).alias("b")).first()
    buckets = max(1, math.ceil(total["b"] / (shards * bucket_bytes)), math.ceil(total["n"] / (shards * bucket_rows)))
    parts = min(max(4 * buckets * shards, LEAST_TASKS), MOST_TASKS)
    records = df.select(
        df[key].alias("_key"),
        df[text].alias("_text"),
        *[df[c].alias(f"_c{i}") for i, c in enumerate(carry)],
        rendezvous(df[key], shards, seed).cast("int").alias("_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), df[key], df[text]), F.lit(buckets)).alias("_bucket"),
    )
    items = [c for c in records.columns if c not in ("_shard", "_bucket")]
    shuffled = (
        records.repartition(parts, "_shard", "_bucket")
        .groupBy("_shard", "_bucket")
        .agg(F.sort_array(F.collect_list(F.struct(*items))).alias("_items"))
        .sortWithinPartitions("_shard", "_bucket")
        .select("_shard", "_bucket", F.shuffle("_items", F.lit(seed + 2)).alias("_items"))
    )
    return write_table(shuffled.select("_shard", "_bucket", F.posexplode("_items").alias("_pos", "_item")).select("_shard", "_bucket", "_pos", "_item.*"))


def shuffle_into_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, size, text_crc32, the carried columns, shard, slot and grown_shard (with one shard more), from the written shards."""
    written = shuffled_buckets(df, key, text, shards, seed, bucket_bytes, bucket_rows, carry)
    offsets = written.groupBy("_shard", "_bucket").count().select(
        "_shard", "_bucket", (F.sum("count").over(W.partitionBy("_shard").orderBy("_bucket")) - F.col("count")).alias("_before")
    )
    body = F.coalesce("_text", F.lit(""))
    return written.join(F.broadcast(offsets), ["_shard", "_bucket"]).select(
        F.col("_key").alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("_shard").alias("shard"),
        (F.col("_before") + F.col("_pos")).cast("long").alias("slot"),
        rendezvous(F.col("_key"), shards + 1, seed).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, carry: tuple[str, ...] = ()) -> None:
    """Write the shards as folders shard=0, shard=1 and so on, the buckets of a shard as folders in order and
    the records of a bucket in order: the key, the text, the carried columns and _pos, the place in the bucket."""
    written = shuffled_buckets(df, key, text, shards, seed, bucket_bytes, bucket_rows, carry)
    columns = [F.col("_key").alias(key), F.col("_text").alias(text), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]]
    rows = written.select(F.col("_shard").alias("shard"), F.col("_bucket").alias("bucket"), "_pos", *columns)
    rows.sortWithinPartitions("shard", "bucket", "_pos").write.partitionBy("shard", "bucket").parquet(path)
    drop_table(written)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `key`."""
    return shuffle_into_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
