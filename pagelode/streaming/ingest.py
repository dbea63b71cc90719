"""Ingestion of PDF files as they arrive; the latest version of a path counts, within a batch and across them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_pdfs(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """An unbounded DataFrame of documents below path."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(F.col("path").alias("doc_id"), "path", "length", F.col("modificationTime").alias("modified"), "content")


def latest(docs: DataFrame, key: str = "path") -> DataFrame:
    """Of each path, or whatever names a document, the version modified last."""
    order = W.partitionBy(key).orderBy(F.col("modified").desc(), F.col("length").desc())
    return docs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def write_relations(docs: DataFrame, transform, out: str, checkpoint: str):
    """Start a query that parses what has arrived and writes transform(batch), keyed by doc_id, below out.

    Each batch has a folder of its own, which a batch that runs again writes anew, so rows
    are never there twice. Beside them stands which documents it held, and from when.
    """

    def batch(df: DataFrame, number: int) -> None:
        newest = latest(df, "doc_id")
        newest.select("doc_id", "modified").write.mode("overwrite").parquet(f"{out}/arrivals/batch={number}")
        transform(newest).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The rows that write_relations() wrote of the latest version of each document, over all batches."""
    rows, arrivals = spark.read.parquet(f"{out}/rows"), spark.read.parquet(f"{out}/arrivals")
    last = arrivals.groupBy("doc_id").agg(F.max_by("batch", F.struct("modified", "batch")).alias("batch"))
    return rows.join(last, ["doc_id", "batch"]).drop("batch")
