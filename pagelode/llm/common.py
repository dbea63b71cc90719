"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what separates two words in every word-based contract.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

ARROW_ROWS = 512
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that a few very long texts fit a Python worker.

    These are settings of the session that plans read when they run; all operators here set the same ones.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, made known to its context; on one machine alone a temporary folder will do."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from the files."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def give_back() -> None:
    """Return to the system what this process no longer uses; else the driver keeps the memory of a fit to its end."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_table(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table into the checkpoint folder and read it back; drop_table() removes it."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._table_path = path
    return table


def drop_table(df: DataFrame) -> None:
    """Remove a table of write_table() that no later job reads."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._table_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with a column _rid that is unique to the row: the key, as a long, where all keys are unique and none is null."""
    again = df.groupBy(df[key].alias("key")).count().filter("count > 1 or key is null").limit(1).count()
    return cut(df.withColumn("_rid", F.monotonically_increasing_id())) if again else df.withColumn("_rid", F.col(key).cast("long"))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """rid, doc, key and text of df: rid is unique to the row, doc orders the keys (null last); a null text is empty."""
    rows = numbered(df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text")), "key")
    return rows.select(F.col("_rid").alias("rid"), F.coalesce(F.col("key").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), "key", "text")
