"""PDF files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions.document import FULL_LIMIT


def read_pdfs(spark: SparkSession, path: str, most: int = FULL_LIMIT) -> DataFrame:
    """doc_id (the path), path, length, modified and content of the PDF files below path.

    Files over `most` bytes keep their row with no content; the filter on length reaches
    the scan, so theirs isn't read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    names = [F.col("path").alias("doc_id"), "path", "length", F.col("modificationTime").alias("modified")]
    whole = files.filter(F.col("length") <= most).select(*names, "content")
    rest = files.filter(F.col("length") > most).select(*names, F.lit(None).cast("binary").alias("content"))
    return whole.unionByName(rest)
