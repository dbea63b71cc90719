"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame that is written as Parquet and read again for the next one. All but
the last return the columns of documents.

Null and empty texts pass through; they are equal to one another, so one of them
stays after the near duplicates. Rows that repeat a key, or have none, are rows of their
own up to the mix: a repeated row goes as an exact copy, and of rows with one key
and different texts each stays on its own. Texts are worked on whole, however
long. Without labels nothing is toxic. Columns beside those of documents are
dropped by the first stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import bpe, bwt, mixing, probminhash, toxicity
from pagelode.llm.common import documents, drop_table, give_back, numbered, table, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    give_back()
    return toxicity.drop_toxic(docs.select(COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    rows = numbered(docs.select(COLUMNS), "doc_id")
    found = probminhash.near_duplicate_classes(rows, key="_rid")
    kept = found.filter(F.col("_rid") == F.col("class_id")).select("_rid")
    return rows.join(kept, "_rid", "left_semi").select(COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that start anywhere else go from every text; n_chars follows."""
    rows = numbered(docs.select(COLUMNS), "doc_id")
    cleaned = bwt.without_repeats(rows, key="_rid", as_text=True)
    others = [c for c in COLUMNS if c not in ("text", "n_chars")]
    joined = rows.select("_rid", F.col("text").isNull().alias("none"), *others).join(cleaned, "_rid")
    text = F.when(~F.col("none"), F.col("kept"))
    return joined.select(*others, text.alias("text"), F.col("kept_chars").alias("n_chars")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it."""
    rows = numbered(docs.select(COLUMNS), "doc_id")
    taken = mixing.mix(rows, key="_rid").select("_rid", "copies").filter("copies > 0")
    return rows.join(taken, "_rid").select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the digests of ids and decoded bytes."""
    ranks, pattern = bpe.default_ranks()
    return bpe.bpe_encode(docs, ranks, pattern, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mixing", mix_sources),
    ("tokens", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs)
            if before is not None:
                drop_table(before)
            before = docs
    return docs
