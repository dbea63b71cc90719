"""Language identification by word-first backoff.

Known words are scored by their log frequency in each language; a word that no
language has is scored by its known character n-grams, the longest order first
and progressively shorter ones after. Words are runs of letters, lower case.

The model is fitted on a bounded sample of the labelled training rows, at most
`max_rows` rows and `max_chars` characters of each language, picked by a hash
of the key (documented bounds; every row is used while they aren't reached).
Counting, of n-grams too, is done by Spark. A word or n-gram that the sample
holds fewer than `least` times has no row of its own; the n-grams of such a word
count all the same. Every text is then scored whole.

Null text or text without a letter: `und`, score 0. No training rows at all:
`und`, score 0. No known piece in the text: the language with the most training
rows, with its share as score. Ties go to the language first in code point
order. Repeated rows get equal rows. An empty table gives an empty result.
Columns other than those named are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.common import documents, small_batches

MAX_ROWS = 4_000
MAX_CHARS = 12_000_000
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
LEAST = 2
LETTERS = regex.compile(r"\p{L}+")


def held_out(key: Column) -> Column:
    """Rows whose crc32 of the key as text leaves 1 when divided by 3 are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(word: str, order: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


class Model:
    """Log frequencies by language, one row for each word and for each n-gram, the mean of a row taken off."""

    def __init__(self, counts: list[tuple[str, int, str, int]], priors: dict[str, int]):
        """counts: piece, order (0 for a whole word, else the length of an n-gram), language, number."""
        self.langs = sorted(priors)
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.prior = np.array([priors[x] for x in self.langs], float)
        self.words: dict[str, int] = {}
        self.pieces: dict[int, dict[str, int]] = {n: {} for n in ORDERS}
        parts = [np.zeros((0, len(self.langs)))]
        start = 0
        for order in (0, *ORDERS):
            own = [(piece, lang, n) for piece, o, lang, n in counts if o == order]
            rows = {piece: i for i, piece in enumerate(sorted({piece for piece, *_ in own}))}
            table = np.full((len(rows), len(self.langs)), SMOOTHING)
            for piece, lang, n in own:
                table[rows[piece], at[lang]] += n
            if rows:
                logs = np.log(table / table.sum(0))
                parts.append(logs - logs.mean(1, keepdims=True))
            held = {piece: start + i for piece, i in rows.items()}
            if order:
                self.pieces[order] = held
            else:
                self.words = held
            start += len(rows)
        self.logs = np.concatenate(parts)

    def backoff(self, word: str) -> list[int]:
        """Rows of the known n-grams of the longest order that has any."""
        for order in ORDERS:
            table = self.pieces[order]
            known = [table[g] for g in grams(word, order) if g in table]
            if known:
                return known
        return []

    def predict(self, text: str | None) -> tuple[str, float]:
        found = LETTERS.findall(text.lower()) if text else []
        if not found or not self.langs:
            return "und", 0.0
        rows: list[int] = []
        weights: list[float] = []
        for word, n in Counter(found).items():
            row = self.words.get(word)
            if row is not None:
                rows.append(row)
                weights.append(n)
            else:
                known = self.backoff(word)
                rows += known
                weights += [n / len(known)] * len(known) if known else ()
        if not rows:
            best = int(np.argmax(self.prior))
            return self.langs[best], float(self.prior[best] / self.prior.sum())
        total = np.array(weights) @ self.logs[rows]
        shares = np.exp(total - total.max())
        best = int(np.argmax(shares))
        return self.langs[best], float(shares[best] / shares.sum())


def piece_counts(words: DataFrame, least: int = LEAST) -> DataFrame:
    """piece, order, lang and number of all words and n-grams of words (lang, word, n) that occur at least `least` times in all languages together."""
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))

    def grams_of(order: int) -> Column:
        starts = F.when(F.length(marked) >= order, F.sequence(F.lit(1), F.length(marked) - (order - 1)))
        return F.transform(starts, lambda i: F.struct(F.substring(marked, i, F.lit(order)).alias("piece"), F.lit(order).alias("order")))

    own = F.array(F.struct(F.col("word").alias("piece"), F.lit(0).alias("order")))
    every = F.concat(own, *[F.coalesce(p, F.filter(own, lambda x: F.lit(False))) for p in map(grams_of, ORDERS)])
    counted = words.select("lang", "n", F.inline(every)).groupBy("piece", "order", "lang").agg(F.sum("n").alias("number"))
    by = counted.groupBy("piece", "order").agg(F.sum("number").alias("total"), F.collect_list(F.struct("lang", "number")).alias("langs"))
    return by.filter(F.col("total") >= least).select("piece", "order", F.inline("langs"))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, least: int = LEAST) -> Model:
    """The model of the labelled rows of df; rows without text or language are no training rows."""
    rows = df.select(df[key].alias("key"), df[text].alias("text"), df[lang].alias("lang")).filter("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    if not sizes:
        return Model([], {})
    part: dict[str, float] = {r["lang"]: min(1.0, max_rows / r["n"], max_chars / max(r["chars"], 1)) for r in sizes}
    of_lang = F.create_map(*[F.lit(x) for lang_part in part.items() for x in lang_part])[F.col("lang")]
    draw = F.pmod(F.xxhash64(F.lit(9), "key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    words = rows.filter(draw < of_lang).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counts = piece_counts(words.groupBy("lang", "word").agg(F.count("*").alias("n")), least).select("piece", "order", "lang", "number").toArrow().to_pydict()
    return Model(list(zip(counts["piece"], counts["order"], counts["lang"], counts["number"], strict=True)), {r["lang"]: r["n"] for r in sizes})


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row of df."""
    spark = df.sparkSession
    small_batches(spark)
    narrow = df.select(df[key].alias("key"), df[text].alias("text"))
    schema = T.StructType([T.StructField(key, narrow.schema["key"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [held.value.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema.fieldNames())

    return narrow.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out(docs["doc_id"])))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
