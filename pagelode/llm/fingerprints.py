"""Document fingerprints by MinHash with universal hash permutations.

A text's shingles are its runs of five words (all its words, if fewer). Each of
the permutations x -> a * x + b modulo 2**32, a odd, keeps the smallest value
of a text; 16 mixed bits of each are the fingerprint, as hexadecimal text. The
share of equal registers of two fingerprints estimates their Jaccard
similarity. near_duplicates() joins texts that share a band of registers and
verifies the Jaccard similarity on their shingles.

Null counts as empty text. Empty texts have no shingle and all the same
fingerprint, which is like no other; equal texts have equal fingerprints.
Repeated rows get rows of their own with equal fingerprints. In the order of rows a
null key comes after all others, and rows of one key follow each other by their
text. Keys have to be castable to a long. Texts are taken whole, in pieces of
bounded size where the work per shingle is large. An empty table gives an empty
result. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.common import documents, shuffle_partitions, small_batches
from pagelode.llm.shingles import Words, mixed, shingle_hashes, utf8

REGISTERS = 128
WIDTH = 5
SEED = 11
GROUP = 1 << 15
EMPTY = 0xFFFF


class MinHasher:
    def __init__(self, registers: int = REGISTERS, width: int = WIDTH, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 1 << 31, registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, registers, dtype=np.uint32)
        self.registers, self.width, self.words = registers, width, Words()

    def shingles(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return shingle_hashes(*self.words.of(texts), self.width)

    def signatures(self, texts: list[bytes]) -> np.ndarray:
        """One row of 16-bit registers for each text."""
        hashes, number = self.shingles(texts)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.full((len(texts), self.registers), EMPTY, dtype=np.uint16)
        full = np.flatnonzero(number)
        ends = np.cumsum(number[full])
        starts = ends - number[full]
        at = 0
        while at < len(full):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + GROUP, side="right")))
            low = self._minima(x[starts[at] : ends[to - 1]], starts[at:to] - starts[at])
            out[full[at:to]] = ((mixed(low.astype(np.uint64) + np.uint64(1)) >> np.uint64(16)) % np.uint64(EMPTY)).astype(np.uint16).T
            at = to
        return out

    def _minima(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        low = np.full((self.registers, len(starts)), 0xFFFFFFFF, dtype=np.uint32)
        for begin in range(0, len(x), 4 * GROUP):  # one very long text may have more
            part = x[begin : begin + 4 * GROUP]
            own = starts if len(x) <= 4 * GROUP else np.zeros(1, np.int64)
            t = np.empty_like(part)
            for k in range(self.registers):
                np.multiply(part, self.a[k], out=t)
                np.add(t, self.b[k], out=t)
                np.minimum(low[k], np.minimum.reduceat(t, own), out=low[k])
        return low


def as_text(signatures: np.ndarray) -> list[str]:
    big = np.ascontiguousarray(signatures.astype(">u2"))
    return [row.tobytes().hex() for row in big]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal registers, row by row."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every row of df."""
    small_batches(df.sparkSession)
    narrow = df.select(df[key].alias("key"), df[text].alias("text"))
    schema = T.StructType([T.StructField(key, narrow.schema["key"].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_text(hasher.signatures(utf8(batch.column(1)))), pa.string())], schema.fieldNames())

    return narrow.mapInArrow(run, schema)


def with_following(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of df in ranges of the key, one range a task, sorted downwards, and each
    range's successor repeated at its end (halo = 1), so that every row can see
    the next one in descending order; after the last row comes the first.

    The ranges come from approximate quantiles of the keys, one for each
    partition; only they and each range's largest key are gathered. A row finds its
    range by binary search. Rows of one key are in one range, null keys in the last.
    """
    spark = df.sparkSession
    lowest = -(1 << 63)
    narrow = df.select(F.coalesce(df[key].cast("long"), F.lit(lowest)).alias("order"), df[key].alias("key"), df[text].alias("text"))
    parts = shuffle_partitions(spark)
    got = narrow.agg(F.percentile_approx("order", F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(1.0)), F.lit(10 * parts)).alias("cuts")).first()["cuts"]
    cuts = np.array(sorted({x for x in got or [] if x != lowest}), dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(order: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, order.to_numpy(), side="left")).astype(np.int32))

    tops = np.full(len(cuts) + 1, lowest, dtype=np.int64)
    used = []
    for r in narrow.groupBy(bucket("order").alias("bucket")).agg(F.max("order").alias("top")).orderBy("bucket").collect():
        tops[r["bucket"]] = r["top"]
        used.append(r["bucket"])
    above = np.zeros(len(cuts) + 1, dtype=np.int32)  # the range whose end needs a range's first row
    above[used] = np.roll(used, 1)

    @F.pandas_udf("array<int>")
    def places(order: pd.Series) -> pd.Series:
        """A row's range and, for a range's largest key, the range before."""
        values = order.to_numpy()
        own = len(cuts) - np.searchsorted(cuts, values, side="left")
        return pd.Series([[b, int(above[b])] if first else [b] for b, first in zip(own.tolist(), (tops[own] == values).tolist(), strict=True)])

    spread = narrow.select("order", "key", "text", F.posexplode(places("order")).alias("halo", "to"))
    return spread.repartitionById(len(cuts) + 1, F.col("to")).sortWithinPartitions("to", "halo", F.desc("order"), "text")


def compare_following(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_chars, the edited text's digest, both fingerprints, and
    the likeness of its fingerprint to the edited and to the next text's."""
    import hashlib

    spark = df.sparkSession
    small_batches(spark)
    rows = with_following(df, key, text)
    kind = rows.schema["key"].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def finish(hasher: MinHasher, rows: list, key_type: pa.DataType) -> pa.RecordBatch:
        """All but the last of rows, each (key, text, to, halo), the next row being its successor."""
        texts = [r[1] or "" for r in rows]
        own = hasher.signatures([t.encode() for t in texts])
        use = [i for i in range(len(rows) - 1) if not rows[i][3]]
        changed = [edited(texts[i], texts[i + 1]).encode() for i in use]
        other = hasher.signatures(changed)
        own_use, following = own[use], own[[i + 1 for i in use]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in use], key_type), pa.array([len(texts[i]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()), pa.array(as_text(own_use), pa.string()), pa.array(as_text(other), pa.string()),
                pa.array(likeness(own_use, other), pa.float64()), pa.array(likeness(own_use, following), pa.float64()),
            ], schema.fieldNames(),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher()
        held: list = []
        for batch in batches:
            held += list(zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True))
            if len(held) > 1:
                yield finish(hasher, held, batch.schema.field(0).type)
                held = held[-1:]

    return rows.select("key", "text", "to", "halo").mapInArrow(run, schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return compare_following(documents(spark, sf_dir))


def _jaccard(a, b) -> float:
    shared = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return shared / max(len(a[0]) + len(b[0]) - shared, 1)


def _signer(registers: int):
    return MinHasher(registers).signatures


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """key and class_id: classes of texts that share a signature band, Jaccard similarity verified."""
    from pagelode.llm.groups import classes
    from pagelode.llm.probminhash import Weights

    return classes(df, lambda: _signer(125), lambda: Weights(WIDTH).profiles, _jaccard, 125, 5, threshold, key, text)
