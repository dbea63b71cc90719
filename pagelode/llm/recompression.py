"""Removal of word passages that an earlier document has, by recompression.

Words are symbols. Each round first replaces maximal runs of one symbol, then
pairs of neighbours of which the left one falls in one half of the alphabet and
the right one in the other (the halves are drawn anew each round by a hash); a
new symbol's name is a hash of what it stands for, so equal strings get equal
names everywhere without exchanging them. As no symbol grows beyond a round's
limit, a round changes at most the symbols at the ends of a window: after the
last round all occurrences of a window have the same symbols in its interior.
The smallest of these is the window's anchor; the words around it that all
windows with this anchor hold name it. Anchors that another document shares
reveal possible repeats. These are verified on the words themselves, by their
MD5 (one space between two): pieces of equal words carry the smallest document
they occur in, and where pieces of an anchor differ, their windows are compared
one by one. Names and anchors only bring candidates together; a clash of their
hashes costs work, not a word.

A window is removed where its words also start in a document with a smaller
key. Null text has no words. A null key counts as greater than all others.
Documents that repeat a key are not before one another. Texts shorter than a
window keep all their words. Keys have to be castable to a long. An empty table
gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.common import documents, drop_table, keyed, small_batches, write_table
from pagelode.llm.repeats import anchored, digests, hits, lists, merged, sliding_minimum, spans_by_row, supplied
from pagelode.llm.shingles import Polynomial, Words, mixed, utf8

WINDOW = 50
LIMITS = (2, 2, 3)  # words that a symbol may stand for after each round
CHUNK = 1 << 17
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def edge(limits: tuple[int, ...]) -> int:
    """Words at either end of a window whose symbols may hang on what is outside."""
    return sum(2 * limit - 1 for limit in limits)


def recompress(symbols: np.ndarray, spans: np.ndarray, text: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and spans (in words) after all rounds; symbols of different texts never join."""
    for level, limit in enumerate(limits):
        if not len(symbols):
            break
        begins = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(begins)
        count = np.diff(np.append(first, len(symbols)))
        join = (count > 1) & (count * spans[first] <= limit)
        keep = begins | ~np.repeat(join, count)
        at = np.cumsum(keep) - 1
        one = at[first[join]]
        n, s = symbols[keep], spans[keep]
        n[one] = mixed(n[one] * np.uint64(0x9FB21C651E98DF25) + count[join].astype(np.uint64) + np.uint64(level << 32))
        s[one] = s[one] * count[join]
        text = text[keep]
        symbols, spans = n, s
        side = (mixed(symbols + np.uint64(0xA0761D6478BD642F * (level + 1) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(~side[:-1] & side[1:] & (text[:-1] == text[1:]) & (spans[:-1] + spans[1:] <= limit))
        symbols[pair] = mixed(symbols[pair] * np.uint64(0xE7037ED1A0B428DB) + mixed(symbols[pair + 1]) + np.uint64(level))
        spans[pair] += spans[pair + 1]
        keep = np.ones(len(symbols), bool)
        keep[pair + 1] = False
        symbols, spans, text = symbols[keep], spans[keep], text[keep]
    return symbols, spans


class WordScanner:
    """The anchored pieces of texts, in words."""

    def __init__(self, window: int = WINDOW, limits: tuple[int, ...] = LIMITS):
        self.window, self.limits = window, limits
        self.words, self.polynomial = Words(), Polynomial()
        self.edge = edge(limits)
        self.room = window - 2 * self.edge - max(limits) + 1  # positions where an anchor may start
        assert self.room > max(limits), "the window is too short for the rounds"

    def prepare(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text's words with one space after each, and where they start and end."""
        for _, _, data, start, end, _ in self.words.groups([text]):
            return data, start, end

    def windows(self, prepared, first: int, n: int) -> np.ndarray:
        """The MD5 of each of n windows from the first, as two integers."""
        data, start, end = prepared
        a, b = start[first : first + n].tolist(), end[first + self.window - 1 : first + n + self.window - 1].tolist()
        return np.frombuffer(b"".join([hashlib.md5(data[x:y]).digest() for x, y in zip(a, b, strict=True)]), dtype=np.int64).reshape(n, 2)

    def pieces(self, texts: list[bytes]):
        """which, first, n, core, piece and anchor arrays, some texts at a time."""
        for which, counts, data, start, end, hashes in self.words.groups(texts):
            ends = np.cumsum(counts)
            held: list[tuple[int, int, int, int]] = []
            size = 0
            for i in np.flatnonzero(counts >= self.window):
                lo = int(ends[i] - counts[i])
                for at in range(0, int(counts[i]) - self.window + 1, CHUNK):
                    hi = min(lo + at + CHUNK + self.window - 1, int(ends[i]))
                    held.append((which[i], at, lo + at, hi))
                    size += hi - lo - at
                    if size >= CHUNK:
                        yield self._scan(held, data, start, end, hashes)
                        held, size = [], 0
            if held:
                yield self._scan(held, data, start, end, hashes)

    def _scan(self, held: list[tuple[int, int, int, int]], data: bytes, begins: np.ndarray, stops: np.ndarray, hashes: np.ndarray):
        words, begins, stops = (np.concatenate([x[lo:hi] for _, _, lo, hi in held]) for x in (hashes, begins, stops))
        sizes = np.array([hi - lo for _, _, lo, hi in held])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        symbols, spans = recompress(words.copy(), np.ones(len(words), dtype=np.int64), np.repeat(np.arange(len(held)), sizes), self.limits)
        at = np.cumsum(spans) - spans
        keys = np.full(len(words), _NONE)
        keys[at] = (symbols >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
        low = (sliding_minimum(keys, self.room) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        windows = sizes - self.window + 1
        which = np.repeat(np.arange(len(held)), windows)
        own = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)
        anchor = low[own + self.edge]
        first, n = anchored(which, anchor)
        start, p, w = own[first], anchor[first], which[first]
        core = self.polynomial.of(self.polynomial.table(words), p - self.edge, p - self.edge - self.room + 1 + self.window)
        piece = digests(data, begins[start], stops[start + n + self.window - 2])
        back = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        return back[0][w], start - starts[w] + back[1][w], n, core, piece, p


def earlier_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """rid and spans (ranges of starts of windows that a row with a smaller doc has) of rows (rid, doc, text)."""
    scanner = lambda: WordScanner(window)
    found = hits(rows, scanner, F.col("low") < F.col("high"))
    distinct = found.groupBy("core", "piece").agg(F.min("doc").alias("low"), F.min(F.struct("rid", "first", "n")).alias("at"))
    distinct = write_table(distinct.select("core", "piece", "low", "at.rid", "at.first", "at.n"))
    mixed_cores = distinct.groupBy("core").agg(F.min("piece").alias("x"), F.max("piece").alias("y")).filter("x <> y").select("core")
    mixed_cores = write_table(mixed_cores)
    several = write_table(distinct.join(mixed_cores, "core", "left_semi"))
    drop_table(mixed_cores)

    def take(scan: WordScanner, prepared, first: int, n: int, carried: list):
        for i, (a, b) in enumerate(scan.windows(prepared, first, n).tolist()):
            yield i, a, b, carried[0]

    windows = supplied(rows, several, scanner, take, "i int, a long, b long, low long", ["low"])
    windows = write_table(windows)
    least = write_table(windows.groupBy("a", "b").agg(F.min("low").alias("least"), F.count("*").alias("k")).filter("k > 1").drop("k"))
    shared = windows.join(least, ["a", "b"], "left").select("core", "piece", "i", F.coalesce("least", "low").alias("least"))
    by_window = shared.groupBy("core", "piece").agg(F.collect_list(F.struct("i", "least")).alias("each"))
    # the smallest document of a piece where all pieces of its core are equal, else that of each of its windows
    known = write_table(distinct.select("core", "piece", "low").join(by_window, ["core", "piece"], "left"))
    for table in (windows, least, several, distinct):
        drop_table(table)
    marked = found.join(known, ["core", "piece"])
    whole = F.when(F.col("low") < F.col("doc"), F.array(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("end"))))
    apart = F.transform(F.filter("each", lambda x: x["least"] < F.col("doc")), lambda x: F.struct((F.col("first") + x["i"]).alias("start"), (F.col("first") + x["i"] + 1).alias("end")))
    ranges = marked.select("rid", F.explode(F.when(F.col("each").isNull(), whole).otherwise(apart)).alias("r"))
    return spans_by_row(ranges.select("rid", "r.start", "r.end"))


def without_earlier(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """For each row of df: key, n_words, n_removed, and the kept words joined by one space or, with digest, their kept_sha256."""
    small_batches(df.sparkSession)
    rows = keyed(df, key, text)
    joined = rows.join(earlier_spans(rows, window), "rid", "left").select("key", "text", "spans")
    last = "kept_sha256" if digest else "kept"
    schema = T.StructType([T.StructField(key, joined.schema["key"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(last, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = WordScanner(window)
        for batch in batches:
            sizes, removed, out = [], [], []
            for raw, (start, end) in zip(utf8(batch.column(1)), lists(batch.column(2), ("start", "end")), strict=True):
                data, begins, stops = scan.prepare(raw)
                kept, at, gone = [], 0, 0
                for a, b in [*merged(start, end, window), (len(begins), len(begins))]:
                    if a > at:
                        kept.append(data[begins[at] : stops[a - 1]])
                    gone += b - a
                    at = b
                sizes.append(len(begins))
                removed.append(gone)
                joined_words = b" ".join(kept)
                out.append(hashlib.sha256(joined_words).hexdigest() if digest else joined_words.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], schema.fieldNames())

    return joined.mapInArrow(run, schema)


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return without_earlier(documents(spark, sf_dir), digest=True)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS gone FROM s),
g AS (SELECT w.*, coalesce(bool_or(f.gone) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM w LEFT JOIN f USING (doc_id, i)),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
