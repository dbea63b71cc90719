"""Removal of repeated byte strings by a run-length index.

Every 200-byte window is routed by its anchor, the smallest hash of its 32-byte
grams; only windows whose anchor gram occurs again can repeat. The distinct
pieces (runs of windows) that share an anchor go to one block. A block's pieces
are sorted as one text to their full length (a suffix array), its
Burrows-Wheeler transform is cut into runs, and the ends of the runs are
sampled: where two neighbours in the suffix order are preceded by different
bytes, their common prefix can't be extended to the left, and its length is
kept at both. A pass through the text streams the matching statistics from the
samples alone: each position's match is the longest sampled one before it that
still reaches here. Windows whose match is as long as themselves occur
elsewhere. A piece that occurs whole more than once (its name is a digest of
its bytes) is in the index once, and all of its windows repeat.

Blocks are bounded: where the pieces of an anchor are together longer than a
block, each is split by the windows' distance from the anchor, again and again
until the parts fit. The windows of a part share the bytes that all of them
hold, and equal windows share anchor and distance, so these bytes are the key
of a smaller group; at the end a part is one window and a group one string.

Texts are UTF-8 bytes; null is empty. Matches never cross documents. A text
shorter than the window has nothing removed. Repeated rows are separate
documents, so each one's windows repeat in the other; a null or repeated key is
a key like any other, as long as it can be cast to a long. Removal can cut a
character; the kept bytes are what they are (the pipeline drops such rests). An
empty table gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.common import documents, drop_table, keyed, shuffle_partitions, small_batches, write_table
from pagelode.llm.repeats import anchored, digests, hits, lists, merged, runs, sliding_minimum, spans_by_row, supplied
from pagelode.llm.shingles import _CODE, Polynomial, utf8

WINDOW = 200
GRAM = 32
CHUNK = 1 << 18
BLOCK_BYTES = 1 << 18
TASK_BYTES = 16 << 20
CORES_BROADCAST = 200_000
END = 0xFF  # no byte of UTF-8


class ByteScanner:
    """The anchored pieces of texts."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.polynomial = window, gram, Polynomial()

    @staticmethod
    def prepare(text: bytes) -> bytes:
        return text

    def grams(self, data: bytes) -> np.ndarray:
        sums = self.polynomial.table(_CODE[np.frombuffer(data, dtype=np.uint8)])
        at = np.arange(len(data) - self.gram + 1)
        return self.polynomial.of(sums, at, at + self.gram)

    def anchor(self, piece: bytes) -> int:
        """Where the anchor of a piece's windows is in it."""
        return int(np.argmin(self.grams(piece[: self.window]) >> np.uint64(32)))

    def pieces(self, texts: list[bytes]):
        """which, first, n, core, piece and anchor arrays, some texts at a time."""
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) < self.window:
                continue
            for at in range(0, len(text) - self.window + 1, CHUNK):
                part = text if len(text) <= CHUNK else text[at : at + CHUNK + self.window - 1]
                held.append((i, at, part))
                size += len(part)
                if size >= CHUNK:
                    yield self._scan(held)
                    held, size = [], 0
                if part is text:
                    break
        if held:
            yield self._scan(held)

    def _scan(self, held: list[tuple[int, int, bytes]]):
        data = b"".join(h[2] for h in held)
        grams = self.grams(data)
        keys = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        low = (sliding_minimum(keys, self.window - self.gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.array([len(h[2]) for h in held])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        windows = sizes - self.window + 1
        which = np.repeat(np.arange(len(held)), windows)
        own = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)
        anchor = low[own]
        first, n = anchored(which, anchor)
        start, p, w = own[first], anchor[first], which[first]
        piece = digests(data, start, start + n + self.window - 1)
        back = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        return back[0][w], start - starts[w] + back[1][w], n, grams[p], piece, p


def suffix_array(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of raw ordered by their first depth bytes (rounded up), by prefix doubling from
    8 bytes; each position's group of equal prefixes; and the 8 bytes at each position."""
    n = len(raw)
    wide = np.zeros(n + 8, dtype=np.uint64)
    wide[:n] = raw
    key = (wide[:-1] << np.uint64(8)) | wide[1:]
    key = (key[:-2] << np.uint64(16)) | key[2:]
    key = ((key[:-4] << np.uint64(32)) | key[4:])[:n]
    del wide
    order = np.argsort(key).astype(np.int32)
    fresh = np.ones(n, bool)
    fresh[1:] = np.diff(key[order]) != 0
    group = np.empty(n, dtype=np.int32)
    group[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), np.int32(0)))
    length = 8
    while length < depth:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = np.flatnonzero(tied).astype(np.int32)
        if not len(slots):
            break
        at = order[slots]
        after = at.astype(np.int64) + length
        second = np.where(after < n, group[np.minimum(after, n - 1)] + 1, 0)
        pair = (group[at].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[slots] = at
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        fresh[slots] |= new
        group[at] = np.maximum.accumulate(np.where(new, slots, np.int32(0)))
        length *= 2
    return order, group, key


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of raw with the matches at their ends."""

    def __init__(self, raw: np.ndarray, depth: int, least: int):
        order, _, key = suffix_array(raw, depth)
        n = len(raw)
        before = np.where(order > 0, raw[order - 1].astype(np.int16), -1)
        # first of each run but the first; what precedes a piece is no common byte
        self.ends = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == END)) + 1
        a, b = order[self.ends - 1].astype(np.int64), order[self.ends].astype(np.int64)
        del order, before
        common = self._common(raw, key, a, b, depth)
        long = common >= least
        self.at = np.concatenate([a[long], b[long]])
        self.length = np.concatenate([common[long], common[long]])
        self.size, self.n_runs = n, len(self.ends) + 1

    @staticmethod
    def _common(raw: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        n = len(raw)
        out = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        done = 0
        while len(live) and done < most:
            x, y = a[live] + done, b[live] + done
            inside = (x < n) & (y < n)
            differ = np.where(inside, key[np.minimum(x, n - 1)] ^ key[np.minimum(y, n - 1)], np.uint64(1) << np.uint64(63))
            same = differ == 0
            stop = live[~same]
            rest = differ[~same]
            extra = np.zeros(len(stop), dtype=np.int64)
            for byte in range(1, 8):
                extra += rest < (np.uint64(1) << np.uint64(64 - 8 * byte))
            out[stop] = done + extra
            live = live[same]
            done += 8
        out[live] = done
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match elsewhere, exact where it is long enough to be sampled."""
        reach = np.full(self.size, -1, dtype=np.int64)
        np.maximum.at(reach, self.at, self.at + self.length)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.size), 0) if self.size else reach


def repeated_windows(pieces: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each piece, which of its windows also start elsewhere in pieces."""
    raw = np.frombuffer(b"".join(p + bytes([END]) for p in pieces), dtype=np.uint8)
    depth = max(len(p) for p in pieces) + 1
    statistics = RunLengthIndex(raw, depth, window).matching_statistics()
    out, at = [], 0
    for p in pieces:
        out.append(statistics[at : at + len(p) - window + 1] >= window)
        at += len(p) + 1
    return out


def resolve(pieces: DataFrame, total: int, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """core, piece, lo, hi: ranges of repeated windows of each piece (core, piece, many, bytes); total: bytes of all pieces.

    The pieces of a core are in one block; a task goes through several blocks, one at a time.
    """
    blocks = max(8, -(-total // block_bytes))
    tasks = min(blocks, max(shuffle_partitions(pieces.sparkSession), -(-total // TASK_BYTES)))
    rows = pieces.withColumn("block", F.pmod(F.xxhash64("core"), F.lit(blocks)).cast("long")).repartition(tasks, "block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        now = None

        def finish() -> pa.RecordBatch:
            out = []
            for (core, piece, many, data), flags in zip(held, repeated_windows([h[3] for h in held], window), strict=True):
                for lo, hi in [(0, len(data) - window + 1)] if many > 1 else runs(flags):
                    out.append((core, piece, lo, hi))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["core", "piece", "lo", "hi"])

        for batch in batches:
            for block, *row in zip(*[batch.column(i).to_pylist() for i in (4, 0, 1, 2, 3)], strict=True):
                if block != now and held:
                    yield finish()
                    held = []
                now = block
                held.append(tuple(row))
        if held:
            yield finish()

    return rows.select("core", "piece", "many", "bytes", "block").mapInArrow(run, "core long, piece long, lo int, hi int")


SPLIT = "core long, piece long, at int, group long, part long, many long, x int, lo int, hi int, bytes binary"


def split(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each piece (core, piece, many, x, lo, hi, bytes) cut in two by the distance of its windows
    from the anchor at x, from lo up to hi: SPLIT, where `at` is the part's first window in the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SPLIT.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        for batch in batches:
            out = []
            for core, piece, many, x, lo, hi, data in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                mid = (lo + hi + 1) // 2
                for low, high in ((lo, mid), (mid, hi)):
                    first, last = max(0, x - high + 1), min(len(data) - window, x - low)
                    if low < high and first <= last:
                        part = data[first : last + window]
                        shared = b"%d,%d,%d," % (core, low, high) + data[x - low : x - high + 1 + window]
                        group, name = digests(shared, np.array([0]), np.array([len(shared)])), digests(part, np.array([0]), np.array([len(part)]))
                        out.append((core, piece, first, int(group.view(np.int64)[0]), int(name.view(np.int64)[0]), many, x - first, low, high, part))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k.split()[1]]) for c, k in zip(columns, SPLIT.split(", "), strict=True)], names)

    return pieces.select("core", "piece", "many", "x", "lo", "hi", "bytes").mapInArrow(run, SPLIT)


def resolve_split(pieces: DataFrame, total: int, window: int, block_bytes: int) -> DataFrame:
    """resolve() for the pieces, of `total` bytes, of cores that are longer than a block."""
    gram, block_bytes = min(GRAM, window), max(block_bytes, 4 * window)

    def with_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = ByteScanner(window, gram)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array([scan.anchor(x) for x in batch.column(3).to_pylist()], pa.int32())], ["core", "piece", "many", "bytes", "x"])

    now = pieces.select("core", "piece", "many", "bytes").mapInArrow(with_anchor, "core long, piece long, many long, bytes binary, x int")
    now = now.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(window - gram + 1))
    where = None  # which part of a piece each part of a group is
    done: list[DataFrame] = []
    used: list[DataFrame] = []
    while True:
        parts = write_table(split(now.coalesce(max(8, -(-total // TASK_BYTES))), window))  # few files, if they are small
        links = parts.select(F.col("core").alias("from_core"), F.col("piece").alias("from_piece"), "at", "group", "part")
        if where is None:
            where = links.select(F.col("from_core").alias("core"), F.col("from_piece").alias("piece"), "at", "group", "part")
        else:
            link = where.join(links.withColumnRenamed("at", "more"), (where["group"] == links["from_core"]) & (where["part"] == links["from_piece"])).select("core", "piece", (where["at"] + F.col("more")).alias("at"), links["group"], links["part"])
            where = write_table(link)
            used.append(where)
        bodies = parts.groupBy("group", "part").agg(F.sum("many").alias("many"), F.first("x").alias("x"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("bytes").alias("bytes"))
        bodies = write_table(bodies.select(F.col("group").alias("core"), F.col("part").alias("piece"), "many", "x", "lo", "hi", "bytes"))
        sizes = bodies.groupBy("core").agg(F.sum(F.length("bytes")).alias("size"))
        large = write_table(sizes.filter(F.col("size") > block_bytes).select("core"))
        n_large, total = large.count(), bodies.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0)).alias("n")).first()["n"]
        used += [parts, bodies, large]
        small = bodies.join(large, "core", "left_anti") if n_large else bodies
        got = resolve(small, total, window, block_bytes).withColumnsRenamed({"core": "group", "piece": "part"})
        done.append(write_table(where.join(got, ["group", "part"]).select("core", "piece", (F.col("at") + F.col("lo")).cast("int").alias("lo"), (F.col("at") + F.col("hi")).cast("int").alias("hi"))))
        if not n_large:
            break
        now = bodies.join(large, "core", "left_semi")
    for table in used:
        drop_table(table)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def repeated_spans(rows: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rid and spans (ranges of starts of windows that occur elsewhere) of rows (rid, doc, text)."""
    scanner = lambda: ByteScanner(window)
    found = hits(rows, scanner, F.col("n_at") > 1)
    distinct = found.groupBy("core", "piece").agg(F.count("*").alias("many"), F.min(F.struct("rid", "first", "n")).alias("at"))
    distinct = write_table(distinct.select("core", "piece", F.col("many").cast("long"), "at.rid", "at.first", "at.n"))
    length = F.col("n") + (window - 1)
    total = distinct.agg(F.coalesce(F.sum(length), F.lit(0)).alias("b")).first()["b"]
    large = write_table(distinct.groupBy("core").agg(F.sum(length).alias("b")).filter(F.col("b") > block_bytes))
    n_large, in_large = large.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()

    def take(scan: ByteScanner, text: bytes, first: int, n: int, carried: list):
        yield carried[0], text[first : first + n + window - 1]

    bodies = supplied(rows, distinct, scanner, take, "many long, bytes binary", ["many"])
    if n_large:
        bodies = write_table(bodies)
        known = F.broadcast(large.select("core")) if n_large <= CORES_BROADCAST else large.select("core")
        resolved = write_table(resolve(bodies.join(known, "core", "left_anti"), total, window, block_bytes))
        resolved = resolved.unionByName(resolve_split(bodies.join(known, "core", "left_semi"), in_large, window, block_bytes))
        drop_table(bodies)
    else:
        resolved = write_table(resolve(bodies, total, window, block_bytes))
    drop_table(distinct)
    drop_table(large)
    ranges = found.join(resolved, ["core", "piece"]).select("rid", (F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi")).alias("end"))
    return spans_by_row(ranges)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False, as_text: bool = False) -> DataFrame:
    """For each row of df: key, n_bytes, n_removed, n_spans, and the kept bytes, with digest their
    kept_sha256, or with as_text kept and kept_chars, leaving out what is left of cut characters."""
    small_batches(df.sparkSession)
    rows = keyed(df, key, text)
    joined = rows.join(repeated_spans(rows, window), "rid", "left").select("key", "text", "spans")
    last = T.StructField("kept_sha256", T.StringType()) if digest else T.StructField("kept", T.BinaryType())
    lasts = [T.StructField("kept", T.StringType()), T.StructField("kept_chars", T.LongType())] if as_text else [last]
    schema = T.StructType([T.StructField(key, joined.schema["key"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], *lasts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = utf8(batch.column(1))
            removed, spans, out = [], [], []
            for raw, (start, end) in zip(data, lists(batch.column(2), ("start", "end")), strict=True):
                gone = merged(start, end, window)
                at, kept = 0, []
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                removed.append(len(raw) - len(kept))
                spans.append(len(gone))
                out.append(kept.decode("utf-8", "ignore") if as_text else hashlib.sha256(kept).hexdigest() if digest else kept)
            ends = [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())] if as_text else [pa.array(out, pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), *ends], schema.fieldNames())

    return joined.mapInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return without_repeats(documents(spark, sf_dir), digest=True)


OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS fresh FROM r),
b AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
p AS (SELECT doc_id, run, min(i) AS lo, max(i) + 200 AS hi FROM b GROUP BY ALL),
q AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM p),
k AS (SELECT q.doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last, string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (lo - before) AS BIGINT)), '' ORDER BY lo) AS head FROM q JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head || substr(x, CAST(2 * last + 1 AS BIGINT)), x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
