"""What the operators on repeated passages share.

A window (a fixed number of bytes or words) is found again through an anchor:
a position in it that its content alone decides. Consecutive windows with the
same anchor are one piece. Windows with equal content have equal anchors, so
only pieces whose anchor (`core`, a hash of what all its windows hold) occurs
again can repeat. These hits are few; equal pieces are handled once, and only
one document has to supply a piece's text. Every table is grouped by hashes
with partial aggregates, so frequent passages are counted where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import drop_table, small_batches, write_table
from pagelode.llm.shingles import utf8

IDS_BROADCAST = 1_000_000
OCCURRENCES = "core long, piece long, rid long, doc long, first int, n int"


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of the MD5 of each data[start:end]."""
    md5 = hashlib.md5
    return np.frombuffer(b"".join([md5(data[a:b]).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), dtype=np.uint64)[::2]


def lists(column: pa.Array, names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """For each row of an array<struct> column its fields as arrays; a null row has empty ones."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0), dtype=np.int64))])
    values = column.flatten()
    fields = [np.asarray(values.field(values.type.get_field_index(name))) for name in names]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield [f[a:b] for f in fields]


def occurrences(rows: DataFrame, scanner: Callable) -> DataFrame:
    """All pieces of all rows (rid, doc, text): OCCURRENCES."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for batch in batches:
            rid, doc = np.asarray(batch.column(0), dtype=np.int64), np.asarray(batch.column(1), dtype=np.int64)
            for which, first, n, core, piece, _ in scan.pieces(utf8(batch.column(2))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(rid[which]), pa.array(doc[which]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["core", "piece", "rid", "doc", "first", "n"],
                )

    return rows.select("rid", "doc", "text").mapInArrow(run, OCCURRENCES)


def hits(rows: DataFrame, scanner: Callable, repeats: Column) -> DataFrame:
    """The occurrences whose core meets the condition on n_at, low and high (occurrences, smallest and largest doc of the core), as a table."""
    all_pieces = write_table(occurrences(rows, scanner))
    cores = all_pieces.groupBy("core").agg(F.count("*").alias("n_at"), F.min("doc").alias("low"), F.max("doc").alias("high")).filter(repeats).select("core")
    cores = write_table(cores)  # so that the join can split a frequent core, which below an aggregate it could not
    found = write_table(all_pieces.join(cores, "core"))
    drop_table(all_pieces)
    drop_table(cores)
    return found


def supplied(rows: DataFrame, pieces: DataFrame, scanner: Callable, extract: Callable, schema: str, carry: list[str]) -> DataFrame:
    """What extract() makes of each of pieces (core, piece, rid, first, n and carry, all long) from the text of its row.

    extract(scanner, prepared text, first, n, carried values) yields rows of schema, after core and piece.
    """
    wanted = pieces.groupBy("rid").agg(F.collect_list(F.struct("core", "piece", *[F.col(c).cast("long").alias(c) for c in ("first", "n", *carry)])).alias("wanted"))
    ids = pieces.select("rid").distinct()
    small = ids.count() <= IDS_BROADCAST
    texts = rows.select("rid", "text").join(F.broadcast(ids) if small else ids, "rid", "left_semi")
    names = ["core", "piece", *[x.strip().split()[0] for x in schema.split(",")]]
    kinds = ["long", "long", *[x.strip().split()[1] for x in schema.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for text, each in zip(utf8(batch.column(0)), lists(batch.column(1), ("core", "piece", "first", "n", *carry)), strict=True):
                prepared = scan.prepare(text)
                for at in range(0, len(each[0]), 4096):
                    for core, piece, first, n, *carried in zip(*[f[at : at + 4096].tolist() for f in each], strict=True):
                        for made in extract(scan, prepared, first, n, carried):
                            out.append((core, piece, *made))
                        size += n
                    if size >= 1 << 19:
                        yield _batch(out, names, kinds)
                        out, size = [], 0
            if out:
                yield _batch(out, names, kinds)

    return texts.join(wanted, "rid").select("text", "wanted").mapInArrow(run, f"core long, piece long, {schema}")


def _batch(rows: list[tuple], names: list[str], kinds: list[str]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def spans_by_row(ranges: DataFrame) -> DataFrame:
    """rid and spans, an array of (start, end) in window starts, from ranges (rid, start, end)."""
    return ranges.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(start: np.ndarray, end: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal covered runs from ranges of window starts, ends exclusive."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    a, b = start[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64) + window - 1)
    fresh = np.concatenate([[True], a[1:] > b[:-1]])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(a) - 1)
    return list(zip(a[fresh].tolist(), b[last].tolist(), strict=True))


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width keys in a row, from running minima of blocks."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    pad = -len(keys) % width
    full = np.concatenate([keys, np.full(pad, np.iinfo(keys.dtype).max, dtype=keys.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored(which: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first, and number, of consecutive windows with the same text and anchor."""
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1])]))
    return first, np.diff(np.append(first, len(which)))
