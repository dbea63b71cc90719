"""Exact top-k search by columnar branch-and-bound.

Candidates of a batch are held vertically, in blocks of dimensions. Queries with
the same heaviest block take the blocks in one order, by their mass; after each,
a candidate's score can still change by at most the product of what is left of
both norms. Pairs that can no longer reach the query's k-th best are compacted
away. The first blocks, in which too few pairs would go, are opened at once for a
tile of queries; how many they are follows from the pairs that were left before.
What is left goes on block by block. Scores are integers and the survivors' are exact.

Queries and candidates are dealt into blocks, each pair of blocks is a cell, and
a row is sent to all cells of its block: one block of queries of bounded size
is held in a task while a block of candidates streams past, and neither passes
through the driver. With n_q and n_c blocks the candidates are shuffled n_q and
the queries n_c times; up to `query_bytes` of queries n_q is 1. Each cell gives
its k best, which a window per query merges.

Vectors that are null or hold null or non-finite components take no part, as
query or candidate. A vector shorter than another counts as ended by zeros. Ties go
to the smaller id; a query skips the candidates with its own id; repeated ids
are separate candidates, and a repeated query id gets one answer, for its
smallest vector. Where products are too large for float64 to add up exactly, the
pairs concerned are added up as whole numbers without a bound; scores beyond a
long are cut to its ends before they are ranked. Null ids take no part. Empty
tables give empty results. Columns other than key and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.llm.common import shuffle_partitions, small_batches, table

DIMS = 8
QUERY_BYTES = 64 << 20
CANDIDATE_BYTES = 128 << 20
CANDIDATES = 4096
QUERIES = 256
PAIRS = 1 << 14
# an opening is lengthened or shortened by a block if more or fewer of its pairs are left
MANY, FEW = 2e-3, 2e-4
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<double> column, shorter ones ended by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width))
    values = np.asarray(column.flatten(), dtype=np.float64)
    if width and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


class Searcher:
    """The k best of all candidates shown so far, for each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.best_ids, self.best, self.known = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64), np.zeros(len(ids), np.int64)
        self.highest = -LONG - 1
        self._blocks(vectors)

    def _blocks(self, vectors: np.ndarray) -> None:
        self.vectors, width = vectors, vectors.shape[1]
        self.blocks = [slice(i, min(i + DIMS, width)) for i in range(0, width, DIMS)]
        self.largest = np.abs(vectors).max(1, initial=0)
        with np.errstate(over="ignore"):
            self.mass = np.stack([(vectors[:, b] ** 2).sum(1) for b in self.blocks], 1) if self.blocks else np.zeros((len(self.ids), 0))
        heaviest = self.mass.argmax(1) if self.blocks else np.zeros(len(self.ids), np.int64)
        self.groups = []
        for first in np.unique(heaviest):
            own = np.flatnonzero(heaviest == first)
            order = np.argsort(-self.mass[own].sum(0), kind="stable")
            self.groups.append((order, [own[i : i + QUERIES] for i in range(0, len(own), QUERIES)]))
        self.opening = [len(self.blocks)] * len(self.groups)

    def show(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids):
            return
        more = vectors.shape[1] - self.vectors.shape[1]
        if more > 0:
            self._blocks(np.pad(self.vectors, ((0, 0), (0, more))))
        elif more < 0:
            vectors = np.pad(vectors, ((0, 0), (0, -more)))
        # of equal scores the smaller id is better, so what comes with larger ids than all before must be better by one
        self.over = int(ids.min() >= self.highest)
        largest = np.abs(vectors).max(1, initial=0)
        most, width = float(largest.max(initial=0)), max(vectors.shape[1], 1)
        # candidates with components below this add up exactly
        limit = np.where(self.largest < EXACT, EXACT / width / np.maximum(self.largest, 1.0), 0.0)
        for g, (order, tiles) in enumerate(self.groups):
            shown, met, left = None, 0, 0
            for tile in tiles:
                if most < limit[tile].min():
                    shown = shown or Shown(ids, vectors, self.blocks, order)
                    left += self._tile(tile, shown, self.opening[g])
                    met += len(tile) * len(ids)
                    continue
                for q in tile:
                    tame = largest < limit[q]
                    if tame.any():
                        self._tile(np.array([q]), Shown(ids[tame], vectors[tame], self.blocks, order), len(order))
                    self._wide(int(q), ids, vectors, np.flatnonzero((ids != self.ids[q]) & ~tame))
            if left > MANY * met:
                self.opening[g] = min(self.opening[g] + 1, len(order))
            elif met and left < FEW * met:
                self.opening[g] = max(self.opening[g] - 1, 1)
        self.highest = max(self.highest, int(ids.max()))

    def _tile(self, tile: np.ndarray, shown: Shown, opening: int) -> int:
        """Show candidates to a tile of queries; the number of pairs that outlived the first `opening` blocks."""
        full = self.known[tile] >= self.k
        need = np.where(full, self.best[tile, self.k - 1].astype(np.float64) + self.over, -math.inf) if self.k else np.full(len(tile), math.inf)
        opening = opening if full.all() else len(shown.order)
        queries, mass = self.vectors[tile], self.mass[tile][:, shown.order]
        rest = np.concatenate([np.cumsum(mass[:, ::-1], 1)[:, ::-1], np.zeros((len(tile), 1))], 1)
        dims = shown.dims[opening]
        # one more dimension adds what the rest can reach; single floats are off by less than slack, survivors are added up exactly
        bound = np.concatenate([queries[:, dims], np.sqrt(rest[:, opening : opening + 1])], 1).astype(np.float32) @ shown.opened(opening)
        slack = (len(dims) + 8) * 2.0**-23 * np.sqrt(rest[:, 0]) * shown.longest + 1e-3
        if not full.all() and len(shown.ids) > self.k:
            own = np.flatnonzero(np.isin(shown.ids, self.ids[tile]))
            row, at = np.nonzero(self.ids[tile][:, None] == shown.ids[own][None, :])
            bound[row, own[at]] = -math.inf
            low = np.partition(bound, len(shown.ids) - self.k, axis=1)[:, len(shown.ids) - self.k]
            need = np.maximum(need, low.astype(np.float64) - slack)
        floor = np.nextafter((need - slack).astype(np.float32), np.float32(-math.inf))
        which = np.flatnonzero(bound >= floor[:, None])
        for start in range(0, len(which), PAIRS):
            q, c = np.divmod(which[start : start + PAIRS], len(shown.ids))
            other = self.ids[tile[q]] != shown.ids[c]
            self._pairs(tile, q[other], c[other], shown, opening, need, queries, rest)
        return len(which)

    def _pairs(self, tile: np.ndarray, q: np.ndarray, c: np.ndarray, shown: Shown, opening: int, need: np.ndarray, queries: np.ndarray, rest: np.ndarray) -> None:
        """Go on with pairs block by block, without those that can no longer reach what their query needs."""
        score, a, b = np.zeros(len(q)), queries[q], shown.vectors[c]
        for i, block in enumerate(shown.order):
            score += np.einsum("ij,ij->i", a[:, self.blocks[block]], b[:, self.blocks[block]])
            if opening <= i + 1 < len(shown.order):
                left = np.sqrt(rest[q, i + 1])
                keep = score + left * np.sqrt(shown.rest[i + 1, c]) * (1 + 1e-9) + 1e-6 * (1 + left) >= need[q]
                if keep.sum() < 0.7 * len(keep):
                    q, c, score, a, b = q[keep], c[keep], score[keep], a[keep], b[keep]
        near = score >= need[q]
        self._keep(tile[q[near]], shown.ids[c[near]], score[near].astype(np.int64))

    def _wide(self, q: int, ids: np.ndarray, vectors: np.ndarray, which: np.ndarray) -> None:
        """The same for pairs whose sums float64 can't hold, in whole numbers without a bound."""
        query = [int(x) for x in self.vectors[q].tolist()]
        scores = [min(max(sum(a * int(b) for a, b in zip(query, row, strict=True) if a and b), -LONG - 1), LONG) for row in vectors[which].tolist()]
        self._keep(np.full(len(which), q), ids[which], np.array(scores, dtype=np.int64))

    def _keep(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge scores of candidates into the best of their queries."""
        touched = np.unique(queries)
        row, at = np.nonzero(np.arange(self.k)[None, :] < self.known[touched][:, None])
        queries = np.concatenate([touched[row], queries])
        ids, scores = np.concatenate([self.best_ids[touched[row], at], ids]), np.concatenate([self.best[touched[row], at], scores])
        order = np.lexsort((ids, ~scores, queries))  # ~ turns the order around and can't overflow
        start = np.searchsorted(queries[order], touched)
        n = np.diff(np.append(start, len(order)))
        place = np.arange(len(order)) - np.repeat(start, n)
        first = order[place < self.k]
        self.best_ids[queries[first], place[place < self.k]], self.best[queries[first], place[place < self.k]] = ids[first], scores[first]
        self.known[touched] = np.minimum(n, self.k)


class Shown:
    """Candidates, held vertically in an order of blocks: what is left of their mass after each block, and the first blocks."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, blocks: list[slice], order: np.ndarray):
        self.ids, self.vectors, self.order = ids, vectors, order
        parts = [np.arange(blocks[b].start, blocks[b].stop) for b in order]
        self.dims = [np.concatenate([np.empty(0, np.int64), *parts[:n]]) for n in range(len(parts) + 1)]
        mass = np.stack([(vectors[:, p] ** 2).sum(1) for p in parts]) if parts else np.zeros((0, len(ids)))
        self.rest = np.concatenate([np.cumsum(mass[::-1], 0)[::-1], np.zeros((1, len(ids)))])
        self.longest = float(np.sqrt(self.rest[0].max(initial=0)))
        self.made: dict[int, np.ndarray] = {}

    def opened(self, n: int) -> np.ndarray:
        """The first n blocks, and the norm of the rest, as rows."""
        if n not in self.made:
            self.made[n] = np.concatenate([self.vectors[:, self.dims[n]].T, np.sqrt(self.rest[n])[None, :]]).astype(np.float32)
        return self.made[n]


def scaled(vector: Column) -> Column:
    """floor(256 * x) of each component, as a double; from 2**52 on doubles are whole."""
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) < float(1 << 44), F.floor(x.cast("double") * 256).cast("double")).otherwise(x.cast("double") * 256))


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, prepare=scaled, query_bytes: int = QUERY_BYTES, candidate_bytes: int = CANDIDATE_BYTES) -> DataFrame:
    """query_id, rank, the key and score of the k best candidates of every query row, by inner product."""
    small_batches(df.sparkSession)
    finite = F.forall(df[vector], lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = df.filter(df[vector].isNotNull() & df[key].isNotNull() & finite)
    rows = rows.select(rows[key].cast("long").alias("id"), rows[vector].alias("raw"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    length = 8 * F.greatest(F.size("raw"), F.lit(1)).cast("long")
    size = rows.agg(F.coalesce(F.sum(F.when(F.col("asks"), length)), F.lit(0)).alias("q"), F.coalesce(F.sum(length), F.lit(0)).alias("c")).first()
    n_q = max(1, -(-size["q"] // query_bytes))
    n_c = max(1, -(-shuffle_partitions(df.sparkSession) // n_q), -(-size["c"] // candidate_bytes))
    q_block = F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int")
    c_block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_c)).cast("int")  # so that repeated ids spread
    both = F.array(F.struct(F.lit(0).alias("side"), q_block.alias("own")), F.struct(F.lit(1).alias("side"), c_block.alias("own")))
    sides = rows.select("id", "raw", F.inline(F.filter(both, lambda s: F.col("asks") | (s["side"] == 1))))
    others = F.sequence(F.lit(0), F.when(F.col("side") == 0, n_c - 1).otherwise(n_q - 1))
    cells = sides.select("id", "raw", "side", "own", F.explode(others).alias("other"))
    cell = F.when(F.col("side") == 0, F.col("own") * F.lit(n_c) + F.col("other")).otherwise(F.col("other") * F.lit(n_c) + F.col("own"))
    dealt = cells.select(cell.cast("int").alias("cell"), "side", "id", "raw").repartitionById(n_q * n_c, F.col("cell")).sortWithinPartitions("cell", "side", "id", "raw")
    found = dealt.select("side", "id", prepare(F.col("raw")).alias("v")).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(key), "score")


def _search(k: int):
    """Each task has one cell: its queries first, then its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        searcher = None

        def together() -> tuple[np.ndarray, np.ndarray]:
            width = max([m.shape[1] for _, m in held], default=0)
            ids = np.concatenate([np.empty(0, np.int64), *[i for i, _ in held]])
            vectors = np.concatenate([np.zeros((0, width)), *[np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in held]])
            held.clear()
            return ids, vectors

        for batch in batches:
            n = int((np.asarray(batch.column(0)) == 0).sum())
            for side, part in ((0, batch.slice(0, n)), (1, batch.slice(n))):
                if side and part.num_rows and searcher is None:
                    ids, vectors = together()
                    ids, first = np.unique(ids, return_index=True)
                    searcher = Searcher(ids, vectors[first], k)
                if part.num_rows:
                    held.append((np.asarray(part.column(1), dtype=np.int64), _matrix(part.column(2))))
                if side and searcher and sum(len(i) for i, _ in held) >= CANDIDATES:
                    searcher.show(*together())
        if searcher and held:
            searcher.show(*together())
        for start in range(0, len(searcher.ids) if searcher else 0, 1024):
            row, at = np.nonzero(np.arange(k)[None, :] < searcher.known[start : start + 1024, None])
            out = [searcher.ids[start + row], searcher.best_ids[start + row, at], searcher.best[start + row, at]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return run


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for every vector whose id is divisible by 50."""
    df = table(spark, sf_dir, "embeddings")
    return top_k(df, F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
