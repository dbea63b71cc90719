"""Classes of near duplicates from banded signatures, with every link verified.

Equal texts are one node, named by their digest. Two nodes that share a band are
candidates. In each bucket the smallest node is first compared with all others;
verified links are closed to components. Where a bucket's members then still lie in several
components, each member outside the commonest one is compared with the member of
that component whose signature is nearest, until this links nothing more. What
is left is compared pair by pair, except inside a component: signatures in
blocks first, then the texts of all pairs that come near. So a class loses no
link that the bands reveal, and a bucket of many copies costs about one
comparison for each copy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import cut, small_batches
from pagelode.llm.shingles import utf8

BLOCK = 1024
LINKS_BROADCAST = 20_000
FEW = 8
MAP_BITS = 16  # of a map of nodes for each node, so that one in sixteen others passes
MAP_WORDS = 1 << 18  # 2 MB, however many nodes
PAIRS_PER_SLOT = 2048
BEST_ROUNDS = 1
MARGIN = 0.2  # of 125 registers, 5.6 standard deviations at a similarity of 0.8


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for each node of edges (a, b).

    Each round every node takes the smallest label of its neighbours and then its label's
    label. Up to LINKS_BROADCAST edges, a few MB in the driver, the labels are broadcast and
    held in a few partitions; beyond, the joins shuffle.
    """
    small = edges.count() <= LINKS_BROADCAST
    few = (lambda df: df.coalesce(FEW)) if small else (lambda df: df)
    near = F.broadcast if small else (lambda df: df)
    both = cut(few(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()))
    labels = cut(few(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))))
    while True:
        seen = both.join(near(labels.withColumnRenamed("node", "b")), "b").select(F.col("a").alias("node"), F.col("label").alias("next"), F.lit(None).cast("binary").alias("label"))
        every = seen.unionByName(labels.select("node", F.col("label").alias("next"), "label"))
        lower = every.groupBy("node").agg(F.min("next").alias("next"), F.max("label").alias("label"))
        lower = cut(few(lower))
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("root"))
        moved = lower.join(near(jump), "next", "left").select("node", "label", F.least("next", F.coalesce("root", "next")).alias("next"))
        moved = cut(few(moved))
        changed = moved.filter("label <> next").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def texts_of(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """One row (node, text) for each of the n nodes in ids, and for few others, which a join with ids leaves out.

    The rows to shuffle are picked by a map of one bit a hash of the nodes. It is all that
    passes through the driver: the nodes themselves would grow there with the corpus.
    """
    words = min(MAP_WORDS, 1 << max(0, (n * MAP_BITS // 64).bit_length()))
    at = F.xxhash64("node")
    word, bit = at.bitwiseAND(F.lit(words - 1)).cast("int"), F.shiftrightunsigned(at, 58).cast("int")
    got = ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(words, np.int64)
    bits[np.asarray(got.column("word"))] = np.asarray(got.column("bits"))
    table = texts.sparkSession.createDataFrame(pa.table({"bits": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(bits))}))
    marked = F.call_function("shiftright", F.get("bits", word), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return texts.join(F.broadcast(table), marked, "left_semi").dropDuplicates(["node"])


def verify(pairs: DataFrame, texts: DataFrame, profile: Callable, similarity: Callable, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least threshold alike. texts: node, text.

    A text that many others are compared with is sent to several slots, each of which
    then sees a bounded share of the others, one at a time.
    """
    pairs = cut(pairs.select("a", "b").distinct())
    n = pairs.count()
    slots = max(16, -(-n // PAIRS_PER_SLOT))
    pairs = pairs.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(slots)))
    needs = pairs.select(F.col("b").alias("node"), "a", "s", F.lit(1).alias("kind")).unionByName(
        pairs.select("a", "s").distinct().select(F.col("a").alias("node"), "a", "s", F.lit(0).alias("kind"))
    )
    own = texts_of(texts, needs.select("node"), 2 * n)
    rows = needs.join(own, "node").repartition("a", "s").sortWithinPartitions("a", "s", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = profile()
        current = None
        for batch in batches:
            data, kinds = utf8(batch.column(3)), batch.column(2).to_pylist()
            a, b = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            found: list[tuple[bytes, bytes, float]] = []
            for i, made in enumerate(make(data)):
                if kinds[i] == 0:
                    current = made
                else:
                    value = similarity(current, made)
                    if value >= threshold - 1e-12:
                        found.append((a[i], b[i], value))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.float64())], ["a", "b", "similarity"])

    return rows.select("node", "a", "kind", "text").mapInArrow(run, "a binary, b binary, similarity double")


def _blocks(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """Each block of the members outside a bucket's commonest component (side 0) with each block of that component (side 1).

    members: key, band, node, label. signatures: node, signature.
    """
    per = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    top = cut(per.groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("top"), F.sum("n").alias("size")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    rows = members.join(top, "key").select("key", "node", (F.col("label") == F.col("top")).cast("int").alias("side"), block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("key", F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("other")).alias("i"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("block")).alias("j"), "side", "node")
    return rows.join(signatures, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")


def nearest_pairs(members: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b): each node outside its bucket's commonest component with the node of that
    component whose signature agrees most, in a share of least at least."""
    met = _blocks(members, signatures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, held = None, [], []
        matrix: np.ndarray | None = None
        best: list[tuple[float, bytes | None]] = []

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.float64()))], ["node", "other", "share"])

        def close() -> list[tuple]:
            return [(n, o, x) for n, (x, o) in zip(nodes, best, strict=False) if o is not None]

        for batch in batches:
            found: list[tuple] = []
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True))
            for k, which, node, raw in zip(keys, *[batch.column(i).to_pylist() for i in range(3, 6)], strict=True):
                if k != at:
                    found += close()
                    at, nodes, held, matrix, best = k, [], [], None, []
                signature = np.frombuffer(raw, np.uint16)
                if which == 0:
                    nodes.append(node)
                    held.append(signature)
                elif nodes:
                    best = best or [(least, None)] * len(nodes)
                    matrix = np.stack(held) if matrix is None else matrix
                    share = (matrix == signature).mean(1)
                    for i in np.flatnonzero(share >= least):
                        if best[i][1] is None or share[i] > best[i][0]:
                            best[i] = (share[i], node)
            yield out(found)
        yield out(close())

    pairs = met.select("key", "i", "j", "side", "node", "signature").mapInArrow(run, "node binary, other binary, share double")
    pairs = pairs.groupBy("node").agg(F.max_by("other", F.struct("share", "other")).alias("other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def all_links(members: DataFrame, per_node: DataFrame, band_rows: int, least: float, profile: Callable, similarity: Callable, threshold: float) -> DataFrame:
    """Verified links (a, b, similarity) of all pairs that share a bucket but no component and
    whose signatures agree in a share of least. per_node: node, signature, text.

    A bucket's blocks meet in pairs i <= j; in (i, i) every member is compared with those before
    it. A pair counts in the first bucket that it shares.
    """
    size = members.groupBy("key").agg(F.count("*").alias("size"))
    rows = members.join(cut(size), "key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.select("key", "band", "node", "label", F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int").alias("block"), blocks.alias("blocks"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    met = rows.select("key", "band", "node", "label", "block", F.explode(meet).alias("m")).select("key", "m.i", "m.j", (F.col("block") != F.col("m.i")).cast("int").alias("side"), "band", "node", "label")
    met = met.join(per_node, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = profile()
        at = None
        nodes: list[bytes] = []
        labels: list[bytes] = []
        texts: list[bytes] = []
        profiles: list = []
        matrix = np.zeros((0, 0), np.uint16)
        for batch in batches:
            found: list[tuple[bytes, bytes, float]] = []
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True))
            columns = [batch.column(i).to_pylist() for i in range(3, 8)]
            for k, side, band, node, label, raw, text in zip(keys, *columns, utf8(batch.column(8)), strict=True):
                if k != at:
                    at, nodes, labels, texts, profiles = k, [], [], [], []
                signature = np.frombuffer(raw, np.uint16)
                mine = None
                if nodes and (side or k[1] == k[2]):
                    equal = matrix[: len(nodes)] == signature
                    near = np.flatnonzero(equal.mean(1) >= least)
                    bands = equal[near].reshape(len(near), len(signature) // band_rows, band_rows).all(2)
                    for i in near[bands.argmax(1) == band]:
                        if labels[i] == label:
                            continue
                        if profiles[i] is None:
                            profiles[i] = next(iter(make([texts[i]])))
                        mine = mine or next(iter(make([text])))
                        value = similarity(profiles[i], mine)
                        if value >= threshold - 1e-12:
                            found.append((min(nodes[i], node), max(nodes[i], node), value))
                if not side:
                    if matrix.shape[1] != len(signature) or matrix.shape[0] <= len(nodes):
                        grown = np.zeros((max(64, 2 * len(nodes)), len(signature)), np.uint16)
                        if nodes:
                            grown[: len(nodes)] = matrix[: len(nodes)]
                        matrix = grown
                    matrix[len(nodes)] = signature
                    nodes.append(node)
                    labels.append(label)
                    texts.append(text)
                    profiles.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.float64()))], ["a", "b", "similarity"])

    return met.select("key", "i", "j", "side", "band", "node", "label", "signature", "text").mapInArrow(run, "a binary, b binary, similarity double")


def classes(df: DataFrame, sign: Callable, profile: Callable, similarity: Callable, registers: int, band_rows: int, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and class_id of every row of df.

    class_id is the smallest key of the rows whose texts are linked, directly or through
    others; a row without near duplicates is its own class.
    """
    spark = df.sparkSession
    small_batches(spark)
    base = df.select(df[key].alias("id"), F.coalesce(df[text], F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))
    n_bands = registers // band_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = sign()
        nothing = make([b""])[0].tobytes()
        for batch in batches:
            rows = [r.tobytes() for r in np.ascontiguousarray(make(utf8(batch.column(2))), dtype=np.uint16)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if r == nothing else r for r in rows], pa.binary())], ["id", "node", "signature"])

    kind = base.schema["id"].dataType.simpleString()
    signed = base.select("id", "node", "text").mapInArrow(run, f"id {kind}, node binary, signature binary")
    rows = cut(signed)
    nodes = cut(rows.groupBy("node").agg(F.first("signature").alias("signature")))
    width = 2 * band_rows
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("signature", 1 + i * width, width)) for i in range(n_bands)])
    banded = nodes.filter("signature is not null").select("node", F.posexplode(keys).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last")
    shared = cut(shared)  # joins with what is written can split a frequent key; below an aggregate they could not
    members = cut(banded.join(shared, "key").select("key", "band", "node", "first"))
    texts = base.select("node", "text")
    pairs = members.filter("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = cut(verify(pairs, texts, profile, similarity, threshold))
    labels = cut(components(links))
    for last in (*[False] * BEST_ROUNDS, True):
        named = members.join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label"))
        unsettled = cut(named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key"))
        left = cut(named.join(unsettled, "key", "left_semi"))
        ids = left.select("node").distinct()
        n = ids.count()
        if not n:
            break
        signatures = nodes.join(ids, "node", "left_semi")
        if last:
            more = all_links(left, signatures.join(texts_of(texts, ids, n), "node"), band_rows, threshold - MARGIN, profile, similarity, threshold)
        else:
            more = verify(nearest_pairs(left, signatures, threshold - MARGIN), texts, profile, similarity, threshold)
        more = cut(more)
        if more.limit(1).count():
            links = links.unionByName(more)
            labels = cut(components(links))
    placed = cut(rows.select("id", "node").join(labels, "node", "left").select("id", F.coalesce("label", "node").alias("label")))
    smallest = cut(placed.groupBy("label").agg(F.min("id").alias("class_id")))
    return placed.join(smallest, "label").select(F.col("id").alias(key), "class_id")
