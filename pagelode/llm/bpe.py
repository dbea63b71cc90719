"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Every text is split by the pre-tokenizer pattern and each match is encoded on
its own. Long texts are first cut at boundaries where no match can span: a
visible ASCII character followed by a space or a line break. Text between two
such boundaries that is longer than one piece (a long run of one kind) is
encoded by walking the pattern's matches one by one.

Null and empty texts have no ids. Rows are independent, so ties, null keys and
repeated rows need no rule: each row in gives one row out. An empty table gives an
empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pagelode.llm.common import documents, small_batches

PIECE_CHARS = 1 << 14
_SAFE = re.compile(r"[!-~](?=[ \n])")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class ByteBPE:
    """Encoder and decoder for one rank file and one pre-tokenizer pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.matches = regex.compile(pattern)
        self.names = [str(i) for i in range(max(table.values(), default=-1) + 1)]

    @staticmethod
    def pieces(text: str) -> Iterator[str]:
        """text in order, cut only where no match of the pattern can span."""
        start = 0
        while len(text) - start > PIECE_CHARS:
            found = _SAFE.search(text, start + PIECE_CHARS)
            if not found:
                break
            yield text[start : found.end()]
            start = found.end()
        if start < len(text):
            yield text[start:]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(text or ""):
            if len(piece) <= 8 * PIECE_CHARS:
                ids.extend(self.encoding.encode_ordinary(piece))
            else:
                for match in self.matches.finditer(piece):
                    ids.extend(self.encoding._encode_single_piece(match.group()) if len(match.group()) > PIECE_CHARS else self.encoding.encode_ordinary(match.group()))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def bpe_encode(df: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """One row for each row of df: its key, n_tokens and, as asked for, token_ids
    (array of int) and the digests ids_sha256 and decoded_sha256; the latter is
    taken over the bytes that decoding the ids gives."""
    spark = df.sparkSession
    small_batches(spark)
    narrow = df.select(df[key].alias("key"), df[text].alias("text"))
    fields = [T.StructField(key, narrow.schema["key"].dataType), T.StructField("n_tokens", T.LongType())]
    if ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(ranks, pattern)
        for batch in batches:
            counts, lists, of_ids, of_bytes = [], [], [], []
            for x in batch.column(1):
                got = bpe.encode(x.as_py())
                counts.append(len(got))
                if ids:
                    lists.append(got)
                if digests:
                    of_ids.append(hashlib.sha256(" ".join([bpe.names[i] for i in got]).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(bpe.decode(got)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64())]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            if digests:
                columns += [pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return narrow.mapInArrow(run, T.StructType(fields))


def bpe_decode(df: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """One row for each row of df: its key and the bytes that its ids stand for."""
    narrow = df.select(df[key].alias("key"), df[ids].alias("ids"))
    schema = T.StructType([T.StructField(key, narrow.schema["key"].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(ranks, pattern)
        for batch in batches:
            out = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema.fieldNames())

    return narrow.mapInArrow(run, schema)


def default_ranks() -> tuple[bytes, str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    ranks, pattern = default_ranks()
    return bpe_encode(documents(spark, sf_dir), ranks, pattern, ids=False, digests=True)
