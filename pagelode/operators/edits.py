"""Scalar and stream edits of documents, with a check that the written bytes read back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.functions.document import parse_document
from pagelode.functions.writer import Edit, EditError, apply_edit, replace_stream, scalar, serialize


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, content (null on failure), n_objects and error of every document that edits name.

    edits: doc_id, obj, gen, path array<string> (keys and positions), value string; or with a
    null value, stream_text string for a new stream content. Edits apply in order of ord.
    """
    one = F.struct("ord", "obj", "gen", "path", "value", "stream_text")
    per = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("edits"))
    rows = docs.select("doc_id", "content").join(per, "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts, errors = [], [], []
            for data, todo in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    doc = parse_document(data)
                    for e in todo:
                        ref = (e["obj"], e["gen"])
                        if e["value"] is None:
                            replace_stream(doc, ref, (e["stream_text"] or "").encode())
                        else:
                            apply_edit(doc, Edit(ref, e["path"], e["value"]))
                    made = serialize(doc)
                    again = parse_document(made)
                    if set(again.objects) != set(doc.objects):
                        raise EditError("the written document doesn't hold the same objects")
                    out.append(made)
                    counts.append(len(again.objects))
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    counts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(counts, pa.int32()), pa.array(errors, pa.string())], ["doc_id", "content", "n_objects", "error"])

    return rows.mapInArrow(run, f"doc_id {kind}, content binary, n_objects int, error string")


def check_values(values: DataFrame) -> DataFrame:
    """value, type (null if it can't be written) and error of edit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, errors = [], []
            for v in batch.column(0).to_pylist():
                try:
                    kinds.append(scalar(v or "")[0])
                    errors.append(None)
                except EditError as e:
                    kinds.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(errors, pa.string())], ["value", "type", "error"])

    return values.select("value").mapInArrow(run, "value string, type string, error string")
