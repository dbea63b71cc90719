"""Files from rows: documents, stream contents and image previews, written where the rows are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_LIMIT = 512 << 20
DECODED_LIMIT = 256 << 20
_UNSAFE = re.compile(r"[^A-Za-z0-9_-]")


def safe_name(text: str) -> str:
    return _UNSAFE.sub("_", text) or "_"


def safe_text(text: Column) -> Column:
    """safe_name() of a column."""
    name = F.regexp_replace(text.cast("string"), _UNSAFE.pattern, "_")
    return F.when(name == "", "_").otherwise(name)


class ExportError(ValueError):
    pass


def write_files(rows: DataFrame, uri: str, sources: list[str] = ()) -> None:
    """Write rows (name, data) as files below uri, a folder of any file system that all executors share.

    A task that runs again writes the same bytes to the same names. sources are folders or
    files that the rows were read from; uri must be none of them nor hold or lie in one.
    """
    plain = lambda p: re.sub(r"^file:/*", "/", p).rstrip("/") + "/"
    for source in sources:
        if plain(uri).startswith(plain(source)) or plain(source).startswith(plain(uri)):
            raise ExportError(f"refusing to write over the source {source}")

    def put(part) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
        system.create_dir(base, recursive=True)
        for row in part:
            with system.open_output_stream(f"{base}/{row['name']}") as out:
                out.write(bytes(row["data"]))

    rows.select("name", "data").filter("data is not null").foreachPartition(put)


def export_documents(docs: DataFrame, uri: str, sources: list[str] = ()) -> None:
    """Write docs (doc_id, content) as <doc_id>.pdf."""
    write_files(docs.select(F.concat(safe_text(F.col("doc_id")), F.lit(".pdf")).alias("name"), F.col("content").alias("data")), uri, sources)


def export_streams(streams: DataFrame, uri: str, decoded: bool = False) -> None:
    """Write the stream_bytes relation as <doc_id>-<obj>-<gen>.bin, raw or decoded; what is over the limit or fails is left out."""
    data = F.when(F.col("clean") & (F.length("decoded") <= DECODED_LIMIT), F.col("decoded")) if decoded else F.when(F.length("raw") <= RAW_LIMIT, F.col("raw"))
    doc = safe_text(F.col("doc_id"))
    write_files(streams.select(F.concat_ws("-", doc, "obj", F.concat(F.col("gen").cast("string"), F.lit(".bin"))).alias("name"), data.alias("data")), uri)


def export_lazy_streams(docs: DataFrame, wanted: DataFrame, uri: str, decoded: bool = False) -> DataFrame:
    """Write streams wanted (doc_id, obj, gen) of docs (doc_id, path), read by ranges, and give doc_id, obj, gen, bytes and error.

    Sizes are tested before anything is read. Each stream is written under a temporary name
    and moved into place. The result is computed when it is read; reading it again writes again.
    """
    rows = docs.select("doc_id", "path").join(wanted.select("doc_id", F.col("obj").cast("long"), F.col("gen").cast("int")).distinct(), "doc_id").repartition("doc_id").sortWithinPartitions("doc_id", "obj", "gen")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        from pagelode.functions.lazy import FileReader, open_lazy

        system, base = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
        system.create_dir(base, recursive=True)
        doc = at = None
        for batch in batches:
            sizes, errors = [], []
            for doc_id, path, obj, gen in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                try:
                    if path != at:
                        doc, at = open_lazy(FileReader(path)), path
                    data = doc.export((obj, gen), decoded)
                    name = f"{base}/{safe_name(str(doc_id))}-{obj}-{gen}.bin"
                    if path.endswith(name):
                        raise ExportError(f"refusing to write over the source {path}")
                    with system.open_output_stream(f"{name}.part") as out:
                        out.write(data)
                    system.move(f"{name}.part", name)
                    sizes.append(len(data))
                    errors.append(None)
                except Exception as e:  # one bad stream must not end the job
                    at = None if doc is None else at
                    sizes.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["doc_id", "obj", "gen", "bytes", "error"])

    return rows.select("doc_id", "path", "obj", "gen").mapInArrow(run, f"doc_id {kind}, obj long, gen int, bytes long, error string")


def save_in_place(edited: DataFrame) -> DataFrame:
    """Put edited contents (path, content) in the place of their files, and give path, bytes and error.

    Each is written beside its file, read back, parsed and compared by its objects before it
    is moved over the file in one step; on any failure the file stays as it was and
    what was written goes. Null contents are failures. The result is computed when it is read.
    """

    def save(path: str, data: bytes | None) -> int:
        from pyarrow import fs

        from pagelode.functions.document import parse_document

        if data is None:
            raise ExportError("there is no edited content")
        system, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        if system.get_file_info(name).type != fs.FileType.File:
            raise ExportError("the file to replace is not there")
        beside = f"{name}.saving"
        try:
            with system.open_output_stream(beside) as out:
                out.write(data)
            with system.open_input_file(beside) as f:
                back = f.read()
            made, read = parse_document(data), parse_document(back)
            if back != data or not read.objects or set(made.objects) != set(read.objects):
                raise ExportError("the written document doesn't read back")
            system.move(beside, name)
        except Exception:
            if system.get_file_info(beside).type == fs.FileType.File:
                system.delete_file(beside)
            raise
        return len(data)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, errors = [], []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    sizes.append(save(path, data.as_py()))
                    errors.append(None)
                except Exception as e:
                    sizes.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["path", "bytes", "error"])

    return edited.select("path", "content").mapInArrow(run, "path string, bytes long, error string")


def draft_snapshots(docs: DataFrame, edits: DataFrame, uri: str) -> None:
    """Write documents with their pending edits under names of their own, <doc_id>-draft.pdf; their files stay as they are."""
    from pagelode.operators.edits import apply_edits

    name = F.concat(safe_text(F.col("doc_id")), F.lit("-draft.pdf"))
    write_files(apply_edits(docs, edits).select(name.alias("name"), F.col("content").alias("data")), uri)
