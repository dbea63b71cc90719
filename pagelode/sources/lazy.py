"""PDF files read by ranges: the data source `pdf_lazy` and the same relations from content.

The data source lists files on the driver, deals them out in groups of about the
same cost and takes equality filters on obj and gen before it touches an object, so a point lookup reads the
chain and that object only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string

from pagelode.functions.lazy import TAIL, BytesReader, FileReader, LazyDocument, LazyError, fast_findings, open_lazy
from pagelode.functions.structure import object_summary
from pagelode.functions import deep, lazy_report
from pagelode.operators.relations import SCHEMAS, _page_links, _pages, batches_of, column

PARTITION_BYTES = 128 << 20
FILE_COST = 1 << 20
FILES = 1000
OBJECTS = "path string, obj long, gen int, in_use boolean, byte_offset long, container long, value_type string, summary string, stream_start long, stream_length long, error string"
FINDINGS = "ord int, rule_id string, severity string, message string, obj long, gen int, page int, byte_offset long, suggested_next_step string"
STEP = "struct<filter:string,status:string,message:string>"
STREAM_VIEW = f"obj long, gen int, declared_length long, actual_length long, raw_start long, raw_end long, filters array<string>, decoded_length long, steps array<{STEP}>, issues array<struct<filter:string,kind:string,message:string>>, warnings array<struct<rule_id:string,message:string,byte_offset:long>>, raw_preview binary, raw_truncated boolean, decoded_preview binary, decoded_truncated boolean, decoded_error string, can_export_raw boolean, can_export_decoded boolean"
PARTS = {
    "metadata": SCHEMAS["metadata"], "pages": SCHEMAS["pages"], "page_links": SCHEMAS["page_links"], "findings": FINDINGS, "tree": SCHEMAS["tree"],
    "objects": OBJECTS.removeprefix("path string, "), "notes": "ord int, rule_id string, message string, byte_offset long", "stream_views": STREAM_VIEW,
}


class PdfPartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def object_rows(doc: LazyDocument, path: str, only: dict) -> Iterator[tuple]:
    for ref in sorted(doc.entries):
        e = doc.entries[ref]
        if any(want != have for want, have in ((only.get("obj", ref[0]), ref[0]), (only.get("gen", ref[1]), ref[1]))):
            continue
        kind = text = start = length = error = None
        if e.in_use:
            try:
                o = doc.read_object(ref)
                kind, text = o.value[0], object_summary(o)
                if o.stream:
                    start, length = o.stream.start, o.stream.end - o.stream.start
            except LazyError as x:
                error = str(x)
        yield path, *ref, e.in_use, None if e.stream is not None else e.offset, e.stream, kind, text, start, length, error


class PdfReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], size: int):
        self.files, self.size, self.only = files, size, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("path",), ("obj",), ("gen",)):
                self.only[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        """Files in groups, each of about the same cost; what a file costs is its tail and objects, no more than its size."""
        groups: list[list[str]] = []
        held = self.size
        for path, size in self.files:
            if self.only.get("path", path) != path:
                continue
            if held >= self.size or len(groups[-1]) >= FILES:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += min(size, 2 * TAIL) + FILE_COST
        return [PdfPartition(g) for g in groups] or [PdfPartition([])]

    def read(self, partition):
        for path in partition.paths:
            try:
                yield from object_rows(open_lazy(FileReader(path)), path, self.only)
            except Exception as e:  # one bad file must not end the job
                yield path, *[None] * 9, str(e) if isinstance(e, LazyError) else f"{type(e).__name__}: {e}"


class LazyPdfSource(DataSource):
    """format("pdf_lazy").load(path): one row per cross-reference entry of the files below path."""

    @classmethod
    def name(cls):
        return "pdf_lazy"

    def schema(self):
        return OBJECTS

    def reader(self, schema):
        from pyarrow import fs

        root = self.options["path"]
        system, base = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
        one = system.get_file_info(base)
        found = [one] if one.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File]
        return PdfReader(sorted((i.path, i.size or 0) for i in found if i.path.lower().endswith(".pdf")), int(self.options.get("partitionBytes", PARTITION_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LazyPdfSource)


def _finding_rows(doc: LazyDocument):
    for i, (rule, severity, message, ref, page, offset, step) in enumerate(fast_findings(doc)):
        yield i, rule, severity, message, *(ref or (None, None)), page, offset, step


def _stream_views(doc: LazyDocument):
    """Views of the content streams of all pages."""
    for ref in dict.fromkeys(ref for p in doc.page_index() for kind, _, ref in p.links if kind == "contents"):
        found = doc.objects.get(ref)
        if found and found.stream:
            yield *ref, *doc.stream_view(ref).values()


def _notes(doc: LazyDocument):
    """What opening and the page walk warned of."""
    if not doc.indexed:
        doc.page_index()
    yield from ((i, n.rule, n.message, n.offset) for i, n in enumerate(doc.notes))


MAKERS = {
    "objects": lambda d: (row[1:] for row in object_rows(d, "", {})), "pages": _pages, "page_links": _page_links, "findings": _finding_rows, "stream_views": _stream_views, "notes": _notes,
    "tree": lambda d: ((i, list(n.path), n.label, n.kind, *(n.ref or (None, None)), n.summary) for i, n in enumerate(d.tree())),
}
ENRICHMENT = "scope string, target string, page int, obj long, gen int, partial boolean, summary string, findings array<struct<rule_id:string,severity:string,message:string,obj:long,gen:int,page:int,byte_offset:long,suggested_next_step:string>>, warnings array<string>, limitations array<string>, details array<struct<name:string,value:string>>, error string"


def parse_lazy(docs: DataFrame, *parts: str) -> DataFrame:
    """doc_id, error, touched (bytes read) and a column for each of PARTS, from docs (doc_id, content), read by ranges."""
    schema = StructType().add("doc_id", docs.schema["doc_id"].dataType).add("error", "string").add("touched", "long")
    for part in parts:
        own = _parse_datatype_string(PARTS[part])
        schema.add(part, own if part == "metadata" else ArrayType(own))
    arrow = to_arrow_schema(schema)

    def one(doc_id, data: bytes | None) -> list:
        reader = BytesReader(data or b"")
        try:
            doc = open_lazy(reader)
            made = []
            for part in parts:
                if part == "metadata":
                    own = doc.metadata(str(doc_id))
                    made.append(tuple(own[f.name] for f in schema[part].dataType.fields))
                else:
                    made.append(list(MAKERS[part](doc)))
            return [None, reader.touched, *made]
        except Exception as e:  # one bad file must not end the job
            return [str(e) if isinstance(e, LazyError) else f"{type(e).__name__}: {e}", reader.touched, *[None] * len(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 1):
                rows = [one(doc_id, data.as_py()) for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
                columns = [column([r[k] for r in rows], f.dataType, arrow.field(k + 1).type) for k, f in enumerate(schema.fields[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    return docs.select("doc_id", "content").mapInArrow(run, schema)


def _deep(doc: LazyDocument, target: dict) -> deep.Enrichment:
    if target["kind"] == "page":
        return deep.deep_page(doc, target["number"])
    return {"stream": deep.deep_stream, "object": deep.deep_object}[target["kind"]](doc, (target["number"], target["gen"] or 0))


def _with_targets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """docs with the array targets, in order of kind, number and generation; a document without any has none."""
    per = targets.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("kind", F.col("number").cast("long").alias("number"), F.col("gen").cast("int").alias("gen")))).alias("targets"))
    return docs.select("doc_id", "content").join(per, "doc_id", "left")


def deep_diagnostics(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id and ENRICHMENT of each of targets (doc_id, kind: page, stream or object, number, gen) in docs (doc_id, content).

    A target that can't be read gives its error; targets of documents that aren't there give nothing.
    """
    rows = _with_targets(docs, targets).filter("targets is not null")
    schema = StructType().add("doc_id", docs.schema["doc_id"].dataType)
    for f in _parse_datatype_string(ENRICHMENT).fields:
        schema.add(f)
    arrow = to_arrow_schema(schema)

    def one(data: bytes | None, wanted: list[dict]) -> Iterator[tuple]:
        doc = failed = None
        try:
            doc = open_lazy(BytesReader(data or b""))
        except Exception as e:
            failed = str(e)
        for t in wanted:
            name = f"Page {t['number']}" if t["kind"] == "page" else f"{t['kind'].capitalize()} {t['number']} {t['gen'] or 0} R"
            try:
                if doc is None:
                    raise LazyError(failed)
                e = _deep(doc, t)
                found = [(rule, severity, message, *(ref or (None, None)), page, offset, step) for rule, severity, message, ref, page, offset, step in e.findings]
                yield e.kind, e.target, e.page, *(e.ref or (None, None)), bool(e.limitations), e.summary, found, e.warnings, e.limitations, e.details, None
            except Exception as e:  # one bad target must not end the job
                yield t["kind"], name, *[None] * 9, str(e) if isinstance(e, LazyError) else f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 1):
                rows = [(doc_id, *r) for doc_id, data, wanted in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True) for r in one(data, wanted)]
                yield pa.RecordBatch.from_arrays([column([r[k] for r in rows], f.dataType, arrow.field(k).type) for k, f in enumerate(schema.fields)], schema=arrow)

    return rows.select("doc_id", "content", "targets").mapInArrow(run, schema)


def lazy_reports(docs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """doc_id, report (JSON), markdown and error of docs (doc_id, content), with deep diagnostics of targets that can be read."""
    rows = docs.select("doc_id", "content", F.lit(None).cast("array<struct<kind:string,number:bigint,gen:int>>").alias("targets")) if targets is None else _with_targets(docs, targets)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(doc_id, data: bytes | None, wanted: list[dict] | None) -> tuple:
        try:
            doc = open_lazy(BytesReader(data or b""))
            extra = []
            for t in wanted or ():
                try:
                    extra.append(_deep(doc, t))
                except LazyError:
                    continue
            made = lazy_report.report(doc, str(doc_id), extra)
            return lazy_report.as_json(made), lazy_report.as_markdown(made), None
        except Exception as e:
            return None, None, str(e) if isinstance(e, LazyError) else f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 1):
                made = [one(*r) for r in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([m[k] for m in made], pa.string()) for k in range(3)]], ["doc_id", "report", "markdown", "error"])

    return rows.select("doc_id", "content", "targets").mapInArrow(run, f"doc_id {kind}, report string, markdown string, error string")
