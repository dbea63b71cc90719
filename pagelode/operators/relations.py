"""From documents (doc_id, content) to relations.

A document is parsed once, in one Arrow stage without a shuffle; each relation that
is asked for becomes an array column of that stage and is exploded in the JVM. What
isn't asked for isn't made. A document that can't be parsed gives a row with its
error instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructType, _parse_datatype_string

from pagelode.functions import content, structure, views
from pagelode.functions.page_objects import Inspector, TextInspector, rectangle
from pagelode.functions.document import FULL_LIMIT, Document, parse_document
from pagelode.functions.values import references, summary, walk

ROWS = 64  # documents parsed at a time
BYTES = 32 << 20

BOX = "struct<llx:double,lly:double,urx:double,ury:double,width:double,height:double>"
# Each relation's columns; all but metadata are arrays of these.
SCHEMAS = {
    "metadata": "file_name string, file_size long, pdf_version string, page_count long, encrypted boolean, linearized boolean, incremental_update_count int, root string, info string, trailer_keys array<string>, info_summary map<string,string>, object_count int, stream_count int, xref_entry_count int, has_xref_stream boolean, has_object_stream boolean, parse_warning_count int",
    "warnings": "ord int, byte_offset long, message string",
    "xref": "obj long, gen int, section int, byte_offset long, in_use boolean, valid_offset boolean",
    "objects": "obj long, gen int, value_type string, type string, subtype string, summary string, raw_start long, raw_end long, is_stream boolean, container long, keys array<string>",
    "index": "obj long, gen int, type string",
    "nodes": "obj long, gen int, container long, node int, parent int, depth int, key string, idx int, path array<int>, type string, num double, str string, ref_obj long, ref_gen int, summary string",
    "refs": "obj long, gen int, ref_obj long, ref_gen int",
    "targets": "obj long, gen int",
    "streams": "obj long, gen int, declared_length long, actual_length long, filters array<string>, raw_start long, raw_end long, decoded_length long, steps array<struct<filter:string,status:string,message:string>>, issues array<struct<filter:string,kind:string,message:string>>, image_missing array<string>",
    "stream_bytes": "obj long, gen int, raw binary, decoded binary, clean boolean",
    "pages": f"page int, obj long, gen int, media_box {BOX}, crop_box {BOX}, bleed_box {BOX}, trim_box {BOX}, art_box {BOX}, rotation int, contents int, annotations int, fonts int, xobjects int, images int",
    "page_links": "page int, ord int, kind string, label string, obj long, gen int",
    "tree_problems": "ord int, rule_id string, obj long, gen int, page int, byte_offset long, detail string",
    "page_checks": "ord int, page int, obj long, gen int, has_media_box boolean, byte_offset long, fonts array<string>, xobjects array<string>, fonts_used array<string>, xobjects_used array<string>",
    "page_operators": "ord int, page int, obj long, gen int, i int, name string, start long, end long, operands array<string>",
    "page_warnings": "ord int, page int, obj long, gen int, i int, name string, start long, end long, depth int, rule_id string, k int",
    "tree": "ord int, path array<int>, label string, kind string, obj long, gen int, summary string",
    "fields": "ord int, name string, obj long, gen int, field_type string",
    "field_warnings": "ord int, message string",
    "annotations": "ord int, page int, page_obj long, page_gen int, obj long, gen int, subtype string, rect string, flags string, contents string, color string, border string, appearance string, ca string, keys array<string>, llx double, lly double, urx double, ury double",
    "text_runs": "page int, seq int, text string",
    "page_objects": "page int, seq int, id string, kind string, label string, summary string, llx double, lly double, urx double, ury double, obj long, gen int, stream_obj long, stream_gen int, start long, end long, text string, properties array<struct<name:string,value:string>>, warnings array<string>",
    "page_object_warnings": "page int, ord int, rule_id string, obj long, gen int, message string",
    "images": "obj long, gen int, width int, height int, bits int, color_space string, jpeg boolean, renderable boolean",
    "image_previews": "obj long, gen int, media string, width int, height int, rgb binary, data binary",
    "inspections": "obj long, gen int, object_type string, summary string, raw_length long, keys array<string>, references array<struct<obj:long,gen:int>>, declared_length long, actual_length long, decoded_length long",
    "previews": "obj long, gen int, raw string, hex string, decoded string, truncated boolean",
    "content_views": "obj long, gen int, i int, name string, operands int, known boolean, explanation string, start long, end long",
    "tokens": "obj long, gen int, i int, kind string, lexeme string, start long, end long",
    "operators": "obj long, gen int, i int, name string, start long, end long, operands array<string>",
}


def _name_of(d: dict | None, key: str) -> str | None:
    v = (d or {}).get(key)
    return v[1] if v and v[0] == "Name" else None


def _objects(doc: Document):
    for o in doc.ordered():
        d = o.dictionary
        keys = sorted(d, key=str.encode) if d else []
        yield *o.ref, o.value[0], _name_of(d, "Type"), _name_of(d, "Subtype"), structure.object_summary(o), o.start, o.end, o.stream is not None, o.container[0] if o.container else None, keys


def _nodes(doc: Document):
    roots = [(o.ref, o.container[0] if o.container else None, ("Dictionary", o.stream.dictionary) if o.stream else o.value) for o in doc.ordered()]
    if doc.trailer:
        roots.append(((-1, 0), None, doc.trailer))
    for ref, container, value in roots:
        for node, parent, depth, key, idx, path, (kind, x) in walk(value):
            num = x if kind == "Number" else float(x) if kind == "Boolean" else None
            text = x if kind in ("Name", "String", "HexString", "Raw") else None
            to = x if kind == "Reference" else (None, None)
            yield *ref, container, node, parent, depth, key, idx, list(path), kind, num, text, *to, summary((kind, x))


def _refs(doc: Document):
    for o in doc.ordered():
        for to in sorted(set(references(("Dictionary", o.stream.dictionary) if o.stream else o.value))):
            yield *o.ref, *to
    for to in sorted(set(references(doc.trailer)) if doc.trailer else ()):
        yield -1, 0, *to


def _streams(doc: Document):
    for o in doc.ordered():
        if o.stream:
            s, got = o.stream, o.stream.decode()
            missing = [k for k in ("Width", "Height", "ColorSpace", "BitsPerComponent") if k not in s.dictionary] if _name_of(s.dictionary, "Subtype") == "Image" else []
            yield *o.ref, s.declared, max(s.end - s.start, 0), s.filters, s.start, s.end, got.length, got.steps, got.issues, missing


def _stream_bytes(doc: Document):
    for o in doc.ordered():
        if o.stream:
            got = o.stream.decode()
            yield *o.ref, o.stream.raw, got.data, not got.issues


def _pages(doc: Document):
    for p in structure.pages(doc):
        yield p.number, *p.ref, *[p.boxes[k] for k in structure.BOXES], p.rotation, *[p.counts[k] for k in ("contents", "annotations", "fonts", "xobjects", "images")]


def _page_links(doc: Document):
    for p in structure.pages(doc):
        for i, (kind, label, ref) in enumerate(p.links):
            yield p.number, i, kind, label, *ref


def _targets(doc: Document):
    """What any value names, once each."""
    named = {to for o in doc.objects.values() for to in references(("Dictionary", o.stream.dictionary) if o.stream else o.value)}
    yield from sorted(named | set(references(doc.trailer) if doc.trailer else ()))


def _checked(doc: Document) -> list:
    """The page tree as the rules see it, each page with its operators; made once a document."""
    made = doc.__dict__.get("_checked")
    if made is None:
        made = doc.__dict__["_checked"] = [(i, p, structure.page_operators(p.data) if isinstance(p, structure.PageContent) and p.data else []) for i, p in enumerate(structure.check_pages(doc))]
    return made


def _tree_problems(doc: Document):
    for i, p, _ in _checked(doc):
        if isinstance(p, structure.Problem):
            yield i, p.rule, *(p.ref or (None, None)), p.page, p.offset, p.detail


def _page_checks(doc: Document):
    for i, p, ops in _checked(doc):
        if isinstance(p, structure.PageContent):
            yield i, p.page, *p.ref, p.has_media_box, p.offset, p.fonts, p.xobjects, sorted(content.fonts_used(ops)), sorted(content.xobjects_used(ops))


def _page_operators(doc: Document):
    for i, p, ops in _checked(doc):
        for j, op in enumerate(ops):
            yield i, p.page, *p.ref, j, op.name, op.start, op.end, [t.lexeme for t in op.operands]


def _page_warnings(doc: Document):
    for i, p, ops in _checked(doc):
        for found in content.problems(ops):
            yield i, p.page, *p.ref, *found


def _tree(doc: Document):
    for i, n in enumerate(structure.object_tree(doc)):
        yield i, list(n.path), n.label, n.kind, *(n.ref or (None, None)), n.summary


def _annotations(doc: Document):
    for i, a in enumerate(structure.annotations(doc, structure.pages(doc))[0]):
        box = rectangle((doc.dictionary(("Reference", a["ref"])) or {}).get("Rect")) or [None] * 4
        yield i, a["page"], *a["page_ref"], *a["ref"], *[a[k] for k in ("subtype", "rect", "flags", "contents", "color", "border", "appearance", "ca", "keys")], *box


def _text_runs(doc: Document):
    for p in structure.pages(doc):
        for i, text in enumerate(TextInspector(doc, p).run().texts):
            yield p.number, i + 1, text


def _page_objects(doc: Document):
    for p in structure.pages(doc):
        for i, o in enumerate(Inspector(doc, p).run().shown):
            yield p.number, i + 1, o.id, o.kind, o.label, o.summary, *(o.bbox or [None] * 4), *(o.ref or (None, None)), *(o.stream or (None, None)), *(o.range or (None, None)), o.text, o.properties, o.warnings


def _page_object_warnings(doc: Document):
    for p in structure.pages(doc):
        for i, (rule, ref, message) in enumerate(Inspector(doc, p).run().warnings):
            yield p.number, i, rule, *(ref or (None, None)), message


def _images(doc: Document):
    for o in doc.ordered():
        meta = views.image_metadata(o) if o.stream else None
        if meta:
            yield *o.ref, *[meta[k] for k in ("width", "height", "bits", "color_space", "jpeg", "renderable")]


def _image_previews(doc: Document):
    """Images that can be shown: JPEG data as it stands, other samples as RGB and as a PNG file."""
    for o in doc.ordered():
        meta = views.image_metadata(o) if o.stream else None
        if meta and meta["jpeg"]:
            got = o.stream.decode()
            if not got.issues:
                yield *o.ref, "image/jpeg", meta["width"], meta["height"], None, got.data
        elif meta and (shown := views.pixels(o)):
            yield *o.ref, "image/png", *shown, views.png(*shown)


def _inspections(doc: Document):
    for o in doc.ordered():
        own = views.inspect_object(o)
        stream = own["stream"] or {}
        yield *o.ref, own["object_type"], own["value_summary"], own["raw_length"], own["dictionary_keys"], [(r["object"], r["generation"]) for r in own["references"]], stream.get("declared_length"), stream.get("actual_length"), stream.get("decoded_length")


def _previews(doc: Document):
    """The raw text of each object; of streams the bytes in hex and the decoded text."""
    raw = doc.__dict__["raw"]
    for o in doc.ordered():
        shown = [views.stream_preview(o, mode) for mode in ("hex", "decoded")] if o.stream else [{"text": None, "truncated": False}] * 2
        yield *o.ref, views.raw_preview(raw[o.start : o.end]), *[x["text"] for x in shown], any(x["truncated"] for x in shown)


def _content_views(doc: Document):
    for o in doc.ordered():
        if o.stream and _is_content(o.stream.dictionary):
            try:
                own = views.content_view(o)
            except views.NoContent:
                continue
            for i, op in enumerate(own["operators"]):
                yield *o.ref, i, op["name"], len(op["operands"]), op["known"], op["explanation"], op["byte_range"]["start"], op["byte_range"]["end"]


def _is_content(d: dict) -> bool:
    """No image and no XObject, so possibly page content."""
    return _name_of(d, "Subtype") != "Image" and _name_of(d, "Type") != "XObject"


def _content_streams(doc: Document):
    for o in doc.ordered():
        if o.stream and _is_content(o.stream.dictionary) and _name_of(o.stream.dictionary, "Type") not in ("ObjStm", "XRef", "Metadata"):
            got = o.stream.decode()
            if not got.issues:
                yield o.ref, got.data


def _tokens(doc: Document):
    for ref, data in _content_streams(doc):
        for i, t in enumerate(content.tokenize(data)):
            yield *ref, i, t.kind, t.lexeme, t.start, t.end


def _operators(doc: Document):
    for ref, data in _content_streams(doc):
        for i, op in enumerate(structure.page_operators(data)):
            yield *ref, i, op.name, op.start, op.end, [t.lexeme for t in op.operands]


MAKERS: dict[str, Callable] = {
    "warnings": lambda d: ((i, at, text) for i, (at, text) in enumerate(d.warnings)),
    "xref": lambda d: ((*e.ref, e.section, e.offset, e.in_use, e.valid) for e in d.xref),
    "objects": _objects,
    "nodes": _nodes,
    "index": lambda d: ((*o.ref, _name_of(o.dictionary, "Type")) for o in d.ordered()),
    "refs": _refs,
    "targets": _targets,
    "streams": _streams,
    "stream_bytes": _stream_bytes,
    "pages": _pages,
    "page_links": _page_links,
    "tree_problems": _tree_problems,
    "page_checks": _page_checks,
    "page_operators": _page_operators,
    "page_warnings": _page_warnings,
    "tree": _tree,
    "fields": lambda d: ((i, n, *r, t) for i, (n, r, t) in enumerate(structure.form_fields(d)[0])),
    "field_warnings": lambda d: enumerate(structure.form_fields(d)[1]),
    "annotations": _annotations,
    "text_runs": _text_runs,
    "page_objects": _page_objects,
    "page_object_warnings": _page_object_warnings,
    "images": _images,
    "image_previews": _image_previews,
    "inspections": _inspections,
    "previews": _previews,
    "content_views": _content_views,
    "tokens": _tokens,
    "operators": _operators,
}


def _struct(part: str) -> StructType:
    return _parse_datatype_string(SCHEMAS[part])


def column(values: list, kind: DataType, arrow: pa.DataType) -> pa.Array:
    """values, in which tuples stand for structs, as an Arrow array."""
    if isinstance(kind, StructType):
        rows = [(None,) * len(kind) if v is None else tuple(v) for v in values]
        children = [column([r[i] for r in rows], f.dataType, arrow.field(i).type) for i, f in enumerate(kind.fields)]
        return pa.StructArray.from_arrays(children, fields=list(arrow), mask=pa.array([v is None for v in values], pa.bool_()))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        lengths = [0 if v is None else len(v) for v in values]
        offsets = [0, *accumulate(lengths)]
        flat = column([x for v in values if v is not None for x in v], kind.elementType, arrow.value_type)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, type=arrow, mask=pa.array([v is None for v in values], pa.bool_()))
    return pa.array([list(v.items()) if isinstance(v, dict) else v for v in values], arrow)


def batches_of(batch: pa.RecordBatch, content: int, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most `rows` rows and, more than one row in it, `size` bytes of its column `content`."""
    lengths = [x or 0 for x in pc.binary_length(batch.column(content)).to_pylist()]
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def parse(docs: DataFrame, *parts: str, gui: bool = False) -> DataFrame:
    """doc_id, error and a column for each of parts, from docs (doc_id, content and, if there, path and length).

    gui picks the reading mode that skips table entries whose offsets fail instead of
    scanning the file. Contents that are null or over the full-parse limit get an error, as do failures.
    """
    kind = docs.schema["doc_id"].dataType
    name = F.col("path") if "path" in docs.columns else F.col("doc_id").cast("string")
    length = F.col("length").cast("long") if "length" in docs.columns else F.length("content").cast("long")
    needs_bytes = bool({"streams", "stream_bytes", "page_checks", "page_operators", "page_warnings", "text_runs", "page_objects", "page_object_warnings", "image_previews", "inspections", "previews", "content_views", "tokens", "operators", "tree_problems"} & set(parts))
    schema = StructType().add("doc_id", kind).add("error", "string")
    for part in parts:
        schema.add(part, _struct(part) if part == "metadata" else ArrayType(_struct(part)))
    arrow = to_arrow_schema(schema)

    def one(path, size: int | None, data: bytes | None) -> list:
        try:
            if data is None or len(data) > FULL_LIMIT:
                raise ValueError("file has no content" if size is None else f"file is {size} bytes, over the full parse limit of {FULL_LIMIT}")
            doc = parse_document(data, skip_invalid=gui, keep_streams=needs_bytes)
            doc.__dict__["raw"] = data
            made = []
            for part in parts:
                if part == "metadata":
                    own = doc.metadata(path)
                    made.append(tuple(own[f.name] for f in schema[part].dataType.fields))
                else:
                    made.append(list(MAKERS[part](doc)))
            return [None, *made]
        except Exception as e:  # one bad file must not end the job
            return [f"{type(e).__name__}: {e}", *[None] * len(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 3):
                rows = [one(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()) for i in range(batch.num_rows)]
                columns = [column([r[k] for r in rows], f.dataType, arrow.field(k + 1).type) for k, f in enumerate(schema.fields[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    return docs.select("doc_id", name.alias("path"), length.alias("length"), "content").mapInArrow(run, schema)


def relation(parsed: DataFrame, part: str) -> DataFrame:
    """One relation of parse(): doc_id and the columns of SCHEMAS[part]."""
    if part == "metadata":
        return parsed.filter(F.col(part).isNotNull()).select("doc_id", f"{part}.*")
    return parsed.select("doc_id", F.explode(part).alias("_r")).select("doc_id", "_r.*")
