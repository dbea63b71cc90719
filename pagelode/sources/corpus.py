"""Deterministic PDF corpora rendered from rows of ordinary tables.

The queries of this repository run over such corpora where no PDF files are at
hand: each function takes a table and gives (doc_id, content), one document per
row or group, rendered in Arrow batches where the rows are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions.writer import Builder

FONT = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
ROOT = "<< /Root 1 0 R /Size {} >>"
ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def render(rows: DataFrame, build: Callable[[dict], bytes]) -> DataFrame:
    """doc_id and content from rows that have a doc_id and whatever build reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            got = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in got], pa.int64()), pa.array([build(r) for r in got], pa.binary())], ["doc_id", "content"])

    return rows.mapInArrow(run, "doc_id long, content binary")


def simple(content: bytes, page: str = "", box: str = "/MediaBox [0 0 200 200]", root: str = "") -> Builder:
    """Catalog, page tree, one page, its content and a font; the table is still to come."""
    b = Builder("1.4").add(1, f"<< /Type /Catalog /Pages 2 0 R {root} >>").add(2, f"<< /Type /Pages /Kids [3 0 R] /Count 1 {box} >>")
    b.add(3, f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R {page} >>")
    return b.stream(4, content).add(5, FONT)


TEXT = b"BT /F1 12 Tf (Hi) Tj ET"


def defective(kind: int) -> bytes:
    """A small document with defect kind modulo 8; 0 has none."""
    kind %= 8
    b = simple({4: b"BT /F1 12 Tf (Hi) Tj ZZ ET", 7: b"q BT /F1 12 Tf (Hi) Tj ET"}.get(kind, TEXT), box="" if kind == 6 else "/MediaBox [0 0 200 200]", page="/Annots [99 0 R]" if kind == 1 else "")
    size = 6
    if kind == 3:
        b.stream(6, b"not valid zlib bytes", "/Filter /FlateDecode")
    if kind == 5:
        b.stream(6, b"plain", length=80)
    if kind in (3, 5):
        size = 7
    return b.table(ROOT.format(size), shift={5: 7} if kind == 2 else None).bytes()


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per customer; its defect is the key modulo 8."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return render(rows, lambda r: defective(r["doc_id"]))


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order, one page per line item.

    Every second page has a box of its own, as wide as the quantity; the others inherit.
    """
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))).alias("lines"))

    def build(r: dict) -> bytes:
        pages = r["lines"]
        kids = " ".join(f"{10 + i} 0 R" for i in range(len(pages)))
        b = Builder().add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 100 50] /Rotate 90 >>")
        for i, p in enumerate(pages):
            box = f"/MediaBox [0 0 {p['l_quantity']:g} 70]" if p["l_linenumber"] % 2 else ""
            b.add(10 + i, f"<< /Type /Page /Parent 2 0 R {box} /Part {p['l_partkey']} >>")
        return b.table(ROOT.format(10 + len(pages))).bytes()

    return render(rows, build)


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per user of events; each event is an incremental update of the object of its type."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("events"))

    def build(r: dict) -> bytes:
        b = simple(TEXT).table(ROOT.format(6))
        prev = b.out.rfind(b"xref\n0 ")
        for e in r["events"]:
            number = 10 + KINDS.index(e["event_type"]) if e["event_type"] in KINDS else 10 + len(KINDS)
            b.add(number, f"<< /Event {e['event_id']} >>")
            at = len(b.out)
            b.table(f"<< /Root 1 0 R /Size 20 /Prev {prev} >>")
            prev = at
        return b.bytes()

    return render(rows, build)


# Event types in the order of their object numbers, from 10 on.
KINDS = ["click", "error", "purchase", "signup", "view"]


def object_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per part: an object stream under one of five filters holds its name and size."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand", "p_size")

    def build(r: dict) -> bytes:
        first, second = f"<< /Name ({r['p_name']}) /Brand ({r['p_brand']}) >>", f"<< /Size {r['p_size']} >>"
        head = f"20 0 21 {len(first) + 1} "
        data = (head + first + " " + second).encode()
        names, raw = filtered(r["p_size"] % 5, data)
        b = simple(TEXT).stream(6, raw, f"/Type /ObjStm /N 2 /First {len(head)} {names}")
        return b.table(ROOT.format(22)).bytes()

    return render(rows, build)


def filtered(kind: int, data: bytes) -> tuple[str, bytes]:
    """A /Filter entry and data encoded for it."""
    if kind == 1:
        return "/Filter /FlateDecode", zlib.compress(data)
    if kind == 2:
        return "/Filter /AHx", data.hex().encode() + b">"
    if kind == 3:
        return "/Filter [/ASCII85Decode /Fl]", ascii85(zlib.compress(data))
    if kind == 4:
        out = bytearray()
        for i in range(0, len(data), 128):
            out += bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128]
        return "/Filter /RunLengthDecode", bytes(out) + b"\x80"
    return "", data


def ascii85(data: bytes) -> bytes:
    import base64

    return base64.a85encode(data) + b"~>"


def event_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per user of events whose page content is one operator per event."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("events"))

    def build(r: dict) -> bytes:
        content = "\n".join(f"{e['event_id']} {OPERATOR_OF.get(e['event_type'], 'ZZ')}" for e in r["events"])
        return simple(content.encode()).table(ROOT.format(6)).bytes()

    return render(rows, build)


# The content operator that an event type stands for; all others are unknown operators.
OPERATOR_OF = {"click": "q", "error": "ZZ", "purchase": "BT", "signup": "ET", "view": "Q"}


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per region: its nations are fonts, its content uses the next region's nations as well."""
    n = table(spark, sf_dir, "nation")
    rows = n.groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("own"))

    def build(r: dict) -> bytes:
        fonts = " ".join(f"/N{k} 5 0 R" for k in r["own"])
        content = " ".join(f"/N{k + d} 9 Tf /X{k + d} Do" for k in r["own"] for d in (0, 1))
        images = " ".join(f"/X{k} 6 0 R" for k in r["own"] if k % 2)
        b = Builder().add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 9 9] /Resources 7 0 R >>")
        b.add(3, "<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>").stream(4, content.encode()).add(5, FONT)
        b.stream(6, b"\0", "/Type /XObject /Subtype /Image /Width 1 /Height 1").add(7, f"<< /Font << {fonts} >> /XObject << {images} >> >>")
        return b.table(ROOT.format(8)).bytes()

    return render(rows, build)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per nation: a form whose field tree is nation, market segment, customer."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    own = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list(F.struct("c_mktsegment", "c_custkey"))).alias("customers"))
    rows = n.join(own, "n_nationkey").select(F.col("n_nationkey").cast("long").alias("doc_id"), "n_name", "customers")

    def build(r: dict) -> bytes:
        segments: dict[str, list[int]] = {}
        for x in r["customers"]:
            segments.setdefault(x["c_mktsegment"], []).append(x["c_custkey"])
        b = simple(TEXT, root="/AcroForm << /Fields [10 0 R] >>")
        kids = " ".join(f"{20 + i} 0 R" for i in range(len(segments)))
        b.add(10, f"<< /T ({r['n_name']}) /Kids [{kids}] >>")
        number = 100
        for i, (segment, keys) in enumerate(segments.items()):
            refs = " ".join(f"{number + k} 0 R" for k in range(len(keys)))
            b.add(20 + i, f"<< /T ({segment}) /Kids [{refs}] >>")
            for key in keys:
                b.add(number, f"<< /T (c{key}) /FT /{'Tx' if key % 2 else 'Btn'} >>")
                number += 1
        return b.table(ROOT.format(number)).bytes()

    return render(rows, build)


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per supplier: each of its line items is an annotation with a rectangle."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))).alias("lines"))

    def build(r: dict) -> bytes:
        refs = " ".join(f"{10 + i} 0 R" for i in range(len(r["lines"])))
        b = simple(TEXT, page=f"/Annots [{refs}]")
        for i, x in enumerate(r["lines"]):
            q, n = x["l_quantity"], x["l_linenumber"]
            b.add(10 + i, f"<< /Type /Annot /Subtype /{'Link' if x['l_returnflag'] == 'R' else 'Text'} /Rect [{n} {n} {n + q:g} {n + 2 * q:g}] /F {n} /Contents (order {x['l_orderkey']}) >>")
        return b.table(ROOT.format(10 + len(r["lines"]))).bytes()

    return render(rows, build)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per supplier with key modulo 5 objects that nothing refers to."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name", "s_nationkey")

    def build(r: dict) -> bytes:
        b = simple(TEXT, root="/Names << /Title (x) >>")
        for i in range(r["doc_id"] % 5):
            b.add(30 + i, f"<< /Type /Extra /Name ({r['s_name']}) /N {r['s_nationkey']} >>")
        return b.table(ROOT.format(40)).bytes()

    return render(rows, build)


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per part that refers to objects 100 and up by supplier of its line items; of those only numbers divisible by 3 exist."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("to"))

    def build(r: dict) -> bytes:
        refs = " ".join(f"{100 + k} 0 R" for k in r["to"])
        b = simple(TEXT).add(6, f"[{refs}]")
        for k in r["to"]:
            if (100 + k) % 3 == 0:
                b.add(100 + k, f"({k})")
        return b.table(ROOT.format(1000)).bytes()

    return render(rows, build)


LINE = 200


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per row of documents: its whole text in lines of two-byte codes, with a ToUnicode map of the characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def build(r: dict) -> bytes:
        codes = {c: i for i, c in enumerate(sorted(set(r["text"])))}
        lines = [r["text"][i : i + LINE] for i in range(0, len(r["text"]), LINE)]
        shown = "\n".join("<" + "".join(f"{codes[c]:04X}" for c in line) + "> Tj" for line in lines)
        pairs = "\n".join(f"<{i:04X}> <{c.encode('utf-16-be').hex().upper()}>" for c, i in codes.items())
        b = Builder().add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 9 9] >>")
        b.add(3, "<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>")
        b.stream(4, zlib.compress(f"BT /F1 9 Tf\n{shown}\nET".encode(), 1), "/Filter /FlateDecode")
        b.add(5, "<< /Type /Font /Subtype /Type0 /BaseFont /Any /ToUnicode 6 0 R >>").stream(6, f"{len(codes)} beginbfchar\n{pairs}\nendbfchar".encode())
        return b.table(ROOT.format(7)).bytes()

    return render(rows, build)


PAGE = "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>"
# The documents of faulty(), by kind: the catalog, the root of the page tree, object 8 and the trailer; None is as in a sound document.
FAULTS = (
    (None, None, None, "<< /Size 9 >>"),  # no catalog
    ("[1 2]", None, None, None),  # a catalog that is no dictionary
    ("<< /Type /Catalog >>", None, None, None),  # no pages
    ("<< /Type /Catalog /Pages << /Kids [] >> >>", None, None, None),  # pages that are no reference
    (None, "<< /Type /Pages /Kids [3 0 R 2 0 R] /Count 1 >>", None, None),  # a cycle
    (None, "<< /Type /Pages /Kids [3 0 R 77 0 R] /Count 1 >>", None, None),  # a missing node
    (None, "<< /Type /Pages /Kids [3 0 R 8 0 R] /Count 1 >>", "(text)", None),  # a node that is no dictionary
    (None, "<< /Type /Pages /Kids [3 0 R 8 0 R] /Count 1 >>", "<< /Type /Pages >>", None),  # a node without kids
    (None, "<< /Type /Pages /Kids [3 0 R 12] /Count 1 >>", None, None),  # a kid that is no reference
    (None, "<< /Type /Pages /Kids [3 0 R 8 0 R] /Count 1 >>", "<< /Type /Font >>", None),  # a node of another type
    (None, None, None, "<< /Root 1 0 R /Size 9 /Encrypt << /V 1 >> >>"),  # encryption
    (None, None, "<< /Type /ObjStm /N 0 /First 0 >>", None),  # an object stream
    (None, None, "<< /Type /XRef >>", None),  # a cross-reference stream
    (None, None, "<< /Filter /JBIG2Decode >>", None),  # a filter that isn't supported
    (None, None, "<< /Subtype /Image /Width 1 >>", None),  # an image without three of its keys
    (None, None, None, None),  # an update, see faulty_document()
    (None, None, None, None),  # no header
    (None, "<< /Type /Pages /Kids [3 0 R 100 0 R] /Count 1 >>", None, None),  # a tree 80 nodes deep
)
DEPTH = 80


def faulty_document(kind: int) -> bytes:
    """A document with one fault of those that FAULTS lists."""
    catalog, tree, other, trailer = FAULTS[kind]
    b = Builder("1.4").add(1, catalog or "<< /Type /Catalog /Pages 2 0 R >>").add(2, tree or "<< /Type /Pages /Kids [3 0 R] /Count 1 >>").add(3, PAGE).stream(4, TEXT).add(5, FONT)
    if other and other.startswith("<<") and kind >= 11:
        b.stream(8, b"", other[2:-2])
    elif other:
        b.add(8, other)
    if kind == 17:
        for i in range(DEPTH):
            b.add(100 + i, f"<< /Type /Pages /Kids [{101 + i} 0 R] >>")
        b.add(100 + DEPTH, PAGE)
    b.table(trailer or ROOT.format(9))
    if kind == 15:
        start = b.out.rfind(b"xref\n0 ")
        b.add(8, "(new)").table(f"<< /Root 1 0 R /Size 9 /Prev {start} >>")
    return b.bytes().replace(b"%PDF-", b"%XXX-") if kind == 16 else b.bytes()


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per customer; its fault is the key modulo the number of kinds."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return render(rows, lambda r: faulty_document(r["doc_id"] % len(FAULTS)))


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per supplier: by the key modulo 5 linearized, without startxref, without a table, with all offsets wrong, sound."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))

    def build(r: dict) -> bytes:
        kind = r["doc_id"] % 5
        b = Builder("1.4")
        b.add(9, "<< /Linearized 1 >>" if kind == 0 else "<< /Other 1 >>")
        for number, body in ((1, "<< /Type /Catalog /Pages 2 0 R >>"), (2, "<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), (3, "<< /Type /Page /Parent 2 0 R >>")):
            b.add(number, body)
        if kind == 2:
            return b.bytes()
        made = b.table(ROOT.format(10), shift=dict.fromkeys((1, 2, 3, 9), 7) if kind == 3 else None).bytes()
        return made.replace(b"startxref", b"startnone") if kind == 1 else made

    return render(rows, build)


def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per part whose font lies in an object stream; odd keys have a classic table beside the cross-reference stream."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"))

    def build(r: dict) -> bytes:
        font = f"<< /Type /Font /Subtype /Type1 /BaseFont /P{r['doc_id']} >>"
        b = Builder("1.5").add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 >>").add(3, "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] >>")
        b.stream(6, b"5 0 " + font.encode(), "/Type /ObjStm /N 1 /First 4")
        start = len(b.out)
        offsets = {n: at for (n, _), at in b.offsets.items()} | {7: start}
        entries = b"".join(bytes([k]) + at.to_bytes(4, "big") + bytes(2) for n in range(8) for k, at in [(1, offsets[n]) if n in offsets else (2, 6) if n == 5 else (0, 0)])
        b.stream(7, entries, "/Type /XRef /W [1 4 2] /Size 8 /Root 1 0 R")
        if r["doc_id"] % 2:
            return b.table(f"<< /Root 1 0 R /Size 8 /XRefStm {start} >>").bytes()
        return b.bytes() + f"startxref\n{start}\n%%EOF\n".encode()

    return render(rows, build)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per customer with its name as creator: by the key modulo 3 a literal string, UTF-16 in hex, UTF-16 in a literal string."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")

    def build(r: dict) -> bytes:
        wide = b"\xfe\xff" + r["c_name"].encode("utf-16-be")
        literal = b"(" + wide.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
        creator = (f"({r['c_name']})".encode(), b"<" + wide.hex().encode() + b">", literal)[r["doc_id"] % 3]
        b = simple(TEXT).add(6, b"<< /Creator " + creator + b" /Mark#65d /A#20B >>")
        return b.table("<< /Root 1 0 R /Info 6 0 R /Size 7 >>").bytes()

    return render(rows, build)


def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per supplier whose page shows an image, a path and a form that draws a path, at places that follow from its columns."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_nationkey")

    def build(r: dict) -> bytes:
        x, y, w = r["doc_id"] % 30, r["doc_id"] % 40, r["s_nationkey"] + 1
        content = f"q {w} 0 0 {2 * w} {x} {y} cm /Im1 Do Q {x} {y} {w} {2 * w} re S q 2 0 0 2 {x} {y} cm /Fm1 Do Q".encode()
        b = Builder().add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 200] /Resources << /XObject << /Im1 6 0 R /Fm1 8 0 R >> >> >>")
        b.add(3, "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>").stream(4, content)
        b.stream(6, b"\0", "/Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8")
        b.stream(8, b"0 0 5 5 re S", "/Type /XObject /Subtype /Form /Matrix [1 0 0 1 3 4] /BBox [0 0 50 50]")
        return b.table(ROOT.format(9)).bytes()

    return render(rows, build)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per part that shows three glyphs with widths and kerning, in the part's size."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_size")

    def build(r: dict) -> bytes:
        content = f"BT /F1 {r['p_size']} Tf {r['doc_id'] % 50} 7 Td [(AB) {r['doc_id'] % 100} (C)] TJ ET".encode()
        b = Builder().add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 200] >>")
        b.add(3, "<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>").stream(4, content)
        b.add(5, "<< /Type /Font /Subtype /Type1 /BaseFont /Any /FirstChar 65 /Widths [600 700 800] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [66 /uni20AC] >> >>")
        return b.table(ROOT.format(6)).bytes()

    return render(rows, build)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per nation with an image of one sample: by the key modulo 4 gray, RGB, CMYK, JPEG data."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"))

    def build(r: dict) -> bytes:
        k = r["doc_id"]
        data, space, more = ((bytes([k]), "Gray", ""), (bytes([k, 2 * k, 3 * k]), "RGB", ""), (bytes([k, 2 * k, 3 * k, 200]), "CMYK", ""), (b"\xff\xd8" + bytes([k]), "RGB", "/Filter /DCTDecode"))[k % 4]
        b = simple(TEXT).stream(6, data, f"/Type /XObject /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /Device{space} {more}")
        return b.table(ROOT.format(7)).bytes()

    return render(rows, build)


STREAMS = 600
BARE = 12


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per region that is larger than the limits of trees, reports and checks: pages without boxes, the first with many content streams."""
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"))

    def build(r: dict) -> bytes:
        kids = " ".join(f"{10 + i} 0 R" for i in range(BARE))
        b = Builder("1.4").add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, f"<< /Type /Pages /Kids [{kids}] /Count {BARE} >>")
        for i in range(BARE):
            contents = f"/Contents [{' '.join(f'{100 + k} 0 R' for k in range(STREAMS))}]" if not i else ""
            b.add(10 + i, f"<< /Type /Page /Parent 2 0 R {contents} >>")
        for k in range(STREAMS):
            b.stream(100 + k, b"q Q " * 20)
        return b.table(ROOT.format(100 + STREAMS)).bytes()

    return render(rows, build)


# A content stream with a token of every kind.
EVERY_TOKEN = b"% note\n[1 2.5 (a(b)) <4142>] << /K true >> /N Do ) \xff"


def odd_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per nation whose content has every kind of token."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"))
    return render(rows, lambda r: simple(EVERY_TOKEN).table(ROOT.format(6)).bytes())
