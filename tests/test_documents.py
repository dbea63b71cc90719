"""Parsing, structure and rules on documents built in code."""

import zlib

import pytest
from pyspark.sql import functions as F

from pagelode.functions import content, filters, structure
from pagelode.functions.document import parse_document
from pagelode.functions.strings import decode_hex_text, decode_text
from pagelode.functions.values import number_text, parse_value, references, summary, walk
from pagelode.functions.writer import Builder, Edit, EditError, apply_edit, replace_stream, scalar, serialize
from pagelode.operators.relations import parse, relation
from pagelode.plans import queries, rules
from pagelode.sources import corpus
from pagelode.sources.corpus import FONT, ROOT, TEXT, defective, simple


def minimal():
    return simple(TEXT).table(ROOT.format(6)).bytes()


def xref_stream(with_object_stream):
    b = Builder("1.5").add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 >>").add(3, "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] >>")
    if with_object_stream:
        b.stream(6, b"5 0 " + FONT.encode(), "/Type /ObjStm /N 1 /First 4")
    start = len(b.out)
    rows = bytearray()
    offsets = {n: at for (n, _), at in b.offsets.items()} | {7: start}
    for n in range(8):
        kind, at, last = (1, offsets[n], 0) if n in offsets else (2, 6, 0) if n == 5 and with_object_stream else (0, 0, 0)
        rows += bytes([kind]) + at.to_bytes(4, "big") + last.to_bytes(2, "big")
    b.stream(7, bytes(rows), "/Type /XRef /W [1 4 2] /Size 8 /Root 1 0 R")
    b.out += f"startxref\n{start}\n%%EOF\n".encode()
    return b.bytes()


def test_minimal():
    doc = parse_document(minimal())
    meta = doc.metadata("m")
    assert (meta["pdf_version"], meta["page_count"], meta["object_count"], meta["xref_entry_count"]) == ("1.4", 1, 5, 6)
    assert not doc.warnings and all(e.valid for e in doc.xref if e.in_use)
    assert len(doc.objects[(4, 0)].stream.raw) == 23
    assert list(references(doc.objects[(1, 0)].value)) == [(2, 0)]


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        (b"[1 2.50 -3 .5]", "Array", "[4 item(s)]"), (b"<< /B 1 /A (x) /A (y) >>", "Dictionary", "<<A, B>>"), (b"12 0 R", "Reference", "12 0 R"), (b"12 0 X", "Number", "12"),
        (b"(a\\(b\\)\\101)", "String", "(a(b)101)"), (b"<48 65 6C>", "HexString", "(Hel)"), (b"/A#20B", "Name", "/A B"), (b"truex", "Boolean", "true"), (b"% c\n null", "Null", "null"),
        (b"abc", "Raw", "abc"), (b"0.00001", "Number", "0.00001"), (b"1e5", "Number", "1"), (b".", "Raw", "."),
    ],
)
def test_values(text, kind, shown):
    value, _ = parse_value(text)
    assert (value[0], summary(value)) == (kind, shown)


@pytest.mark.parametrize("text", [b"", b"<< /A >>", b"[1 2", b"<< A 1 >>", b"+", b")", b"(a\\"])
def test_no_value(text):
    assert parse_value(text) is None


def test_deep_values_need_no_recursion():
    value, end = parse_value(b"[" * 50_000 + b"]" * 50_000)
    assert end == 100_000 and sum(1 for _ in walk(value)) == 50_000


def test_numbers():
    assert [number_text(x) for x in (1.0, -2.5, 1e-7, 1e300, 123456789.25)] == ["1", "-2.5", "0.0000001", str(2**63 - 1), "123456789.25"]


def test_strings():
    assert decode_text(b"\xfe\xff\x00M\x00S")[:2] == ("MS", "Utf16Be")
    assert decode_text(b"\xff\xfeM\x00")[:2] == ("M", "Utf16Le")
    assert decode_text(b"H\x8di")[:2] == ("H“i", "PdfDocEncoding")
    assert decode_text("é".encode())[:2] == ("é", "Utf8")
    assert decode_text(b"\xfe\xff\xd8\x3d\xde\x00\xd8\x00")[0] == "\U0001f600�"
    assert decode_hex_text("FEFF004D2")[2][0].startswith("Odd-length")


def test_filters():
    assert filters.decode(b"48656c6c6f>", ["AHx"]).data == b"Hello"
    assert filters.decode(b'<~87cURD]i,"Ebo7~>', ["ASCII85Decode"]).data == b"Hello World"
    assert filters.decode(bytes([2]) + b"abc" + bytes([254]) + b"Z" + bytes([128]), ["RL"]).data == b"abcZZZ"
    assert filters.decode(zlib.compress(b"x" * 99), ["Fl"]).data == b"x" * 99
    assert filters.decode(zlib.compress(b"x" * 99), ["FlateDecode"], 10).issues[0][1] == "failed"
    assert filters.decode(zlib.compress(b"x" * 99)[:-6], ["FlateDecode"]).issues
    assert filters.decode(b"x", ["DCT", "Crypt", "Fl"]).issues == [("Crypt", "unsupported", "unsupported stream filter /Crypt")]


def test_content_tokens_end_on_stray_delimiters():
    ops = content.operators(content.tokenize(b"BT /F1 12 Tf (a(b)\\)) Tj ) } > ET [ 1 true ] << /A 1 >> 3 4 re BI /W 1 ID x [ ] EI Q"))
    assert [o.name for o in ops] == ["BT", "Tf", "Tj", "ET", "re", "BI", "ID", "EI", "Q"]
    assert [t.lexeme for t in ops[4].operands] == ["[", "1", "true", "]", "<<", "A", "1", ">>", "3", "4"]
    assert [t.lexeme for t in ops[8].operands] == ["[", "]"]
    assert content.fonts_used(ops) == {"F1"} and len(content.OPERATORS) == 73


def test_incremental_updates_and_fallbacks():
    b = simple(TEXT).table(ROOT.format(6))
    first = b.out.rfind(b"xref\n0 ")
    b.add(5, "<< /Updated true >>").add(6, "<< /Added true >>").table(f"<< /Root 1 0 R /Size 7 /Prev {first} >>")
    doc = parse_document(b.bytes())
    assert sum(e.in_use for e in doc.xref) == 6 and len(doc.xref) == 7 and doc.sections == 2
    assert "Updated" in doc.objects[(5, 0)].value[1]
    wrong = simple(TEXT).table(ROOT.format(6), shift={2: 3}).bytes()
    assert (2, 0) not in parse_document(wrong).objects
    gui = parse_document(wrong, skip_invalid=True)
    assert gui.warnings[0][1].startswith("Skipped 1 in-use")
    broken = simple(TEXT).table(ROOT.format(6), shift=dict.fromkeys(range(1, 5), 3)).bytes()
    doc = parse_document(broken)
    assert len(doc.objects) == 5 and "falling back" in doc.warnings[0][1]
    scanned = parse_document(minimal().replace(b"startxref", b"startxxxx"))
    assert len(scanned.xref) == 6 and scanned.trailer


def test_object_and_xref_streams():
    doc = parse_document(xref_stream(True))
    meta = doc.metadata("x")
    assert meta["has_xref_stream"] and meta["has_object_stream"] and meta["root"] == "1 0 R" and meta["page_count"] == 1
    assert doc.objects[(5, 0)].container == (6, 0) and doc.objects[(5, 0)].dictionary["BaseFont"] == ("Name", "Helvetica")
    assert [w[1] for w in doc.warnings] == ["No classic xref table was discovered"]


def test_page_inheritance():
    b = Builder().add(1, "<< /Type /Catalog /Pages 2 0 R >>")
    b.add(2, "<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 200 300] /CropBox [10 20 190 280] /Rotate 90 /Resources << /Font << /F1 5 0 R >> /XObject << /Im1 6 0 R >> >> >>")
    b.add(3, "<< /Type /Page /Parent 2 0 R /BleedBox [5 5 195 290] /Contents 4 0 R /Annots [7 0 R] >>").stream(4, TEXT).add(5, FONT)
    b.stream(6, b"\0", "/Subtype /Image").add(7, "<< /Subtype /Link /Rect [10 20 90 40] /F 4 /Contents (fixture link) >>")
    doc = parse_document(b.table(ROOT.format(8)).bytes())
    page = structure.pages(doc)[0]
    assert page.boxes["MediaBox"][4:] == (200, 300) and page.boxes["CropBox"][0] == 10 and page.boxes["BleedBox"][3] == 290 and page.rotation == 90
    assert set(page.counts.values()) == {1} and ("image", "/Im1 Image", (6, 0)) in page.links
    rows, warnings = structure.annotations(doc, [page])
    assert not warnings and (rows[0]["subtype"], rows[0]["rect"], rows[0]["flags"], rows[0]["contents"]) == ("/Link", "[4 item(s)]", "4", "fixture link")


def test_page_trees_with_cycles_and_depth():
    b = Builder().add(1, "<< /Type /Catalog /Pages 10 0 R >>")
    for i in range(500):
        b.add(10 + i, f"<< /Type /Pages /Kids [{11 + i} 0 R 10 0 R 9 0 R 7] >>")
    doc = parse_document(b.add(510, "<< /Type /Page >>").table(ROOT.format(600)).bytes())
    assert [p.ref for p in structure.pages(doc)] == [(510, 0)]
    found = [p.rule for p in structure.check_pages(doc) if isinstance(p, structure.Problem)]
    assert found.count("page_tree.cyclic_reference") == 500 + 499 and found.count("page_tree.missing_node") == 1 and found.count("page_tree.invalid_kid_reference") == 500


def test_form_fields():
    b = simple(TEXT, root="/AcroForm 6 0 R").add(6, "<< /Fields [7 0 R 8 0 R << /T (direct) >>] >>").add(7, "<< /T (zName) /FT /Tx >>").add(8, "<< /T (contact) /Kids [9 0 R 8 0 R] >>").add(9, "<< /T (email) /FT /Tx >>")
    fields, warnings = structure.form_fields(parse_document(b.table(ROOT.format(10)).bytes()))
    assert fields == [("contact.email", (9, 0), "Tx"), ("zName", (7, 0), "Tx")]
    assert len(warnings) == 2 and "Cycle" in warnings[0] and "direct" in warnings[1]


def test_all_form_fields(spark, tmp_path):
    n = structure.FIELDS + 5
    spark.createDataFrame([(7, "PERU", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.range(n).selectExpr("id as c_custkey", "7 as c_nationkey", "'BUILDING' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    names = sorted(f"PERU.BUILDING.c{k}" for k in range(n))
    assert sorted(r["name"] for r in queries.form_fields(spark, str(tmp_path)).collect()) == names
    assert [(r["doc_id"], r["n"]) for r in queries.form_field_search(spark, str(tmp_path)).collect()] == [(7, n)]
    assert sorted((r["ord"], r["name"]) for r in queries.ordered_fields(spark, str(tmp_path)).collect()) == list(enumerate(names))
    doc = parse_document(corpus.forms(spark, str(tmp_path)).first()["content"])
    fields, warnings = structure.form_fields(doc, structure.FIELDS)
    assert len(fields) == structure.FIELDS and len(warnings) == 5 and "limit reached (10000)" in warnings[0]


@pytest.mark.parametrize("query", ["form_field_search", "ordered_fields"])
def test_large_forms_against_sql(spark, tmp_path, query):
    """Forms of more fields than a viewer lists, with repeated keys, in mixed order."""
    duckdb = pytest.importorskip("duckdb")
    rows = 2 * (structure.FIELDS + 2000)
    spark.createDataFrame([(0, "PERU", 1), (1, "CHINA", 2)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    customers = spark.range(rows).selectExpr("id * 7919 % 11000 as c_custkey", "cast(id % 2 as int) as c_nationkey", "if(id % 4 < 2, 'AUTOMOBILE', 'BUILDING') as c_mktsegment")
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    sql = duckdb.connect()
    for name in ("nation", "customer"):
        sql.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.QUERIES[query](spark, str(tmp_path))
    want = sql.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[query]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_edits():
    doc = parse_document(simple(zlib.compress(b"Old"), page="/X [1 (a)]").table(ROOT.format(6)).bytes().replace(b">>\nstream\nx", b"/Filter /Fl >>\nstream\nx"))
    apply_edit(doc, Edit((3, 0), ["X", 1], "(b)"))
    apply_edit(doc, Edit((2, 0), ["Count"], "7"))
    again = parse_document(serialize(doc))
    assert again.page_count() == 7 and again.objects[(3, 0)].value[1]["X"] == ("Array", [("Number", 1.0), ("String", "b")])
    for text in ("[1]", "<< >>", "true", "null", "1 0 R", "1 2", ""):
        with pytest.raises(EditError):
            scalar(text)
    sparse = parse_document(Builder().add(3, "(a)").add(70, "(b)", 2).table("<< /Size 71 >>").bytes())
    assert parse_document(serialize(sparse)).objects.keys() == {(3, 0), (70, 2)}
    plain = parse_document(minimal())
    replace_stream(plain, (4, 0), b"q Q")
    back = parse_document(serialize(plain)).objects[(4, 0)].stream
    assert (back.raw, back.declared) == (b"q Q", 3)


EXPECTED = {0: [], 1: ["object.missing_reference"], 2: ["object.missing_reference", "xref.invalid_offset"], 3: ["stream.decode_failed"], 4: ["content.unknown_operator"], 5: ["stream.length_mismatch"], 6: ["page.missing_mediabox"], 7: ["content.unbalanced_graphics_state"]}


def test_rules(spark):
    docs = spark.createDataFrame([(k, bytearray(defective(k))) for k in range(8)] + [(8, bytearray(b"junk")), (9, None), (10, bytearray(xref_stream(True)))], "doc_id long, content binary")
    found = {}
    for r in rules.findings(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["ord"], r["rule_id"], r["message"]))
    assert {k: sorted(x[1] for x in found.get(k, [])) for k in range(8)} == EXPECTED
    assert [x[1] for x in sorted(found[8])] == ["parse.warning"] * 4 + ["page_tree.missing_catalog"]
    assert {x[1] for x in found[10]} == {"parse.warning", "document.object_stream_detected", "document.xref_stream_detected"}
    assert rules.findings(docs.filter("false")).count() == 0


def test_content_warnings_match_a_fold(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for d in range(120):
        names = [rng.choice(["q", "Q", "BT", "ET", "ZZ", "re"]) for _ in range(rng.randint(1, 25))]
        rows += [(d, i, n, i, i + 1) for i, n in enumerate(names)]
        depth, open_text, out = 0, False, []
        for n in names:
            if n == "ZZ":
                out.append("content.unknown_operator")
            if n == "BT":
                out += ["content.nested_text_object"] * open_text
                open_text = True
            if n == "ET":
                out += ["content.unmatched_text_end"] * (not open_text)
                open_text = False
            if n == "Q" and not depth:
                out.append("content.unmatched_graphics_restore")
            depth = max(0, depth + (n == "q") - (n == "Q"))
        want[d] = sorted(out + ["content.unclosed_text_object"] * open_text + ["content.unbalanced_graphics_state"] * (depth > 0))
    got = {}
    for r in rules.content_warnings(spark.createDataFrame(rows, "doc_id long, i int, name string, start long, end long"), ["doc_id"]).collect():
        got.setdefault(r["doc_id"], []).append(r["rule"])
    assert {d: sorted(got.get(d, [])) for d in want} == want


def test_files_and_errors(spark, tmp_path):
    from pagelode.sources.files import read_pdfs

    (tmp_path / "a.pdf").write_bytes(minimal())
    (tmp_path / "b.PDF").write_bytes(minimal() + b"%" * 4000)
    (tmp_path / "c.txt").write_bytes(b"no")
    docs = read_pdfs(spark, str(tmp_path), most=2000)
    rows = {r["doc_id"].rsplit("/", 1)[1]: r["content"] for r in docs.collect()}
    assert set(rows) == {"a.pdf", "b.PDF"} and rows["b.PDF"] is None
    meta = relation(parse(docs.filter("content is not null"), "metadata"), "metadata").collect()
    assert [m["page_count"] for m in meta] == [1]


def test_streaming_ingestion(spark, tmp_path):
    """The latest version of a path counts across batches, and a batch that runs again adds nothing."""
    import os
    import shutil

    from pagelode.streaming.ingest import current, stream_pdfs, write_relations

    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")

    def arrive(check: str) -> None:
        made = lambda df: relation(parse(df, "metadata"), "metadata").select("doc_id", "file_size", "page_count")
        docs = stream_pdfs(spark, str(tmp_path / "in")).withColumn("doc_id", F.regexp_extract("path", r"/(\w)\d\.pdf$", 1))
        write_relations(docs, made, out, str(tmp_path / check)).awaitTermination()

    def now() -> list:
        return sorted((r["doc_id"], r["page_count"], r["file_size"]) for r in current(spark, out).collect())

    (tmp_path / "in" / "a1.pdf").write_bytes(minimal())
    arrive("check")
    assert now() == [("a", 1, len(minimal()))]
    shutil.copytree(tmp_path / "check", tmp_path / "before")
    (tmp_path / "in" / "a2.pdf").write_bytes(defective(3))
    os.utime(tmp_path / "in" / "a2.pdf", (2e9, 2e9))
    (tmp_path / "in" / "b1.pdf").write_bytes(minimal())
    arrive("check")
    want = [("a", 1, len(defective(3))), ("b", 1, len(minimal()))]
    assert now() == want
    arrive("before")  # the second batch once more
    assert now() == want and spark.read.parquet(f"{out}/rows").count() == 3


def test_exports(spark, tmp_path):
    from pagelode.operators.exports import export_documents, export_streams
    from pagelode.sources.files import read_pdfs

    docs = spark.createDataFrame([(1, bytearray(minimal())), (2, bytearray(defective(3)))], "doc_id long, content binary")
    export_documents(docs, str(tmp_path / "docs"))
    assert read_pdfs(spark, str(tmp_path / "docs")).count() == 2 and (tmp_path / "docs" / "1.pdf").read_bytes() == minimal()
    export_streams(relation(parse(docs, "stream_bytes"), "stream_bytes"), str(tmp_path / "streams"), decoded=True)
    assert sorted(p.name for p in (tmp_path / "streams").iterdir()) == ["1-4-0.bin", "2-4-0.bin"]


def test_images_relation(spark):
    b = simple(TEXT).stream(6, b"123", "/Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB")
    docs = spark.createDataFrame([(1, bytearray(b.table(ROOT.format(7)).bytes()))], "doc_id long, content binary")
    assert relation(parse(docs, "images"), "images").first()["renderable"]


def test_over_limit_files_are_errors(spark, monkeypatch, tmp_path):
    from pagelode.sources.files import read_pdfs

    (tmp_path / "a.pdf").write_bytes(minimal())
    (tmp_path / "b.pdf").write_bytes(minimal() + b"%" * 5000)
    got = {r["doc_id"].rsplit("/", 1)[1]: r for r in parse(read_pdfs(spark, str(tmp_path), most=4000), "metadata").collect()}
    assert got["a.pdf"]["error"] is None and got["a.pdf"]["metadata"]["page_count"] == 1
    assert got["b.pdf"]["metadata"] is None and "over the full parse limit" in got["b.pdf"]["error"]
    assert parse(spark.createDataFrame([(1, None)], "doc_id long, content binary"), "metadata").first()["error"] == "ValueError: file has no content"


def test_every_filter_has_a_bound(monkeypatch):
    from pagelode.functions import filters

    monkeypatch.setattr(filters, "BOMB_LIMIT", 1000)
    for name, raw in (("RunLengthDecode", b"\x81a" * 100), ("ASCII85Decode", b"z" * 300 + b"~>"), ("ASCIIHexDecode", b"41" * 2000 + b">"), ("FlateDecode", zlib.compress(bytes(5000)))):
        got = filters.decode(raw, [name])
        assert got.issues and "exceeds output limit of 1000 bytes" in got.issues[0][2]


def test_ascii85_matches_the_standard_library():
    import base64
    import random

    from pagelode.functions.filters import FilterError, ascii85

    rng = random.Random(1)
    for n in [*range(12), 50, 333]:
        data = bytes(rng.choice([0, 0, 0, rng.randrange(256)]) for _ in range(n))
        coded = base64.a85encode(data)
        assert ascii85(b"<~" + coded[:7] + b"\n " + coded[7:] + b"~>", None) == data
    for bad, message in ((b"ab|", "invalid ASCII85 byte 0x7C"), (b"abz|", "'z' short form"), (b"a|bz", "invalid ASCII85 byte 0x7C"), (b"abcdef", "only one digit")):
        with pytest.raises(FilterError, match=message):
            ascii85(bad, None)


def test_safe_saves_and_guarded_exports(spark, tmp_path):
    from pagelode.operators.exports import ExportError, draft_snapshots, export_documents, export_lazy_streams, save_in_place

    for name, data in (("a", minimal()), ("b", defective(3))):
        (tmp_path / f"{name}.pdf").write_bytes(data)
    path = lambda name: str(tmp_path / f"{name}.pdf")
    edited = minimal().replace(b"200 200", b"300 300")
    rows = spark.createDataFrame([(path("a"), bytearray(edited)), (path("b"), bytearray(b"no document")), (path("c"), bytearray(edited)), (path("b"), None)], "path string, content binary")
    got = [(r["path"], r["bytes"], r["error"]) for r in save_in_place(rows).collect()]
    assert (path("a"), len(edited), None) in got and sum(e is not None for *_, e in got) == 3
    assert (tmp_path / "a.pdf").read_bytes() == edited and (tmp_path / "b.pdf").read_bytes() == defective(3)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.pdf", "b.pdf"]
    docs = spark.createDataFrame([(1, path("a"), bytearray(edited)), (2, path("b"), bytearray(defective(3)))], "doc_id long, path string, content binary")
    with pytest.raises(ExportError):
        export_documents(docs, str(tmp_path), sources=[f"file://{tmp_path}"])
    wanted = spark.createDataFrame([(1, 4, 0), (2, 6, 0), (2, 3, 0), (1, 99, 0)], "doc_id long, obj long, gen int")
    got = {(r["doc_id"], r["obj"]): (r["bytes"], r["error"]) for r in export_lazy_streams(docs, wanted, str(tmp_path / "raw")).collect()}
    assert got[(1, 4)] == (len(TEXT), None) and got[(2, 6)] == (20, None) and got[(2, 3)][1] == "stream 3 0 R was not found" and "was not found" in got[(1, 99)][1]
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["1-4-0.bin", "2-6-0.bin"] and (tmp_path / "raw" / "1-4-0.bin").read_bytes() == TEXT
    got = {(r["doc_id"], r["obj"]): r["error"] for r in export_lazy_streams(docs, wanted.filter("obj in (4, 6)"), str(tmp_path / "decoded"), decoded=True).collect()}
    assert got[(1, 4)] is None and got[(2, 6)].startswith("/FlateDecode: ")
    edits = spark.createDataFrame([(1, 0, 2, 0, ["Count"], "7", None)], "doc_id long, ord int, obj long, gen int, path array<string>, value string, stream_text string")
    draft_snapshots(docs, edits, str(tmp_path / "drafts"))
    assert [p.name for p in (tmp_path / "drafts").iterdir()] == ["1-draft.pdf"] and b"/Count 7" in (tmp_path / "drafts" / "1-draft.pdf").read_bytes() and (tmp_path / "a.pdf").read_bytes() == edited


def test_lazy_limits(monkeypatch):
    from pagelode.functions import lazy

    def walked(data, only=None):
        doc = lazy.open_lazy(lazy.BytesReader(data))
        return [p.number for p in doc.page_index(only)], [(n.rule, n.message) for n in doc.notes]

    kids = " ".join(f"{10 + i} 0 R" for i in range(6))
    b = Builder().add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, f"<< /Type /Pages /Kids [{kids}] >>")
    for i in range(6):
        b.add(10 + i, "<< /Type /Page >>")
    data = b.table(ROOT.format(20)).bytes()
    assert walked(data) == ([1, 2, 3, 4, 5, 6], []) and walked(data, 3) == ([3], [])
    monkeypatch.setattr(lazy, "PAGES", 4)
    assert walked(data) == ([1, 2, 3, 4], [("lazy.page_tree.page_limit", "Page tree traversal reached page limit 4")])
    monkeypatch.setattr(lazy, "PAGE_NODES", 3)
    assert walked(data) == ([1, 2], [("lazy.page_tree.node_limit", "Page tree traversal reached node limit 3")])
    big = simple(b"x" * 3000).table(ROOT.format(6)).bytes()
    monkeypatch.setattr(lazy, "PREVIEW", 1000)
    view = lambda: lazy.open_lazy(lazy.BytesReader(big)).stream_view((4, 0))
    assert [w[0] for w in view()["warnings"]] == ["lazy.stream.preview_truncated", "lazy.stream.decoded_preview_truncated"] and len(view()["raw_preview"]) == 1000
    monkeypatch.setattr(lazy, "STREAM_IN", 2000)
    monkeypatch.setattr(lazy, "EXPORT_RAW", 2500)
    got = view()
    assert [w[0] for w in got["warnings"]] == ["lazy.stream.preview_truncated", "lazy.stream.decode_preview_skipped", "lazy.stream.raw_export_limit"]
    assert not got["can_export_raw"] and not got["can_export_decoded"] and got["decoded_preview"] is None
    with pytest.raises(lazy.LazyError, match="export limit 2500"):
        lazy.open_lazy(lazy.BytesReader(big)).export((4, 0))
    monkeypatch.setattr(lazy, "XREF_CHILDREN", 2)
    tree = lazy.open_lazy(lazy.BytesReader(big)).tree()
    assert [n.label for n in tree][-3:] == ["1 0 R", "2 0 R", "More xref objects"] and tree[-1].summary == "3 additional in-use object(s) hidden in this first lazy tree"


def test_xref_sections_read_odd_tables():
    from pagelode.functions.document import xref_section

    table = b"xref\r\n0 2\r\n0000000000 65535 f \r\n0000000017 00000 n \r\n\r\n5 1 \n 0000000099 00002 n\ngarbage\ntrailer\n<< /Size 3 /Prev 12 >>"
    assert xref_section(table, 0, None)[0] == [((0, 65535), 0, False), ((1, 0), 17, True), ((5, 2), 99, True)]
    assert xref_section(b"xref\n0 1\nbroken line\ntrailer << /Prev 7 >>", 0, None) == ([], ("Dictionary", {"Prev": ("Number", 7.0)}), 7)
    notes = []
    assert xref_section(b"xref\n0 0\ntrailer", 0, notes)[1] is None and notes == [(16, "Could not parse trailer dictionary")]
    assert xref_section(b"none", 0, None) is None
