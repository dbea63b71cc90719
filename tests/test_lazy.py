"""Reading by ranges."""

import pytest
from test_documents import xref_stream

from pagelode.functions import structure
from pagelode.functions.document import parse_document
from pagelode.functions.lazy import BytesReader, LazyError, fast_findings, open_lazy
from pagelode.functions.writer import Builder
from pagelode.sources.corpus import FONT, ROOT, TEXT, simple


def rules(data):
    return [f[0] for f in fast_findings(open_lazy(BytesReader(data)))]


def test_streams_of_entries_and_members():
    doc = open_lazy(BytesReader(xref_stream(True)))
    meta = doc.metadata("x")
    assert meta["has_xref_stream"] and meta["has_object_stream"] and meta["page_count"] == 1
    assert doc.objects[(5, 0)].dictionary["BaseFont"] == ("Name", "Helvetica") and doc.objects[(5, 0)].container == (6, 0)
    assert [p.ref for p in structure.pages(doc)] == [(3, 0)]
    assert rules(xref_stream(True)) == ["document.xref_stream_detected", "document.object_stream_detected", "lazy.deep_diagnostics_deferred"]


def test_newest_entry_wins_and_cycles_end():
    b = simple(TEXT).table(ROOT.format(6))
    first = b.out.rfind(b"xref\n0 ")
    b.add(5, "<< /Updated true >>").add(6, "<< /Added true >>").table(f"<< /Root 1 0 R /Size 7 /Prev {first} >>")
    doc = open_lazy(BytesReader(b.bytes()))
    assert len(doc.objects) == 6 and len(doc.entries) == 7 and "Updated" in doc.objects[(5, 0)].value[1] and doc.metadata("")["incremental_update_count"] == 1
    start = len(b.out)
    loop = b.add(7, "1").table(f"<< /Root 1 0 R /Prev {start + 17} >>").bytes()
    assert "lazy.xref_chain.cycle" in rules(loop)


def test_only_what_is_asked_for_is_read():
    big = simple(TEXT).stream(6, b"x" * 5_000_000).table(ROOT.format(7)).bytes()
    reader = BytesReader(big)
    doc = open_lazy(reader)
    before = reader.touched
    assert doc.objects[(5, 0)].dictionary["BaseFont"] == ("Name", "Helvetica")
    assert before < 1_100_000 and reader.touched - before <= 64 << 10
    assert doc.objects[(6, 0)].stream.end - doc.objects[(6, 0)].stream.start == 5_000_000


def test_fast_rules():
    b = Builder().add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, "<< /Type /Pages /Kids [3 0 R 9 0 R] >>").add(3, "<< /Type /Page /Contents [4 0 R 8 0 R] >>").stream(4, b"x", "/Filter /MysteryDecode").add(5, FONT)
    assert rules(b.table(ROOT.format(6)).bytes()) == ["lazy.page_tree.object_unavailable", "stream.unsupported_filter", "lazy.page_link_missing_from_xref", "lazy.stream.metadata_unavailable", "lazy.deep_diagnostics_deferred"]
    assert rules(b"%PDF-1.4\n") == ["lazy.page_tree.root_missing", "lazy.trailer_missing", "lazy.startxref_missing", "lazy.root_missing", "lazy.deep_diagnostics_deferred"]
    with pytest.raises(LazyError):
        open_lazy(BytesReader(b"%PDF-1.4\nstartxref\n999\n%%EOF"))


def test_indirect_length():
    b = Builder().add(1, "<< /Type /Catalog >>").add(4, b"<< /Length 5 0 R >>\nstream\nabc\nendstream").add(5, "3")
    doc = open_lazy(BytesReader(b.table(ROOT.format(6)).bytes()))
    assert doc.objects[(4, 0)].stream.declared == 3
    assert parse_document(b.bytes()).objects[(4, 0)].stream.declared is None


def test_data_source_pushes_lookups_down(spark, tmp_path):
    from pagelode.sources.lazy import register

    for name in "ab":
        (tmp_path / f"{name}.pdf").write_bytes(simple(TEXT).table(ROOT.format(6)).bytes())
    register(spark)
    df = spark.read.format("pdf_lazy").load(str(tmp_path))
    assert df.count() == 12
    got = df.filter("obj = 5 and gen = 0").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got) == ["a.pdf", "b.pdf"] and got[0]["summary"] == "/Type /Font, /Subtype /Type1"
