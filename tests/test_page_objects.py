"""What pages show, on documents built in code."""

import pytest

from pagelode.functions import fonts, structure
from pagelode.functions.document import parse_document
from pagelode.functions.page_objects import Inspector
from pagelode.functions.writer import Builder
from pagelode.sources.corpus import FONT, ROOT


def inspect(content, resources="/Font << /F1 5 0 R >> /XObject << /Im1 6 0 R /Fm1 8 0 R >>", extra="", order="outer", more=()):
    b = Builder().add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, "<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 200 200] >>")
    b.add(3, f"<< /Type /Page /Parent 2 0 R /Resources << {resources} >> /Contents 4 0 R {extra} >>").stream(4, content).add(5, FONT)
    b.stream(6, b"\0", "/Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8")
    b.add(7, "<< /Subtype /Link /Rect [150 150 180 175] >>")
    b.stream(8, b"BT /F1 10 Tf (In) Tj ET 0 0 5 5 re S", "/Type /XObject /Subtype /Form /Matrix [1 0 0 1 3 4] /BBox [0 0 50 50]")
    for number, body in more:
        b.stream(number, body) if isinstance(body, bytes) else b.add(number, body)
    doc = parse_document(b.table(ROOT.format(20)).bytes())
    return Inspector(doc, structure.pages(doc)[0], order).run()


def test_text_path_image_and_annotation():
    got = inspect(b"q 40 0 0 30 20 40 cm /Im1 Do Q BT /F1 12 Tf 10 20 Td (Hi) Tj ET 1 2 30 40 re S", extra="/Annots [7 0 R 99 0 R]")
    assert [(o.kind, o.ref) for o in got.shown] == [("annotation", (7, 0)), ("image", (6, 0)), ("text", None), ("path", None)]
    assert got.shown[0].bbox == (150, 150, 180, 175) and got.shown[1].bbox == (20, 40, 60, 70)
    assert got.shown[2].text == "Hi" and got.shown[2].bbox == (10, 20, 22, 32) and got.shown[3].bbox == (1, 2, 31, 42)
    assert got.shown[2].id == "page-1-text-3" and [w[0] for w in got.warnings] == ["page_object.missing_annotation"]


def test_to_unicode_and_widths():
    cmap = b"1 begincodespacerange\n2 beginbfchar\n<01> <0041>\n<02> <0042>\nendbfchar\n1 beginbfrange\n<03> <05> <0061>\nendbfrange\n"
    font = "<< /Type /Font /Subtype /Type1 /BaseFont /X /FirstChar 1 /Widths [600 700] /ToUnicode 10 0 R >>"
    got = inspect(b"BT /F2 10 Tf <0102> Tj [(\\003) -100 (\\004)] TJ (\\011) Tj ET", "/Font << /F2 9 0 R >>", more=[(9, font), (10, cmap)])
    assert [o.text for o in got.shown] == ["AB", "ab", "\t"]
    properties = dict(got.shown[0].properties)
    assert properties["Raw glyph bytes"] == "01 02" and properties["Width source"] == "/Widths from FirstChar 1" and properties["Estimated advance"] == "13"
    assert any("not covered" in w for w in got.shown[2].warnings)


def test_forms_and_matrix_order():
    got = inspect(b"q 2 0 0 2 20 30 cm /Fm1 Do Q")
    assert [o.kind for o in got.shown] == ["form", "text", "path"] and got.shown[0].bbox == (23, 34, 123, 134)
    assert dict(got.shown[1].properties)["Parent form"] == "/Fm1 8 0 R" and got.shown[2].bbox == (23, 34, 33, 44)
    assert inspect(b"q 2 0 0 2 20 30 cm /Fm1 Do Q", order="inner").shown[0].bbox == (26, 38, 126, 138)


def test_forms_that_hold_themselves_end():
    loop = b"<< /Length 8 /Subtype /Form /Resources << /XObject << /A 9 0 R >> >> >>\nstream\n/A Do   \nendstream".decode()
    got = inspect(b"/A Do /No Do", "/XObject << /A 9 0 R >>", more=[(9, loop)])
    assert [w[0] for w in got.warnings] == ["page_object.form_recursion_cycle", "page_object.missing_xobject_resource"]


def test_resources_of_a_parent_loop_end():
    b = Builder().add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(2, "<< /Type /Pages /Kids [3 0 R] /Parent 3 0 R >>").add(3, "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>").stream(4, b"(x) Tj")
    doc = parse_document(b.table(ROOT.format(5)).bytes())
    assert [o.text for o in Inspector(doc, structure.pages(doc)[0]).run().shown] == ["x"]


@pytest.mark.parametrize(("name", "text"), [("A", "A"), ("space", " "), ("uni00410042", "AB"), ("uniD800", "/uniD800"), ("odd", "/odd"), ("seven", "7")])
def test_glyph_names(name, text):
    assert fonts.glyph_text(name) == text


def test_encoding_differences():
    b = Builder().add(1, "<< /Type /Catalog /Pages 2 0 R >>").add(5, "<< /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /B /C 200 /uni20AC] >> >>")
    doc = parse_document(b.table(ROOT.format(6)).bytes())
    font = fonts.font(doc, doc.objects[(5, 0)].dictionary, (5, 0))
    assert fonts.text_of(b"AB\xc8", font)[0] == "BC€" and font.encoding_source == "/WinAnsiEncoding with Differences"
