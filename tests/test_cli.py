"""The command line, views and deep diagnostics."""

import json
import zlib

import pytest

from pagelode import cli
from pagelode.functions import deep, views
from pagelode.functions.document import parse_document
from pagelode.functions.lazy import BytesReader, LazyError, open_lazy
from pagelode.functions.writer import Builder
from pagelode.sources.corpus import ROOT, TEXT, defective, simple


@pytest.fixture
def file(tmp_path):
    def write(data):
        (tmp_path / "a.pdf").write_bytes(data)
        return str(tmp_path / "a.pdf")

    return write


def out(capsys):
    return json.loads(capsys.readouterr().out)


def test_inspect_and_dump(file, capsys, tmp_path):
    path = file(defective(0))
    assert cli.main(["inspect", path]) == 0 and out(capsys)["object_count"] == 5
    assert cli.main(["inspect", path, "--structure"]) == 0 and out(capsys)["children"][1]["label"] == "Catalog"
    assert cli.main(["dump-object", path, "1", "0", "--json"]) == 0 and out(capsys)["references"] == [{"object": 2, "generation": 0}]
    assert cli.main(["dump-stream", path, "4", "0", "--json"]) == 0 and out(capsys)["decoded_length"] == 23
    assert cli.main(["dump-stream", path, "4", "0", "--content-json"]) == 0 and [o["name"] for o in out(capsys)["operators"]] == ["BT", "Tf", "Tj", "ET"]
    assert cli.main(["dump-stream", path, "4", "0", "--decoded", str(tmp_path / "d")]) == 0 and (tmp_path / "d").read_bytes() == TEXT
    assert cli.main(["dump-stream", path, "4", "0", "--json", "--hex"]) == 2
    assert cli.main(["dump-object", path, "77", "0"]) == 2 and cli.main(["inspect", path + "x"]) == 2
    assert cli.main(["dump-stream", file(defective(3)), "6", "0", "--decoded", str(tmp_path / "e")]) == 1


def test_lazy_inspect(file, capsys):
    path = file(defective(7))
    for flags, check in ((["--pages"], lambda r: len(r) == 1), (["--page-list"], lambda r: r[0]["reference"] == "3 0 R"), (["--diagnostics"], lambda r: r[-1]["rule_id"] == "lazy.deep_diagnostics_deferred"), (["--object", "5", "0"], lambda r: "BaseFont" in r["dictionary_keys"]), (["--deep-page", "1"], lambda r: r["findings"][0][0] == "lazy.deep.content.unbalanced_graphics_state"), ([], lambda r: r["page_count"] == 1)):
        assert cli.main(["lazy-inspect", path, *flags]) == 0 and check(out(capsys))


@pytest.mark.parametrize(("kind", "code"), [(0, 0), (1, 1), (4, 0)])
def test_check(spark, file, tmp_path, kind, code):
    path = file(defective(kind))
    assert cli.main(["check", path, "--json", str(tmp_path / "r.json"), "--markdown", str(tmp_path / "r.md")]) == code
    assert len(json.loads((tmp_path / "r.json").read_text())["findings"]) == (kind > 0)
    assert (tmp_path / "r.md").read_text().startswith("## PDF Debug Report\n")
    assert cli.main(["check", path, "--lazy-page", "1", "--json", str(tmp_path / "l.json")]) == int(kind == 1)


def test_deep_diagnostics():
    b = simple(b"BT ZZ q").add(6, "<< /A 1 0 R /B 99 0 R >>").stream(7, b"x", "/Filter /Crypt")
    doc = open_lazy(BytesReader(b.table(ROOT.format(8)).bytes()))
    assert [f[0] for f in deep.deep_stream(doc, (4, 0)).findings] == ["lazy.deep.content.unknown_operator", "lazy.deep.content.unclosed_text_object", "lazy.deep.content.unbalanced_graphics_state"]
    assert [f[0] for f in deep.deep_object(doc, (6, 0)).findings] == ["object.missing_reference"]
    assert [f[0] for f in deep.deep_object(doc, (7, 0)).findings] == ["lazy.deep.stream_unsupported_filter"]
    with pytest.raises(LazyError):
        deep.deep_page(doc, 2)


def test_hex_dump_and_previews():
    assert views.hex_dump(b"Hi\x00 0123456789abcdef").splitlines() == ["00000000  48 69 00 20 30 31 32 33  34 35 36 37 38 39 61 62  Hi. 0123456789ab", "00000010  63 64 65 66                                       cdef"]
    o = parse_document(defective(0)).objects[(4, 0)]
    assert views.stream_preview(o, "raw", 5) == {"text": "BT /F", "truncated": True, "warnings": ["Preview was truncated at 5 bytes."]}
    assert views.raw_preview(b"x" * 900).endswith("x\n...")


def test_images():
    def image(space, data, name=""):
        b = Builder().stream(1, data, f"/Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /{space} {name}")
        return parse_document(b.table("<< /Size 2 >>").bytes()).objects[(1, 0)]

    assert views.pixels(image("DeviceGray", zlib.compress(b"\x01\x02"), "/Filter /Fl")) == (2, 1, b"\1\1\1\2\2\2")
    assert views.pixels(image("DeviceCMYK", bytes([0, 0, 0, 255, 255, 0, 0, 0]))) == (2, 1, bytes([0, 0, 0, 0, 255, 255]))
    assert views.pixels(image("DeviceRGB", b"123")) is None and views.pixels(image("Lab", b"123456")) is None
    assert views.image_metadata(image("DeviceRGB", b"x", "/Filter /DCTDecode"))["renderable"]
    assert views.png(2, 1, b"123456").startswith(b"\x89PNG")
