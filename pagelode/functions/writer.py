"""PDF bytes from values: whole documents, edits, and the builder that fixtures and corpora use."""

from __future__ import annotations

import re
from typing import NamedTuple

from pagelode.functions import filters
from pagelode.functions.document import Document, Ref, Stream
from pagelode.functions.values import Value, as_count, entries, number_text, parse_value, reference_text

_NAME_UNSAFE = re.compile(r"[ \t\n\x0c\r()<>\[\]{}/%]")
_TEXT_UNSAFE = str.maketrans({"(": "\\(", ")": "\\)", "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"})


def _name(name: str) -> str:
    return "/" + _NAME_UNSAFE.sub(lambda m: f"#{ord(m[0]):02X}", name)


def value_bytes(value: Value) -> bytes:
    kind, x = value
    if kind == "Array":
        return b"[" + b" ".join(value_bytes(v) for v in x) + b"]"
    if kind == "Dictionary":
        return b"<<" + b"".join(b" " + _name(k).encode() + b" " + value_bytes(v) for k, v in entries(x)) + b" >>"
    if kind == "Null":
        return b"null"
    if kind == "Boolean":
        return b"true" if x else b"false"
    if kind == "Number":
        return number_text(x).encode()
    if kind == "Name":
        return _name(x).encode()
    if kind == "String":
        return b"(" + x.translate(_TEXT_UNSAFE).encode() + b")"
    if kind == "HexString":
        return b"<" + x.encode() + b">"
    return reference_text(x).encode() if kind == "Reference" else x.encode()


def stream_bytes(dictionary: dict, raw: bytes) -> bytes:
    full = {**dictionary}
    full.setdefault("Length", ("Number", float(len(raw))))
    return value_bytes(("Dictionary", full)) + b"\nstream\n" + raw + b"\nendstream"


class Builder:
    """Objects written one after the other, then cross-reference subsections for the numbers in use."""

    def __init__(self, version: str = "1.7"):
        self.out = bytearray(f"%PDF-{version}\n%".encode() + b"\xe2\xe3\xcf\xd3\n")
        self.offsets: dict[Ref, int] = {}

    def add(self, number: int, body: bytes | str, generation: int = 0) -> Builder:
        self.offsets[(number, generation)] = len(self.out)
        body = body.encode() if isinstance(body, str) else body
        self.out += f"{number} {generation} obj\n".encode() + body + b"\nendobj\n"
        return self

    def stream(self, number: int, data: bytes, dictionary: str = "", length: int | None = None) -> Builder:
        size = len(data) if length is None else length
        return self.add(number, f"<< /Length {size} {dictionary} >>\nstream\n".encode() + data + b"\nendstream")

    def table(self, trailer: str, shift: dict[int, int] | None = None) -> Builder:
        """A section for what was added since the last one; shift moves offsets, for broken fixtures."""
        start = len(self.out)
        refs = sorted(self.offsets)
        self.out += b"xref\n"
        if not any(n == 0 for n, _ in refs):
            refs = [(0, 65535), *refs]
        at = 0
        while at < len(refs):
            to = at + 1
            while to < len(refs) and refs[to][0] == refs[to - 1][0] + 1:
                to += 1
            self.out += f"{refs[at][0]} {to - at}\n".encode()
            for ref in refs[at:to]:
                if ref in self.offsets:
                    self.out += f"{self.offsets[ref] + (shift or {}).get(ref[0], 0):010d} {ref[1]:05d} n \n".encode()
                else:
                    self.out += f"{0:010d} 65535 f \n".encode()
            at = to
        self.out += f"trailer\n{trailer}\nstartxref\n{start}\n%%EOF\n".encode()
        self.offsets = {}
        return self

    def bytes(self) -> bytes:
        return bytes(self.out)


def serialize(doc: Document) -> bytes:
    """The whole document anew: all objects, one classic section, /Prev and /XRefStm gone.

    An object from an object stream becomes an object of its own.
    """
    b = Builder()
    for o in doc.ordered():
        b.add(o.ref[0], stream_bytes(o.stream.dictionary, o.stream.raw) if o.stream else value_bytes(o.value), o.ref[1])
    trailer = dict(doc.trailer[1]) if doc.trailer and doc.trailer[0] == "Dictionary" else {}
    trailer["Size"] = ("Number", float(max((r[0] for r in doc.objects), default=0) + 1))
    for key in ("Prev", "XRefStm"):
        trailer.pop(key, None)
    return b.table(value_bytes(("Dictionary", trailer)).decode("utf-8", "surrogateescape")).bytes()


class Edit(NamedTuple):
    ref: Ref
    path: list[str | int]  # keys and positions
    value: str  # a number, string or name in PDF syntax


class EditError(ValueError):
    pass


def scalar(text: str) -> Value:
    """text as the only kind of value that edits may write: number, string or name."""
    got = parse_value(text.encode())
    if not got or text.encode()[got[1] :].strip(b" \t\n\x0c\r"):
        raise EditError("edit value must be one complete PDF value")
    if got[0][0] not in ("Number", "String", "Name"):
        raise EditError("only number, string, and name scalar values can be edited")
    return got[0]


def apply_edit(doc: Document, edit: Edit) -> None:
    found = doc.objects.get(edit.ref)
    if not found:
        raise EditError(f"object {reference_text(edit.ref)} was not found")
    new = scalar(edit.value)
    old = ("Dictionary", found.stream.dictionary) if found.stream else found.value

    def changed(value: Value, path: list) -> Value:
        if not path:
            if value[0] not in ("Number", "String", "HexString", "Name"):
                raise EditError(f"{value[0]} values can't be edited")
            return new
        key, rest = path[0], path[1:]
        if value[0] == "Dictionary" and key in value[1]:
            return "Dictionary", {**value[1], key: changed(value[1][key], rest)}
        if value[0] == "Array" and str(key).isdigit() and int(key) < len(value[1]):
            return "Array", [changed(v, rest) if i == int(key) else v for i, v in enumerate(value[1])]
        raise EditError(f"path step {key} was not found in {reference_text(edit.ref)}")

    found.value = changed(old, edit.path)
    if found.stream:
        found.stream.dictionary = found.value[1]
        found.stream.declared = as_count(found.value[1].get("Length"))


def replace_stream(doc: Document, ref: Ref, text: bytes) -> None:
    """New content for a stream without filter or with Flate alone; /Length follows."""
    found = doc.objects.get(ref)
    if not found or not found.stream:
        raise EditError(f"stream {reference_text(ref)} was not found")
    raw = filters.encode(text, found.stream.filters)
    dictionary = {**found.stream.dictionary, "Length": ("Number", float(len(raw)))}
    found.stream = Stream(dictionary, len(raw), 0, len(raw), found.stream.filters, raw)
    found.value = ("Dictionary", dictionary)
