"""One PDF from its bytes: cross-reference entries, objects, streams, trailer, metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pagelode.functions import filters
from pagelode.functions.values import DELIMITERS, Value, as_count, entries, gap, is_name, parse_value, reference_text, summary, white

FULL_LIMIT = 1 << 30
OBJECT_STREAM_LIMIT = 32 << 20
HEAD = 1024
_DIGITS = re.compile(rb"[0-9]+")
_EOL = re.compile(rb"[\r\n]")
_SCAN = re.compile(rb"([0-9]+)[ \t\n\x0b\x0c\r]+([0-9]+)[ \t\n\x0b\x0c\r]+obj\b")
_HEADER = re.compile(rb"([0-9]+)[ \t\n\x0c\r]*([0-9]+)[ \t\n\x0c\r]*obj(?=[" + DELIMITERS + rb"]|\Z)")
_XREF_LINE = re.compile(rb"(?:^|(?<=[\r\n]))xref(?=[ \t\n\x0c\r]|\Z)")

Ref = tuple[int, int]


@dataclass
class Stream:
    dictionary: dict
    declared: int | None
    start: int
    end: int
    filters: list[str]
    raw: bytes

    def decode(self, limit: int | None = None) -> filters.Decoded:
        return filters.decode(self.raw, self.filters, limit)


@dataclass
class Object:
    ref: Ref
    value: Value
    stream: Stream | None
    start: int
    end: int
    container: Ref | None = None

    @property
    def dictionary(self) -> dict | None:
        if self.stream:
            return self.stream.dictionary
        return self.value[1] if self.value[0] == "Dictionary" else None


@dataclass
class XrefEntry:
    ref: Ref
    offset: int
    in_use: bool
    valid: bool | None
    section: int


@dataclass
class Document:
    size: int
    version: str | None = None
    linearized: bool = False
    sections: int = 0
    trailer: Value | None = None
    objects: dict[Ref, Object] = field(default_factory=dict)
    xref: list[XrefEntry] = field(default_factory=list)
    warnings: list[tuple[int | None, str]] = field(default_factory=list)

    def get(self, key: str) -> Value | None:
        return self.trailer[1].get(key) if self.trailer and self.trailer[0] == "Dictionary" else None

    def reference(self, key: str) -> Ref | None:
        v = self.get(key)
        return v[1] if v and v[0] == "Reference" else None

    def dictionary(self, value: Value | None) -> dict | None:
        """value's dictionary, directly or by one reference."""
        if value is None:
            return None
        if value[0] == "Reference":
            found = self.objects.get(value[1])
            return found.dictionary if found else None
        return value[1] if value[0] == "Dictionary" else None

    def ordered(self) -> list[Object]:
        return [self.objects[r] for r in sorted(self.objects)]

    def page_count(self) -> int | None:
        root = self.objects.get(self.reference("Root")) if self.reference("Root") else None
        catalog = root.dictionary if root else None
        pages = catalog.get("Pages") if catalog else None
        if pages is None:
            return None
        if pages[0] == "Reference" and pages[1] in self.objects:
            node = self.objects[pages[1]].dictionary
            if node is None:
                return None
            count = as_count(node.get("Count"))
            if count is not None:
                return count & 0xFFFFFFFF
        found = sum(is_name(o.dictionary, "Type", "Page") for o in self.objects.values())
        return found or None

    def metadata(self, name: str) -> dict:
        info = self.objects.get(self.reference("Info")) if self.reference("Info") else None
        trailer = self.trailer[1] if self.trailer and self.trailer[0] == "Dictionary" else {}
        typed = lambda name: any(is_name(o.dictionary, "Type", name) for o in self.objects.values())
        ref = lambda key: reference_text(self.reference(key)) if self.reference(key) else None
        return {
            "file_name": name, "file_size": self.size, "pdf_version": self.version, "page_count": self.page_count(), "encrypted": "Encrypt" in trailer,
            "linearized": self.linearized, "incremental_update_count": max(self.sections - 1, 0), "root": ref("Root"), "info": ref("Info"),
            "trailer_keys": [k for k, _ in entries(trailer)], "info_summary": {k: summary(v) for k, v in entries(info.dictionary)} if info and info.dictionary else {},
            "object_count": len(self.objects), "stream_count": sum(o.stream is not None for o in self.objects.values()), "xref_entry_count": len(self.xref),
            "has_xref_stream": typed("XRef"), "has_object_stream": typed("ObjStm"), "parse_warning_count": len(self.warnings),
        }


def _line_end(data: bytes, pos: int) -> int:
    m = _EOL.search(data, pos)
    return m.start() if m else len(data)


def _skip_blank(data: bytes, pos: int) -> int:
    while pos < len(data):
        end = _line_end(data, pos)
        if data[pos:end].strip(b" \t\n\x0c\r"):
            return pos
        pos = end + 1
    return pos


def _digits(data: bytes, pos: int, bits: int) -> tuple[int, int] | None:
    m = _DIGITS.match(data, pos)
    if not m or int(m[0]) >= 1 << bits:
        return None
    return int(m[0]), m.end()


def header_at(data: bytes, offset: int) -> tuple[int, Ref] | None:
    """The end and reference of the object header at offset, white space and comments skipped."""
    m = _HEADER.match(data, gap(data, offset)) if offset <= len(data) else None
    if not m or int(m[1]) >= 1 << 32 or int(m[2]) >= 1 << 16:
        return None
    return m.end(), (int(m[1]), int(m[2]))


# a subsection's head, an entry's line and the trailer, each after blank lines
_SUBSECTION = re.compile(rb"[\x00\t\n\x0c\r ]*(?:(trailer)|(\d+)[\x00\t\n\x0c\r ]+(\d+)[^\r\n]*(?:\r\n?|\n|$))")
_ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(?:(\d+)[\x00\t\x0c ]+(\d+)[\x00\t\x0c ]*([^\x00\t\n\x0c\r ])|(?!trailer)[^\r\n]+)[^\r\n]*(?:\r\n?|\n|$)")


def xref_section(data: bytes, start: int, warnings: list | None):
    """Entries, trailer and /Prev of the classic section at start, or None."""
    if not data.startswith(b"xref", start):
        return None
    found: list[tuple[Ref, int, bool]] = []
    pos = _line_end(data, start)
    while head := _SUBSECTION.match(data, pos):
        if head[1]:
            got = parse_value(data, head.end())
            if not got and warnings is not None:
                warnings.append((head.end(), "Could not parse trailer dictionary"))
            value = got[0] if got else None
            return found, value, as_count(value[1].get("Prev")) if value and value[0] == "Dictionary" else None
        first, count, pos = int(head[2]), int(head[3]), head.end()
        if first >= 1 << 32 or count >= 1 << 64:
            break
        for number in range(first, first + count):
            entry = _ENTRY.match(data, pos)
            if not entry:
                break
            pos = entry.end()
            if entry[1] and int(entry[1]) < 1 << 64 and int(entry[2]) < 1 << 16:
                found.append(((number, int(entry[2])), int(entry[1]), entry[3] == b"n"))
    return found, None, None


def read_xref(doc: Document, data: bytes) -> list[list[tuple[Ref, int, bool]]]:
    """Sections of entries, newest first; sets the trailer and the number of sections."""
    marker = data.rfind(b"startxref")
    start = _digits(data, white(data, marker + 9), 64) if marker >= 0 else None
    if start:
        seen, sections, offset, trailer = set(), [], start[0], None
        while offset not in seen:
            seen.add(offset)
            got = xref_section(data, offset, None)
            if got is None:
                break
            sections.append(got[0])
            trailer = trailer or got[1]
            if got[2] is None:
                doc.trailer, doc.sections = trailer, len(seen)
                return sections
            offset = got[2]
        else:
            doc.trailer, doc.sections = trailer, len(seen)
            return sections
    sections = []
    for m in _XREF_LINE.finditer(data):
        got = xref_section(data, m.start(), doc.warnings)
        sections.append(got[0])
        doc.trailer = got[1] or doc.trailer
    doc.sections = len(sections)
    return sections[::-1]


def _body(data: bytes, start: int, header: int, stop: int, ref: Ref, keep: bool) -> Object | None:
    body = data[header:stop]
    got = parse_value(body)
    if not got:
        return None
    value, end = got
    word = gap(body, end)
    if not body.startswith(b"stream", word):
        close = body.find(b"endobj", end)
        return Object(ref, value, None, start, header + (close + 6 if close >= 0 else len(body)))
    dictionary = value[1] if value[0] == "Dictionary" else {}
    first = word + 6
    first += 2 if body.startswith(b"\r\n", first) else int(body[first : first + 1] in (b"\n", b"\r"))
    declared = as_count(dictionary.get("Length"))
    marker = white(body, first + declared) if declared is not None and first + declared <= len(body) else None
    if marker is not None and body.startswith(b"endstream", marker):
        last = first + declared
    else:
        marker = body.find(b"endstream", first)
        marker = len(body) if marker < 0 else marker
        last = marker
        if last > first:
            if last >= 2 and body[last - 2 : last] == b"\r\n":
                last -= 2
            elif body[last - 1 : last] in (b"\n", b"\r"):
                last -= 1
    close = body.find(b"endobj", marker + 9) if marker + 9 <= len(body) else -1
    raw = body[first:last] if keep or is_name(dictionary, "Type", "ObjStm") else b""
    stream = Stream(dictionary, declared, header + first, header + max(last, first), filters.names(dictionary.get("Filter")), raw)
    return Object(ref, ("Dictionary", dictionary), stream, start, header + (close + 6 if close >= 0 else len(body)))


def _from_starts(doc: Document, data: bytes, starts: list[tuple[int, int, Ref]], keep: bool) -> None:
    for i, (start, header, ref) in enumerate(starts):
        stop = starts[i + 1][0] if i + 1 < len(starts) else len(data)
        made = _body(data, start, header, max(stop, header), ref, keep)
        if made:
            doc.objects[ref] = made
        else:
            doc.warnings.append((start, f"Could not parse indirect object {reference_text(ref)}"))


def read_objects(doc: Document, data: bytes, skip_invalid: bool, keep: bool) -> None:
    """Objects at the offsets of the table, or by scanning where too few resolve."""
    wanted = [e for e in doc.xref if e.in_use]
    if wanted:
        starts = []
        for e in wanted:
            got = header_at(data, e.offset)
            if got and got[1] == e.ref:
                starts.append((e.offset, got[0], e.ref))
        missing = len(wanted) - len(starts)
        if skip_invalid and starts:
            if missing:
                doc.warnings.append((None, f"Skipped {missing} in-use xref object(s) whose offsets did not resolve to the expected object"))
        elif len(starts) < 2 or 2 * len(starts) < len(wanted):
            doc.warnings.append((None, f"Classic xref offsets parsed only {len(starts)} of {len(wanted)} in-use object(s); falling back to full object scan"))
            starts = None
        if starts is not None:
            starts.sort(key=lambda s: s[0])
            return _from_starts(doc, data, [s for i, s in enumerate(starts) if not i or s[2] != starts[i - 1][2]], keep)
    found = [(m.start(), m.end(), (int(m[1]), int(m[2]))) for m in _SCAN.finditer(data)]
    return _from_starts(doc, data, [f for f in found if f[2][0] < 1 << 32 and f[2][1] < 1 << 16], keep)


def member_table(decoded: bytes, first: int, count: int) -> list[tuple[int, int]] | None:
    if first > len(decoded):
        return None
    words = decoded[:first].decode("utf-8", "replace").split()
    if len(words) < 2 * count or not all(w.lstrip("+").isdecimal() for w in words[: 2 * count]):
        return None
    numbers = [int(w) for w in words[: 2 * count]]
    return list(zip(numbers[::2], numbers[1::2], strict=True)) if all(n < 1 << 32 for n in numbers[::2]) else None


def expand_object_streams(doc: Document) -> None:
    """Objects inside object streams; one that is there already stays."""
    for holder in [o for o in doc.ordered() if o.stream and is_name(o.stream.dictionary, "Type", "ObjStm")]:
        name = reference_text(holder.ref)

        def warn(text: str, at: int = holder.start) -> None:
            doc.warnings.append((at, text))

        first, count = as_count(holder.stream.dictionary.get("First")), as_count(holder.stream.dictionary.get("N"))
        if first is None or count is None:
            warn(f"Object stream {name} is missing numeric /{'First' if first is None else 'N'}")
            continue
        decoded = holder.stream.decode(OBJECT_STREAM_LIMIT)
        if decoded.issues:
            warn(f"Could not decode object stream {name}: " + "; ".join(f"/{f}: {m}" for f, _, m in decoded.issues))
            continue
        members = member_table(decoded.data, first, count)
        if members is None:
            warn(f"Could not parse object stream {name} member table")
            continue
        for number, offset in members:
            if first + offset >= len(decoded.data):
                warn(f"Object stream {name} member {number} starts outside decoded bytes")
                continue
            got = parse_value(decoded.data, first + offset)
            if not got:
                warn(f"Could not parse object stream {name} member {number}")
            else:
                doc.objects.setdefault((number, 0), Object((number, 0), got[0], None, holder.start, holder.end, holder.ref))


def parse_document(data: bytes, skip_invalid: bool = False, keep_streams: bool = True) -> Document:
    doc = Document(len(data))
    head = data[:HEAD]
    at = head.find(b"%PDF-")
    if at >= 0:
        doc.version = data[at + 5 : _line_end(data, at + 5)].decode("utf-8", "replace").strip()
    else:
        doc.warnings.append((0, "PDF header was not found in the first 1024 bytes"))
    doc.linearized = b"/Linearized" in head
    newest: dict[Ref, XrefEntry] = {}
    for i, section in enumerate(read_xref(doc, data)):
        for ref, offset, in_use in section:
            newest.setdefault(ref, XrefEntry(ref, offset, in_use, None, i))
    doc.xref = [newest[r] for r in sorted(newest)]
    read_objects(doc, data, skip_invalid, keep_streams)
    expand_object_streams(doc)
    if doc.trailer is None:
        found = next((o.stream for o in doc.ordered() if o.stream and is_name(o.stream.dictionary, "Type", "XRef")), None)
        doc.trailer = ("Dictionary", found.dictionary) if found else None
    for e in doc.xref:
        if e.in_use:
            got = header_at(data, e.offset) if e.offset < len(data) else None
            e.valid = bool(got) and got[1] == e.ref
    for missing, text in ((not doc.objects, "No indirect objects were discovered"), (not doc.xref, "No classic xref table was discovered"), (doc.trailer is None, "No trailer dictionary was discovered")):
        if missing:
            doc.warnings.append((None, text))
    return doc
