"""Demand-driven reading: the head, the tail, the cross-reference chain, then single objects.

A reader gives byte ranges (size and read(offset, length)); nothing else of a file is
touched, so its size doesn't matter. The objects of a lazy document are a mapping
that reads an object when it is asked for, so whatever walks a full document's
graph (pages, resources) also walks a lazy one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

from pagelode.functions import filters, structure
from pagelode.functions.document import Document, Object, Ref, _body, _digits, _line_end, _skip_blank, header_at, member_table
from pagelode.functions.values import Value, as_count, is_name, parse_value, reference_text, summary, white
from pagelode.functions.values import entries as listed

HEAD = 1024
TAIL = 1 << 20
OBJECT_FIRST = 64 << 10
OBJECT_MOST = 2 << 20
XREF_MOST = 16 << 20
STREAM_IN = 16 << 20
STREAM_OUT = 32 << 20
SECTIONS = 32
STREAM_CHECKS = 256
PREVIEW = 1 << 20
EXPORT_RAW = 512 << 20
EXPORT_DECODED = 256 << 20
PAGE_DEPTH = 64
PAGE_NODES = 20_000
PAGES = 20_000
XREF_CHILDREN = 512
# What the page index and the stream view warn of.
WARNINGS = {
    "page_tree.root_missing": "Lazy page index could not run because the trailer has no Root reference",
    "page_tree.catalog_missing": "Could not read Root catalog {ref}",
    "page_tree.pages_missing": "Root catalog {ref} does not contain a /Pages reference",
    "page_tree.depth_limit": "Page tree traversal reached depth limit {most} at {ref}",
    "page_tree.node_limit": "Page tree traversal reached node limit {most}",
    "page_tree.page_limit": "Page tree traversal reached page limit {most}",
    "page_tree.cycle": "Cycle detected while traversing page tree at {ref}",
    "page_tree.object_unavailable": "Could not read page tree object {ref}: {error}",
    "page_tree.non_dictionary": "Page tree object {ref} is not a dictionary",
    "page_tree.kids_missing": "Pages node {ref} does not contain a /Kids array",
    "page_tree.invalid_kid": "Pages node {ref} contains a non-reference /Kids entry",
    "page_tree.unexpected_type": "Page tree object {ref} has unexpected /Type /{kind}",
    "stream.preview_truncated": "Stream preview is truncated to {most} bytes from {size} total bytes",
    "stream.decoded_preview_truncated": "Decoded stream preview is truncated to {most} bytes from {size} decoded bytes",
    "stream.decode_preview_skipped": "Decoded preview skipped because raw stream length {size} exceeds lazy decode input limit {most}",
    "stream.raw_export_limit": "Raw stream export is disabled because stream length {size} exceeds export limit {most}",
}
WARNING_STEP = "Continue with lazy inspection; if this affects a branch, inspect the referenced object by xref offset."
DEFERRED = "Large PDF opened in lazy mode. Fast diagnostics are ready; stream decode validation, content stream analysis, page object extraction, image/font deep validation, and full report generation are deferred."


class LazyError(ValueError):
    pass


class BytesReader:
    def __init__(self, data: bytes):
        self.data, self.size, self.touched = data, len(data), 0

    def read(self, offset: int, length: int) -> bytes:
        got = self.data[offset : offset + length]
        self.touched += len(got)
        return got


class FileReader:
    """Ranges of a file of any file system that pyarrow knows."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
        self.file = system.open_input_file(path)
        self.size, self.touched = self.file.size(), 0

    def read(self, offset: int, length: int) -> bytes:
        got = self.file.read_at(max(0, min(length, self.size - offset)), offset) if offset < self.size else b""
        self.touched += len(got)
        return got


class Entry(NamedTuple):
    ref: Ref
    offset: int
    in_use: bool
    stream: int | None  # the object stream that holds it
    index: int | None
    section: int


class Warned(NamedTuple):
    rule: str
    message: str
    offset: int | None


class LazyObjects(Mapping):
    """Objects by reference, read when asked for and kept."""

    def __init__(self, owner: LazyDocument):
        self.owner, self.known, self.errors = owner, {}, {}

    def get(self, ref, default=None):
        if ref not in self.known:
            try:
                self.known[ref] = self.owner.read_object(ref)
            except LazyError as e:
                self.known[ref], self.errors[ref] = None, str(e)
        return self.known[ref] or default

    def __getitem__(self, ref):
        found = self.get(ref)
        if found is None:
            raise KeyError(ref)
        return found

    def __contains__(self, ref) -> bool:
        return self.get(ref) is not None

    def __iter__(self):
        return (e.ref for e in self.owner.entries.values() if e.in_use)

    def __len__(self) -> int:
        return sum(e.in_use for e in self.owner.entries.values())


@dataclass
class LazyDocument(Document):
    reader: object = None
    startxref: int | None = None
    entries: dict[Ref, Entry] = field(default_factory=dict)
    notes: list[Warned] = field(default_factory=list)
    eofs: int = 0
    indexed: bool = False

    def note(self, rule: str, message: str, offset: int | None) -> None:
        self.notes.append(Warned(f"lazy.{rule}", message, offset))

    def warn(self, rule: str, offset: int | None = None, ref: Ref | None = None, **values) -> None:
        self.note(rule, WARNINGS[rule].format(ref=reference_text(ref) if ref else None, **values), offset)

    def page_index(self, only: int | None = None) -> list[structure.Page]:
        """Pages in tree order, within limits, or the page with number `only` alone; what is amiss is noted."""
        self.indexed = True
        root = self.reference("Root")
        if root is None:
            self.warn("page_tree.root_missing")
            return []
        catalog = self.objects.get(root)
        if catalog is None:
            self.warn("page_tree.catalog_missing", ref=root)
            return []
        start = (catalog.dictionary or {}).get("Pages")
        if not start or start[0] != "Reference":
            self.warn("page_tree.pages_missing", catalog.start, root)
            return []
        out: list[structure.Page] = []
        seen: set[Ref] = set()
        count = 0
        stack: list[tuple] = [(start, {}, 0, None)]
        while stack:
            value, above, depth, holder = stack.pop()
            if value[0] != "Reference":
                self.warn("page_tree.invalid_kid", holder.start, holder.ref)
                continue
            ref = value[1]
            if depth > PAGE_DEPTH:
                self.warn("page_tree.depth_limit", ref=ref, most=PAGE_DEPTH)
                continue
            if len(seen) >= PAGE_NODES or count >= PAGES:
                which = ("node", PAGE_NODES) if len(seen) >= PAGE_NODES else ("page", PAGES)
                self.warn(f"page_tree.{which[0]}_limit", most=which[1])
                break
            if ref in seen:
                self.warn("page_tree.cycle", ref=ref)
                continue
            seen.add(ref)
            found = self.objects.get(ref)
            if found is None:
                self.warn("page_tree.object_unavailable", ref=ref, error=self.objects.errors.get(ref))
                continue
            d = found.dictionary
            if d is None:
                self.warn("page_tree.non_dictionary", found.start, ref)
                continue
            kind, state = structure.type_name(d), structure.inherited(self, d, above)
            if kind == "Page":
                count += 1
                if only in (None, count):
                    out.append(structure.page_of(self, count, ref, d, state))
                if only == count:
                    break
            elif kind in ("Pages", None):
                kids = d.get("Kids")
                if not kids or kids[0] != "Array":
                    self.warn("page_tree.kids_missing", found.start, ref)
                else:
                    stack.extend((k, state, depth + 1, found) for k in reversed(kids[1]))
            else:
                self.warn("page_tree.unexpected_type", found.start, ref, kind=kind)
        return out

    def stream_view(self, ref: Ref) -> dict:
        """Sizes, decoding and previews of a stream within limits, and the warnings these give rise to."""
        found = self.read_object(ref)
        if not found.stream:
            raise LazyError(f"stream {reference_text(ref)} was not found")
        s = found.stream
        size, warned = s.end - s.start, []

        def warn(rule: str, most: int, n: int) -> None:
            warned.append((f"lazy.{rule}", WARNINGS[rule].format(most=most, size=n), s.start))

        whole = size <= STREAM_IN
        raw = self.reader.read(s.start, size if whole else min(size, PREVIEW))
        if size > min(len(raw), PREVIEW):
            warn("stream.preview_truncated", PREVIEW, size)
        got = filters.decode(raw, s.filters, STREAM_OUT) if whole else None
        clean = got is not None and not got.issues
        if clean and got.length > PREVIEW:
            warn("stream.decoded_preview_truncated", PREVIEW, got.length)
        if not whole:
            warn("stream.decode_preview_skipped", STREAM_IN, size)
        if size > EXPORT_RAW:
            warn("stream.raw_export_limit", EXPORT_RAW, size)
        error = "; ".join(f"/{f}: {m}" for f, _, m in got.issues) if got else f"Decoded preview skipped because raw stream length exceeds {STREAM_IN} bytes"
        return {
            "declared_length": s.declared, "actual_length": size, "raw_start": s.start, "raw_end": s.end, "filters": s.filters, "decoded_length": got.length if clean else None,
            "steps": got.steps if got else [], "issues": got.issues if got else [], "warnings": warned, "raw_preview": raw[:PREVIEW], "raw_truncated": size > min(len(raw), PREVIEW),
            "decoded_preview": got.data[:PREVIEW] if clean else None, "decoded_truncated": clean and got.length > PREVIEW, "decoded_error": None if clean else error,
            "can_export_raw": size <= EXPORT_RAW, "can_export_decoded": clean,
        }

    def export(self, ref: Ref, decoded: bool = False) -> bytes:
        """A stream's bytes as they stand or decoded; sizes are tested before anything is read."""
        found, name = self.read_object(ref), reference_text(ref)
        if not found.stream:
            raise LazyError(f"stream {name} was not found")
        size = found.stream.end - found.stream.start
        if not decoded:
            if size > EXPORT_RAW:
                raise LazyError(WARNINGS["stream.raw_export_limit"].format(size=size, most=EXPORT_RAW))
            return self.reader.read(found.stream.start, size)
        got = self.stream_data(found, out=EXPORT_DECODED)
        if got.issues:
            raise LazyError("; ".join(f"/{f}: {m}" for f, _, m in got.issues))
        return got.data

    def tree(self) -> list[structure.Node]:
        """The first look at a lazily opened document: trailer, catalog and some entries, without reading an object."""
        used = [e for e in self.entries.values() if e.in_use]
        out = [structure.Node((), "PDF", "root", None, f"lazy open, {len(self.entries)} xref entrie(s), {len(used)} in-use object(s)")]
        out.append(structure.Node((0,), "Trailer", "trailer", None, summary(self.trailer) if self.trailer else None))
        for i, (key, value) in enumerate(listed(self.trailer[1]) if self.trailer else ()):
            out.append(structure.Node((0, i), key, "reference", value[1] if value[0] == "Reference" else None, summary(value)))
        root = self.reference("Root")
        if root:
            out.append(structure.Node((1,), "Catalog", "catalog", root, "lazy object, click to inspect by xref offset"))
        at = (1 + (root is not None),)
        out.append(structure.Node(at, "Cross-reference", "xref", None, f"startxref {'unknown' if self.startxref is None else self.startxref}, {len(self.entries)} entrie(s)"))
        for i, e in enumerate(sorted(used)[:XREF_CHILDREN]):
            out.append(structure.Node((*at, i), reference_text(e.ref), "object", e.ref, f"xref offset {e.offset}, lazy object"))
        if len(used) > XREF_CHILDREN:
            out.append(structure.Node((*at, XREF_CHILDREN), "More xref objects", "xref", None, f"{len(used) - XREF_CHILDREN} additional in-use object(s) hidden in this first lazy tree"))
        return out

    def read_object(self, ref: Ref) -> Object:
        entry = self.entries.get(ref)
        if entry is None or not entry.in_use:
            raise LazyError(f"object {reference_text(ref)} was not found")
        if entry.stream is not None:
            return self._member(entry)
        window = OBJECT_FIRST
        while True:
            data = self.reader.read(entry.offset, window)
            if b"endobj" in data or len(data) < window or window >= OBJECT_MOST:
                break
            window = min(2 * window, OBJECT_MOST)
        header = header_at(data, 0)
        made = _body(data, 0, header[0], len(data), ref, False) if header and header[1] == ref else None
        if not made:
            text = f"Could not parse object {reference_text(ref)} at xref offset {entry.offset}"
            self.note("object_parse_failed", text, entry.offset)
            raise LazyError(text)
        made.start += entry.offset
        made.end += entry.offset
        if made.stream:
            s = made.stream
            if s.declared is None:
                s.declared = self._length(s.dictionary.get("Length"), ref)
            size = s.declared if s.declared is not None else s.end - s.start
            s.start += entry.offset
            s.end = s.start + size
        return made

    def _length(self, value: Value | None, ref: Ref) -> int | None:
        """A /Length behind one reference."""
        if not value or value[0] != "Reference" or value[1] == ref:
            return None
        try:
            return as_count(self.read_object(value[1]).value)
        except LazyError:
            return None

    def stream_data(self, o: Object, most: int = STREAM_IN, out: int = STREAM_OUT) -> filters.Decoded:
        size = o.stream.end - o.stream.start
        if size > most:
            raise LazyError(f"stream {reference_text(o.ref)} is {size} bytes, above the lazy decode input limit {most} bytes")
        return filters.decode(self.reader.read(o.stream.start, size), o.stream.filters, out)

    def _member(self, entry: Entry) -> Object:
        holder = self.objects.get((entry.stream, 0))
        name, own = f"{entry.stream} 0 R", reference_text(entry.ref)
        if not holder or not holder.stream:
            raise LazyError(f"object {own} is compressed in {name}, but that object is not a stream")
        if not is_name(holder.stream.dictionary, "Type", "ObjStm"):
            self.note("object_stream.unexpected_type", f"object {own} is stored in {name}, which is not marked /Type /ObjStm", holder.start)
        first, count = as_count(holder.stream.dictionary.get("First")), as_count(holder.stream.dictionary.get("N"))
        if first is None or count is None:
            raise LazyError(f"object stream {name} is missing numeric /{'First' if first is None else 'N'}")
        if entry.index >= count:
            raise LazyError(f"object {own} index {entry.index} is outside object stream {name} member count {count}")
        decoded = self.stream_data(holder)
        members = None if decoded.issues else member_table(decoded.data, first, count)
        if members is None or first + members[entry.index][1] >= len(decoded.data):
            raise LazyError(f"Could not decode object stream {name}")
        end = first + members[entry.index + 1][1] if entry.index + 1 < count else len(decoded.data)
        got = parse_value(decoded.data[:end] if end > first + members[entry.index][1] else decoded.data, first + members[entry.index][1])
        if not got:
            raise LazyError(f"Could not parse object {own} in object stream {name}")
        return Object(entry.ref, got[0], None, holder.start, holder.end, holder.ref)

    def metadata(self, name: str) -> dict:
        trailer = self.trailer[1] if self.trailer else {}
        root = self.objects.get(self.reference("Root")) if self.reference("Root") else None
        pages = self.dictionary((root.dictionary or {}).get("Pages")) if root else None
        text = lambda key: reference_text(self.reference(key)) if self.reference(key) else None
        return {
            "file_name": name, "file_size": self.size, "pdf_version": self.version, "page_count": as_count((pages or {}).get("Count")), "encrypted": "Encrypt" in trailer, "linearized": self.linearized,
            "incremental_update_count": max(self.eofs - 1, 0), "root": text("Root"), "info": text("Info"), "trailer_keys": sorted(trailer, key=str.encode), "info_summary": {},
            "object_count": sum(e.in_use for e in self.entries.values()), "stream_count": 0, "xref_entry_count": len(self.entries),
            "has_xref_stream": is_name(trailer, "Type", "XRef") or "XRefStm" in trailer, "has_object_stream": any(e.stream is not None for e in self.entries.values()), "parse_warning_count": len(self.notes),
        }


def _classic(doc: LazyDocument, start: int, number: int):
    data = doc.reader.read(start, XREF_MOST)
    found: list[Entry] = []
    pos = _line_end(data, 0) + 1
    while True:
        pos = _skip_blank(data, pos)
        if pos >= len(data):
            break
        if data.startswith(b"trailer", pos):
            got = parse_value(data, pos + 7)
            if not got:
                doc.note("trailer_parse_failed", "Could not parse lazy trailer dictionary", start + pos + 7)
            return found, got[0] if got else None
        words = data[pos : _line_end(data, pos)].split()
        if len(words) != 2 or not all(w.isdigit() for w in words):
            break
        first, count = int(words[0]), int(words[1])
        pos = _line_end(data, pos) + 1
        for i in range(count):
            pos = _skip_blank(data, pos)
            end = _line_end(data, pos)
            if end <= pos:
                break
            parts = data[pos:end].split()
            if len(parts) >= 3 and parts[0].isdigit() and parts[1].isdigit() and int(parts[1]) < 1 << 16:
                found.append(Entry((first + i, int(parts[1])), int(parts[0]), parts[2] == b"n", None, None, number))
            pos = end + 1
    doc.note("trailer_missing", "Classic xref table was parsed without a trailer dictionary", start)
    return found, None


def _stream(doc: LazyDocument, start: int, number: int):
    if start >= doc.size:
        raise LazyError(f"startxref offset {start} is outside the file")
    data = doc.reader.read(start, OBJECT_MOST)
    header = header_at(data, 0)
    if not header:
        raise LazyError(f"startxref offset {start} does not point to an indirect object or classic xref table")
    made = _body(data, 0, header[0], len(data), header[1], True)
    name = reference_text(header[1])
    if not made or not made.stream:
        raise LazyError(f"startxref object {name} is not a classic xref table or xref stream")
    s = made.stream
    if not is_name(s.dictionary, "Type", "XRef"):
        doc.note("xref_stream_or_invalid", "startxref points to a stream object that is not /Type /XRef", start)
    if s.declared is None or s.declared > STREAM_OUT:
        raise LazyError(f"xref stream {name} has no usable numeric /Length")
    decoded = filters.decode(doc.reader.read(start + s.start, s.declared), s.filters, STREAM_OUT)
    if decoded.issues:
        raise LazyError(f"Could not decode xref stream {name}: " + "; ".join(f"/{f}: {m}" for f, _, m in decoded.issues))
    widths = s.dictionary.get("W")
    if not widths or widths[0] != "Array" or len(widths[1]) != 3:
        raise LazyError("xref stream /W must contain exactly three widths")
    w = [as_count(v) or 0 for v in widths[1]]
    if not sum(w):
        raise LazyError(f"xref stream {name} has zero-width /W entries")
    listed = s.dictionary.get("Index")
    if listed and listed[0] == "Array":
        numbers = [as_count(v) or 0 for v in listed[1]]
        ranges = list(zip(numbers[::2], numbers[1::2], strict=False))
    elif as_count(s.dictionary.get("Size")) is not None:
        ranges = [(0, as_count(s.dictionary["Size"]))]
    else:
        raise LazyError("xref stream is missing /Index and numeric /Size")
    found, at, raw = [], 0, decoded.data
    for n in (first + i for first, count in ranges for i in range(count)):
        if at + sum(w) > len(raw):
            break
        kind, a, b = (int.from_bytes(raw[at + sum(w[:k]) : at + sum(w[: k + 1])], "big") for k in range(3))
        at += sum(w)
        kind = kind if w[0] else 1
        if kind in (0, 1):
            found.append(Entry((n, min(b, 0xFFFF)), a, kind == 1, None, None, number))
        elif kind == 2:
            found.append(Entry((n, 0), 0, True, a, b, number))
    return found, ("Dictionary", s.dictionary)


def open_lazy(reader) -> LazyDocument:
    """Head, tail and cross-reference chain; newer sections win, a hybrid stream beats its own table."""
    doc = LazyDocument(reader.size, reader=reader)
    doc.objects = LazyObjects(doc)
    head = reader.read(0, HEAD)
    at = head.find(b"%PDF-")
    if at >= 0:
        doc.version = head[at + 5 : _line_end(head, at + 5)].decode("utf-8", "replace").strip()
    else:
        doc.note("header_missing", "PDF header was not found in the first 1024 bytes", 0)
    doc.linearized = b"/Linearized" in head
    base = max(0, doc.size - TAIL)
    tail = reader.read(base, TAIL)
    doc.eofs = tail.count(b"%%EOF")
    marker = tail.rfind(b"startxref")
    got = _digits(tail, white(tail, marker + 9), 64) if marker >= 0 else None
    doc.startxref = got[0] if got else None
    if doc.startxref == 0:
        doc.note("startxref_zero", "startxref resolved to offset 0", base + marker)
    trailer: dict = {}
    seen: set[int] = set()
    cursor, any_trailer, number = doc.startxref, False, 0
    while cursor is not None:
        if number >= SECTIONS:
            doc.note("xref_chain.limit", f"Stopped lazy xref /Prev traversal after {SECTIONS} section(s)", cursor)
            break
        if cursor in seen:
            doc.note("xref_chain.cycle", f"Detected a repeated xref /Prev offset at byte {cursor}", cursor)
            break
        seen.add(cursor)
        classic = reader.read(cursor, 4) == b"xref"
        entries, own = _classic(doc, cursor, number) if classic else _stream(doc, cursor, number)
        d = own[1] if own and own[0] == "Dictionary" else {}
        hybrid = as_count(d.get("XRefStm"))
        section = {e.ref: e for e in entries}
        if hybrid is not None:
            try:
                section |= {e.ref: e for e in _stream(doc, hybrid, number)[0]}
            except LazyError as e:
                doc.note("hybrid_xref_stream_failed", f"Could not parse hybrid /XRefStm at byte {hybrid}: {e}", hybrid)
        for ref, e in section.items():
            doc.entries.setdefault(ref, e)
        any_trailer |= bool(own)
        for key, value in d.items():
            trailer.setdefault(key, value)
        cursor, number = as_count(d.get("Prev")), number + 1
    doc.trailer = ("Dictionary", trailer) if any_trailer else None
    doc.sections = number
    return doc


# Severity, message and next step of the fast rules.
TEXTS = {
    "lazy.trailer_missing": ("error", "Lazy open did not find a trailer dictionary", "Verify startxref and the classic xref trailer section"),
    "lazy.startxref_missing": ("error", "No startxref offset was found in the file tail", "Verify the PDF tail and %%EOF/startxref section"),
    "lazy.root_missing": ("error", "The trailer does not contain a /Root catalog reference", "Inspect the trailer dictionary and root catalog reference"),
    "document.encryption_detected": ("warning", "The trailer contains /Encrypt; encrypted content may not be inspectable without credentials", "Reproduce with an unencrypted fixture when possible, or provide credentials to downstream tools"),
    "document.incremental_updates_detected": ("info", "Detected {count} incremental update section(s)", "Check whether the issue reproduces before and after the incremental update section"),
    "document.xref_stream_detected": ("info", "Xref stream detected; lazy fast diagnostics use bounded xref stream metadata when available", "Inspect referenced objects through the lazy Object Inspector to validate xref stream entries"),
    "document.object_stream_detected": ("info", "Object stream detected; lazy object inspection can expand selected compressed members on demand", "Open a referenced object to inspect the selected object-stream member within lazy limits"),
    "lazy.root_missing_from_xref": ("error", "{label} {ref} is not present in the lazy xref table", "Check whether {ref} is missing, in an object stream, or omitted from the classic xref table"),
    "lazy.page_missing_from_xref": ("error", "{label} {ref} is not present in the lazy xref table", "Check whether {ref} is missing, in an object stream, or omitted from the classic xref table"),
    "lazy.page_link_missing_from_xref": ("error", "{label} {ref} is not present in the lazy xref table", "Check whether {ref} is missing, in an object stream, or omitted from the classic xref table"),
    "lazy.reference_free_xref_entry": ("error", "{label} {ref} points to a free xref entry", "Verify the xref entry and regenerate the referenced object"),
    "xref.invalid_offset": ("error", "Xref entry for {ref} points outside the file at byte {at}", "Compare the xref table against the raw file length and object header"),
    "lazy.fast_stream_metadata_limit": ("info", "Lazy fast diagnostics checked the first {most} unique stream dictionaries and deferred additional stream metadata checks", "Open a specific stream or run selected deep diagnostics for additional stream checks"),
    "lazy.stream.metadata_unavailable": ("warning", "Could not read stream metadata for {ref}", "Inspect the object by xref offset and verify its stream dictionary"),
    "lazy.stream.invalid_length": ("warning", "Stream {ref} {problem}", "Inspect the stream dictionary /Length and compare it with the xref byte range"),
    "stream.unsupported_filter": ("warning", "Stream {ref} uses unsupported or deferred filter /{name}; lazy fast diagnostics did not decode the stream bytes", "Use raw export or add support for this filter before deep stream validation"),
    "lazy.deep_diagnostics_deferred": ("info", DEFERRED, "Inspect individual objects/streams on demand, or run full diagnostics on a smaller repro PDF."),
}
NO_LENGTH = "has no numeric /Length; marker-based lazy validation is deferred"
TOO_LONG = "byte range {start}..{end} exceeds file size {size}"


class _Fast:
    """The fast rules over one document: what they find, in order, each once."""

    def __init__(self, doc: LazyDocument):
        self.doc, self.found = doc, {}
        self.checked: set[Ref] = set()
        self.streams: set[Ref] = set()

    def put(self, rule: str, severity: str, message: str, step: str, ref: Ref | None = None, page: int | None = None, offset: int | None = None) -> None:
        self.found.setdefault((rule, message, ref, page, offset), (rule, severity, message, ref, page, offset, step))

    def add(self, rule: str, ref: Ref | None = None, page: int | None = None, offset: int | None = None, **values) -> None:
        severity, *texts = TEXTS[rule]
        name = reference_text(ref) if ref else None
        message, step = (t.format(ref=name, **values) for t in texts)
        self.put(rule, severity, message, step, ref, page, offset)

    def reference(self, ref: Ref, rule: str, label: str) -> None:
        """A reference has to be in the table, in use, and inside the file; looked at once."""
        if ref in self.checked:
            return
        self.checked.add(ref)
        entry = self.doc.entries.get(ref)
        if entry is None:
            self.add(rule, ref, label=label)
        elif not entry.in_use:
            self.add("lazy.reference_free_xref_entry", ref, None, entry.offset, label=label)
        elif entry.stream is None and entry.offset >= self.doc.size:
            self.add("xref.invalid_offset", ref, None, entry.offset, at=entry.offset)

    def document(self) -> None:
        doc, meta, root = self.doc, self.doc.metadata(""), self.doc.reference("Root")
        for n in doc.notes:
            self.put(n.rule, "warning", n.message, WARNING_STEP, offset=n.offset)
        if doc.trailer is None:
            self.add("lazy.trailer_missing", offset=doc.startxref)
        if doc.startxref is None:
            self.add("lazy.startxref_missing")
        if root is None:
            self.add("lazy.root_missing", offset=doc.startxref)
        else:
            self.reference(root, "lazy.root_missing_from_xref", "Root catalog reference")
        if meta["encrypted"]:
            self.add("document.encryption_detected")
        if meta["incremental_update_count"]:
            self.add("document.incremental_updates_detected", count=meta["incremental_update_count"])
        if meta["has_xref_stream"]:
            self.add("document.xref_stream_detected", offset=doc.startxref)
        if meta["has_object_stream"]:
            self.add("document.object_stream_detected")

    def stream(self, ref: Ref, page: int) -> None:
        """A stream's dictionary, of the first ones met."""
        if ref in self.streams:
            return
        self.streams.add(ref)
        if len(self.streams) > STREAM_CHECKS:
            return self.add("lazy.fast_stream_metadata_limit", most=STREAM_CHECKS)
        found = self.doc.objects.get(ref)
        if not found or not found.stream:
            return self.add("lazy.stream.metadata_unavailable", ref, page, self.doc.entries[ref].offset if ref in self.doc.entries else None)
        s = found.stream
        if s.declared is None or s.end > self.doc.size:
            self.add("lazy.stream.invalid_length", ref, page, s.start, problem=NO_LENGTH if s.declared is None else TOO_LONG.format(start=s.start, end=s.end, size=self.doc.size))
        for name in s.filters:
            if name not in filters.KNOWN:
                self.add("stream.unsupported_filter", ref, page, s.start, name=name)


def fast_findings(doc: LazyDocument) -> list[tuple]:
    """Findings that need no stream bytes: (rule, severity, message, ref, page, offset, next step), each once."""
    index, fast = doc.page_index(), _Fast(doc)
    fast.document()
    for page in index:
        fast.reference(page.ref, "lazy.page_missing_from_xref", "Page reference")
        for kind, label, ref in page.links:
            fast.reference(ref, "lazy.page_link_missing_from_xref", f"Page {page.number} {label} reference")
            if kind in ("contents", "xobject", "image"):
                fast.stream(ref, page.number)
    fast.add("lazy.deep_diagnostics_deferred", doc.reference("Root"), None, doc.startxref)
    return list(fast.found.values())
