"""Deep diagnostics of one page, stream or object of a lazy document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pagelode.functions import filters, views
from pagelode.functions.document import Ref
from pagelode.functions.lazy import LazyDocument, LazyError
from pagelode.functions.structure import page_operators
from pagelode.functions.values import entries, number_text, reference_text, references, summary

STREAMS = 4
SAMPLE = 16
PAGE_LIMIT = "Precise lazy page object extraction is still deferred; this enrichment inspects page metadata, object links, and a bounded number of content streams."


@dataclass
class Enrichment:
    kind: str
    target: str
    page: int | None
    ref: Ref | None
    summary: str = ""
    findings: list[tuple] = field(default_factory=list)  # rule, severity, message, ref, page, offset, next step
    warnings: list[str] = field(default_factory=list)
    limitations: list[str] = field(default_factory=list)
    details: list[tuple[str, str]] = field(default_factory=list)


def deep_stream(doc: LazyDocument, ref: Ref, page: int | None = None) -> Enrichment:
    name, found = reference_text(ref), doc.objects.get(ref)
    if not found or not found.stream:
        raise LazyError(f"stream {name} was not found")
    s = found.stream
    out = Enrichment("stream", f"Stream {name}", page, ref, f"Stream {name} lazy deep diagnostics inspected metadata, decode status, and bounded content operators.")
    try:
        got: filters.Decoded | None = doc.stream_data(found)
    except LazyError as e:
        got = None
        out.limitations.append(f"Content stream operator analysis skipped: {e}")
    clean = got is not None and not got.issues
    out.details = [
        ("Declared length", "unknown" if s.declared is None else str(s.declared)), ("Actual length", str(s.end - s.start)), ("Filters", " -> ".join(s.filters) or "None"),
        ("Decoded length", str(got.length) if clean else "unknown"), ("Raw range", f"{s.start}..{s.end}"),
    ]
    for name_of, kind, message in got.issues if got else ():
        failed = kind == "failed"
        out.findings.append(("lazy.deep.stream_decode_failed" if failed else "lazy.deep.stream_unsupported_filter", "error" if failed else "warning", f"Stream {name} filter /{name_of} could not be decoded during lazy deep diagnostics: {message}", ref, page, s.start, "Export the raw stream or inspect the /Filter chain and encoded bytes"))
    if s.end - s.start > views.PREVIEW:
        out.limitations.append(f"Raw/hex preview was truncated at {views.PREVIEW} bytes; report enrichment does not embed stream bytes.")
    if clean and got.length > views.PREVIEW:
        out.limitations.append(f"Decoded preview was truncated at {views.PREVIEW} bytes; report enrichment does not embed decoded bytes.")
    try:
        views.content_candidate(found)
    except views.NoContent as e:
        out.limitations.append(str(e))
        return out
    if got is not None and not clean:
        out.limitations.append("; ".join(f"/{f}: {m}" for f, _, m in got.issues))
    if clean:
        ops = page_operators(got.data)
        warned = views.stream_warnings(ops)
        out.details += [("Content tokens", str(len(views.content.tokenize(got.data)))), ("Content operators", str(len(ops))), ("Content warnings", str(len(warned)))]
        if ops:
            out.details.append(("Operator sample", " ".join(op.name for op in ops[:SAMPLE])))
        out.findings += [(f"lazy.deep.{rule}", "warning", message, ref, page, None if at is None else s.start + at[0], step) for rule, _, at, message, step in warned]
    return out


def deep_object(doc: LazyDocument, ref: Ref) -> Enrichment:
    name, found = reference_text(ref), doc.read_object(ref)
    value = ("Dictionary", found.stream.dictionary) if found.stream else found.value
    linked = sorted(set(references(value)))
    out = Enrichment("object", f"Object {name}", None, ref, f"Object {name} lazy deep diagnostics inspected one indirect object and {len(linked)} reference(s).")
    out.details = [("Object type", "stream" if found.stream else views.KINDS[found.value[0]]), ("Summary", summary(found.value)), ("Raw range", f"{found.start}..{found.end}"), ("Dictionary keys", ", ".join(k for k, _ in entries(found.dictionary or {}))), ("Referenced objects", str(len(linked)))]
    for to in linked:
        text, entry = reference_text(to), doc.entries.get(to)
        if entry is None:
            out.findings.append(("object.missing_reference", "error", f"Object {name} references {text}, which is missing from the lazy xref table", to, None, None, "Check whether the referenced object is missing or stored in an unsupported object stream"))
        elif not entry.in_use:
            out.findings.append(("lazy.deep.object_reference_free", "error", f"Object {name} references free xref entry {text}", to, None, entry.offset, "Verify the referenced object and regenerate the xref table"))
        elif entry.stream is None and entry.offset >= doc.size:
            out.findings.append(("xref.invalid_offset", "error", f"Object {name} references {text}, whose xref offset {entry.offset} is outside the file", to, None, entry.offset, "Compare the xref table against the raw file length"))
    if found.stream:
        out.details += [("Stream actual length", str(found.stream.end - found.stream.start)), ("Stream filters", " -> ".join(found.stream.filters) or "None")]
        own = deep_stream(doc, ref)
        out.findings += own.findings
        out.warnings += own.warnings
        out.limitations += own.limitations
        out.details += [(f"Stream {n}", v) for n, v in own.details]
    return out


def deep_page(doc: LazyDocument, number: int) -> Enrichment:
    if number < 1:
        raise LazyError("Page numbers start at 1.")
    page = next(iter(doc.page_index(number)), None)
    if page is None:
        raise LazyError(f"Page {number} was not found in the lazy page tree")
    own = reference_text(page.ref)
    streams = [r for kind, _, r in page.links if kind == "contents"]
    out = Enrichment("page", f"Page {number}", number, page.ref, f"Page {number} lazy deep diagnostics inspected {len(page.links)} link(s) and {min(len(streams), STREAMS)} content stream(s).", limitations=[PAGE_LIMIT])
    out.details = [("Page reference", own), ("Rotation", str(page.rotation or 0)), *[(label, str(page.counts[key])) for label, key in (("Fonts", "fonts"), ("XObjects", "xobjects"), ("Images", "images"), ("Content streams", "contents"), ("Annotations", "annotations"))]]
    box = page.boxes["MediaBox"]
    if box:
        out.details.append(("MediaBox", " ".join(number_text(x) for x in box[:4])))
    else:
        out.findings.append(("lazy.deep.page_missing_mediabox", "warning", f"Page {number} ({own}) has no inherited MediaBox in lazy metadata", page.ref, number, None, "Inspect the page tree ancestors for a /MediaBox entry"))
    resources = sum(kind in ("resources", "font", "xobject", "image", "annotation") for kind, *_ in page.links)
    out.details += [("Page object links", str(len(page.links))), ("Resource links", str(resources))]
    for ref in streams[:STREAMS]:
        text = reference_text(ref)
        try:
            got = deep_stream(doc, ref, number)
        except LazyError as e:
            out.findings.append(("lazy.deep.page_content_stream_unavailable", "warning", f"Could not run deep diagnostics for content stream {text}: {e}", ref, number, None, "Inspect this content stream directly through lazy stream diagnostics"))
            continue
        out.findings += got.findings
        out.warnings += [f"Content stream {text}: {w}" for w in got.warnings]
        out.details.append((f"Content stream {text}", got.summary))
    if len(streams) > STREAMS:
        out.limitations.append(f"Only the first {STREAMS} content stream(s) were analyzed for this page; {len(streams) - STREAMS} additional stream(s) were skipped.")
    return out
