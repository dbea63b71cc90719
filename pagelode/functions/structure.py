"""What a document's object graph says: pages, page-tree problems, tree, form fields, annotations."""

from __future__ import annotations

import math
from typing import NamedTuple

from pagelode.functions import content
from pagelode.functions.document import Document, Object, Ref
from pagelode.functions.values import Value, entries, is_name, reference_text, summary

BOXES = ("MediaBox", "CropBox", "BleedBox", "TrimBox", "ArtBox")
HOPS = 32  # references followed in a row before a value counts as absent
FIELD_DEPTH = 24
FIELDS = 10_000
XREF_CHILDREN = 256


def follow(doc: Document, value: Value | None) -> Value | None:
    for _ in range(HOPS):
        if value is None or value[0] != "Reference":
            return value
        found = doc.objects.get(value[1])
        value = found.value if found else None
    return None


def page_box(doc: Document, value: Value | None) -> tuple[float, ...] | None:
    """Lower left, upper right, width and height of four numbers."""
    got = follow(doc, value)
    if not got or got[0] != "Array" or len(got[1]) != 4 or any(v[0] != "Number" for v in got[1]):
        return None
    a, b, c, d = (v[1] for v in got[1])
    return a, b, c, d, abs(c - a), abs(d - b)


def rotation(doc: Document, value: Value | None) -> int | None:
    got = follow(doc, value)
    if not got or got[0] != "Number" or not math.isfinite(got[1]) or got[1] != math.floor(got[1]):
        return None
    return max(-(1 << 31), min((1 << 31) - 1, int(got[1])))


def nested_references(value: Value | None) -> list[Ref]:
    """References in value or in its arrays, in order."""
    out, stack = [], [value] if value else []
    while stack:
        v = stack.pop()
        if v[0] == "Reference":
            out.append(v[1])
        elif v[0] == "Array":
            stack.extend(reversed(v[1]))
    return out


class Page(NamedTuple):
    number: int
    ref: Ref
    boxes: dict[str, tuple[float, ...] | None]
    rotation: int | None
    counts: dict[str, int]
    links: list[tuple[str, str, Ref]]  # kind, label, target


def type_name(d: dict) -> str | None:
    v = d.get("Type")
    return v[1] if v and v[0] == "Name" else None


def _resources(doc: Document, value: Value | None, counts: dict[str, int], links: list) -> None:
    own = doc.dictionary(value)
    if own is None:
        return
    fonts, xobjects = doc.dictionary(own.get("Font")), doc.dictionary(own.get("XObject"))
    for name, v in entries(fonts or {}):
        if v[0] == "Reference":
            links.append(("font", f"/{name} Font", v[1]))
    counts["fonts"] = len(fonts or ())
    counts["xobjects"] = len(xobjects or ())
    for name, v in entries(xobjects or {}):
        if v[0] == "Reference":
            image = is_name(doc.dictionary(v), "Subtype", "Image")
            counts["images"] += image
            links.append(("image", f"/{name} Image", v[1]) if image else ("xobject", f"/{name} XObject", v[1]))


def inherited(doc: Document, d: dict, above: dict) -> dict:
    """What the pages below a node of the page tree get from it and from what is above."""
    state = dict(above)
    for key in BOXES:
        if key in d:
            state[key] = page_box(doc, d[key])
    if "Rotate" in d:
        state["Rotate"] = rotation(doc, d["Rotate"])
    if "Resources" in d:
        state["Resources"] = d["Resources"]
    return state


def pages(doc: Document) -> list[Page]:
    """Pages in tree order with what they inherit. A node without type holds pages; a node met before is skipped."""
    root = doc.reference("Root")
    catalog = doc.dictionary(("Reference", root)) if root else None
    start = catalog.get("Pages") if catalog else None
    out: list[Page] = []
    seen: set[Ref] = set()
    stack = [(start[1], {})] if start and start[0] == "Reference" else []
    while stack:
        ref, above = stack.pop()
        if ref in seen:
            continue
        seen.add(ref)
        d = doc.dictionary(("Reference", ref))
        if d is None:
            continue
        state = inherited(doc, d, above)
        kind = type_name(d)
        if kind == "Page":
            out.append(page_of(doc, len(out) + 1, ref, d, state))
        elif kind in ("Pages", None):
            kids = d.get("Kids")
            if kids and kids[0] == "Array":
                stack.extend((k[1], state) for k in reversed(kids[1]) if k[0] == "Reference")
    return out


def page_of(doc: Document, number: int, ref: Ref, d: dict, state: dict) -> Page:
    links: list[tuple[str, str, Ref]] = [("page", "Page", ref)]
    if d.get("Parent", ("",))[0] == "Reference":
        links.append(("parent", "Parent", d["Parent"][1]))
    counts = dict.fromkeys(("contents", "annotations", "fonts", "xobjects", "images"), 0)
    for key, kind, label, name in (("Contents", "contents", "Contents", "contents"), ("Annots", "annotation", "Annotation", "annotations")):
        found = nested_references(d.get(key))
        counts[name] = len(found)
        links += [(kind, label, r) for r in found]
    resources = state.get("Resources")
    if resources and resources[0] == "Reference":
        links.append(("resources", "Resources", resources[1]))
    _resources(doc, resources, counts, links)
    return Page(number, ref, {k: state.get(k) for k in BOXES}, state.get("Rotate"), counts, list(dict.fromkeys(links)))


class Problem(NamedTuple):
    rule: str
    ref: Ref | None
    page: int | None
    offset: int | None
    detail: str | None


class PageContent(NamedTuple):
    page: int
    ref: Ref
    has_media_box: bool
    offset: int
    fonts: list[str]
    xobjects: list[str]
    data: bytes | None


def content_bytes(doc: Document, value: Value | None) -> bytes | None:
    """A page's content streams one after the other, those in arrays each with a line break; None if there are none."""
    out = bytearray()
    stack: list[Value | None] = [value] if value else []
    while stack:
        v = stack.pop()
        if v is None:
            out += b"\n"
        elif v[0] == "Array":
            for x in reversed(v[1]):
                stack += [None, x]
        elif v[0] == "Reference":
            found = doc.objects.get(v[1])
            if found and found.stream:
                decoded = found.stream.decode()
                if not decoded.issues:
                    out += decoded.data
    return bytes(out) or None


def check_pages(doc: Document) -> list[Problem | PageContent]:
    """The page tree as the rules see it: problems and pages in the order they are met."""
    root = doc.reference("Root")
    if root is None:
        return [Problem("page_tree.missing_catalog", None, None, None, None)]
    catalog = doc.dictionary(("Reference", root))
    if catalog is None:
        return [Problem("page_tree.invalid_catalog_reference", root, None, None, None)]
    start = catalog.get("Pages")
    if start is None:
        return [Problem("page_tree.missing_pages", root, None, None, None)]
    if start[0] != "Reference":
        return [Problem("page_tree.invalid_pages_reference", root, None, None, None)]
    out: list[Problem | PageContent] = []
    seen: set[Ref] = set()
    number = 0
    stack: list[tuple[Ref, bool, Value | None] | Problem] = [(start[1], False, None)]
    while stack:
        item = stack.pop()
        if isinstance(item, Problem):
            out.append(item)
            continue
        ref, boxed, resources = item
        if ref in seen:
            out.append(Problem("page_tree.cyclic_reference", ref, None, None, None))
            continue
        seen.add(ref)
        found = doc.objects.get(ref)
        if found is None:
            out.append(Problem("page_tree.missing_node", ref, None, None, None))
            continue
        d = found.dictionary
        if d is None:
            out.append(Problem("page_tree.node_not_dictionary", ref, None, found.start, None))
            continue
        boxed, resources = boxed or "MediaBox" in d, d.get("Resources", resources)
        kind = type_name(d)
        if kind == "Pages":
            kids = d.get("Kids")
            if not kids or kids[0] != "Array":
                out.append(Problem("page_tree.pages_without_kids", ref, None, found.start, None))
                continue
            bad = Problem("page_tree.invalid_kid_reference", ref, None, found.start, None)
            stack.extend((k[1], boxed, resources) if k[0] == "Reference" else bad for k in reversed(kids[1]))
        elif kind == "Page":
            number += 1
            own = doc.dictionary(resources) or {}
            names = [[k for k, _ in entries(doc.dictionary(own.get(key)) or {})] for key in ("Font", "XObject")]
            out.append(PageContent(number, ref, boxed, found.start, *names, content_bytes(doc, d.get("Contents"))))
        else:
            out.append(Problem("page_tree.invalid_node_type", ref, None, found.start, "None" if kind is None else f'Some("{kind}")'))
    return out


def object_summary(o: Object) -> str:
    d = o.dictionary or {}
    parts = [f"/{key} /{d[key][1]}" for key in ("Type", "Subtype") if d.get(key, ("",))[0] == "Name"]
    if o.stream:
        parts.append(f"stream {max(o.stream.end - o.stream.start, 0)} byte(s)")
        if o.stream.filters:
            parts.append(f"filters {' -> '.join(o.stream.filters)}")
    return ", ".join(parts) or summary(o.value)


class Node(NamedTuple):
    path: tuple[int, ...]
    label: str
    kind: str
    ref: Ref | None
    summary: str | None


class _Tree:
    """Nodes in pre-order, and the references that were met on the way."""

    def __init__(self, doc: Document):
        self.doc, self.met, self.nodes = doc, set(), []
        self.kids: dict[tuple[int, ...], int] = {}

    def add(self, parent: tuple[int, ...] | None, label: str, kind: str, ref: Ref | None = None, text: str | None = None) -> tuple[int, ...]:
        if parent is None:
            path: tuple[int, ...] = ()
        else:
            path = (*parent, self.kids.get(parent, 0))
            self.kids[parent] = path[-1] + 1
        self.nodes.append(Node(path, label, kind, ref, text))
        return path

    def named(self, parent, label: str, kind: str, value: Value):
        if value[0] != "Reference":
            return self.add(parent, label, kind, None, summary(value))
        self.met.add(value[1])
        found = self.doc.objects.get(value[1])
        return self.add(parent, label, kind, value[1], object_summary(found) if found else "missing reference")

    def dictionary(self, value: Value | None) -> dict | None:
        if value and value[0] == "Reference":
            self.met.add(value[1])
        return self.doc.dictionary(value)

    def resource_map(self, parent, label: str, kind: str, item: str, value: Value) -> list[tuple[str, Value]]:
        path = self.named(parent, label, kind, value)
        images = []
        for name, v in entries(self.dictionary(value) or {}):
            image = v[0] == "Reference" and is_name(self.doc.dictionary(v), "Subtype", "Image")
            self.named(path, f"/{name}", "image" if image else item, v)
            if image:
                images.append((name, v))
        return images

    def page(self, parent, ref: Ref, d: dict) -> None:
        parts = [f"{label} {summary(d[key])}" for key, label in (("MediaBox", "MediaBox"), ("CropBox", "CropBox"), ("Rotate", "Rotate")) if key in d]
        path = self.add(parent, "Page", "page", ref, ", ".join(parts) or "/Type /Page")
        if "Resources" in d:
            at = self.named(path, "Resources", "resources", d["Resources"])
            own = self.dictionary(d["Resources"]) or {}
            if "Font" in own:
                self.resource_map(at, "Fonts", "fonts", "font", own["Font"])
            if "XObject" in own:
                images = self.resource_map(at, "XObjects", "x_objects", "x_object", own["XObject"])
                if images:
                    group = self.add(at, "Images", "images")
                    for name, v in images:
                        self.named(group, f"/{name}", "image", v)
        if "Annots" in d:
            at = self.named(path, "Annotations", "annotations", d["Annots"])
            for v in d["Annots"][1] if d["Annots"][0] == "Array" else ():
                self.named(at, "Annotation", "annotation", v)
        if "Contents" in d:
            self.named(path, "Contents", "reference", d["Contents"])

    def page_tree(self, parent, start: Ref) -> None:
        seen: set[Ref] = set()
        stack: list[tuple] = [(parent, ("Reference", start))]
        while stack:
            at, value = stack.pop()
            if value[0] != "Reference":
                self.named(at, "Kid", "reference", value)
                continue
            ref = value[1]
            self.met.add(ref)
            if ref in seen:
                self.add(at, "Cycle", "cycle", ref, "cyclic page tree reference")
                continue
            seen.add(ref)
            found = self.doc.objects.get(ref)
            if not found:
                self.add(at, "Missing page tree node", "missing", ref)
            elif found.dictionary is None:
                self.add(at, "Invalid page tree node", "object", ref, object_summary(found))
            else:
                d = found.dictionary
                kind = type_name(d)
                if kind == "Page":
                    self.page(at, ref, d)
                elif kind in ("Pages", None):
                    path = self.add(at, "Pages", "pages", ref, f"Count {summary(d['Count'])}" if "Count" in d else object_summary(found))
                    kids = d.get("Kids")
                    if kids and kids[0] == "Array":
                        stack.extend((path, k) for k in reversed(kids[1]))
                else:
                    self.add(at, "Unexpected page tree node", "object", ref, f"/Type /{kind}")


def object_tree(doc: Document) -> list[Node]:
    t = _Tree(doc)
    streams = sum(o.stream is not None for o in doc.objects.values())
    root = t.add(None, "PDF", "root", None, f"{len(doc.objects)} object(s), {streams} stream(s)")
    trailer = t.add(root, "Trailer", "trailer", None, summary(doc.trailer) if doc.trailer else "missing")
    if doc.trailer and doc.trailer[0] == "Dictionary":
        for key, v in entries(doc.trailer[1]):
            t.named(trailer, key, "reference", v)
    ref = doc.reference("Root")
    if ref is None:
        t.add(root, "Catalog missing", "missing")
    else:
        t.met.add(ref)
        found = doc.objects.get(ref)
        if not found:
            t.add(root, "Catalog missing", "missing", ref)
        else:
            at = t.add(root, "Catalog", "catalog", ref, object_summary(found))
            d = found.dictionary or {}
            if d.get("Pages", ("",))[0] == "Reference":
                t.page_tree(at, d["Pages"][1])
            if "AcroForm" in d:
                t.named(at, "AcroForm", "acro_form", d["AcroForm"])
            files = (t.dictionary(d.get("Names")) or {}).get("EmbeddedFiles")
            if files:
                t.named(at, "Embedded files", "embedded_files", files)
    used = [e for e in doc.xref if e.in_use]
    at = t.add(root, "Cross-reference", "xref", None, f"{len(doc.xref)} entrie(s), {sum(e.valid is False for e in used)} invalid in-use offset(s)")
    if any(is_name(o.dictionary, "Type", "XRef") for o in doc.objects.values()):
        t.add(at, "Xref stream detected", "xref", None, "full expansion deferred")
    for e in used[:XREF_CHILDREN]:
        valid = "unknown" if e.valid is None else str(e.valid).lower()
        t.add(at, reference_text(e.ref), "object", e.ref, f"offset {e.offset}, valid offset: {valid}")
    alone = [o for o in doc.ordered() if o.ref not in t.met]
    if alone:
        at = t.add(root, "Orphaned objects", "orphaned_objects", None, f"{len(alone)} object(s)")
        for o in alone:
            t.add(at, reference_text(o.ref), "object", o.ref, object_summary(o))
    return t.nodes


# How value types are called in messages.
LABELS = {"Null": "null", "Boolean": "boolean", "Number": "number", "Name": "name", "String": "string", "HexString": "hex string", "Array": "array", "Dictionary": "dictionary", "Reference": "reference", "Raw": "raw"}


def string_of(value: Value) -> str:
    if value[0] == "String":
        return value[1]
    return summary(value).lstrip("(").rstrip(")") if value[0] == "HexString" else summary(value)


def form_fields(doc: Document, limit: int | None = None) -> tuple[list[tuple[str, Ref, str | None]], list[str]]:
    """Terminal fields (name, reference, type), by lower-case name, and warnings.

    All fields, unless a limit is given, such as FIELDS, a viewer's; each reference met beyond it is a warning.
    """
    root = doc.reference("Root")
    found = doc.objects.get(root) if root else None
    if not found:
        return [], ["Root catalog is missing; AcroForm cannot be inspected."]
    if found.dictionary is None:
        return [], [f"Root catalog {reference_text(found.ref)} is not a dictionary."]
    form = found.dictionary.get("AcroForm")
    if form is None:
        return [], []
    d = doc.dictionary(form)
    if d is None:
        return [], [f"/AcroForm is {LABELS[form[0]]}, not a dictionary reference or dictionary."]
    top = d.get("Fields")
    if top is None:
        return [], ["AcroForm dictionary does not contain a /Fields array."]
    if top[0] != "Array":
        return [], [f"AcroForm /Fields is {LABELS[top[0]]}, not an array."]
    fields: list[tuple[str, Ref, str | None]] = []
    warnings: list[str] = []
    open_refs: set[Ref] = set()
    stack: list[tuple] = [(v, "", 0) for v in reversed(top[1])]
    while stack:
        value, parent, depth = stack.pop()
        ref = None
        if value is None:  # a field and all below it are done
            open_refs.discard(parent)
            continue
        if value[0] == "Dictionary":
            own = value[1]
            name = string_of(own["T"]) if "T" in own else ""
            warnings.append(f"Direct AcroForm field dictionaries are summarized but cannot be opened as indirect objects: {name or '<unnamed>'}.")
        elif value[0] == "Reference":
            ref = value[1]
            text = reference_text(ref)
            if depth > FIELD_DEPTH:
                warnings.append(f"AcroForm traversal depth limit reached at {text}.")
                continue
            if limit is not None and len(fields) >= limit:
                warnings.append(f"AcroForm field limit reached ({limit}); remaining fields were skipped.")
                continue
            if ref in open_refs:
                warnings.append(f"Cycle detected while walking AcroForm field {text}.")
                continue
            if ref not in doc.objects:
                warnings.append(f"AcroForm field object {text} was not found.")
                continue
            own = doc.objects[ref].dictionary
            if own is None:
                warnings.append(f"AcroForm field object {text} is not a dictionary.")
                continue
            open_refs.add(ref)
            stack.append((None, ref, 0))
        else:
            warnings.append(f"AcroForm field entry is {LABELS[value[0]]}, not an indirect reference or dictionary.")
            continue
        name = ".".join(x for x in (parent, string_of(own["T"]) if "T" in own else "") if x)
        kids = own.get("Kids")
        if kids and kids[0] != "Array":
            shown = reference_text(ref) if ref else name if name.strip() else "<unnamed 0 0 R>"
            warnings.append(f"AcroForm field {shown} has a /Kids entry that is {LABELS[kids[0]]}, not an array.")
            kids = None
        if ref and not (kids and kids[1]):
            kind = own.get("FT")
            fields.append((name if name.strip() else f"<unnamed {reference_text(ref)}>", ref, kind[1] if kind and kind[0] == "Name" else None))
        stack.extend((k, name, depth + 1) for k in reversed(kids[1] if kids else []))
    return sorted(fields, key=lambda f: (f[0].lower(), f[1])), warnings


ANNOTATION_TEXTS = (("rect", "Rect"), ("flags", "F"), ("color", "C"), ("border", "Border"), ("appearance", "AP"), ("ca", "CA"))


def annotations(doc: Document, of: list[Page]) -> tuple[list[dict], list[str]]:
    """Annotations of pages, by page and reference, and warnings."""
    rows, warnings = [], []
    for page in of:
        for ref in dict.fromkeys(r for kind, _, r in page.links if kind == "annotation"):
            d = doc.dictionary(("Reference", ref))
            if d is None:
                state = "is not a dictionary" if ref in doc.objects else "was not found"
                warnings.append(f"Page {page.number} annotation object {reference_text(ref)} {state}.")
                continue
            slash = lambda n: n if n.startswith("/") else f"/{n}"
            subtype = d.get("Subtype")
            row = {name: summary(d[key]) if key in d else None for name, key in ANNOTATION_TEXTS}
            rows.append(row | {
                "page": page.number, "page_ref": page.ref, "ref": ref, "subtype": slash(subtype[1]) if subtype and subtype[0] == "Name" else None,
                "contents": string_of(d["Contents"]) if "Contents" in d else None, "keys": [slash(k) for k, _ in entries(d)],
            })
    return sorted(rows, key=lambda r: (r["page"], r["ref"])), warnings


def page_operators(data: bytes) -> list[content.Operator]:
    return content.operators(content.tokenize(data))
