"""What a page shows: text, paths, images, forms and annotations with their bounds.

Content is replayed with a graphics state. Matrices act on row vectors; `order`
picks how a new matrix joins the current one: "outer" (the default) applies it
after the current one, "inner" before it, as PDF itself defines.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pagelode.functions import content, fonts
from pagelode.functions.document import Document, Ref
from pagelode.functions.structure import HOPS, Page, nested_references, page_operators
from pagelode.functions.values import reference_text, summary

FORM_DEPTH = 4
PARENTS = 64
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
Matrix = tuple[float, ...]
Bounds = tuple[float, float, float, float]


class Shown(NamedTuple):
    id: str
    kind: str
    label: str
    summary: str
    bbox: Bounds | None
    ref: Ref | None
    stream: Ref | None
    range: tuple[int, int] | None
    text: str | None
    properties: list[tuple[str, str]]
    warnings: list[str]


def times(first: Matrix, second: Matrix) -> Matrix:
    """The matrix that applies first and then second."""
    a, b, c, d, e, f = first
    g, h, i, j, k, m = second
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + m


def at(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def around(points: list[tuple[float, float]]) -> Bounds | None:
    if not points:
        return None
    xs, ys = zip(*points, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def corners(m: Matrix, x1: float, y1: float, x2: float, y2: float) -> Bounds:
    return around([at(m, x, y) for x in (x1, x2) for y in (y1, y2)])


def figure(x: float) -> str:
    if not math.isfinite(x):
        return "-"
    return str(int(x)) if x == math.floor(x) else f"{x:.2f}"


def figures(m) -> str:
    return f"[{' '.join(map(figure, m))}]"


def rectangle(value) -> tuple[float, ...] | None:
    if not value or value[0] != "Array" or len(value[1]) != 4 or any(v[0] != "Number" for v in value[1]):
        return None
    return tuple(v[1] for v in value[1])


def matrix_of(value) -> Matrix:
    numbers = [v[1] for v in value[1] if v[0] == "Number"] if value and value[0] == "Array" else []
    return tuple(numbers[:6]) if len(numbers) >= 6 else IDENTITY


@dataclass
class State:
    ctm: Matrix = IDENTITY
    text: Matrix = IDENTITY
    line: Matrix = IDENTITY
    font: str | None = None
    size: float | None = None
    leading: float = 0.0
    character: float = 0.0
    word: float = 0.0
    scaling: float = 100.0


@dataclass
class Context:
    fonts: dict[str, fonts.Font] = field(default_factory=dict)
    xobjects: dict[str, Ref] = field(default_factory=dict)
    ctm: Matrix = IDENTITY
    form: list[tuple[str, str]] = field(default_factory=list)  # properties of what is drawn inside a form
    inside: tuple[Ref, ...] = ()


def _context(doc: Document, value) -> Context:
    own = doc.dictionary(value) or {}
    out = Context()
    for name, v in (doc.dictionary(own.get("Font")) or {}).items():
        d = doc.dictionary(v)
        if d is not None:
            out.fonts[name] = fonts.font(doc, d, v[1] if v[0] == "Reference" else None)
    out.xobjects = {name: v[1] for name, v in (doc.dictionary(own.get("XObject")) or {}).items() if v[0] == "Reference"}
    return out


def _inherited(doc: Document, d: dict):
    """The resources of a page or of the first of its parents that has some."""
    for _ in range(PARENTS):
        if "Resources" in d:
            return d["Resources"]
        parent = d.get("Parent")
        d = doc.dictionary(parent) if parent and parent[0] == "Reference" else None
        if d is None:
            return None
    return None


def _content_refs(doc: Document, value, hops: int = HOPS) -> list[Ref]:
    """Streams of a /Contents entry; references to arrays are followed."""
    out = []
    for ref in nested_references(value):
        found = doc.objects.get(ref)
        out += [ref] if found is None or found.stream or not hops else _content_refs(doc, found.value, hops - 1)
    return out


class Inspector:
    def __init__(self, doc: Document, page: Page, order: str = "outer"):
        self.doc, self.page, self.shown, self.warnings = doc, page, [], []
        self.stream, self.context, self.state, self.stack, self.path = page.ref, Context(), State(), [], []
        self.join = (lambda current, new: times(current, new)) if order == "outer" else (lambda current, new: times(new, current))
        self.handlers = {
            "q": lambda op: self.stack.append(replace(self.state)), "Q": self._restore, "cm": self._concatenate, "BT": self._begin, "Tf": self._font, "Tm": self._set_matrix,
            "Td": self._move, "TD": self._move, "T*": lambda op: self._next_line(), "Tj": self._show, "TJ": self._show, "'": self._show_line, '"': self._show_spaced, "Do": self._paint,
            "re": self._box, "h": lambda op: self.path.append(()), **dict.fromkeys("ml", lambda op: self._points(op, 1)), **dict.fromkeys("cvy", lambda op: self._points(op, 3)),
            **dict.fromkeys("S s f F f* B B* b b* n".split(), self._finish), **{name: (lambda op, slot=slot: self._set(op, slot)) for name, slot in (("Tc", "character"), ("Tw", "word"), ("Tz", "scaling"), ("TL", "leading"))},
        }

    def run(self) -> Inspector:
        d = self.doc.objects[self.page.ref].dictionary
        self._annotations(d)
        if "Contents" not in d:
            self.warn("no_contents", self.page.ref, f"Page {self.page.number} has no /Contents entry")
            return self
        refs = _content_refs(self.doc, d["Contents"])
        if not refs:
            self.warn("unsupported_contents", self.page.ref, "Page /Contents could not be resolved to stream references")
        context = _context(self.doc, _inherited(self.doc, d))
        for ref in refs:
            found = self.doc.objects.get(ref)
            if not found or not found.stream:
                self.warn("content_not_stream", ref, f"Page content object {reference_text(ref)} is not a stream")
                continue
            decoded = found.stream.decode()
            if decoded.issues:
                self.warn("content_decode_failed", ref, f"Content stream {reference_text(ref)} decode issue: " + "; ".join(f"/{f}: {m}" for f, _, m in decoded.issues))
                continue
            self._replay(ref, decoded.data, context)
        return self

    def warn(self, rule: str, ref: Ref | None, message: str) -> None:
        self.warnings.append((f"page_object.{rule}", ref, message))

    def _add(self, prefix: str, kind: str, label: str, text: str, bbox, ref=None, op=None, shown=None, properties=(), warnings=()) -> None:
        properties = [*properties, *(self.context.form if op else ())]
        self.shown.append(Shown(f"page-{self.page.number}-{prefix}-{len(self.shown) + 1}", kind, label, text, bbox, ref, self.stream if op else None, (op.start, op.end) if op else None, shown, properties, list(warnings)))

    def _annotations(self, d: dict) -> None:
        for ref in nested_references(d.get("Annots")):
            name, own = reference_text(ref), self.doc.dictionary(("Reference", ref))
            if own is None:
                if ref in self.doc.objects:
                    self.warn("invalid_annotation", ref, f"Annotation object {name} does not contain a dictionary")
                else:
                    self.warn("missing_annotation", ref, f"Annotation object {name} was referenced by the page but was not found")
                continue
            subtype = own["Subtype"][1] if own.get("Subtype", ("",))[0] == "Name" else "Unknown"
            box = rectangle(own.get("Rect"))
            told = [("Subtype", f"/{subtype}"), ("Reference", name), *[(label, summary(own[key]) if key in own else "-") for label, key in (("Rect", "Rect"), ("Flags", "F"))]]
            self._add("annotation", "annotation", f"Annotation /{subtype}", f"Annotation {name} /{subtype}", corners(IDENTITY, *box) if box else None, ref, properties=told, warnings=[] if box else ["Annotation has no usable /Rect bbox."])

    def _replay(self, ref: Ref, data: bytes, context: Context) -> None:
        self.stream, self.context, self.state, self.stack, self.path = ref, context, State(ctm=context.ctm), [], []
        for op in page_operators(data):
            handler = self.handlers.get(op.name)
            if handler:
                handler(op)

    @staticmethod
    def _numbers(op: content.Operator) -> list[float]:
        return [float(t.lexeme) for t in op.operands if t.kind == "number"]

    @staticmethod
    def _operand(op: content.Operator, i: int, kind: str):
        return op.operands[i].lexeme if i < len(op.operands) and op.operands[i].kind == kind else None

    def _number(self, op: content.Operator, i: int) -> float | None:
        got = self._operand(op, i, "number")
        return None if got is None else float(got)

    def _set(self, op: content.Operator, slot: str, i: int = 0) -> None:
        value = self._number(op, i)
        if value is not None:
            setattr(self.state, slot, value)

    def _restore(self, op) -> None:
        if self.stack:
            self.state = self.stack.pop()

    def _concatenate(self, op) -> None:
        n = self._numbers(op)
        if len(n) >= 6:
            self.state.ctm = self.join(self.state.ctm, tuple(n[:6]))

    def _begin(self, op) -> None:
        self.state.text = self.state.line = IDENTITY

    def _font(self, op) -> None:
        self.state.font = self._operand(op, 0, "name") or self.state.font
        self._set(op, "size", 1)

    def _set_matrix(self, op) -> None:
        n = self._numbers(op)
        if len(n) >= 6:
            self.state.text = self.state.line = tuple(n[:6])

    def _shift(self, m: Matrix, x: float, y: float) -> Matrix:
        return self.join(m, (1.0, 0.0, 0.0, 1.0, x, y))

    def _move(self, op) -> None:
        x, y = self._number(op, 0), self._number(op, 1)
        if x is not None and y is not None:
            if op.name == "TD":
                self.state.leading = -y
            self.state.text = self.state.line = self._shift(self.state.text, x, y)

    def _next_line(self) -> None:
        self.state.text = self.state.line = self._shift(self.state.line, 0.0, -self.state.leading)

    def _show_line(self, op) -> None:
        self._next_line()
        self._show(op)

    def _show_spaced(self, op) -> None:
        self._set(op, "word", 0)
        self._set(op, "character", 1)
        self._show_line(op)

    def _show(self, op) -> None:
        s = self.state
        used = self.context.fonts.get(s.font) if s.font else None
        raw = fonts.glyph_bytes(op)
        text, warnings = fonts.text_of(raw, used) if raw else ("", [])
        if not text:
            return
        size = max(abs(12.0 if s.size is None else s.size), 1.0)
        width = fonts.advance(op, raw, text, used, size, s.character, s.word, s.scaling)
        box = corners(self.join(s.ctm, s.text), 0.0, 0.0, width, size)
        snippet = text if len(text) <= 80 else text[:80] + "..."
        if used is None:
            warnings.append("Active font resource was not found; text decoding and width use fallback byte mapping.")
        warnings.append("Text bbox remains best-effort; full shaping, kerning, vertical writing, and renderer glyph rasterization are not simulated.")
        told = [
            ("Text", snippet), ("Raw glyph bytes", raw[:64].hex(" ").upper()), ("Font resource", s.font or "-"), ("Font reference", reference_text(used.ref) if used and used.ref else "-"),
            ("Base font", used and used.base or "-"), ("Font subtype", used and used.subtype or "-"), ("Encoding source", used.encoding_source if used else "fallback"), ("Width source", used.width_source if used else "fallback"),
            ("Font size", figure(size)), ("Horizontal scaling", f"{figure(s.scaling)}%"), ("Character spacing", figure(s.character)), ("Word spacing", figure(s.word)), ("Estimated advance", figure(width)),
            ("Text matrix", figures(s.text)), ("CTM", figures(s.ctm)), ("Operator", op.name), ("Byte range", f"{op.start}..{op.end}"),
        ]
        self._add("text", "text", f"Text: {snippet}", f"Text run from operator {op.name}", box, op=op, shown=text, properties=told, warnings=warnings)
        s.text = self._shift(s.text, width, 0.0)

    def _points(self, op, pairs: int) -> None:
        n = self._numbers(op)[-2 * pairs :]
        if len(n) == 2 * pairs:
            self.path.append(tuple(at(self.state.ctm, *n[i : i + 2]) for i in range(0, len(n), 2)))

    def _box(self, op) -> None:
        n = self._numbers(op)
        if len(n) >= 4:
            x, y, w, h = n[:4]
            self.path.append(tuple(at(self.state.ctm, a, b) for a, b in ((x, y), (x + w, y), (x, y + h), (x + w, y + h))))

    def _finish(self, op) -> None:
        points = [p for command in self.path for p in command]
        if points:
            told = [("Paint operator", op.name), ("Command count", str(len(self.path))), ("Point count", str(len(points))), ("Byte range", f"{op.start}..{op.end}")]
            self._add("path", "path", f"Path: {len(points)} point(s)", f"Path painted with {op.name}", around(points), op=op, properties=told)
        self.path = []

    def _paint(self, op) -> None:
        name = self._operand(op, len(op.operands) - 1, "name") if op.operands else None
        if name is None:
            return
        ref = self.context.xobjects.get(name)
        if ref is None:
            self.warn("missing_xobject_resource", self.stream, f"XObject /{name} was invoked but was not found in page resources")
            return
        d = self.doc.dictionary(("Reference", ref)) or {}
        subtype = d["Subtype"][1] if d.get("Subtype", ("",))[0] == "Name" else "Unknown"
        form = subtype == "Form"
        inner = self.join(self.state.ctm, matrix_of(d.get("Matrix")))
        if form:
            own = rectangle(d.get("BBox"))
            box = corners(inner, *own) if own else None
        else:
            box = corners(self.state.ctm, 0.0, 0.0, 1.0, 1.0)
        number = lambda key: figure(d[key][1]) if d.get(key, ("",))[0] == "Number" else "-"
        told = [
            ("XObject name", f"/{name}"), ("Subtype", f"/{subtype}"), ("Reference", reference_text(ref)), ("Width", number("Width")), ("Height", number("Height")),
            *[(k, summary(d[k]) if k in d else "-") for k in ("ColorSpace", "BitsPerComponent")], ("CTM", figures(self.state.ctm)), ("Byte range", f"{op.start}..{op.end}"),
        ]
        warnings = ["Form XObject bbox uses invocation CTM unit bounds; supported child content is expanded as separate page objects."] if form else []
        self._add("xobject", {"Image": "image", "Form": "form"}.get(subtype, "x_object"), f"/{name} {subtype}", f"Paint XObject /{name} ({reference_text(ref)})", box, ref, op, None, told, warnings)
        if form:
            self._expand(name, ref, inner)

    def _expand(self, name: str, ref: Ref, ctm: Matrix) -> None:
        found, text = self.doc.objects.get(ref), reference_text(ref)
        outer = self.context
        if len(outer.inside) >= FORM_DEPTH:
            return self.warn("form_recursion_limit", ref, f"Form XObject /{name} reached recursion depth limit {FORM_DEPTH}")
        if ref in outer.inside:
            return self.warn("form_recursion_cycle", ref, f"Form XObject /{name} references an ancestor form; recursive expansion stopped")
        if not found or not found.stream:
            return self.warn("form_not_stream", ref, f"Form XObject /{name} at {text} is not a stream")
        decoded = found.stream.decode()
        if decoded.issues:
            return self.warn("form_decode_failed", ref, f"Form XObject /{name} at {text} decode issue: " + "; ".join(f"/{f}: {m}" for f, _, m in decoded.issues))
        own = _context(self.doc, found.stream.dictionary.get("Resources"))
        box = rectangle(found.stream.dictionary.get("BBox"))
        told = [("Parent form", f"/{name} {text}"), ("Form depth", str(len(outer.inside) + 1)), ("Form invoked from", reference_text(self.stream)), ("Form BBox", figures(corners(IDENTITY, *box)) if box else "-")]
        held = self.stream, self.context, self.state, self.stack, self.path
        self._replay(ref, decoded.data, Context(outer.fonts | own.fonts, outer.xobjects | own.xobjects, ctm, told, (*outer.inside, ref)))
        self.stream, self.context, self.state, self.stack, self.path = held


class TextInspector(Inspector):
    """The texts that a page's operators show, in order, without places, properties or warnings."""

    def __init__(self, doc: Document, page: Page):
        super().__init__(doc, page)
        self.texts: list[str] = []
        for name in ("re", "h", *"mlcvy", *"S s f F f* B B* b b* n".split(), "cm", "Tm", "Td", "TD", "T*", "Tc", "Tw", "Tz", "TL"):
            del self.handlers[name]

    def _annotations(self, d: dict) -> None:
        pass

    def _add(self, *args, **more) -> None:
        pass

    def _show(self, op) -> None:
        used = self.context.fonts.get(self.state.font) if self.state.font else None
        raw = fonts.glyph_bytes(op)
        text = fonts.text_of(raw, used)[0] if raw else ""
        if text:
            self.texts.append(text)

    def _show_line(self, op) -> None:
        self._show(op)

    _show_spaced = _show_line
