"""Views of single objects and streams, as plain dictionaries, and bounded previews."""

from __future__ import annotations

from pagelode.functions import content, filters
from pagelode.functions.document import Object
from pagelode.functions.values import Value, entries, reference_text, references, summary

PREVIEW = 1 << 20
RAW_PREVIEW = 4096
RAW_CHARS = 800
# How value types are called in views.
KINDS = {"Null": "null", "Boolean": "boolean", "Number": "number", "Name": "name", "String": "string", "HexString": "hex string", "Array": "array", "Dictionary": "dictionary", "Reference": "reference", "Raw": "raw"}


def hex_dump(data: bytes) -> str:
    """Sixteen bytes a row, a gap after the eighth, the printable characters at the end."""
    rows = []
    for at in range(0, len(data), 16):
        row = data[at : at + 16]
        digits = "".join(f"{b:02x} " for b in row).ljust(48)
        shown = "".join(chr(b) if 0x20 <= b < 0x7F else "." for b in row)
        rows.append(f"{at:08x}  {digits[:24]} {digits[24:]} {shown}\n")
    return "".join(rows)


def _ref(ref) -> dict:
    return {"object": ref[0], "generation": ref[1]}


def _issues(got: filters.Decoded) -> list[dict]:
    return [{"filter": f, "kind": k, "message": m} for f, k, m in got.issues]


def inspect_stream(o: Object, decode: bool = True) -> dict:
    s = o.stream
    out = {"reference": _ref(o.ref), "declared_length": s.declared, "actual_length": s.end - s.start, "raw_range": {"start": s.start, "end": s.end}, "filters": s.filters, "decoded_length": None, "decode_steps": [], "decode_issues": []}
    if decode:
        got = s.decode()
        out |= {"decoded_length": None if got.issues else got.length, "decode_steps": [{"filter": f, "status": k, "message": m} for f, k, m in got.steps], "decode_issues": _issues(got)}
    return out


def inspect_object(o: Object, decode: bool = True) -> dict:
    d = o.dictionary or {}
    value: Value = ("Dictionary", o.stream.dictionary) if o.stream else o.value
    return {
        "reference": _ref(o.ref), "object_type": "stream" if o.stream else KINDS[o.value[0]], "value_summary": summary(o.value), "raw_range": {"start": o.start, "end": o.end},
        "raw_length": o.end - o.start, "dictionary_keys": [k for k, _ in entries(d)], "references": [_ref(r) for r in sorted(set(references(value)))], "stream": inspect_stream(o, decode) if o.stream else None,
    }


class NoContent(ValueError):
    pass


def content_candidate(o: Object) -> None:
    """Raises NoContent for images and other XObjects."""
    name = lambda key: o.stream.dictionary[key][1] if o.stream.dictionary.get(key, ("",))[0] == "Name" else None
    if name("Subtype") == "Image":
        raise NoContent(f"Object {reference_text(o.ref)} is an image XObject stream, not a PDF page content stream.")
    if name("Type") == "XObject":
        raise NoContent(f"Object {reference_text(o.ref)} is an XObject stream ({name('Subtype') or 'unknown subtype'}) rather than a page content stream.")


def content_view(o: Object, decoded: filters.Decoded | None = None) -> dict:
    content_candidate(o)
    got = decoded or o.stream.decode()
    if got.issues:
        raise NoContent("; ".join(f"/{f}: {m}" for f, _, m in got.issues))
    tokens = content.tokenize(got.data)
    ops = content.operators(tokens)
    show = lambda t: {"kind": t.kind, "lexeme": t.lexeme, "byte_range": {"start": t.start, "end": t.end}}
    return {
        "reference": _ref(o.ref), "decoded_length": got.length, "filters": o.stream.filters, "tokens": [show(t) for t in tokens],
        "operators": [{"name": op.name, "operands": [show(t) for t in op.operands], "byte_range": {"start": op.start, "end": op.end}, "known": op.known, "explanation": content.explanation(op.name)} for op in ops],
        "warnings": [{"rule_id": r, "operator": n, "byte_range": None if at is None else {"start": at[0], "end": at[1]}, "message": m, "suggested_next_step": s} for r, n, at, m, s in stream_warnings(ops)],
    }


def stream_warnings(ops: list[content.Operator]) -> list[tuple]:
    """(rule, operator, range, message, next step) of one stream's operators, by a fold; the rules do the same with windows."""
    out: list[tuple] = []
    open_text, depth = False, 0

    def add(rule: str, op: content.Operator | None, named: bool = True) -> None:
        message, step = content.CHECKS[rule]
        values = {"name": op.name, "start": op.start, "end": op.end} if op else {}
        out.append((rule, op.name if op and named else None, (op.start, op.end) if op else None, message.format(**values, depth=depth), step))

    for op in ops:
        if not op.known:
            add("content.unknown_operator", op)
        if op.name == "BT":
            if open_text:
                add("content.nested_text_object", op)
            open_text = True
        elif op.name == "ET":
            if not open_text:
                add("content.unmatched_text_end", op)
            open_text = False
        elif op.name == "q":
            depth += 1
        elif op.name == "Q":
            if depth:
                depth -= 1
            else:
                add("content.unmatched_graphics_restore", op)
    last = ops[-1] if ops else None
    if open_text:
        add("content.unclosed_text_object", last, False)
    if depth:
        add("content.unbalanced_graphics_state", last, False)
    return out


def raw_preview(data: bytes) -> str:
    text = data[:RAW_PREVIEW].decode("utf-8", "replace")
    return text if len(text) <= RAW_CHARS and len(data) <= RAW_PREVIEW else text[:RAW_CHARS] + "\n..."


def stream_preview(o: Object, mode: str, limit: int = PREVIEW) -> dict:
    """text and truncated of a stream in mode raw, hex or decoded."""
    data, warnings = o.stream.raw, []
    if mode == "decoded":
        got = o.stream.decode()
        if got.issues:
            return {"text": None, "truncated": False, "warnings": [f"/{f}: {m}" for f, _, m in got.issues]}
        data = got.data
    if len(data) > limit:
        warnings.append(f"Preview was truncated at {limit} bytes.")
    part = data[:limit]
    return {"text": hex_dump(part) if mode == "hex" else part.decode("utf-8", "replace"), "truncated": len(data) > limit, "warnings": warnings}


def image_metadata(o: Object) -> dict | None:
    """Size, colour and whether the samples can be shown: 8-bit gray, RGB or CMYK whose decoded length fits."""
    d = o.stream.dictionary
    if d.get("Subtype") != ("Name", "Image"):
        return None
    number = lambda key: int(d[key][1]) if d.get(key, ("",))[0] == "Number" else None
    space = d["ColorSpace"][1] if d.get("ColorSpace", ("",))[0] == "Name" else None
    width, height, bits = number("Width"), number("Height"), number("BitsPerComponent")
    parts = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}.get(space)
    jpeg = bool(o.stream.filters) and filters.ALIASES.get(o.stream.filters[-1], o.stream.filters[-1]) == "DCTDecode"
    return {"width": width, "height": height, "bits": bits, "color_space": space, "jpeg": jpeg, "renderable": jpeg or bool(width and height and parts and bits == 8)}


def pixels(o: Object) -> tuple[int, int, bytes] | None:
    """Width, height and RGB samples of a renderable image that is no JPEG."""
    meta = image_metadata(o)
    if not meta or not meta["renderable"] or meta["jpeg"]:
        return None
    got = o.stream.decode()
    w, h = meta["width"], meta["height"]
    n = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}[meta["color_space"]]
    if got.issues or len(got.data) < w * h * n:
        return None
    raw = got.data[: w * h * n]
    if n == 1:
        return w, h, bytes(b for b in raw for _ in range(3))
    if n == 3:
        return w, h, raw
    return w, h, bytes(255 - min(raw[i + c] + raw[i + 3], 255) for i in range(0, len(raw), 4) for c in range(3))


def png(width: int, height: int, rgb: bytes) -> bytes:
    """A PNG file of RGB samples."""
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


