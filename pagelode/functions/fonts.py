"""Fonts of resources: encodings, widths, ToUnicode maps, and text from glyph bytes."""

from __future__ import annotations

import re
from typing import NamedTuple

from pagelode.functions import content
from pagelode.functions.document import Document, Ref
from pagelode.functions.strings import hex_bytes

# Glyph names and what they stand for; letters stand for themselves.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]",
    "asciicircum": "^", "underscore": "_", "quoteleft": "`", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
}
LATIN = {c: "�" if 0x80 <= c < 0xA0 else chr(c) for c in range(256)}
_UNI = re.compile(r"uni((?:[0-9A-Fa-f]{4})+)")
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n?|\n)|(.)|\Z)", re.DOTALL)
# What a letter after a backslash stands for.
_LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\x08", b"f": b"\x0c"}
_HEX = re.compile(r"(?<!<)<(?!<)([^>]*)>?")
_SECTION = re.compile(r"begin(bfchar|bfrange)\s*$")


class Font(NamedTuple):
    ref: Ref | None
    subtype: str | None
    base: str | None
    encoding: dict[int, str]
    encoding_source: str
    widths: dict[int, float]
    missing_width: float | None
    width_source: str
    to_unicode: dict[bytes, str]


def glyph_text(name: str) -> str:
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    if name in GLYPHS:
        return GLYPHS[name]
    m = _UNI.fullmatch(name)
    if m:
        units = [int(m[1][i : i + 4], 16) for i in range(0, len(m[1]), 4)]
        if not any(0xD800 <= u < 0xE000 for u in units):
            return "".join(map(chr, units))
    return f"/{name}"


def _encoding(doc: Document, d: dict) -> tuple[dict[int, str], str]:
    value = d.get("Encoding")
    if value and value[0] == "Name":
        return dict(LATIN), f"/{value[1]}"
    own = doc.dictionary(value)
    if own is None:
        return dict(LATIN), "StandardEncoding fallback"
    base = own.get("BaseEncoding")
    named = f"/{base[1]} with Differences" if base and base[0] == "Name" else None
    if value[0] == "Reference":
        at = f"{value[1][0]} {value[1][1]} R"
        source = f"{at} {named}" if named else f"{at} Differences"
    else:
        source = named or "Encoding dictionary Differences"
    out, code = dict(LATIN), None
    differences = own.get("Differences")
    for kind, x in differences[1] if differences and differences[0] == "Array" else ():
        if kind == "Number" and 0 <= x <= 0xFFFF:
            code = int(x)
        elif kind == "Name" and code is not None:
            out[code] = glyph_text(x)
            code = code + 1 if code < 0xFFFF else None
    return out, source


def _number(value) -> float | None:
    return value[1] if value and value[0] == "Number" else None


def font(doc: Document, d: dict, ref: Ref | None) -> Font:
    name = lambda key: d[key][1] if d.get(key, ("",))[0] == "Name" else None
    encoding, source = _encoding(doc, d)
    first = min(int(max(_number(d.get("FirstChar")) or 0.0, 0.0)), 0xFFFF)
    value = d.get("Widths")
    if value and value[0] == "Reference":
        value = doc.objects[value[1]].value if value[1] in doc.objects else None
    listed = value[1] if value and value[0] == "Array" else []
    widths = {min(first + i, 0xFFFF): w[1] for i, w in enumerate(listed) if w[0] == "Number"}
    descriptor = doc.dictionary(d.get("FontDescriptor"))
    to_unicode: dict[bytes, str] = {}
    target = d.get("ToUnicode")
    if target and target[0] == "Reference" and target[1] in doc.objects and doc.objects[target[1]].stream:
        decoded = doc.objects[target[1]].stream.decode()
        if not decoded.issues:
            to_unicode = unicode_map(decoded.data)
    return Font(ref, name("Subtype"), name("BaseFont"), encoding, source, widths, _number((descriptor or {}).get("MissingWidth")), f"/Widths from FirstChar {first}" if widths else "fallback", to_unicode)


def _utf16(raw: bytes) -> str:
    if len(raw) >= 2 and len(raw) % 2 == 0:
        try:
            return raw.decode("utf-16-be")
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


def unicode_map(data: bytes) -> dict[bytes, str]:
    """A ToUnicode map from its bfchar and bfrange lines."""
    out: dict[bytes, str] = {}
    section = None
    for line in data.decode("utf-8", "replace").splitlines():
        line = line.strip()
        if section is None:
            m = _SECTION.search(line)
            section = m[1] if m else None
            continue
        if line.endswith(f"end{section}"):
            section = None
            continue
        codes = [hex_bytes(h)[0] for h in _HEX.findall(line)]
        if section == "bfchar":
            if len(codes) >= 2:
                out[codes[0]] = _utf16(codes[1])
        elif len(codes) >= 3 and codes[0] and codes[1]:
            width, low, high = len(codes[0]), int.from_bytes(codes[0], "big"), int.from_bytes(codes[1], "big")
            key = lambda c, w=width: (c & ((1 << 8 * w) - 1)).to_bytes(w, "big")
            if "[" in line:
                for i, target in enumerate(codes[2:]):
                    out[key(low + i)] = _utf16(target)
                    if low + i >= high:
                        break
            elif codes[2]:
                size = len(codes[2])
                base = int.from_bytes(codes[2], "big")
                for c in range(low, min(high, low + 0xFFFF) + 1):
                    out[key(c)] = _utf16((base + c - low & ((1 << 8 * size) - 1)).to_bytes(size, "big"))
    return out


def string_bytes(token: content.Token) -> bytes:
    """The bytes of a string token of a content stream; octal escapes count."""
    raw = token.raw
    if token.kind == "hex_string":
        inner = raw[1:-1] if raw.startswith(b"<") and raw.endswith(b">") and len(raw) > 1 else raw
        return hex_bytes(inner.decode("latin-1"))[0]
    inner = raw[1:-1] if raw.startswith(b"(") and raw.endswith(b")") and len(raw) > 1 else raw

    def one(m: re.Match) -> bytes:
        if m[1]:
            return bytes([min(int(m[1], 8), 255)])
        return _LETTERS.get(m[3], m[3]) if m[3] else b""

    return _ESCAPE.sub(one, inner)


def glyph_bytes(op: content.Operator) -> bytes:
    return b"".join(string_bytes(t) for t in op.operands if t.kind in ("string", "hex_string"))


def text_of(raw: bytes, used: Font | None) -> tuple[str, list[str]]:
    """Text of glyph bytes and warnings: by the longest ToUnicode match, else the encoding, else as UTF-8."""
    if used is None:
        return raw.decode("utf-8", "replace"), []
    if not used.to_unicode:
        return "".join(used.encoding.get(b, chr(b)) for b in raw), []
    longest = max(len(k) for k in used.to_unicode)
    out, i, missed = [], 0, 0
    while i < len(raw):
        n = next((n for n in range(min(longest, len(raw) - i), 0, -1) if raw[i : i + n] in used.to_unicode), 0)
        out.append(used.to_unicode[raw[i : i + n]] if n else chr(raw[i]))
        missed += not n
        i += n or 1
    return "".join(out), [f"{missed} glyph byte(s) were not covered by the font /ToUnicode CMap."] if missed else []


def advance(op: content.Operator, raw: bytes, text: str, used: Font | None, size: float, character: float, word: float, scaling: float) -> float:
    """Estimated width of shown text in text space."""
    count = max(len(raw), len(text), 1)
    known = [w for b in raw for w in [used.widths.get(b, used.missing_width)] if w is not None] if used else []
    width = sum(known) / 1000 * size if known else count * size * 0.5
    width += (count - 1) * character + raw.count(b" ") * word
    if op.name == "TJ":
        width -= sum(float(t.lexeme) for t in op.operands if t.kind == "number") / 1000 * size
    return max(width * scaling / 100, size * 0.25)
