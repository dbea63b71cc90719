"""PDF values from bytes.

A value is a pair (type, payload): Null, Boolean, Number (float), Name, String and
HexString (text), Array (list of values), Dictionary (dict, last of equal keys
wins), Reference ((object, generation)) and Raw (text that is nothing else).
Parsing runs a compiled lexer over the bytes and keeps open containers on a stack,
so depth is bounded by memory only.
"""

from __future__ import annotations

import math
import re

from pagelode.functions.strings import decode_hex_text, decode_text

Value = tuple[str, object]

WHITE = rb" \t\n\x0c\r"
DELIMITERS = rb" \t\n\x0c\r()<>\[\]{}/%"
_GAP = re.compile(rb"(?:[" + WHITE + rb"]+|%[^\r\n]*)*")
_WHITE = re.compile(rb"[" + WHITE + rb"]*")
_REGULAR = re.compile(rb"[^" + DELIMITERS + rb"]+")
_NAME = re.compile(rb"/([^" + DELIMITERS + rb"]*)")
_HEX = re.compile(rb"<([^>]*)>?")
_NUMBER = re.compile(rb"[+-]?[0-9]*(?:\.[0-9]*)?")
_INTEGER = re.compile(rb"[+-]?[0-9]+(?!\.)(?![0-9])")
_LITERAL = re.compile(rb"[()\\]")
_NAME_ESCAPE = re.compile(rb"#([+0-9A-Fa-f][0-9A-Fa-f])")
_SIMPLE = ((b"true", ("Boolean", True)), (b"false", ("Boolean", False)), (b"null", ("Null", None)))
# What a backslash stands for before these bytes.
_ESCAPES = {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\x08", 0x66: b"\x0c"}


def gap(data: bytes, pos: int) -> int:
    """The first position from pos on that is neither white space nor comment."""
    return _GAP.match(data, pos).end() if pos <= len(data) else pos


def white(data: bytes, pos: int) -> int:
    return _WHITE.match(data, pos).end() if pos <= len(data) else pos


def unescape_name(raw: bytes) -> str:
    def byte(m: re.Match) -> bytes:
        return m[0] if m.end() > len(m.string) else bytes([int(m[1], 16)])

    return (_NAME_ESCAPE.sub(byte, raw) if b"#" in raw else raw).decode("utf-8", "replace")


def literal_bytes(data: bytes, pos: int) -> tuple[bytes | None, int]:
    """The bytes of the literal string that opens at pos, and where it ends; None if it ends in a backslash."""
    pos += 1
    depth, out = 1, []
    while True:
        m = _LITERAL.search(data, pos)
        if not m:
            out.append(data[pos:])
            return b"".join(out), len(data)
        out.append(data[pos : m.start()])
        pos = m.end()
        if m[0] == b"\\":
            if pos >= len(data):
                return None, pos
            c = data[pos]
            pos += 1
            if c == 0x0D:
                pos += data[pos : pos + 1] == b"\n"
            elif c != 0x0A:
                out.append(_ESCAPES.get(c, bytes([c])))
        else:
            depth += 1 if m[0] == b"(" else -1
            if depth == 0:
                return b"".join(out), pos
            out.append(m[0])


def unsigned(raw: bytes, bits: int) -> int | None:
    """raw as an integer of so many bits; a plus sign may lead."""
    digits = raw[1:] if raw[:1] == b"+" else raw
    if not digits.isdigit():
        return None
    value = int(digits)
    return value if value < 1 << bits else None


def _number(data: bytes, pos: int) -> tuple[Value | None, int]:
    """A reference, a number or, failing both, a raw token at pos."""
    first = _INTEGER.match(data, pos)
    if first:
        second = _INTEGER.match(data, gap(data, first.end()))
        if second:
            r = gap(data, second.end())
            if data[r : r + 1] == b"R":
                obj, gen = unsigned(first[0], 32), unsigned(second[0], 16)
                if obj is not None and gen is not None:
                    return ("Reference", (obj, gen)), r + 1
    token = _NUMBER.match(data, pos)
    if token[0] in (b"", b"+", b"-"):
        return None, pos
    if token[0].lstrip(b"+-") == b".":
        raw = _REGULAR.match(data, pos)
        return ("Raw", raw[0].decode("utf-8", "replace")), raw.end()
    return ("Number", float(token[0])), token.end()


def _atom(data: bytes, pos: int) -> tuple[Value | None, int]:
    """A value that is no container."""
    c = data[pos : pos + 1]
    if c == b"/":
        m = _NAME.match(data, pos)
        return ("Name", unescape_name(m[1])), m.end()
    if c == b"(":
        raw, end = literal_bytes(data, pos)
        return (None if raw is None else ("String", decode_text(raw)[0])), end
    if c == b"<":
        m = _HEX.match(data, pos)
        return ("HexString", "".join(m[1].decode("utf-8", "replace").split())), m.end()
    if c in b"+-.0123456789":
        return _number(data, pos)
    for word, value in _SIMPLE:
        if data.startswith(word, pos):
            return value, pos + len(word)
    m = _REGULAR.match(data, pos)
    return (("Raw", m[0].decode("utf-8", "replace")), m.end()) if m else (None, pos)


def parse_value(data: bytes, pos: int = 0) -> tuple[Value, int] | None:
    """The value at pos and where it ends, or None if there is none."""
    stack: list[tuple[str, list | dict, str | None]] = []
    while True:
        pos = gap(data, pos)
        if pos >= len(data):
            return None
        if stack:
            kind, held, key = stack[-1]
            if kind == "Dictionary" and key is None:
                if data.startswith(b">>", pos):
                    stack.pop()
                    value, pos = (kind, held), pos + 2
                else:
                    m = _NAME.match(data, pos)
                    if not m:
                        return None
                    stack[-1] = (kind, held, unescape_name(m[1]))
                    pos = m.end()
                    continue
            elif kind == "Array" and data[pos : pos + 1] == b"]":
                stack.pop()
                value, pos = (kind, held), pos + 1
            else:
                value = None
        else:
            value = None
        if value is None:
            if data.startswith(b"<<", pos):
                stack.append(("Dictionary", {}, None))
                pos += 2
                continue
            if data[pos : pos + 1] == b"[":
                stack.append(("Array", [], None))
                pos += 1
                continue
            value, pos = _atom(data, pos)
            if value is None:
                return None
        if not stack:
            return value, pos
        kind, held, key = stack[-1]
        if kind == "Array":
            held.append(value)
        else:
            held[key] = value
            stack[-1] = (kind, held, None)


def as_count(value: Value | None) -> int | None:
    """A non-negative whole number."""
    if value and value[0] == "Number" and value[1] >= 0 and math.isfinite(value[1]) and value[1] == math.floor(value[1]):
        return int(value[1])
    return None


def is_name(d: dict | None, key: str, name: str) -> bool:
    return bool(d) and d.get(key) == ("Name", name)


def entries(d: dict) -> list[tuple[str, Value]]:
    """Dictionary entries in byte order of their keys."""
    return sorted(d.items(), key=lambda kv: kv[0].encode("utf-8", "surrogatepass"))


def shorten(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 1] + "…"


def number_text(x: float) -> str:
    """Whole numbers as integers within 64 bits, others as the shortest decimal without exponent."""
    if x == math.floor(x) if math.isfinite(x) else False:
        return str(max(-(1 << 63), min((1 << 63) - 1, int(x))))
    plain = repr(x)
    if "e" in plain:
        mantissa, power = plain.split("e")
        sign, digits = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
        whole, _, rest = digits.partition(".")
        plain = sign + "0." + "0" * (-int(power) - 1) + whole + ("" if rest == "0" else rest)
    return plain


def reference_text(ref: tuple[int, int]) -> str:
    return f"{ref[0]} {ref[1]} R"


def summary(value: Value) -> str:
    kind, x = value
    if kind == "Null":
        return "null"
    if kind == "Boolean":
        return "true" if x else "false"
    if kind == "Number":
        return number_text(x)
    if kind == "Name":
        return f"/{x}"
    if kind == "String":
        return f"({shorten(x, 48)})"
    if kind == "HexString":
        text = decode_hex_text(x)[0]
        return f"<{shorten(x, 48)}>" if not text or "�" in text else f"({shorten(text, 48)})"
    if kind == "Array":
        return f"[{len(x)} item(s)]"
    if kind == "Dictionary":
        keys = [k for k, _ in entries(x)]
        return f"<<{', '.join(keys[:6])}{', ...' if len(keys) > 6 else ''}>>"
    return reference_text(x) if kind == "Reference" else shorten(x, 64)


def walk(value: Value):
    """Every value in value, itself first: (node, parent, depth, key, index, path, value).

    Nodes are numbered in pre-order; the path is the positions of its ancestors
    and itself among their siblings, dictionaries in the order of their keys.
    """
    stack = [(None, 0, None, None, (), value)]
    n = 0
    while stack:
        parent, depth, key, index, path, v = stack.pop()
        node, n = n, n + 1
        yield node, parent, depth, key, index, path, v
        if v[0] == "Array":
            kids = [(None, i, x) for i, x in enumerate(v[1])]
        elif v[0] == "Dictionary":
            kids = [(k, i, x) for i, (k, x) in enumerate(entries(v[1]))]
        else:
            continue
        stack.extend((node, depth + 1, k, i, (*path, i), x) for k, i, x in reversed(kids))


def references(value: Value):
    return (v[1] for *_, v in walk(value) if v[0] == "Reference")
