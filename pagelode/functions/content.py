"""Content streams: tokens, operators and the checks on them."""

from __future__ import annotations

import re
from typing import NamedTuple

from pagelode.functions.values import DELIMITERS, unescape_name

# The operators of content streams.
OPERATORS = (
    "BT ET Tc Tw Tz TL Tf Tr Ts Td TD Tm T* Tj TJ ' \" q Q cm w J j M d ri i gs m l c v y h re S s f F f* B B* b b* n W W* "
    "CS cs SC SCN sc scn G g RG rg K k sh Do BI ID EI MP DP BMC BDC EMC BX EX d0 d1"
).split()
# What operators do.
EXPLANATIONS = {
    "Begin a text object": "BT",
    "End a text object": "ET",
    "Set text font and size": "Tf",
    "Move or set text position": "Td TD Tm T*",
    "Show text": "Tj TJ ' \"",
    "Save graphics state": "q",
    "Restore graphics state": "Q",
    "Concatenate the current transformation matrix": "cm",
    "Paint an external object": "Do",
    "Construct a path": "m l c v y h re",
    "Paint or end the current path": "S s f F f* B B* b b* n",
    "Set color or color space": "CS cs SC SCN sc scn G g RG rg K k",
}
_EXPLAINED = {op: text for text, ops in EXPLANATIONS.items() for op in ops.split()}
_KNOWN = frozenset(OPERATORS)

_TOKEN = re.compile(
    rb"(?P<comment>%[^\r\n]*)|(?P<name>/[^" + DELIMITERS + rb"]*)|(?P<string>\()|(?P<dictionary_start><<)|(?P<dictionary_end>>>)"
    rb"|(?P<hex_string><[^>]*>?)|(?P<array_start>\[)|(?P<array_end>\])|(?P<atom>[^" + DELIMITERS + rb"]+)|(?P<other>[(){}>])|[ \t\n\x0c\r]+"
)
_PAREN = re.compile(rb"\\.?|[()]", re.DOTALL)
_FLOAT = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)", re.IGNORECASE)
_KEYWORD = re.compile(rb"[!-~]+")
_OPENERS = {"array_start": 1, "array_end": -1, "dictionary_start": 1, "dictionary_end": -1}


class Token(NamedTuple):
    kind: str
    lexeme: str
    start: int
    end: int
    raw: bytes


class Operator(NamedTuple):
    name: str
    operands: list[Token]
    start: int
    end: int

    @property
    def known(self) -> bool:
        return self.name in _KNOWN


def explanation(name: str) -> str:
    return _EXPLAINED.get(name) or ("Known PDF content stream operator" if name in _KNOWN else "Unknown PDF content stream operator")


def _string_end(data: bytes, pos: int) -> int:
    depth = 0
    for m in _PAREN.finditer(data, pos):
        if m[0] == b"(":
            depth += 1
        elif m[0] == b")":
            depth -= 1
            if not depth:
                return m.end()
    return len(data)


def tokenize(data: bytes) -> list[Token]:
    """All tokens. A delimiter that opens or closes nothing is a token of its own, kind other."""
    out: list[Token] = []
    pos = 0
    while pos < len(data):
        m = _TOKEN.match(data, pos)
        start, kind = pos, m.lastgroup
        pos = m.end()
        if kind is None:
            continue
        if kind == "string":
            pos = _string_end(data, start)
        raw = data[start:pos]
        if kind == "name":
            lexeme = unescape_name(raw[1:])
        else:
            lexeme = raw.decode("utf-8", "replace")
        if kind == "atom":
            kind = "number" if _FLOAT.fullmatch(lexeme) else "keyword" if _KEYWORD.fullmatch(raw) else "other"
        out.append(Token(kind, lexeme, start, pos, raw))
    return out


def operators(tokens: list[Token]) -> list[Operator]:
    """Keywords outside arrays and dictionaries with the tokens before them; between ID and EI only those that nest count."""
    out: list[Operator] = []
    operands: list[Token] = []
    depth = {"array": 0, "dictionary": 0}
    image = False
    for t in tokens:
        if t.kind == "comment":
            continue
        if t.kind in _OPENERS:
            what = t.kind.split("_")[0]
            depth[what] = max(0, depth[what] + _OPENERS[t.kind])
            operands.append(t)
        elif image:
            if t.kind == "keyword" and t.lexeme == "EI":
                out.append(Operator("EI", [], t.start, t.end))
                image = False
        elif t.kind == "keyword" and not any(depth.values()) and t.lexeme not in ("true", "false", "null"):
            out.append(Operator(t.lexeme, operands, t.start, t.end))
            operands = []
            image = t.lexeme == "ID"
        else:
            operands.append(t)
    return out


# Messages and next steps of the checks.
CHECKS = {
    "content.unknown_operator": ("Unknown or unsupported content stream operator `{name}` at content byte range {start}..{end}", "Check whether the content stream contains a typo, unsupported extension, or corrupted operator bytes"),
    "content.nested_text_object": ("Nested BT operator found before the previous text object ended", "Verify that every BT text object is closed with ET before starting another"),
    "content.unmatched_text_end": ("ET operator found without a matching BT", "Check content generation around text object boundaries"),
    "content.unmatched_graphics_restore": ("Q operator restores a graphics state that was not saved with q", "Check q/Q balancing in the page content stream"),
    "content.unclosed_text_object": ("Content stream ended while a BT text object was still open", "Add a matching ET or inspect whether the content stream was truncated"),
    "content.unbalanced_graphics_state": ("Content stream ended with {depth} unmatched q graphics state save operator(s)", "Add matching Q operators or inspect whether the content stream was truncated"),
}


def fonts_used(ops: list[Operator]) -> set[str]:
    return {next(t.lexeme for t in op.operands if t.kind == "name") for op in ops if op.name == "Tf" and any(t.kind == "name" for t in op.operands)}


def xobjects_used(ops: list[Operator]) -> set[str]:
    return {next(t.lexeme for t in reversed(op.operands) if t.kind == "name") for op in ops if op.name == "Do" and any(t.kind == "name" for t in op.operands)}


def problems(ops: list[Operator]):
    """(index, name, start, end, depth, rule, rank) of what is wrong with a stream's operators, in order; depth is what is open at the end."""
    open_text, depth = False, 0
    for i, op in enumerate(ops):
        at = i, op.name, op.start, op.end, None
        if not op.known:
            yield *at, "content.unknown_operator", 0
        if op.name == "BT":
            if open_text:
                yield *at, "content.nested_text_object", 1
            open_text = True
        elif op.name == "ET":
            if not open_text:
                yield *at, "content.unmatched_text_end", 1
            open_text = False
        elif op.name == "q":
            depth += 1
        elif op.name == "Q":
            if not depth:
                yield *at, "content.unmatched_graphics_restore", 1
            depth = max(0, depth - 1)
    if ops:
        at = len(ops) - 1, ops[-1].name, ops[-1].start, ops[-1].end, depth
        if open_text:
            yield *at, "content.unclosed_text_object", 2
        if depth:
            yield *at, "content.unbalanced_graphics_state", 3
