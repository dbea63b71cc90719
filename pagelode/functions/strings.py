"""Text of PDF strings."""

from __future__ import annotations

import re
import unicodedata

# Where PDFDocEncoding differs from Latin-1, from 0x18 and from 0x80 on, and at 0xA0.
_FROM_18 = "˘ˇˆ˙˝˛˚˜"
_FROM_80 = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�"
_AT_A0 = "€"
_TABLE = {0x18 + i: c for i, c in enumerate(_FROM_18)} | {0x80 + i: c for i, c in enumerate(_FROM_80)} | {0xA0: _AT_A0}
_HEX_PAIR = re.compile(rb"[0-9A-Fa-f]{2}")

ODD_UNITS = "UTF-16 PDF string has an odd byte length; the last byte was ignored."
BAD_PAIR = "UTF-16 PDF string contained an invalid surrogate pair."
ODD_HEX = "Odd-length PDF hex string was padded with a trailing 0 nibble."


def decode_text(raw: bytes) -> tuple[str, str, list[str]]:
    """Text, encoding and warnings of a string's bytes."""
    for mark, order, name in ((b"\xfe\xff", "big", "Utf16Be"), (b"\xff\xfe", "little", "Utf16Le")):
        if raw.startswith(mark):
            return _utf16(raw[2:], order, name)
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        pass
    else:
        if not any(unicodedata.category(c) == "Cc" and c not in "\n\r\t" for c in text):
            return text, "Utf8", []
    return raw.decode("latin-1").translate(_TABLE), "PdfDocEncoding", []


def _utf16(raw: bytes, order: str, name: str) -> tuple[str, str, list[str]]:
    warnings = [ODD_UNITS] if len(raw) % 2 else []
    units = [int.from_bytes(raw[i : i + 2], order) for i in range(0, len(raw) - 1, 2)]
    out, i = [], 0
    while i < len(units):
        u = units[i]
        i += 1
        if 0xD800 <= u < 0xE000:
            low = units[i] if u < 0xDC00 and i < len(units) and 0xDC00 <= units[i] < 0xE000 else None
            if low is None:
                warnings.append(BAD_PAIR)
                out.append("�")
            else:
                i += 1
                out.append(chr(0x10000 + ((u - 0xD800) << 10) + (low - 0xDC00)))
        else:
            out.append(chr(u))
    return "".join(out), name, warnings


def hex_bytes(digits: str) -> tuple[bytes, list[str]]:
    """Bytes of hexadecimal digits; bad pairs are skipped, a single last digit gets a 0."""
    raw = re.sub(rb"[ \t\n\x0c\r]", b"", digits.encode("utf-8", "replace"))
    warnings = []
    if len(raw) % 2:
        raw += b"0"
        warnings.append(ODD_HEX)
    out = bytearray()
    for i in range(0, len(raw), 2):
        pair = raw[i : i + 2]
        if _HEX_PAIR.fullmatch(pair):
            out.append(int(pair, 16))
        else:
            warnings.append(f"Invalid hex pair at byte offset {i} was skipped.")
    return bytes(out), warnings


def decode_hex_text(digits: str) -> tuple[str, str, list[str]]:
    raw, warnings = hex_bytes(digits)
    text, encoding, more = decode_text(raw)
    return text, encoding, warnings + more
