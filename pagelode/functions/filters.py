"""Stream filters, one after the other, with a trace."""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np

# Short names of filters.
ALIASES = {"Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "DCT": "DCTDecode"}
KNOWN = {*ALIASES, *ALIASES.values()}
# What the trace says of a filter that went well.
DONE = {
    "FlateDecode": "decoded with zlib/deflate",
    "ASCIIHexDecode": "decoded ASCII hexadecimal data",
    "ASCII85Decode": "decoded ASCII85 data",
    "RunLengthDecode": "decoded PDF run-length data",
}
BOMB_LIMIT = 256 << 20  # executors are protected even where no limit is asked for
_WHITE = re.compile(rb"[ \t\n\x0c\r]+")
_NOT_BASE85 = re.compile(rb"[^!-uz]")
_POWERS85 = np.array([85**4, 85**3, 85**2, 85, 1], dtype=np.uint64)


class Decoded(NamedTuple):
    data: bytes
    length: int
    steps: list[tuple[str, str, str]]  # filter, status, message
    issues: list[tuple[str, str, str]]  # filter, kind, message


class FilterError(ValueError):
    pass


def _within(size: int, limit: int | None) -> None:
    most = BOMB_LIMIT if limit is None else limit
    if size > most:
        raise FilterError(f"decoded stream exceeds output limit of {most} bytes")


def flate(data: bytes, limit: int | None) -> bytes:
    most = BOMB_LIMIT if limit is None else limit
    inflater = zlib.decompressobj()
    try:
        out = inflater.decompress(data, most + 1)
    except zlib.error as e:
        raise FilterError(str(e)) from None
    _within(len(out), most)
    if not inflater.eof and not inflater.unconsumed_tail:
        raise FilterError("corrupt deflate stream")
    return out


def ascii_hex(data: bytes, limit: int | None) -> bytes:
    digits = _WHITE.sub(b"", data.split(b">", 1)[0])
    bad = re.search(rb"[^0-9A-Fa-f]", digits)
    if bad:
        raise FilterError(f"invalid ASCIIHex byte 0x{bad[0][0]:02X}")
    _within(-(-len(digits) // 2), limit)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes, limit: int | None) -> bytes:
    """Groups of five digits at once; a z stands for a group of zeros and ends the digits before it."""
    body = _WHITE.sub(b"", data).removeprefix(b"<~").partition(b"~")[0]
    runs = body.split(b"z")
    odd = next((i for i, r in enumerate(runs[:-1]) if len(r) % 5), None)
    bad = _NOT_BASE85.search(body)
    if bad and (odd is None or bad.start() < sum(map(len, runs[: odd + 1])) + odd):
        raise FilterError(f"invalid ASCII85 byte 0x{bad[0][0]:02X}")
    if odd is not None:
        raise FilterError("'z' short form appeared inside an ASCII85 group")
    rest = len(runs[-1]) % 5
    _within((sum(map(len, runs)) // 5 + len(runs) - 1) * 4 + max(rest - 1, 0), limit)
    if rest == 1:
        raise FilterError("ASCII85 final group has only one digit")
    out = []
    for run in runs:
        digits = np.frombuffer(run + b"u" * (-len(run) % 5), np.uint8).reshape(-1, 5).astype(np.uint64) - np.uint64(33)
        out.append((digits @ _POWERS85).astype(">u4").tobytes())  # a group beyond 32 bits wraps
    whole = bytes(4).join(out)
    return whole[: len(whole) - 5 + rest] if rest else whole


def run_length(data: bytes, limit: int | None) -> bytes:
    most = BOMB_LIMIT if limit is None else limit
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            if i + n + 2 > len(data):
                raise FilterError("RunLengthDecode literal run exceeds stream length")
            out += data[i + 1 : i + n + 2]
            i += n + 2
        else:
            if i + 1 >= len(data):
                raise FilterError("RunLengthDecode repeat run is missing its byte")
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        _within(len(out), most)
    return bytes(out)


_DECODERS = {"FlateDecode": flate, "ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii85, "RunLengthDecode": run_length}


def decode(raw: bytes, filters: list[str], limit: int | None = None) -> Decoded:
    """raw through filters; the first that fails or isn't supported ends the chain."""
    steps: list[tuple[str, str, str]] = []
    issues: list[tuple[str, str, str]] = []

    def fail(name: str, message: str, kind: str = "failed") -> None:
        issues.append((name, kind, message))
        steps.append((name, kind, message))

    if limit is not None and len(raw) > limit:
        fail("raw", f"raw stream bytes exceed decoded output limit of {limit} bytes")
        return Decoded(raw, 0, steps, issues)
    data = raw
    for name in filters:
        full = ALIASES.get(name, name)
        if full == "DCTDecode":
            if limit is not None and len(data) > limit:
                fail(name, f"DCT/JPEG stream exceeds decoded output limit of {limit} bytes")
                break
            steps.append((name, "passthrough", "DCT/JPEG image data preserved for preview or export"))
        elif full in _DECODERS:
            try:
                data = _DECODERS[full](data, limit)
            except FilterError as e:
                fail(name, str(e))
                break
            steps.append((name, "decoded", DONE[full]))
        else:
            fail(name, f"unsupported stream filter /{name}", "unsupported")
            break
    return Decoded(data, len(data), steps, issues)


def encode(data: bytes, filters: list[str]) -> bytes:
    """data as a stream without filter or with a single Flate filter."""
    if not filters:
        return data
    if len(filters) == 1 and ALIASES.get(filters[0], filters[0]) == "FlateDecode":
        return zlib.compress(data)
    chain = " -> ".join(f"/{f}" for f in filters)
    raise FilterError(f"content stream editing can only re-encode unfiltered or single /FlateDecode streams; current filters: {chain}")


def names(value) -> list[str]:
    """Filter names of a /Filter entry."""
    if value and value[0] == "Name":
        return [value[1]]
    if value and value[0] == "Array":
        return [v[1] for v in value[1] if v[0] == "Name"]
    return []
