"""Vectorised hashes of words and of runs of words.

A word is a run of bytes other than space and \\t to \\r, as it stands in the
text's UTF-8. Its hash mixes its bytes one lane after the other; a shingle's
hash is a polynomial over the few hashes of its words. Polynomials modulo 2**64
are for short strings only: they can't tell some strings of 1,024 and more
symbols apart.
"""

from __future__ import annotations

import hashlib

import numpy as np

PIECE = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Polynomial:
    """Hashes of any substring of a sequence of 64-bit codes."""

    def __init__(self, base: np.uint64 = _BASE):
        self.base, self.up, self.down = base, powers(base, 0), powers(base, 0)

    def table(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) + 1 > len(self.up):
            size = max(len(codes) + 1, PIECE + 4096)
            self.up, self.down = powers(self.base, size), powers(inverse(self.base), size)
        sums = np.empty(len(codes) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(codes * self.up[: len(codes)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


LANES = 32


class Words:
    """Words of many texts at once: their hashes, and the texts with one space after each word."""

    @staticmethod
    def split(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """data with one space after each word and nothing else, where its words start and end, and where they started before."""
        raw = np.frombuffer(data, dtype=np.uint8)
        word = np.zeros(len(raw) + 2, bool)
        word[1:-1] = ~_SPACE[raw]
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[::2], edge[1::2]
        out = np.full(int((end - start).sum()) + len(start), 32, dtype=np.uint8)
        sizes = end - start
        to = np.cumsum(sizes + 1) - sizes - 1
        keep = np.ones(len(out), bool)
        keep[to + sizes] = False
        out[keep] = raw[word[1:-1]]
        return out.tobytes(), to, to + sizes, start

    @staticmethod
    def hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits for each word: its length and its bytes, eight at a time, each mixed into what came before.

        Of words longer than LANES times eight bytes the MD5 is taken.
        """
        sizes = end - start
        lanes = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
        out = mixed(sizes.astype(np.uint64) * _BASE)
        live = np.arange(len(start))
        for k in range(LANES):
            live = live[sizes[live] > 8 * k] if k else live
            if not len(live):
                break
            lane = lanes[start[live] + 8 * k]
            short = np.flatnonzero(sizes[live] < 8 * k + 8)
            lane[short] &= (np.uint64(1) << ((sizes[live[short]] - 8 * k) * 8).astype(np.uint64)) - np.uint64(1)
            out[live] = mixed((out[live] ^ lane) * _STEP + _BASE)
        for i in np.flatnonzero(sizes > 8 * LANES):
            out[i] = np.frombuffer(hashlib.md5(data[start[i] : end[i]]).digest()[:8], "<u8")[0]
        return out

    def groups(self, texts: list[bytes]):
        """For some texts at a time: which, how many words each, their words laid end to end (data, start, end) and the hashes of these."""
        held: list[int] = []
        size = 0

        def flush():
            data, start, end, begins = self.split(b"\n".join([texts[i] for i in held]))
            counts = np.diff(np.searchsorted(begins, np.cumsum([len(texts[i]) + 1 for i in held])), prepend=0)
            return held, counts, data, start, end, self.hashes(data, start, end)

        for i, text in enumerate(texts):
            if held and size + len(text) > PIECE:
                yield flush()
                held, size = [], 0
            if len(text) > PIECE:
                parts = [self.split(part) for part in pieces(text)]
                before = np.cumsum([0, *[len(p[0]) for p in parts]])
                data = b"".join([p[0] for p in parts])
                start, end = (np.concatenate([p[k] + at for p, at in zip(parts, before, strict=False)]) for k in (1, 2))
                hashes = np.concatenate([self.hashes(*p[:3]) for p in parts])
                yield [i], np.array([len(start)]), data, start, end, hashes
                continue
            held.append(i)
            size += len(text) + 1
        if held:
            yield flush()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of all texts, end to end, and the number of words of each text."""
        counts = np.zeros(len(texts), dtype=np.int64)
        hashes = [np.zeros(0, np.uint64)]
        for which, number, *_, got in self.groups(texts):
            counts[which] = number
            hashes.append(got)
        return np.concatenate(hashes), counts


def pieces(text: bytes):
    """text cut before spaces, so that no word is in two pieces."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = [x for x in (text.find(c, end, end + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
            while not found and end < len(text):
                end += PIECE
                found = [x for x in (text.find(c, end, end + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
            end = min(found, default=len(text))
        yield text[at:end]
        at = max(end, at + 1)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of texts laid end to end, and the number of each text's.

    A text of fewer words than width, but any, has one shingle of all its words.
    """
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = len(words)
    out = np.zeros(total, dtype=np.uint64)
    for j in range(min(width, total)):
        out[: total - j] = out[: total - j] * _STEP + words[j:]
    ends = np.cumsum(counts)
    starts = ends - counts
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for w in words[starts[i] : ends[i]]:
                h = h * _STEP + w
        out[starts[i]] = h
    keep = np.arange(total) < np.repeat(starts + number, counts)
    return mixed(out[keep]), number


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]
