"""Near-duplicate classes by ProbMinHash.

A text's shingles of five words, weighted by how often it holds them, each run
a Poisson process of that rate, driven by a hash of the shingle. Every arrival
falls on a random register and the earliest one keeps it; a process ends when its
next arrival comes later than the latest register. Two texts then agree in a
register with the probability Jaccard similarity of their weights. Bands of
registers give candidates; each is verified by its exact probability Jaccard
similarity.

Null counts as empty text. Equal texts are one class whatever they hold, empty
texts too, and an empty text is near no other. Rows with a null key get a class
like others; the class of null keys alone is null. Repeated rows get equal rows.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pagelode.llm.common import documents
from pagelode.llm.groups import classes
from pagelode.llm.shingles import Words, mixed, shingle_hashes

REGISTERS = 125
BAND_ROWS = 5
WIDTH = 5
THRESHOLD = 0.8
_MASK = np.uint64((1 << 48) - 1)
_GAP = np.uint64(0x632BE59BD9B4E019)


class Weights:
    """Weighted shingles of texts: for all texts end to end, which text, 48 bits of hash, count."""

    def __init__(self, width: int = WIDTH):
        self.words, self.width = Words(), width

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, number = shingle_hashes(*self.words.of(texts), self.width)
        which = np.repeat(np.arange(len(texts), dtype=np.uint64), number)
        keys = np.sort((which << np.uint64(48)) | (hashes & _MASK))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        return (keys >> np.uint64(48)).astype(np.int64), keys & _MASK, counts

    def profiles(self, texts: list[bytes]):
        which, keys, counts = self.of(texts)
        at = np.searchsorted(which, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            yield keys[at[i] : at[i + 1]], counts[at[i] : at[i + 1]].astype(float)


def signer(registers: int = REGISTERS, width: int = WIDTH):
    """Signatures of texts, 16 bits a register."""
    weights = Weights(width)

    def sign(texts: list[bytes]) -> np.ndarray:
        which, keys, counts = weights.of(texts)
        earliest = np.full(len(texts) * registers, np.inf)
        owner = np.zeros(len(texts) * registers, dtype=np.uint64)
        time = np.zeros(len(keys))
        i = 0
        while len(keys):
            i += 1
            draw = mixed(keys * _GAP + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / counts
            slot = which * registers + (mixed(draw + _GAP) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(earliest, slot, time)
            won = earliest[slot] == time
            owner[slot[won]] = keys[won]
            latest = earliest.reshape(len(texts), registers).max(1)
            going = time < latest[which]
            which, keys, counts, time = which[going], keys[going], counts[going], time[going]
        return (mixed(owner) >> np.uint64(48)).astype(np.uint16).reshape(len(texts), registers)

    return sign


def probability_jaccard(a, b) -> float:
    """Exact: over common elements, 1 / sum over all elements of the larger of their two relative weights."""
    keys_a, w_a = a
    keys_b, w_b = b
    if not len(keys_a) or not len(keys_b):
        return 0.0
    common, i, j = np.intersect1d(keys_a, keys_b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = w_a[i], w_b[j]
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    only_a, only_b = w_a.sum() - x.sum(), w_b.sum() - y.sum()
    lower = np.searchsorted(ratio, ratio, side="left")  # how many common elements have a smaller ratio
    sum_x, sum_y = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
    larger = only_a + sum_x[-1] - sum_x[lower] + ratio * (only_b + sum_y[lower])
    return float((x / larger).sum())


def near_duplicate_classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key and class_id of every row of df."""
    return classes(df, signer, lambda: Weights().profiles, probability_jaccard, REGISTERS, BAND_ROWS, threshold, key, text)


def op1_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document."""
    return near_duplicate_classes(documents(spark, sf_dir))
