"""Words of a text as bytes, and hashes of runs of consecutive words.

A word is a maximal run of bytes other than the ASCII blanks ``\\x20`` and
``\\x09-\\x0D``: what ``bytes.split()`` gives. A text in *normal form* has its
words joined by one space, so equal word sequences are equal bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash


class Words:
    """The words of one text in normal form, with the byte offsets of each."""

    __slots__ = ("normal", "starts", "ends", "n")

    def __init__(self, text: str | None, lower: bool = False):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = (raw.lower() if lower else raw).split()  # bytes.lower() changes A-Z only
        self.n = len(words)
        self.normal = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, self.n)
        self.ends = np.cumsum(lengths) + np.arange(self.n)
        self.starts = self.ends - lengths

    def slice(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last - 1`` in normal form."""
        return self.normal[self.starts[first] : self.ends[last - 1]] if last > first else b""

    def run_hashes(self, k: int, seed: int = 0) -> np.ndarray:
        """XXH64 of every run of ``k`` words, none for a shorter text."""
        count = self.n - k + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        text, digest = self.normal, xxhash.xxh64_intdigest
        bounds = zip(self.starts[:count].tolist(), self.ends[k - 1 :].tolist())
        return np.fromiter((digest(text[a:b], seed) for a, b in bounds), np.uint64, count)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def runs_of_equal(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every maximal run of equal values."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    return first, np.diff(np.append(first, len(values)))
