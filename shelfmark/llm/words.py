"""Words and word hashes of whole batches of texts, without a loop over words.

A word is a longest run of bytes other than space and ``\\x09`` to ``\\x0d`` in the
UTF-8 text, which are the bytes of ``[^\\x20\\x09-\\x0D]+``. All words of a batch are
hashed by a few passes over one byte array: prefix sums of ``byte * B**i`` modulo 2**64
give the polynomial hash of every word, a finaliser spreads its bits.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
STEP = 0xD6E8FEB86659FD93
CHUNK = 1 << 19


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over the word."""
    x = x ^ np.uint64((seed * 0xA0761D6478BD642F + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i below n."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def prefix(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes; memory is bounded by a chunk, or by the longest word."""
    out = np.empty(len(starts), np.uint64)
    i, pw, inv = 0, *powers(BASE, CHUNK + 1)
    while i < len(starts):
        base = starts[i]
        j = max(int(np.searchsorted(ends, base + CHUNK, "right")), i + 1)
        s, e = starts[i:j] - base, ends[i:j] - base
        if e[-1] > CHUNK:
            pw, inv = powers(BASE, int(e[-1]) + 1)
        part = buf[base : base + e[-1]].astype(np.uint64) + np.uint64(1)
        sums = prefix(part * pw[: len(part)])
        out[i:j] = (sums[e] - sums[s]) * inv[s]
        i = j
    return mix(out)


class Words:
    """Words of a batch of texts: ``hash`` by word, ``first[d]:first[d + 1]`` of text d."""

    def __init__(self, texts: list[bytes | None], lower: bool = False) -> None:
        self.buf = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        gap = SEPARATOR[self.buf]
        inside = np.concatenate([[False], ~gap])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.hash = hash_spans(self.buf, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Starts (as word numbers) and texts of all runs of ``size`` words inside one text.

        With ``short`` a text of one to ``size - 1`` words is one run of all its words.
        """
        n = self.counts
        keep = np.maximum(n - size + 1, 0)
        if short:
            keep = np.where((n > 0) & (n < size), 1, keep)
        text = np.repeat(np.arange(len(n)), keep)
        begin = np.concatenate([[0], np.cumsum(keep)])[:-1]
        return np.arange(int(keep.sum())) - begin[text] + self.first[:-1][text], text

    def run_hash(self, starts: np.ndarray, size: int, ends: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """Hashes of the word runs that begin at ``starts`` (in order of the words)."""
        ends = starts + size if ends is None else ends
        words = mix(self.hash, seed) if seed else self.hash
        out = np.empty(len(starts), np.uint64)
        pw, inv = powers(STEP, CHUNK + size + 1)
        i = 0
        while i < len(starts):
            base = starts[i]
            j = max(int(np.searchsorted(ends, base + CHUNK, "right")), i + 1)
            part = words[base : ends[j - 1]]
            sums = prefix(part * pw[: len(part)])
            out[i:j] = (sums[ends[i:j] - base] - sums[starts[i:j] - base]) * inv[starts[i:j] - base]
            i = j
        return mix(out, seed)

    def shingles(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every shingle of ``size`` words; a shorter text is one shingle."""
        starts, text = self.runs(size, short=True)
        ends = np.minimum(starts + size, self.first[1:][text])
        return self.run_hash(starts, size, ends, seed), text
