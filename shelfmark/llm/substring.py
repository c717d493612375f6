"""Removal of repeated word windows, found with a count-min prefilter.

1. Every block of documents sends its windows to a count-min sketch whose rows are spread
   over segments of the cell space; a block's part is the sorted list of its cells, each
   with "once" or "more". The segments merge the parts. The merged counts overestimate the
   true ones, never the reverse, so a window whose cells all say "more" may be repeated and
   any other window is certainly unique.
2. Only the windows that may be repeated are grouped exactly, by a 96-bit hash of their
   words: each block sends its first occurrence of each, a segment answers whether another
   block has an earlier one. Later occurrences inside a block need no message, so a window
   that a third of all documents share costs one entry a block.

The sketch has ``CELLS`` cells a row for each window of the input at every input size and
lives in segments, so no task or broadcast grows with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.blocks import (
    answered, asked, bytes_of, cuts, gaps, packed, squeeze, total_words, ungaps, unsqueeze, with_answers,
)
from shelfmark.llm.words import Words, mix
from shelfmark.session import cut

WINDOW = 20
DEPTH = 2
CELLS = 8
SEGMENT_WINDOWS = 1 << 20


class Sketch:
    """Where the windows of a corpus of ``n`` windows fall: ``DEPTH`` rows of cells, cut into segments."""

    def __init__(self, n: int, windows: int = SEGMENT_WINDOWS, cells: int = CELLS, depth: int = DEPTH) -> None:
        self.parts = -(-max(n, 1) // windows)
        self.width = min(n + 1, windows) * cells
        self.depth = depth

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        """Cell numbers over all rows; a segment is ``width`` neighbouring cells."""
        return mix(hashes, row + 1) % np.uint64(self.parts * self.width) + np.uint64(row * self.parts * self.width)

    def listed(self, hashes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each row the sorted distinct cells of the windows and whether each is met more than once."""
        out = []
        for row in range(self.depth):
            cells = np.sort(self.cells(hashes, row))
            new = np.ones(len(cells), bool)
            new[1:] = cells[1:] != cells[:-1]
            at = np.flatnonzero(new)
            out.append((cells[at], np.diff(np.append(at, len(cells))) > 1))
        return [c for c, _ in out], [m for _, m in out]

    def parts_of(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        """(segment, from, to) of sorted cells, without empty segments."""
        if not len(cells):
            return []
        seg = (cells // np.uint64(self.width)).astype(np.int64)
        ids, at = np.unique(seg, return_index=True)
        return list(zip(ids.tolist(), at.tolist(), [*at[1:].tolist(), len(cells)], strict=True))


def merged_counts(width: int):
    """The answer of a sketch segment: which cells of each message are met more than once in all."""

    def answer(bodies: list[bytes]) -> list[bytes]:
        count = np.zeros(width, np.uint8)
        lists = []
        for body in bodies:
            step, more = unsqueeze(body)
            cells = ungaps(step).astype(np.int64)
            lists.append(cells)
            count[cells] = np.minimum(count[cells] + 1 + more, 2)
        return [np.packbits(count[c] > 1).tobytes() for c in lists]

    return answer


def earliest(bodies: list[bytes]) -> list[bytes]:
    """The answer of an exact segment: which windows of each message start earlier in another block."""
    parts = [unsqueeze(b) for b in bodies]
    sizes = [len(p[0]) for p in parts]
    low, high, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, doc, high, low))
    low, high, doc, start = low[order], high[order], doc[order], start[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(low)), 0))
    later = np.empty(len(low), bool)
    later[order] = (doc > doc[first]) | (start > start[first])
    return [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(sizes)[:-1])]


class Windows:
    """The windows of a block: two hashes, document and start of each."""

    def __init__(self, table: pa.Table, text: str, doc_id: str, size: int) -> None:
        self.words = Words(bytes_of(table.column(text)))
        self.start, row = self.words.runs(size)
        ids = pa.compute.fill_null(table.column(doc_id).cast(pa.int64()), -(2**63)).to_numpy()
        self.doc, self.at = ids[row], self.start - self.words.first[:-1][row]
        self.low = self.words.run_hash(self.start, size)

    def high(self, chosen: np.ndarray, size: int) -> np.ndarray:
        return (self.words.run_hash(self.start[chosen], size, seed=7) >> np.uint64(32)).astype(np.uint32)

    def estimated(self, sketch: Sketch, bodies: dict[tuple, bytes]) -> np.ndarray:
        """Numbers of the windows that the merged sketch says are repeated."""
        maybe = np.arange(len(self.low))
        lists, _ = sketch.listed(self.low)
        for row, cells in enumerate(lists):
            hot = np.zeros(len(cells), bool)
            for seg, a, b in sketch.parts_of(cells):
                hot[a:b] = np.unpackbits(np.frombuffer(bodies["sketch", seg], np.uint8), count=b - a)
            maybe = maybe[np.isin(sketch.cells(self.low[maybe], row), cells[hot])]
        return maybe

    def firsts(self, chosen: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chosen windows in order of (hashes, document, start), their high hashes, and the first of each."""
        high = self.high(chosen, size)
        order = np.lexsort((self.at[chosen], self.doc[chosen], high, self.low[chosen]))
        chosen, high = chosen[order], high[order]
        new = np.ones(len(chosen), bool)
        new[1:] = (self.low[chosen][1:] != self.low[chosen][:-1]) | (high[1:] != high[:-1])
        return chosen, high, new


def without_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WINDOW, segment: int = SEGMENT_WINDOWS
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_words`` and ``n_removed``.

    A word goes when a window of ``size`` words over it has the same words as a window that
    starts earlier: in a document with a smaller id, or before it in the same document. All
    windows are judged on the input. ``kept_text`` has the words that stay, joined by one
    space; it is the empty string for a null, empty or blank text. A null id is smaller than
    any other. Rows with one id are one document: equal starts in them are not earlier than
    each other, so exact repetitions of a whole row keep their words. All other columns pass
    through unchanged (a column named like one of the three new ones is replaced).
    """
    added = ("kept_text", "n_words", "n_removed")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    blocks = cut(packed(docs, text))
    sketch = Sketch(total_words(blocks), segment)

    def sketched(table: pa.Table) -> list[tuple[int, bytes]]:
        lists, more = sketch.listed(Windows(table, text, doc_id, size).low)
        return [
            (seg, squeeze(gaps(c[a:b] - np.uint64(seg * sketch.width)), m[a:b]))
            for c, m in zip(lists, more, strict=True)
            for seg, a, b in sketch.parts_of(c)
        ]

    counted = cut(answered(asked(blocks, sketched), merged_counts(sketch.width))).withColumn("kind", F.lit("sketch"))

    def candidates(table: pa.Table, bodies: dict[tuple, bytes], block: int) -> pa.Table:
        w = Windows(table, text, doc_id, size)
        chosen, high, new = w.firsts(w.estimated(sketch, bodies), size)
        chosen, high = chosen[new], high[new]
        seg = (w.low[chosen] % np.uint64(sketch.parts)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        chosen, high, seg = chosen[order], high[order], seg[order]
        at = cuts(seg, sketch.parts)
        rows = [
            (s, squeeze(w.low[c], high[a:b], w.doc[c], w.at[c].astype(np.uint32)))
            for s, a, b in zip(range(sketch.parts), at[:-1], at[1:], strict=True)
            if b > a and len(c := chosen[a:b])
        ]
        return pa.table(
            {
                "segment": pa.array([s for s, _ in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()),
                "body": pa.array([b for _, b in rows], pa.binary()),
            }
        )

    exact = answered(with_answers(blocks, counted, candidates, "segment long, block long, body binary"), earliest)
    answers = counted.unionByName(exact.withColumn("kind", F.lit("exact")))

    def finish(table: pa.Table, bodies: dict[tuple, bytes], block: int) -> pa.Table:
        w = Windows(table, text, doc_id, size)
        chosen, _, new = w.firsts(w.estimated(sketch, bodies), size)
        gone = np.zeros(len(chosen), bool)
        leader = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        gone[:] = (w.doc[chosen] > w.doc[chosen[leader[of]]]) | (w.at[chosen] > w.at[chosen[leader[of]]])
        seg = (w.low[chosen[leader]] % np.uint64(sketch.parts)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        later = np.zeros(len(leader), bool)
        at = cuts(seg[order], sketch.parts)
        for s, a, b in zip(range(sketch.parts), at[:-1], at[1:], strict=True):
            if b > a:
                later[order[a:b]] = np.unpackbits(np.frombuffer(bodies["exact", s], np.uint8), count=b - a)
        gone |= later[of]
        cover = np.zeros(len(w.words.hash) + 1, np.int32)
        np.add.at(cover, w.start[chosen[gone]], 1)
        np.add.at(cover, w.start[chosen[gone]] + size, -1)
        stays = np.cumsum(cover)[:-1] == 0
        kept, removed = [], []
        for d, t in enumerate(bytes_of(table.column(text))):
            mask = stays[w.words.first[d] : w.words.first[d + 1]]
            left = (t or b"").split()
            if not mask.all():
                left = [x for x, k in zip(left, mask.tolist(), strict=True) if k]
            kept.append(b" ".join(left))
            removed.append(len(mask) - int(mask.sum()))
        table = table.append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))
        table = table.append_column("n_words", pa.array(w.words.counts, pa.int64()))
        return table.append_column("n_removed", pa.array(removed, pa.int64()))

    schema = docs.withColumns({"kept_text": F.lit(""), "n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return with_answers(blocks, answers, finish, schema)
