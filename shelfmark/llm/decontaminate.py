"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared without case (A-Z) and ASCII punctuation. The n-grams and words of the
test items are counted in the whole corpus. An n-gram that at most ``HELD`` items hold is a
rare seed: wherever a document has it, it proposes the diagonals of these items. One that
more items hold (a common opening) proposes an item only where the passage also has one of
the item's rarest words: a copy shares at least ``LEAST`` of an item's words, so it has one
of the others plus one, the rarest in corpus and items. Nothing is lost by that, and a common
opening costs what its passages hold in common with items, not the number of items. A copy
keeps a seed as long as ``NGRAM`` words in a row are unedited.

Near diagonals are one passage, wide enough for all gaps that a copy may have; the item is
aligned with it unless the words that both have are too few for a copy. The passage is a copy
if the alignment scores at least ``LEAST`` of a perfect one. Documents are read where they lie
and never shuffled.

The items are worked on in blocks of at most about ``BLOCK_WORDS`` words, so what is sent to
the tasks is bounded; more items mean more passes. An alignment costs the product of the
words of item and passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.blocks import bytes_of, split_by_bytes
from shelfmark.llm.words import LOWER, Words, mix

NGRAM = 3
LEAST = 0.5
#: Items that may hold a rare seed. Either way of joining gives the same rows.
HELD = 8
BLOCK_WORDS = 1 << 20
SLICE_BYTES = 1 << 21
CELLS = 1 << 22
PLAIN = LOWER.copy()
PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
PLAIN_TABLE = PLAIN.tobytes()
HITS = "doc_id long, item_id long, score double, item_words long, start_word long, end_word long"


def plain(texts: list[bytes | None]) -> Words:
    """Words without case and punctuation."""
    return Words([(t or b"").translate(PLAIN_TABLE) for t in texts])


class Items:
    """A block of test items with their words and, once counted, their seeds."""

    def __init__(self, ids: list[int], texts: list[bytes | None], n: int) -> None:
        self.ids, self.n = ids, n
        words = plain(texts)
        self.words, self.first = words.hash, words.first
        starts, self.item = words.runs(n)
        self.at = starts - words.first[:-1][self.item]
        self.gram = words.run_hash(starts, n)
        self.known = np.unique(self.gram)
        self.known_words, self.word_n = np.unique(self.words, return_counts=True)

        # Words of each item, as one key a pair of word and item, with how often the item has them.
        self.pair, self.pair_n = np.unique(self.pair_key(np.repeat(np.arange(len(ids)), words.counts), self.words), return_counts=True)

    @staticmethod
    def pair_key(item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(word + mix(item.astype(np.uint64), 1))

    def seeded(self, grams: np.ndarray, words: np.ndarray, least: float) -> None:
        """Choose seeds by the corpus counts of ``known`` n-grams and ``known_words``."""
        m = np.diff(self.first)
        need = np.maximum(np.ceil(least * m), 1).astype(np.int64)
        which = np.searchsorted(self.known_words, self.words)
        count, load = words[which], (words * self.word_n)[which]
        owner = np.repeat(np.arange(len(m)), m)
        possible = np.bincount(owner[count > 0], minlength=len(m)) >= need

        # n-grams that occur, of items that a document can hold.
        order = np.flatnonzero((grams[np.searchsorted(self.known, self.gram)] > 0) & possible[self.item])
        order = order[np.argsort(self.gram[order], kind="stable")]
        seed, item, at = self.gram[order], self.item[order], self.at[order]
        both = np.unique(np.stack([seed, item.astype(np.uint64)]), axis=1) if len(seed) else np.zeros((2, 0), np.uint64)
        held, items = np.unique(both[0], return_counts=True)
        self.frequent = held[items > HELD]
        often = np.isin(seed, self.frequent)
        self.seed, self.seed_item, self.seed_at = seed[~often], item[~often], at[~often]

        # Frequent n-grams are known by item; a copy has one of the ``m - need + 1`` rarest words of the item.
        key = self.pair_key(item[often], seed[often])
        by_key = np.argsort(key, kind="stable")
        self.held, self.held_at = key[by_key], at[often][by_key]
        order = np.lexsort((self.words, load, owner))
        place = np.arange(len(order)) - self.first[:-1][owner]
        wanted = np.zeros(len(m), bool)
        wanted[item[often]] = True
        rare = order[(place <= (m - need)[owner]) & wanted[owner]]
        rare = rare[count[rare] > 0]
        word, one = np.unique(np.stack([self.words[rare], owner[rare].astype(np.uint64)]), axis=1) if len(rare) else np.zeros((2, 0), np.uint64)
        self.rare, self.rare_item = word, one.astype(np.int64)

    def shared(self, item: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many words each item has in common with its passage ``words[low:high]``: no alignment has more matches."""
        out = np.zeros(len(item), np.int64)
        size, at = high - low, 0
        total = np.cumsum(size)
        while at < len(item):
            to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + CELLS // 8, "right")), at + 1)
            n = size[at:to]
            task = np.repeat(np.arange(at, to), n)
            place = np.arange(len(task)) + np.repeat(low[at:to] - (np.cumsum(n) - n), n)
            key = self.pair_key(item[task], words[place])
            which = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            met = self.pair[which] == key
            both, times = np.unique((task[met] - at) * len(self.pair) + which[met], return_counts=True)
            often = np.minimum(times, self.pair_n[both % len(self.pair)])
            out[at:to] = np.bincount(both // len(self.pair), often, minlength=to - at)
            at = to
        return out


def aligned(item: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item row with its passage row: score, end column.

    A match scores 1, a mismatch and a gap -1. Zeros in an item are padding; passages are
    padded with ones, which match nothing.
    """
    pairs, width = passage.shape
    ramp = np.arange(1, width + 1, dtype=np.int32)
    row = np.zeros((pairs, width + 1), np.int32)
    best, end = np.zeros(pairs, np.int32), np.zeros(pairs, np.int64)
    for i in range(item.shape[1]):
        real = item[:, i] != 0
        step = np.where(passage == item[:, i : i + 1], 1, -1)
        top = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] - 1), 0)
        top = np.maximum.accumulate(top + ramp, axis=1) - ramp
        row[:, 1:] = np.where(real[:, None], top, row[:, 1:])
        high = row[:, 1:].max(1)
        better = real & (high > best)
        end[better] = row[better, 1:].argmax(1) + 1
        best = np.where(better, high, best)
    return best, end


def padded(parts: list[np.ndarray], fill: int, backwards: bool = False) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts))), fill, np.uint64)
    for r, p in zip(out, parts, strict=True):
        r[: len(p)] = p[::-1] if backwards else p
    return out


def pieces(sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of ``sizes`` entries each, in pieces of bounded total: (rows, row of each entry within them, entry within its row)."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + CELLS // 8, "right")), at + 1)
        n = sizes[at:to]
        row = np.repeat(np.arange(to - at), n)
        yield slice(at, to), row, np.arange(len(row)) - (np.cumsum(n) - n)[row]
        at = to


def proposals(words: Words, items: Items, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, item, diagonal) of the seeds that texts and items share, in pieces."""
    starts, text = words.runs(items.n)
    grams = words.run_hash(starts, items.n)
    low, high = np.searchsorted(items.seed, grams, "left"), np.searchsorted(items.seed, grams, "right")
    hits = np.flatnonzero(high > low)
    for rows, row, k in pieces((high - low)[hits]):
        hit = hits[rows][row]
        which = low[hit] + k
        yield text[hit], items.seed_item[which], starts[hit] - words.first[:-1][text[hit]] - items.seed_at[which]

    # Frequent seeds: each rare word of an item looks for the item's n-grams within its reach.
    if not len(items.frequent):
        return
    near = np.minimum(np.searchsorted(items.frequent, grams), len(items.frequent) - 1)
    near = np.flatnonzero(items.frequent[near] == grams)
    if not len(near):
        return
    place, gram = starts[near], grams[near]
    low, high = np.searchsorted(items.rare, words.hash, "left"), np.searchsorted(items.rare, words.hash, "right")
    doc_of = np.repeat(np.arange(len(words.counts)), words.counts)
    size = np.diff(items.first)
    hits = np.flatnonzero(high > low)
    for rows, row, k in pieces((high - low)[hits]):
        at = hits[rows][row]
        item, doc = items.rare_item[low[at] + k], doc_of[at]
        m = size[item]
        pad = gaps(m, least)
        a = np.searchsorted(place, np.maximum(at - m - pad, words.first[:-1][doc]))
        b = np.searchsorted(place, np.minimum(at + m + pad + 1, words.first[1:][doc]))
        for part, r, j in pieces(np.maximum(b - a, 0)):
            p = a[part][r] + j
            key = items.pair_key(item[part][r], gram[p])
            left = np.searchsorted(items.held, key, "left")
            ok = np.flatnonzero(items.held[np.minimum(left, len(items.held) - 1)] == key)
            r, p, left = r[ok], p[ok], left[ok]
            n = np.searchsorted(items.held, key[ok], "right") - left
            for some, s, e in pieces(n):
                of = r[some][s]
                diagonal = place[p[some][s]] - items.held_at[left[some][s] + e]
                word, d, i = at[part][of], doc[part][of], item[part][of]
                inside = (word >= diagonal - pad[part][of]) & (word < diagonal + m[part][of] + pad[part][of])
                rows3 = np.stack([d, i, diagonal - words.first[:-1][d]])[:, inside]
                if rows3.shape[1]:
                    yield tuple(np.unique(rows3, axis=1))


def gaps(m: np.ndarray, least: float) -> np.ndarray:
    """How many gaps a copy of an item of ``m`` words has at most."""
    return np.maximum(m - np.ceil(least * m).astype(np.int64), 0)


def passages(words: Words, items: Items, least: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, word after the last) of the passages that may hold a copy of the item."""
    for doc, item, diagonal in proposals(words, items, least):
        m = np.diff(items.first)[item]
        pad = gaps(m, least)
        near = diagonal // np.maximum(pad, 8)
        order = np.lexsort((diagonal, near, item, doc))
        doc, item, diagonal, near, m, pad = (x[order] for x in (doc, item, diagonal, near, m, pad))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (near[1:] != near[:-1])
        one = np.flatnonzero(new)
        end = np.append(one[1:], len(doc)) - 1
        doc, item, m, pad = doc[one], item[one], m[one], pad[one]
        a = np.maximum(diagonal[one] - pad, 0)
        b = np.minimum(diagonal[end] + m + pad, words.counts[doc])
        base = words.first[:-1][doc]
        keep = items.shared(item, words.hash, base + a, base + b) >= least * m
        yield from zip(doc[keep].tolist(), item[keep].tolist(), a[keep].tolist(), b[keep].tolist(), strict=True)


def found(texts: list[bytes | None], items: Items, least: float) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, score, item words, first word, word after the last) of the best copy of each item in each text."""
    words = plain(texts)
    tasks = sorted(set(passages(words, items, least)))
    tasks.sort(key=lambda t: t[3] - t[2])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    at = 0
    while at < len(tasks):
        width, to = tasks[at][3] - tasks[at][2], at
        while to < len(tasks) and (to - at + 1) * (tasks[to][3] - tasks[to][2]) <= CELLS // 8 and tasks[to][3] - tasks[to][2] <= 2 * width + 16:
            to += 1
        part = tasks[at : max(to, at + 1)]
        at += len(part)
        score, end = aligned(
            padded([items.words[items.first[i] : items.first[i + 1]] for _, i, _, _ in part], 0),
            padded([words.hash[words.first[d] + a : words.first[d] + b] for d, _, a, b in part], 1),
        )
        for (d, i, a, _), s, e in zip(part, score.tolist(), end.tolist(), strict=True):
            m = items.first[i + 1] - items.first[i]
            if s >= least * m and (-s, a + e) < best.get((d, i), (0, 0)):
                best[d, i] = (-s, a + e)
    rows = []
    for (d, i), (s, e) in sorted(best.items()):
        item_words = items.words[items.first[i] : items.first[i + 1]]
        reach = max(0, e - 3 * len(item_words))
        passage = words.hash[words.first[d] + reach : words.first[d] + e]
        _, back = aligned(padded([item_words], 0, True), padded([passage], 1, True))
        rows.append((d, i, -s / len(item_words), len(item_words), e - int(back[0]), e))
    return rows


def item_blocks(items: DataFrame, text: str, item_id: str, block_words: int) -> Iterator[tuple[list[int], list[bytes | None]]]:
    """Items by blocks whose size does not follow the number of items."""
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    n = -(-int(total) // (4 * block_words)) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64(item_id, text), F.lit(n)) == k) if n > 1 else items
        rows = part.select(F.col(item_id).cast("long"), text).orderBy(item_id, text).collect()
        yield [r[0] for r in rows], [None if r[1] is None else r[1].encode() for r in rows]


def seeded_blocks(docs: DataFrame, items: DataFrame, text: str, item_text: str, item_id: str, block_words: int, least: float) -> Iterator[Items]:
    """Blocks of items with their seeds, chosen by what occurs in ``docs``."""
    for ids, texts in item_blocks(items, item_text, item_id, block_words):
        block = Items(ids, texts, NGRAM)
        if not len(block.known):
            continue
        known = block.known, block.known_words

        def count(batches: Iterator[pa.RecordBatch], known: tuple = known) -> Iterator[pa.RecordBatch]:
            totals = [np.zeros(len(k), np.int64) for k in known]
            for batch in batches:
                for part in split_by_bytes(batch, text, SLICE_BYTES):
                    words = plain(bytes_of(part.column(text)))
                    for total, k, keys in zip(totals, known, (words.run_hash(words.runs(NGRAM)[0], NGRAM), words.hash), strict=True):
                        at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                        total += np.bincount(at[k[at] == keys], minlength=len(k))
            total = np.concatenate(totals)
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"key": pa.array(met, pa.int64()), "n": pa.array(total[met], pa.int64())})

        counts = np.zeros(len(known[0]) + len(known[1]), np.int64)
        for r in docs.select(text).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n")).collect():
            counts[r[0]] = r[1]
        block.seeded(counts[: len(known[0])], counts[len(known[0]) :], least)
        yield block


def leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
    item_id: str = "item_id", least: float = LEAST, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """A row for each document and test item of which the document holds a copy: its best alignment.

    ``score`` is the alignment score per item word (1.0: the whole item word for word),
    ``start_word`` and ``end_word`` bound the copy among the document's plain words. Null and
    empty texts hold nothing; items of fewer than three plain words have no seed and are not
    looked for, nor are copies without three unedited words in a row. Equal rows or items are reported each. Empty tables give no rows. Other
    columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = docs.sparkSession.createDataFrame([], HITS)
    for block in seeded_blocks(rows, items, "text", item_text, item_id, block_words, least):

        def look(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in split_by_bytes(batch, "text", SLICE_BYTES):
                    hits = found(bytes_of(part.column("text")), block, least)
                    ids = part.column("doc_id").to_pylist()
                    cols = list(zip(*[(ids[d], block.ids[i], *rest) for d, i, *rest in hits], strict=True)) or [()] * 6
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                    names = [x.split()[0] for x in HITS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        out = out.unionByName(rows.mapInArrow(look, HITS))
    return out


def without_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
    least: float = LEAST, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the documents that hold a copy of a test item (see ``leaks``); all columns as they were."""
    out = docs
    for block in seeded_blocks(docs, items, text, item_text, item_id, block_words, least):

        def drop(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in split_by_bytes(batch, text, SLICE_BYTES):
                    keep = np.ones(part.num_rows, bool)
                    keep[[h[0] for h in found(bytes_of(part.column(text)), block, least)]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(drop, docs.schema)
    return out
