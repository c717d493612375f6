"""Alignment of the tokens of two tokenizers, and how often their ids are linked in the corpus.

Both tokenizers cut the same bytes. A place where a token of either one ends is a shared cut. The
cuts are found by divide and conquer: an interval looks for a common end near its middle, by bisect
in the other tokenizer's ends, and is cut there; both halves go on, and an interval without a common
end is a group. All intervals of a part of a block of documents take each step together, as arrays.

A block keeps its distinct linked id pairs with the number of its documents that hold them. Spark adds
these up over all blocks, marks the best partners of every id, and joins the counts back to the blocks.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.blocks import gaps, rows_of, split_by_bytes, squeeze, ungaps, unsqueeze
from shelfmark.session import cut

BLOCK_BYTES = 4 << 20
#: Text of a block that is cut at a time: its pieces and arrays are what a worker holds, beside the words.
PART_BYTES = 512 << 10
LINKS = 1 << 19
#: A group of more links than this is counted by its distinct ids.
LARGE = 1 << 12
CACHED_WORDS = 100_000
CACHED_CHARS = 64
JOINED_CHARS = 1 << 16
DOC_BITS = 24
BLOCKS = "block long, docs binary, pairs binary, links binary"
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_signs() -> dict[str, int]:
    """The sign by which a byte-level vocabulary writes each byte: visible ones themselves, others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Words(dict):
    """Ids of both tokenizers, as little-endian unsigned 16-bit bytes, of pieces of text; None where their bytes differ.

    A piece begins with a blank that follows a visible sign. The first tokenizer begins a token
    there; so does the second, as none of its pieces holds a blank after another sign (if one
    does, whole texts are pieces). Only short pieces are held on to.
    """

    def __init__(self, path_a: str | None, path_b: str | None) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
            held = json.load(file)
        special = {t["content"] for t in held["added_tokens"]}
        signs = byte_signs()
        ranks = {bytes(signs[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b or public_tokenizers.path("piece_bpe_32k.model"))
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_b = n
        self.length_a = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length_a[i] = len(token)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        inner = any("▁" in p.lstrip("▁") for p in pieces)
        self.split = (lambda text: [text]) if inner else re.compile(r"(?<=\S)(?= )").split
        self.digits = np.zeros((max(len(self.length_a), n), 5), np.uint8)
        for i in range(len(self.digits)):
            self.digits[i, : len(str(i))] = np.frombuffer(str(i).encode(), np.uint8)

    def single(self, piece: str) -> tuple[bytes, bytes] | None:
        a = self.a.encode_ordinary(piece)
        b = self.b.encode(piece[1:], num_threads=1) if len(piece) > 1 else [self.b.piece_to_id("▁")]
        same = b"".join([self.bytes_b[i] for i in b]) == piece.encode()
        return (np.array(a, "<u2").tobytes(), np.array(b, "<u2").tobytes()) if same else None

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that end with a visible sign side by side, and each of the others alone."""
        side_by_side = [p for p in pieces if not p[-1].isspace()]
        for p in pieces:
            if p[-1].isspace():
                self[p] = self.single(p)
        at, total = 0, np.cumsum([len(p) for p in side_by_side])
        while at < len(side_by_side):
            to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + JOINED_CHARS, "right")), at + 1)
            some = side_by_side[at:to]
            joined = "".join(some)
            a, b = self.a.encode_ordinary(joined), self.b.encode(joined[1:], num_threads=1)
            if len(some) == 1 or b"".join([self.bytes_b[i] for i in b]) != joined.encode():
                self.update((p, self.single(p)) for p in some)
            else:
                ends = np.cumsum([len(p.encode()) for p in some])
                a, b = np.array(a, "<u2"), np.array(b, "<u2")
                cut_a = 2 * np.searchsorted(np.cumsum(self.length_a[a]), ends) + 2
                cut_b = 2 * np.searchsorted(np.cumsum(self.length_b[b]), ends) + 2
                a, b, i, j = a.tobytes(), b.tobytes(), 0, 0
                for p, x, y in zip(some, cut_a.tolist(), cut_b.tolist(), strict=True):
                    self[p] = a[i:x], b[j:y]
                    i, j = x, y
            at = to

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of a blank and each text; none where either tokenizer does not give these bytes back."""
        pieces = [self.split(" " + t) if t else [] for t in texts]
        wanted = set().union(*pieces)
        new = wanted - self.keys()
        if len(self) + len(new) > CACHED_WORDS:
            again = {p: self[p] for p in wanted - new}
            self.clear()
            self.update(again)
        self.learn(list(new))
        out = []
        for some in pieces:
            found = [self[p] for p in some]
            whole = None not in found
            out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found])) if whole else (b"", b""))
        for p in new:
            if len(p) > CACHED_CHARS:
                del self[p]
        return out


def words_of(path_a: str | None, path_b: str | None) -> Words:
    """One table for each Python worker."""
    import tiktoken

    held = vars(tiktoken).setdefault("_held_words", {})
    if (path_a, path_b) not in held:
        held[path_a, path_b] = Words(path_a, path_b)
    return held[path_a, path_b]


def groups(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups, in tokens of either side, of many texts at once.

    ``ends`` are the byte offsets at which tokens end, ascending over all texts; text d has the
    tokens ``first[d]`` to ``first[d + 1]``, on both sides or none.
    """
    held = np.flatnonzero(np.diff(first_a) > 0)
    lo_a, hi_a, lo_b, hi_b = first_a[held], first_a[held + 1], first_b[held], first_b[held + 1]
    done_a, done_b = [], []
    while len(lo_a):
        leaf = (hi_a - lo_a == 1) | (hi_b - lo_b == 1)
        done_a.append(hi_a[leaf])
        done_b.append(hi_b[leaf])
        lo_a, hi_a, lo_b, hi_b = lo_a[~leaf], hi_a[~leaf], lo_b[~leaf], hi_b[~leaf]
        middle = (lo_a + hi_a) // 2 - 1
        at_a, at_b = np.full(len(lo_a), -1), np.full(len(lo_a), -1)
        open_, away = np.arange(len(lo_a)), 0
        while len(open_):
            for probe in (middle[open_] - away, middle[open_] + away) if away else (middle[open_],):
                inside = (probe >= lo_a[open_]) & (probe < hi_a[open_] - 1) & (at_a[open_] < 0)
                mine, k = open_[inside], probe[inside]
                j = np.searchsorted(ends_b, ends_a[k])
                hit = ends_b[j] == ends_a[k]
                at_a[mine[hit]], at_b[mine[hit]] = k[hit], j[hit]
            away += 1
            beyond = (middle[open_] - away < lo_a[open_]) & (middle[open_] + away >= hi_a[open_] - 1)
            open_ = open_[(at_a[open_] < 0) & ~beyond]
        found = at_a >= 0
        done_a.append(hi_a[~found])
        done_b.append(hi_b[~found])
        cut_a, cut_b = at_a[found] + 1, at_b[found] + 1
        lo_a, hi_a = np.concatenate([lo_a[found], cut_a]), np.concatenate([cut_a, hi_a[found]])
        lo_b, hi_b = np.concatenate([lo_b[found], cut_b]), np.concatenate([cut_b, hi_b[found]])
    end_a, end_b = np.sort(np.concatenate([*done_a, []])).astype(np.int64), np.sort(np.concatenate([*done_b, []])).astype(np.int64)
    return end_a, end_b


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed weights."""
    if weights is None:
        keys = np.sort(keys)
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[begin], np.diff(np.append(begin, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(weights, begin) if len(keys) else weights


def links_of(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, doc: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(id pair, document) keys of all links and how many links each stands for."""
    start_a, start_b = np.append(0, end_a)[:-1], np.append(0, end_b)[:-1]
    n_a, n_b = end_a - start_a, end_b - start_b
    n = n_a * n_b
    code = lambda x, y: x.astype(np.uint64) * np.uint64(size_b) + y.astype(np.uint64)
    key = lambda pair, d: pair << np.uint64(DOC_BITS) | d.astype(np.uint64)
    parts = []
    for g in np.flatnonzero(n > LARGE):
        ua, ca = np.unique(a[start_a[g] : end_a[g]], return_counts=True)
        ub, cb = np.unique(b[start_b[g] : end_b[g]], return_counts=True)
        pair = code(np.repeat(ua, len(ub)), np.tile(ub, len(ua)))
        parts.append((key(pair, np.full(len(pair), doc[g])), np.outer(ca, cb).reshape(-1)))
    small = np.flatnonzero(n <= LARGE)
    total = np.cumsum(n[small])
    at = 0
    while at < len(small):
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS, "right")), at + 1)
        g = small[at:to]
        rep = np.repeat(g, n[g])
        inner = np.arange(len(rep)) - np.repeat(np.cumsum(n[g]) - n[g], n[g])
        pair = code(a[start_a[rep] + inner // n_b[rep]], b[start_b[rep] + inner % n_b[rep]])
        parts.append(counted(key(pair, doc[rep])))
        at = to
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    return counted(keys, np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64))


def group_digests(words: Words, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, last: np.ndarray) -> list[str]:
    """SHA-256 of the groups of each text, written out; ``last`` is the number of groups up to each text's end."""
    g_a = np.searchsorted(end_a, np.arange(len(a)), "right")
    g_b = np.searchsorted(end_b, np.arange(len(b)), "right")
    place_a = np.arange(len(a)) + np.append(0, end_b)[g_a]
    place_b = np.arange(len(b)) + end_a[g_b]
    signs = np.zeros((len(a) + len(b), 6), np.uint8)
    signs[place_a, :5], signs[place_b, :5] = words.digits[a], words.digits[b]
    signs[:, 5] = ord(",")
    signs[place_a[end_a - 1], 5], signs[place_b[end_b - 1], 5] = ord("|"), ord(";")
    size = np.cumsum((signs != 0).sum(axis=1))
    body = memoryview(signs[signs != 0].tobytes())
    ends = np.append(0, size)[np.append(0, end_a + end_b)[last]]
    out, before = [], 0
    for end in ends.tolist():
        out.append(hashlib.sha256(body[before : end - 1]).hexdigest() if end > before else "")
        before = end
    return out


def part_of(words: Words, part: pa.RecordBatch, before: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of some documents, of which the first is number ``before`` of its block, and their links (``links_of``)."""
    texts = part.column("text").to_pylist()
    found = words.ids(texts)
    sizes = np.array([[len(x) // 2, len(y) // 2] for x, y in found], np.int64).reshape(-1, 2)
    first_a, first_b = (np.append(0, np.cumsum(sizes[:, i])) for i in (0, 1))
    a, b = (np.frombuffer(b"".join([f[i] for f in found]), "<u2").astype(np.int64) for i in (0, 1))
    end_a, end_b = groups(np.cumsum(words.length_a[a]), np.cumsum(words.length_b[b]), first_a, first_b)
    last = np.searchsorted(end_a, first_a[1:], "right")
    n_groups = np.diff(np.append(0, last))
    doc = np.repeat(np.arange(len(texts)), n_groups)
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, doc, np.diff(np.append(0, end_a)) * np.diff(np.append(0, end_b)))
    table = pa.table(
        {
            "doc_id": part.column("doc_id"), "n_a": sizes[:, 0], "n_b": sizes[:, 1], "n_groups": n_groups, "n_links": n_links,
            "groups_sha256": group_digests(words, a, b, end_a, end_b, last),
        }
    )
    return table, *links_of(a, b, end_a, end_b, doc + before, words.size_b)


def block_of(words: Words, held: list[pa.RecordBatch]) -> dict[str, Any]:
    """One block: rows of documents, distinct pairs, and the links of each pair and document; made part by part."""
    parts, before = [], 0
    for batch in held:
        for part in split_by_bytes(batch, "text", PART_BYTES):
            parts.append(part_of(words, part, before))
            before += part.num_rows
    keys, times = counted(*(np.concatenate([p[i] for p in parts]) for i in (1, 2)))
    pairs, docs_of = counted(keys >> np.uint64(DOC_BITS))
    table = pa.concat_tables([p[0] for p in parts]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    in_doc = (keys & np.uint64((1 << DOC_BITS) - 1)).astype(np.uint32)
    most = int(times.max(initial=0))
    narrow = times.astype(np.uint8 if most < 2**8 else np.uint32 if most < 2**32 else np.uint64)
    return {
        "block": uuid.uuid4().int >> 65, "docs": sink.getvalue().to_pybytes(), "pairs": squeeze(gaps(pairs), docs_of.astype(np.uint32)),
        "links": squeeze(in_doc, narrow),
    }


def linked(docs: DataFrame, text: str, doc_id: str, path_a: str | None, path_b: str | None) -> DataFrame:
    """All blocks (``BLOCKS``). Write them before they are read twice: their ids are random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        words = words_of(path_a, path_b)
        held, size = [], 0
        for batch in batches:
            for part in split_by_bytes(batch, "text", BLOCK_BYTES):
                n = part.column("text").nbytes
                if held and size + n > BLOCK_BYTES:
                    yield block(words, held)
                    held, size = [], 0
                held.append(part)
                size += n
        if held:
            yield block(words, held)

    def block(words: Words, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        row = block_of(words, held)
        return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, BLOCKS)


def pair_rows(blocks: DataFrame) -> DataFrame:
    """(block, pair, n): the documents of each block that hold each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                steps, n = unsqueeze(body)
                pair = ungaps(steps).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"block": np.full(len(pair), block), "pair": pair, "n": n.astype(np.int64)})

    return blocks.select("block", "pairs").mapInArrow(run, "block long, pair long, n long")


def alignments(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """Tokens, groups and links of every document, with counts of its links in the whole corpus (``ROWS``).

    A null or empty text, and one whose bytes a tokenizer does not give back, has no tokens: zeros
    and an empty digest. Rows with equal or null ids, and equal texts, are documents of their
    own. A text is read whole. Other columns are not read. An empty table gives no rows.
    """
    size_b = words_of(path_a, path_b).size_b
    blocks = cut(linked(docs, text, doc_id, path_a, path_b))
    counts = cut(pair_rows(blocks).groupBy("pair").agg(F.sum("n").alias("count")))
    partners = Window.partitionBy(F.floor(F.col("pair") / size_b))  # at most as many rows as the second vocabulary
    marked = counts.withColumn("best", F.col("count") == F.max("count").over(partners))
    answers = pair_rows(blocks).select("block", "pair").join(marked, "pair")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        count = right.column("count").to_numpy()
        best = right.column("best").to_numpy().astype(np.int64)
        (row,) = left.to_pylist()
        rows, (in_doc, times) = rows_of(row["docs"]), unsqueeze(row["links"])
        reach = unsqueeze(row["pairs"])[1]
        times = times.astype(np.int64)
        n_best, count_sum = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        np.add.at(n_best, in_doc, times * np.repeat(best, reach))
        np.add.at(count_sum, in_doc, times * np.repeat(count, reach))
        return rows.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum)).select(
            [x.split()[0] for x in ROWS.split(", ")]
        )

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, ROWS)
