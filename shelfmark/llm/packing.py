"""Hierarchical packing of token streams into windows of several sizes.

Documents are routed to the smallest tier that holds them (longer ones are first cut into
full windows of the longest tier). The tiers are packed from the longest to the shortest:
a document opens a window of its tier, the gap is filled with the largest shorter documents
that fit, and what is then still open with the beginning of one more. Every window leaves a
tier full. A task packs its own rows in chunks of bounded size and carries what is left on;
its last tokens are cut into windows of decreasing powers of two, so nothing is padded.
Steps are groups of windows of one tier that hold the same number of tokens.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.blocks import split_by_bytes

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 1 << 16
CHUNK_BYTES = 4 << 20
END_ID = 1
CACHED_PIECES = 300_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, step_id long"
)


class Pieces(dict):
    """Token ids, as little-endian unsigned 16-bit bytes, of pieces of text; most pieces recur.

    ``added`` are the tokens that the vocabulary file lists beside its pieces: wherever their signs stand
    in a text they are one token, and the texts before and after are encoded each by itself.
    """

    def __init__(self, path: str | None, added_path: str | None = None) -> None:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(added_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
            self.added = {t["content"]: np.array([t["id"]], "<u2").tobytes() for t in json.load(file)["added_tokens"]}
        longest_first = sorted(self.added, key=lambda t: (-len(t), t))
        self.cut_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")" if self.added else r"(?!)()")
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(
            "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        ids = np.array(self.encode(piece), "<u2").tobytes()
        self[piece] = ids
        return ids


#: A blank before a visible character begins a token whatever stands before it.
CUT = re.compile(r" (?=\S)")


def pieces_of(path: str | None, added_path: str | None = None) -> Pieces:
    """One table of pieces for each Python worker."""
    import tiktoken

    held = vars(tiktoken).setdefault("_held_pieces", {})
    if (path, added_path) not in held:
        held[path, added_path] = Pieces(path, added_path)
    return held[path, added_path]


def token_ids(text: str, pieces: Pieces) -> np.ndarray:
    """Ids of a whole text, then the end id."""
    bodies = []
    for part in pieces.cut_added.split(text):
        if part in pieces.added:
            bodies.append(pieces.added[part])
        elif part:
            head, *rest = CUT.split(part)
            bodies += [pieces[head], *[pieces[" " + x] for x in rest]]
    body = b"".join(bodies)
    return np.append(np.frombuffer(body, "<u2"), END_ID).astype("<u4")


class Packer:
    """Windows of one task; ``windows`` collects (size, [(document, start, length), ...])."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = sorted(tiers)
        self.open: list[tuple[int, int, int]] = []  # (length, document, start) in ascending order
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc: int, n: int) -> None:
        top, start = self.tiers[-1], 0
        while n - start >= top:
            self.windows.append((top, [(doc, start, top)]))
            start += top
        if start < n:
            bisect.insort(self.open, (n - start, doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest open piece of at most ``most`` tokens."""
        i = bisect.bisect_right(self.open, (most, np.inf, 0)) - 1
        return self.open.pop(i) if i >= 0 else None

    def fill(self, size: int) -> None:
        """One full window of ``size`` tokens; there must be as many open."""
        window, gap = [], size
        while gap:
            piece = self.take(gap)
            if piece is None:
                n, doc, start = self.open.pop(0)
                bisect.insort(self.open, (n - gap, doc, start + gap))
                piece = (gap, doc, start)
            window.append((piece[1], piece[2], piece[0]))
            gap -= piece[0]
        self.windows.append((size, window))

    def pack(self) -> None:
        """Pack every tier as long as its windows can be filled."""
        total = sum(p[0] for p in self.open)
        for size, below in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0], strict=True):
            while total >= size and self.open and self.open[-1][0] > below:
                self.fill(size)
                total -= size

    def rest(self) -> None:
        """Close the task: what is left goes to windows of the powers of two it is the sum of."""
        self.pack()
        total = sum(p[0] for p in self.open)
        while total:
            size = 1 << (total.bit_length() - 1)
            self.fill(size)
            total -= size


def packed_sequences(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS, ranks_path: str | None = None, added_path: str | None = None,
) -> DataFrame:
    """One row per piece: its document, place and checksum, its window and place there, its step.

    Every id of every document, and the end id after it, lies in one piece. A null, empty or
    blank text is packed like any other (null: as an empty one, which is the end id alone).
    Rows with equal or null ids are documents of their own. Tier sizes must be powers of two.
    ``sequence_id`` is unique over all tasks and the same when a task is run again. Other
    columns are not read.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tier sizes are powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(ranks_path, added_path)
        task = TaskContext.get().partitionId() << 32
        packer, docs_open, number, made, steps = Packer(tiers), {}, 0, 0, {}

        def rows() -> pa.RecordBatch:
            nonlocal made
            out: list[tuple] = []
            for size, window in packer.windows:
                nth = steps[size] = steps.get(size, -1) + 1
                step = task + (size.bit_length() << 26) + nth * size // max(step_tokens, size)
                offset = 0
                for doc, start, n in window:
                    key, ids = docs_open[doc]
                    crc = zlib.crc32(ids[start : start + n].tobytes())
                    out.append((key, start, n, crc, len(ids), task + made, offset, size, step))
                    offset += n
                made += 1
            packer.windows.clear()
            held = {doc for _, doc, _ in packer.open}
            for doc in [d for d in docs_open if d not in held]:
                del docs_open[doc]
            columns = list(zip(*out, strict=True)) or [()] * 9
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for part in split_by_bytes(batch, text, CHUNK_BYTES):
                keys = part.column(doc_id).to_pylist()
                for key, body in zip(keys, part.column(text).to_pylist(), strict=True):
                    ids = token_ids(body or "", pieces)
                    docs_open[number] = (key, ids)
                    packer.add(number, len(ids))
                    number += 1
                packer.pack()
                yield rows()
        packer.rest()
        yield rows()

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(run, SCHEMA)
