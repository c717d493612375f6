"""Blocks of rows that are written once and read by several passes, and their messages.

``packed`` turns rows, where they lie, into compressed blocks of a few MB. A corpus-wide
question about the words of a block ("does this window occur elsewhere?", "how often does
this word occur?") becomes one message from each block to each segment of the hash space;
a segment answers every block in the order of its message. Both sides are numpy arrays of
bounded size; Spark does the grouping. The number of segments follows the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
MESSAGE = "segment long, block long, body binary"


def bytes_of(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def split_by_bytes(batch: pa.RecordBatch, text: str, limit: int, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text and at most ``rows`` rows; a longer text has a slice of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < batch.num_rows:
        end = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, "right")), start + 1)
        end = min(end, start + rows)
        yield batch.slice(start, end - start)
        start = end


def packed(df: DataFrame, text: str = "text", limit: int = BLOCK_BYTES, even: bool = False) -> DataFrame:
    """Rows as blocks (block, n_words, payload). Write the result before it is read twice: ids are random.

    Blocks end before ``limit`` bytes of text. With ``even`` they are filled to the limit from slices of an
    eighth of it, and a remainder of less than half of it joins the block before.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held: list[pa.RecordBatch] = []
        full: list[pa.RecordBatch] = []
        size = 0

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            words = sum(len((t or b"").split()) for t in bytes_of(table.column(text)))
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([uuid.uuid4().int >> 65], pa.int64()), "n_words": pa.array([words], pa.int64()),
                    "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                }
            )

        for batch in batches:
            for part in split_by_bytes(batch, text, limit // 8 if even else limit):
                n = part.column(text).nbytes
                if held and size + n > limit:
                    if full:
                        yield block(full)
                    if even:
                        full = held
                    else:
                        yield block(held)
                    held, size = [], 0
                held.append(part)
                size += n
        if full and size < limit // 2:
            full, held = full + held, []
        for rest in (full, held):
            if rest:
                yield block(rest)

    return df.mapInArrow(pack, "block long, n_words long, payload binary")


def rows_of(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes, each with its type."""
    out = [len(arrays).to_bytes(1, "big"), len(arrays[0]).to_bytes(8, "big")]
    out += [a.dtype.str.encode().ljust(4) for a in arrays]
    out += [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unsqueeze(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    k, n = raw[0], int.from_bytes(raw[1:9], "big")
    kinds = [np.dtype(raw[9 + 4 * i : 13 + 4 * i].decode().strip()) for i in range(k)]
    at, out = 9 + 4 * k, []
    for kind in kinds:
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def gaps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of sorted values in the narrowest unsigned type."""
    d = np.diff(sorted_values, prepend=sorted_values.dtype.type(0))
    top = int(d.max()) if len(d) else 0
    return d.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


def ungaps(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.uint64)


def cuts(sorted_segments: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each segment in a sorted array of segment numbers."""
    return np.searchsorted(sorted_segments, np.arange(n + 1, dtype=sorted_segments.dtype))


def message(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    seg, block, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table(
        {"segment": pa.array(seg, pa.int64()), "block": pa.array(block, pa.int64()), "body": pa.array(body, pa.binary())}
    )


def answered(messages: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Each segment answers the messages of all blocks at once, one body per message."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        seg, blocks = table.column("segment").to_pylist(), table.column("block").to_pylist()
        return message(list(zip(seg, blocks, answer(table.column("body").to_pylist()), strict=True)))

    return messages.groupBy("segment").applyInArrow(one, MESSAGE)


def asked(blocks: DataFrame, ask: Callable[[pa.Table], list[tuple[int, bytes]]]) -> DataFrame:
    """Messages of blocks that need no answer first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                rows = ask(rows_of(payload.as_buffer()))
                yield from message([(s, block, b) for s, b in rows]).to_batches()

    return blocks.select("block", "payload").mapInArrow(run, MESSAGE)


def with_answers(
    blocks: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, dict[tuple, bytes], int], pa.Table], schema: str
) -> DataFrame:
    """Blocks together with their answers (``kind``, ``segment``, ``body``), as ``finish`` makes of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = zip(right.column("kind").to_pylist(), right.column("segment").to_pylist(), strict=True)
        bodies = dict(zip(keys, right.column("body").to_pylist(), strict=True))
        parts = [
            finish(rows_of(p.as_buffer()), bodies, b)
            for b, p in zip(left.column("block").to_pylist(), left.column("payload"), strict=True)
        ]
        return pa.concat_tables(parts) if parts else None

    left, right = blocks.select("block", "payload").groupBy("block"), answers.groupBy("block")
    return left.cogroup(right).applyInArrow(run, schema)


def total_words(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n_words")).first()[0] or 0
