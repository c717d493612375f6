"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Every shingle is hashed once; the hash names a bin and a value, and a bin keeps its least
value. An empty bin takes the value of a full bin which a hash of (bin, attempt) names, so
it copies any full bin with equal chance and two texts copy alike. Only ``BITS`` low-order
bits of a bin are stored. Bins of different values agree in them by chance with probability
``2**-BITS``, which the likeness corrects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.words import Words, mix
from shelfmark.session import cut

BINS = 512
BITS = 4
SHINGLE = 5
SLICE_CHARS = 1 << 20
EMPTY = np.uint64(2**64 - 1)
ROWS = (
    "part long, kind int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint binary, "
    "edited_fingerprint binary, near_edited double, near_next double"
)


def densified(bins: np.ndarray) -> np.ndarray:
    """Bins of texts (one row each) with every empty bin filled; a text without shingles stays empty."""
    full = bins != EMPTY
    out, count = bins.copy(), full.sum(1)
    for row in np.flatnonzero(count == 1):
        out[row] = bins[row, full[row]][0]
    row, col = np.nonzero(~full & (count > 1)[:, None])
    attempt = 1
    while len(row):
        source = (mix(np.arange(bins.shape[1], dtype=np.uint64), attempt) % np.uint64(bins.shape[1])).astype(np.int64)[col]
        good = full[row, source]
        out[row[good], col[good]] = bins[row[good], source[good]]
        row, col, attempt = row[~good], col[~good], attempt + 1
    return out


def signatures(texts: list[bytes], bins: int = BINS, bits: int = BITS, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of all bins of each text, and whether the text has a word at all."""
    words = Words(texts)
    hashes, text = words.shingles(size)
    table = np.full(len(texts) * bins, EMPTY)
    np.minimum.at(table, text * bins + (hashes % np.uint64(bins)).astype(np.int64), hashes // np.uint64(bins))
    table = densified(table.reshape(len(texts), bins))
    return (mix(table) & np.uint64(2**bits - 1)).astype(np.uint8), words.counts > 0


def packed_bits(values: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Each row as the packed low bits of its values."""
    planes = (values[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return [row.tobytes() for row in np.packbits(planes.reshape(len(values), -1), axis=1)]


def likeness(a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of shingle sets, 0 to 1; two texts without words are alike, one is like no other."""
    chance = 2.0**-bits
    raw = ((a == b).mean(1) - chance) / (1 - chance)
    return np.where(has_a & has_b, np.clip(raw, 0.0, 1.0), (has_a == has_b).astype(float))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(ids: list, texts: list[str], following: list[str], part: int) -> pa.RecordBatch:
    """Result rows of documents and the documents that follow them."""
    n = len(texts)
    changed = [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
    own = [t.encode() for t in texts]
    chained = n > 1 and all(a is b for a, b in zip(texts[1:], following[:-1], strict=True))
    after = [following[-1].encode()] if chained else [f.encode() for f in following]
    sig, has = signatures([*own, *changed, *after])
    a, b = slice(0, n), slice(n, 2 * n)
    c = np.r_[1:n, 2 * n] if chained else np.r_[2 * n : 3 * n]
    prints = packed_bits(sig[: 2 * n])
    prints = [p if h else b"" for p, h in zip(prints, has[: 2 * n], strict=True)]
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array([part] * n, pa.int64()), "kind": pa.array([0] * n, pa.int32()), "doc_id": pa.array(ids, pa.int64()),
            "text": pa.nulls(n, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(x).hexdigest() for x in changed], "fingerprint": pa.array(prints[:n], pa.binary()),
            "edited_fingerprint": pa.array(prints[n:], pa.binary()), "near_edited": likeness(sig[a], sig[b], has[a], has[b]),
            "near_next": likeness(sig[a], sig[c], has[a], has[c]),
        }
    )


def edge(part: int, kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    """The first (kind 2) or last (kind 1) document of a task, whose neighbour is in another one."""
    rest = {"edited_sha256": pa.nulls(1, pa.string()), "fingerprint": pa.nulls(1, pa.binary()), "edited_fingerprint": pa.nulls(1, pa.binary())}
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array([part], pa.int64()), "kind": pa.array([kind], pa.int32()), "doc_id": pa.array([doc_id], pa.int64()),
            "text": pa.array([text]), "n_chars": pa.nulls(1, pa.int64()), **rest, "near_edited": pa.nulls(1, pa.float64()),
            "near_next": pa.nulls(1, pa.float64()),
        }
    )


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness, in order of ids.

    The document that follows is the next by (id, hash of the text, text), null ids first; after the last
    comes the first, so a single document follows itself. Null texts count as empty. A text
    of fewer than five words is one shingle; a text without words has an empty fingerprint.
    The rows are range-partitioned once; a task reads its range in order, and only the last
    document of each task is joined to the first of the next. Other columns are not read.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(ranges, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, texts, size, first = [], [], 0, True
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if first:
                    yield edge(part, 2, key, body)
                    first = False
                ids.append(key)
                texts.append(body)
                size += len(body)
                if size >= SLICE_CHARS and len(ids) > 1:
                    yield compared(ids[:-1], texts[:-1], texts[1:], part)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield compared(ids[:-1], texts[:-1], texts[1:], part)
        if ids:
            yield edge(part, 1, ids[-1], texts[-1])

    done = cut(ordered.mapInArrow(run, ROWS))
    heads = done.where("kind = 2").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    after = done.where("kind = 2").select("part")  # a row for each task
    whole = Window.orderBy("part")
    after = after.select(
        "part", F.coalesce(F.lead("part").over(whole), F.min("part").over(whole)).alias("next_part")
    )
    open_ends = done.where("kind = 1").select("part", "doc_id", "text").join(after, "part").join(heads, "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, body, following = (batch.column(c)[i].as_py() for c in ("doc_id", "text", "next_text"))
                yield compared([key], [body], [following], 0)

    closed = open_ends.select("doc_id", "text", "next_text").mapInArrow(close, ROWS)
    rows = done.where("kind = 0").unionByName(closed).drop("part", "kind", "text")
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
