"""Product codes of vectors: integer codebooks by Lloyd rounds, nearest entries found by LAESA.

A vector is cut into parts, each with a codebook of its own. Every part keeps its distances to a
few fixed pivots, which are computed once. In each round the distances of the entries to the same
pivots give, by the triangle inequality, a lower bound for every part and entry; entries are tried
in the order of their bounds, exactly and in integers, until the bound passes the best distance.

Only the codebooks (parts x entries x components) travel between driver and tasks. A task sums its
rows, groups of tasks add up their sums, and the driver divides at most ``FAN`` of them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import cut

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
PIVOTS = 4
FAN = 64
ROWS = 1 << 14
#: Relative error of a stored pivot distance (32-bit float), with room to spare.
SLACK = 1e-6
TOP = 2**63 - 1


def whole(values: np.ndarray) -> np.ndarray:
    """Whole floats as integers of 64 bits, or as Python integers where squared distances would not fit."""
    top = np.abs(values).max(initial=0)
    if 4 * top * top * max(1, values.shape[-1] * PARTS) < 2**62:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()] or [], object).reshape(values.shape)


def kept(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that are kept and their scaled components, filled up with zeros to ``width``."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    held = np.maximum(sizes, 0)
    row = np.repeat(np.arange(len(sizes)), held)
    place = np.arange(len(values)) - (np.cumsum(held) - held)[row]
    bad = sizes < 0
    bad[row[~np.isfinite(values)]] = True
    out = np.zeros((len(sizes), width))
    out[row, place] = values
    rows, top = np.flatnonzero(~bad), np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return rows, np.clip(np.floor(out[rows] * SCALE), -top, top)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def pivots_of(entries: np.ndarray, n: int) -> np.ndarray:
    """Entries far from each other: the first, then always the one farthest from those chosen."""
    chosen = [0]
    while len(chosen) < n:
        near = np.min([squared(entries, entries[c]) for c in chosen], axis=0)
        chosen.append(int(np.argmax(near)))
    return entries[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, its exact squared distance, and how many distances were evaluated.

    ``to_pivots`` holds the distances of the rows to the pivots. Ties go to the lower index: an
    entry is passed over only where its bound is above the best distance.
    """
    there = roots(squared(entries[None], pivots[:, None]))
    mine = to_pivots.astype(np.float64)[:, :, None]
    bound = np.abs(mine - there) - SLACK * (mine + there)
    bound[~np.isfinite(bound)] = 0
    bound = np.maximum(bound.max(axis=1), 0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    chosen = order[:, 0].copy()
    best = squared(x, entries[chosen])
    rows, tried = np.arange(len(x)), len(x)
    for r in range(1, len(entries)):
        rows = rows[bound[rows, order[rows, r]] <= best[rows].astype(np.float64) * (1 + SLACK)]
        if not len(rows):
            break
        entry = order[rows, r]
        d = squared(x[rows], entries[entry])
        tried += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (entry < chosen[rows]))
        best[rows[better]], chosen[rows[better]] = d[better], entry[better]
    return chosen, best, tried


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of equal size from a binary column."""
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), kind)


def by_part(values: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(values, parts, axis=1)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def assigned(batch: pa.RecordBatch, books: list[np.ndarray], pivots: list[np.ndarray]) -> Iterator[tuple]:
    """Components, nearest entries and squared distances of the rows, part by part."""
    xs = by_part(whole(matrix(batch.column("parts"), np.float64)), len(books))
    distances = by_part(matrix(batch.column("pivots"), np.float32), len(books))
    for x, d, book, pivot in zip(xs, distances, books, pivots, strict=True):
        yield (x, *nearest(x, d, book, pivot)[:2])


def sums(total: list | None, new: list) -> list:
    """Two nested lists of integers added up."""
    if total is None:
        return new
    return [sums(a, b) if isinstance(a, list) else a + b for a, b in zip(total, new, strict=True)]


def added(parts: DataFrame) -> list | None:
    """The sum of nested lists of integers (``body``, as JSON), added in groups of tasks first."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for body in table.column("body").to_pylist():
            total = sums(total, json.loads(body))
        return pa.table({"body": [json.dumps(total)]})

    groups = parts.groupBy((F.spark_partition_id() % FAN).alias("g")).applyInArrow(add, "body string")
    total = None
    for row in groups.collect():
        total = sums(total, json.loads(row.body))
    return total


def updated(blocks: DataFrame, books: list[np.ndarray], pivots: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: floors of the means of the assigned parts; unused entries stay."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches):
            mine = []
            for (x, chosen, _), book in zip(assigned(batch, books, pivots), books, strict=True):
                by_entry = np.zeros(book.shape, x.dtype)
                np.add.at(by_entry, chosen, x)
                mine.append([[np.bincount(chosen, minlength=len(book)).tolist()], by_entry.tolist()])
            total = sums(total, mine)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"body": [json.dumps(total)]})

    out = []
    for book, ((counts,), by_entry) in zip(books, added(blocks.mapInArrow(partial, "body string")), strict=True):
        new = [[s // n for s in row] if n else old for row, n, old in zip(by_entry, counts, book.tolist(), strict=True)]
        out.append(integers(new, book.shape))
    return out


def integers(rows: list, shape: tuple) -> np.ndarray:
    exact = np.empty(shape, object)
    exact[:] = rows
    small = max((abs(v) for v in exact.ravel()), default=0) < 2**52
    return whole(exact.astype(np.float64)) if small else exact


def coded(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, n_pivots: int = PIVOTS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors (id, label, ``codes`` as bytes, ``error``) and the codebooks.

    A vector that is null or holds a null or non-finite component is dropped. Shorter vectors are
    filled up with zeros to the longest one, and that to a multiple of ``parts``. The first
    entries come from the smallest ids (equal ids: smaller vectors first; null ids last); with
    fewer rows a codebook has fewer entries, and an empty table gives none and no rows. Rows with
    equal or null ids are coded one by one. Components of any finite size are exact; ``error``
    stops at 2**63 - 1. Other columns are not read. The coded rows are a written table.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    good = rows.where(F.col("vector").isNotNull() & F.forall("vector", finite))
    width = parts * -(-(good.agg(F.max(F.size("vector"))).first()[0] or 0) // parts)
    seeds = good.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    out = T.StructType(
        [rows.schema["vec_id"], rows.schema["label"], T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())]
    )
    if not seeds:
        return vectors.sparkSession.createDataFrame([], out), []
    first = kept(pa.array([s.vector for s in seeds], pa.list_(pa.float64())), width)[1]
    books = by_part(whole(first), parts)
    pivots = [pivots_of(book, n_pivots) for book in books]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held, values = kept(batch.column("vector"), width)
            far = [roots(squared(x[:, None], p[None])) for x, p in zip(by_part(whole(values), parts), pivots, strict=True)]
            with np.errstate(over="ignore"):
                far = np.concatenate(far, axis=1).astype(np.float32)
            place = pa.array(held)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(place), batch.column("label").take(place),
                    pa.array([v.tobytes() for v in values], pa.binary()), pa.array([d.tobytes() for d in far], pa.binary()),
                ],
                names=["vec_id", "label", "parts", "pivots"],
            )

    held = T.StructType([*out.fields[:2], T.StructField("parts", T.BinaryType()), T.StructField("pivots", T.BinaryType())])
    blocks = cut(rows.mapInArrow(store, held))
    for _ in range(rounds):
        books = updated(blocks.select("parts", "pivots"), books, pivots)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            chosen, error = [], 0
            for _, entry, best in assigned(batch, books, pivots):
                chosen.append(entry)
                error = error + best.astype(object) if best.dtype == object else error + best
            codes = np.stack(chosen, axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array([min(int(e), TOP) for e in error], pa.int64()),
                ],
                names=["vec_id", "label", "codes", "error"],
            )

    return cut(blocks.mapInArrow(finish, out)), books


def book_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of all entries, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, **names: str) -> DataFrame:
    """Codes in hex, errors, and the error summed over equal labels (nulls together), which stops at 2**63 - 1."""
    rows, books = coded(vectors, **names)
    by_label = cut(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total")))
    by_label = by_label.select(F.col("label").alias("same"), F.least("total", F.lit(TOP).cast("decimal(20,0)")).cast("long").alias("label_error"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("same"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256")
    )


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, by all distances, for tables of vectors of one size that divides into the parts."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, len(embedding) // {parts} AS w,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""x AS MATERIALIZED (
  SELECT r, p, i, q[p * w + i + 1] AS val FROM v, range({parts}) a(p), LATERAL (SELECT unnest(range(w)) AS i) b)""",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, val FROM x WHERE r <= {entries})",
    ]
    for t in range(rounds + 1):
        steps.append(f"""d{t} AS (
  SELECT r, p, e, sum((x.val - c.val) * (x.val - c.val)) AS d FROM x JOIN c{t} c USING (p, i) GROUP BY ALL)""")
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT r, p, CAST(min(d * {entries} + e) % {entries} AS BIGINT) AS e, CAST(min(d * {entries} + e) // {entries} AS BIGINT) AS d
  FROM d{t} GROUP BY ALL)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT p, e, i, CAST(coalesce(m.val, c.val) AS BIGINT) AS val FROM c{t} c LEFT JOIN (
    SELECT p, a.e, i, floor(sum(val) / count(*)) AS val FROM x JOIN a{t} a USING (r, p) GROUP BY ALL) m USING (p, e, i))""")
    last = rounds
    return f"""WITH {", ".join(steps)},
f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{last}) AS codebooks_sha256
FROM v JOIN f USING (r)"""
