"""Exact cosine top-k.

Vectors are scored where they lie, a batch at a time against a block of
queries, and only the best ``k`` rows per query and task leave the task. A
block of queries has about ``QUERY_BLOCK`` rows; more queries are more passes
over the vectors, which are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.session import cut

QUERY_BLOCK = 4096
SCORE_DIGITS = 6
#: Scores that are held at once in a task.
SLAB = 400_000


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class Best:
    """The best ``k`` rows of every query among those added so far, ties by id."""

    def __init__(self, q_ids: np.ndarray, k: int) -> None:
        self.q_ids, self.k = q_ids, k
        self.least = np.full(len(q_ids), -np.inf)  # the k-th best score, once there is one
        self.kept = pd.DataFrame({"q": np.zeros(0, np.int64), "chunk_id": [], "score": np.zeros(0)})

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` is a block of (rows, queries); entries that are not finite are no hits."""
        order = np.argsort(ids, kind="stable")
        scores, ids = scores[order], ids[order]
        least = self.least
        if len(ids) > self.k and not np.isfinite(least).all():
            full = np.where(np.isfinite(scores), scores, -np.inf)
            least = np.maximum(least, np.partition(full, -self.k, axis=0)[-self.k])
        q, row = np.nonzero((np.isfinite(scores) & (scores >= least)).T)
        if not len(q):
            return
        score = scores[row, q]
        at = np.lexsort((row, -score, q))
        at = at[_place(q[at]) < self.k]
        found = pd.DataFrame({"q": q[at], "chunk_id": ids[row[at]], "score": score[at]})
        both = pd.concat([self.kept, found], ignore_index=True) if len(self.kept) else found
        both = both.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True], ignore_index=True)
        place = _place(both["q"].to_numpy())
        last = both[place == self.k - 1]
        self.least[last["q"].to_numpy()] = last["score"].to_numpy()
        self.kept = both[place < self.k]

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if len(self.kept):
            kept = self.kept
            out = pd.DataFrame({"query_id": self.q_ids[kept["q"].to_numpy()], "chunk_id": kept["chunk_id"].to_numpy(), "score": kept["score"].to_numpy()})
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)


def _place(groups: np.ndarray) -> np.ndarray:
    """The place of every row in its group; rows of a group are neighbours."""
    n = np.arange(len(groups))
    first = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)
    return n - np.maximum.accumulate(np.where(first, n, 0))


def rows_of(column: pa.Array) -> np.ndarray:
    """Vectors of a batch, all of one length, as a matrix; they are lists of numbers or packed (``providers.packed_vectors``)."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(column.buffers()[2], "<f4", (ends[-1] - ends[0]) // 4, ends[0])
        return flat.reshape(len(column), -1).astype(np.float64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def hit_schema(queries: DataFrame, rows: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", rows.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def top_cosine(
    queries: DataFrame, vectors: DataFrame, k: int, *, same: str | None = None, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """Best ``k`` vectors per query by cosine, ties by id.

    ``queries(query_id, embedding)``, ``vectors(chunk_id, embedding)``; with
    ``same`` both carry that column and only equal values are compared.
    """
    extra = [same] if same else []
    q = cut(queries.select("query_id", "embedding", *extra))
    v = vectors.select("chunk_id", "embedding", *extra)
    schema = hit_schema(q, v)
    found = None
    for block in query_blocks(q, query_block):
        part = _passed(block, v, k, same, schema)
        found = part if found is None else found.unionByName(part)
    return ranked(found, k)


def query_blocks(q: DataFrame, query_block: int = QUERY_BLOCK) -> Iterator[DataFrame]:
    """A table of queries in pieces of about ``query_block`` queries."""
    blocks = max(1, -(-q.select("query_id").distinct().count() // query_block))
    for i in range(blocks):
        yield q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of what the tasks found, written once: a short list that later joins see the size of."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    best = found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return cut(best.withColumn("rank", F.col("_rn") - 1).drop("_rn"))


def _passed(q: DataFrame, v: DataFrame, k: int, same: str | None, schema: T.StructType) -> DataFrame:
    """One pass over the vectors with one block of queries, which travels with the task."""
    local = q.toPandas()  # a block
    if local.empty:
        return q.sparkSession.createDataFrame([], schema)
    q_ids, q_unit = local["query_id"].to_numpy(), _unit(_matrix(local["embedding"]))
    q_same = local[same].to_numpy() if same else None
    step = max(1, SLAB // len(q_ids))
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(q_ids, k)
        for batch in batches:
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), step):
                part = batch.slice(at, step)
                scores = np.round(_unit(rows_of(part.column("embedding"))) @ q_unit.T, SCORE_DIGITS)
                if same is not None:
                    scores[part.column(same).to_numpy(zero_copy_only=False)[:, None] != q_same[None, :]] = -np.inf
                best.add(scores, ids[at : at + step])
        yield from best.rows(arrow)

    return v.mapInArrow(scan, schema)


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector per group as a query set, summed inside tasks before the shuffle."""
    parts = vectors.select(by, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding")
    )
