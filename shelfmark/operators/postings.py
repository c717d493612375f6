"""Term postings and corpus statistics as ordinary tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text

# Fixed values of the ranking function.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6


def tokenized(
    chunks: DataFrame, id_col: str = "child_chunk_id", text_col: str = "embedding_text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """(chunk_id, doc_id, toks, doc_len): tokens of every chunk in text order."""
    rest = [c for c in keep if c in chunks.columns and c != id_col]
    return chunks.select(
        F.col(id_col).alias("chunk_id"), *rest, text.tokens(F.col(text_col)).alias("toks")
    ).withColumn("doc_len", F.size("toks"))


def postings(toks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, chunk_id, tf, doc_len).

    ``terms`` limits the rows to the terms a batch of queries asks for before
    anything is shuffled; statistics of those terms stay those of the corpus.
    """
    rows = toks.select("chunk_id", "doc_len", F.explode_outer("toks").alias("term")).where(
        F.col("term").isNotNull()
    )
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("chunk_id", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len")
    )


def corpus_totals(toks: DataFrame) -> DataFrame:
    """One row: number of chunks and their average length."""
    return toks.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        (F.sum("doc_len") / F.count(F.lit(1))).alias("avg_len"),
    )


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def term_weight(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def scalars(totals: DataFrame) -> Column:
    """The single row of ``totals`` as one struct, read as a scalar subquery."""
    return totals.select(F.struct(*totals.columns)).scalar()


def term_statistics(posts: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf, avg_len): the corpus totals ride along with each term."""
    return weights(document_frequency(posts), totals)


def weights(frequency: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf, avg_len) from the frequencies of terms."""
    return frequency.withColumn("_t", scalars(totals)).select(
        "term", "df", idf(F.col("_t.n_chunks"), F.col("df")).alias("idf"), F.col("_t.avg_len").alias("avg_len")
    )


def positions(toks: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_id, doc_len, tf, positions) of tokenised chunks, made where the chunks lie."""
    kind = lambda c: toks.schema[c].dataType
    schema = T.StructType([
        T.StructField("term", T.StringType()), *[T.StructField(c, kind(c)) for c in ("chunk_id", "doc_id", "doc_len")],
        T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType())),
    ])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("toks")
            lens = np.diff(column.offsets.to_numpy())
            row, words = np.repeat(np.arange(len(lens)), lens), column.flatten().dictionary_encode()
            if not len(row):
                continue
            spot = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
            key = row * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
            ends = np.r_[first, len(key)].astype(np.int32)
            at, term = pa.array(row[order[first]]), pa.array(key[order[first]] % len(words.dictionary))
            yield pa.RecordBatch.from_arrays(
                [
                    words.dictionary.take(term), *[batch.column(c).take(at) for c in ("chunk_id", "doc_id", "doc_len")],
                    pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(spot[order].astype(np.int32))),
                ],
                names=schema.names,
            )

    return toks.select("chunk_id", "doc_id", "doc_len", "toks").mapInArrow(made, schema)
