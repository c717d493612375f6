"""Model calls as batched stages.

A provider is any object with the method its stage names. It runs inside tasks,
gets at most a batch of rows at once, and a failing call marks its rows instead
of failing the job. The defaults are deterministic and need no network.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators.model_stage import BATCH, asked
from shelfmark.session import cut

# Batch and input sizes of the stages.
EMBED_BATCH = 10
CODE_INPUT = 3000
FORMULA_INPUT = 1000
FORMULA_NOTE = 300
VECTOR_SIZE = 256


class Embedder(Protocol):
    def embed(self, texts: list[str], text_type: str) -> np.ndarray: ...


class Describer(Protocol):
    def describe(self, kind: str, content: str) -> str: ...


def token_vectors(toks: Column, size: int = VECTOR_SIZE, packed: bool = False) -> Column:
    """Signed counts of tokens by hashed slot, whole numbers so that sums are exact; cosine search divides by their lengths.

    ``packed`` gives the 32-bit numbers of a vector as bytes.
    """

    def slot(token: str) -> int:
        """The slot of a token, or -1 minus it."""
        digest = hashlib.md5(token.encode()).hexdigest()
        at = int(digest[:4], 16) % size
        return at if int(digest[4], 16) % 2 == 0 else -1 - at

    @F.arrow_udf("binary" if packed else "array<float>")
    def vectors(rows: pa.Array) -> pa.Array:
        words, n = rows.flatten().dictionary_encode(), len(rows)
        slots = np.array([slot(w) for w in words.dictionary.to_pylist()] or [0], np.int64)[words.indices.to_numpy()]
        at, sign = np.where(slots < 0, -1 - slots, slots), np.where(slots < 0, -1.0, 1.0)
        cell = np.repeat(np.arange(n), np.diff(rows.offsets.to_numpy())) * size + at
        out = np.bincount(cell, sign, minlength=n * size).astype(np.float32)
        ends = np.arange(0, (n + 1) * size, size, dtype=np.int32)
        return packed_rows(out, 4 * ends) if packed else pa.ListArray.from_arrays(ends, pa.array(out))

    return vectors(toks)


def packed_rows(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Vectors, one behind the other, as bytes; ``ends`` counts these."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(numbers.astype("<f4"))])


def packed_vectors(vectors: Column) -> Column:
    """The 32-bit numbers of each vector as bytes: a vector is one value to write and to read."""

    @F.arrow_udf("binary")
    def pack(rows: pa.Array) -> pa.Array:
        lens = np.where(rows.is_valid().to_numpy(zero_copy_only=False), rows.value_lengths().fill_null(0).to_numpy(), 0)
        return packed_rows(rows.flatten().to_numpy(zero_copy_only=False), 4 * np.r_[0, np.cumsum(lens)])

    return pack(vectors)


def embed(
    df: DataFrame, text_col: str, provider: Embedder | None = None,
    *, text_type: str = "document", batch: int = EMBED_BATCH,
) -> DataFrame:
    """Add ``embedding``; row and vector stay together, so their counts cannot differ.

    Without a provider the vector is that of the hashed search tokens (``token_vectors``).
    """
    if provider is None:
        return df.withColumn("embedding", token_vectors(text.tokens(F.col(text_col))))
    model = provider

    @F.pandas_udf("array<float>")
    def vectors(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            values = texts.fillna("").tolist()
            rows = []
            for start in range(0, len(values), batch):
                part = values[start : start + batch]
                got = np.asarray(model.embed(part, text_type), dtype=np.float32)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                rows.extend(got)
            yield pd.Series(rows)

    return df.withColumn("embedding", vectors(F.col(text_col)))


class EchoDescriber:
    """Describes a block by its first words."""

    def describe(self, kind: str, content: str) -> str:
        words = re.sub(r"<[^>]+>", " ", content).split()
        note = f"{kind}: " + " ".join(words[:12])
        return f"[功能说明]: {note}\n[核心代码]: {content[:60]}" if kind == "code" else note


class OneByOne:
    """A describer of single blocks as a model of the stage; one that has ``answer`` is taken as it is."""

    def __init__(self, provider: Describer) -> None:
        self.provider = provider

    def answer(self, kind: str, texts: list[str]) -> list[str]:
        many = getattr(self.provider, "answer", None)
        return many(kind, texts) if many else [self.provider.describe(kind, t) for t in texts]


def describe(blocks: DataFrame, provider: Describer | None = None, batch: int | None = None, keep: str | None = None) -> DataFrame:
    """(doc_id, block_id, status, enriched_text) for image, table, code and formula blocks.

    Only images whose asset is a plain image are described, not charts. A failed
    call gives ``partial_failed``, a block without input ``skipped``. Equal inputs are
    described once; a provider with ``answer(kind, texts)`` gets them in batches.
    """
    model = provider or EchoDescriber()
    batch = batch or (BATCH if hasattr(model, "answer") else 1)
    kind, body = F.col("type"), F.col("text")
    image = F.try_element_at(
        F.filter("assets", lambda a: (a["asset_type"] == "image") & (F.coalesce(a["path"], F.lit("")) != "")),
        F.lit(1),
    )["path"]
    markup = F.coalesce("metadata.table_html", F.lit(""))
    ask = (
        F.when(kind == "image", image)
        .when(kind == "table", F.when(markup != "", markup).otherwise(F.nullif(body, F.lit(""))))
        .when(kind == "code", F.substring(text.strip(body), 1, CODE_INPUT))
        .when(kind == "equation", F.substring(text.strip(body), 1, FORMULA_INPUT))
    )
    wanted = blocks.where(
        kind.isin("image", "table") | (kind.isin("code", "equation") & ~text.blank(body))
    ).select("doc_id", "block_id", "type", "text", ask.alias("ask"))

    # The rows are written once: they are reduced to distinct inputs and joined to the answers.
    answered = asked(cut(wanted), F.col("type"), F.col("ask"), OneByOne(model), batch=batch, keep=keep)
    note = text.labelled_note(F.col("answer"), text.strip(F.col("text")))
    filled = lambda label, c: F.when(c != "", F.concat(F.lit(f"[{label}]: "), c))
    nonempty = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    formula = text.strip(F.col("text"))
    made = (
        F.when(
            F.col("type").isin("image", "table"),
            F.concat_ws("\n", nonempty(F.col("text")), nonempty(F.col("answer"))),
        )
        .when(
            F.col("type") == "code",
            F.concat_ws("\n", filled("代码功能说明", note["summary"]), filled("核心代码", note["core"])),
        )
        .otherwise(
            F.concat(
                F.lit("[数学公式]: "), formula, F.lit("\n[公式含义]: "),
                F.substring(text.strip(F.col("answer")), 1, FORMULA_NOTE),
            )
        )
    )
    failed_formula = F.when(F.col("type") == "equation", F.concat(F.lit("[数学公式]: "), formula))
    return answered.select(
        "doc_id", "block_id", "type", "status",
        F.when(F.col("status") == "ok", made)
        .when(F.col("status") == "partial_failed", failed_formula)
        .alias("enriched_text"),
    )


def with_enrichment(blocks: DataFrame, described: DataFrame) -> DataFrame:
    """Blocks with ``enrichment`` (status, enriched_text), empty where no stage described them."""
    told = described.select("doc_id", "block_id", F.struct("status", "enriched_text").alias("enrichment"))
    return blocks.join(told, ["doc_id", "block_id"], "left")
