"""Calls of a language or image model as a stage of a job.

Equal inputs are asked once: rows are reduced to distinct inputs by the hash of their content, these
go to the model in bounded batches inside tasks, and answers are joined back. A batch that fails is
asked again text by text, so an error marks the rows of its own text only. Answers are written before
they are used, so a recomputed task does not call the model again; with a folder they are kept for
later runs as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.session import cut
from shelfmark.sources import stores

BATCH = 16
#: Signs of input that one call takes at most, beyond its first text.
BATCH_CHARS = 60_000
ANSWERS = "key string, answer string, error string"


class Model(Protocol):
    def answer(self, kind: str, texts: list[str]) -> list[str]:
        """One answer a text, in order; ``kind`` names the task."""


def batches_of(texts: list[str], batch: int, chars: int = BATCH_CHARS) -> Iterator[slice]:
    """Places of at most ``batch`` texts that hold together at most ``chars`` signs (or one text)."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= batch or size + len(t) > chars):
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def called(model: Model, kind: str, texts: list[str]) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each text."""
    try:
        got = list(model.answer(kind, texts))
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} answers for {len(texts)} texts")
        return [(a, None) if isinstance(a, str) else (None, "no text") for a in got]
    except Exception as failed:  # the rows are marked, the job goes on
        if len(texts) == 1:
            return [(None, f"{type(failed).__name__}: {failed}"[:500])]
        return [r for t in texts for r in called(model, kind, [t])]


def asked(
    rows: DataFrame, kind: Column, ask: Column, model: Model, *, batch: int = BATCH, keep: str | None = None,
) -> DataFrame:
    """The rows with ``answer`` and ``status``.

    ``skipped`` has no input or a blank one, ``partial_failed`` a call that failed, ``ok`` an answer.
    ``keep`` names a folder of answers: what it holds is not asked again, new answers (not
    failures) are added. The order of rows and their number stay; rows may repeat.
    """
    key = F.sha2(F.concat_ws("\x00", kind, ask), 256)
    rows = rows.withColumns({"_kind": kind, "_ask": ask})
    rows = rows.withColumn("_key", F.when(F.col("_kind").isNotNull() & ~text.blank(F.col("_ask")), key))
    inputs = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.first("_kind").alias("kind"), F.first("_ask").alias("ask"))
    inputs = inputs.withColumnRenamed("_key", "key")
    known = None
    if keep is not None and stores.versions(rows.sparkSession, keep):
        known = stores.read_store(rows.sparkSession, keep, key="key")
        inputs = inputs.join(known.select("key"), "key", "left_anti")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for one_kind, part in pdf.groupby("kind", sort=True):
                texts, out = part["ask"].tolist(), []
                for place in batches_of(texts, batch):
                    out += called(model, str(one_kind), texts[place])
                yield pd.DataFrame({"key": part["key"].to_numpy(), "answer": [a for a, _ in out], "error": [e for _, e in out]})

    new = cut(inputs.mapInPandas(call, ANSWERS))
    if keep is not None:
        stores.replace_in_store(new.where("error IS NULL").select("key", "answer"), keep, key="key")
    every = new.select("key", "answer", "error")
    if known is not None:
        every = every.unionByName(known.select("key", "answer", F.lit(None).cast("string").alias("error")))
    status = F.when(F.col("_key").isNull(), "skipped").when(F.col("_error").isNotNull(), "partial_failed").otherwise("ok")
    given = every.select(F.col("key").alias("_key"), "answer", F.col("error").alias("_error"))
    return rows.drop("answer", "status").join(given, "_key", "left").withColumn("status", status).drop("_key", "_kind", "_ask", "_error")
