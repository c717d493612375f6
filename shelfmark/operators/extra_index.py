"""Extra index entries of parents that are searched like child chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text

# Kinds of entries.
KINDS = ("summary", "hypo_question", "image_desc", "table_desc", "custom")


def virtual_children(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """Enabled entries with a text, in the shape of child chunks."""
    live = entries.where(F.col("enabled") & ~text.blank(F.col("index_text")))
    about = parents.select("parent_chunk_id", "doc_id", "header_path")
    body = text.strip(F.col("index_text"))
    return about.join(live.select("parent_chunk_id", "index_id", "kind", "index_text"), "parent_chunk_id").select(
        F.concat(F.lit("ci-"), F.col("index_id")).alias("child_chunk_id"),
        "parent_chunk_id", "doc_id", "header_path",
        F.lit("paragraph").alias("chunk_type"),
        body.alias("embedding_text"), body.alias("retrieval_text"),
        F.col("kind").alias("index_kind"),
    )


def searchable(children: DataFrame, entries: DataFrame, parents: DataFrame) -> DataFrame:
    """Child chunks and virtual ones, so one search serves both."""
    cols = [
        "child_chunk_id", "parent_chunk_id", "doc_id", "header_path", "chunk_type", "embedding_text",
        "retrieval_text", "index_kind",
    ]
    return children.select(*cols).unionByName(virtual_children(entries, parents).select(*cols))


def question_text(answer: Column) -> Column:
    """Questions of a provider answer, one per line; NULL when there are none."""
    parsed = F.from_json(text.strip_code_fence(answer), "questions array<string>")
    kept = F.filter(F.transform(parsed["questions"], text.strip), lambda q: q != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def set_enabled(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes(index_id, enabled, index_text)``; NULL leaves a field as it is."""
    new = changes.select(
        "index_id", F.col("enabled").alias("_e"), F.col("index_text").alias("_t")
    )
    joined = entries.join(new, "index_id", "left")
    return joined.select(
        *[
            F.coalesce("_e", "enabled").alias("enabled") if c == "enabled"
            else F.coalesce("_t", "index_text").alias("index_text") if c == "index_text"
            else F.col(c)
            for c in entries.columns
        ]
    )


def listing(entries: DataFrame) -> DataFrame:
    return entries.orderBy("parent_chunk_id", "kind", "created_at", "index_id")
