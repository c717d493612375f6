"""Footnotes to their nearest main block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.scan import running

# Fixed values of a link.
ATTACH_MODE = "inline_append"
CONFIDENCE = 0.8


def nearest(
    rows: DataFrame, keys: list[str], order: str, is_anchor, is_note, carry: tuple[str, ...] = ()
) -> DataFrame:
    """For each note the anchor with the smallest distance, the earlier one on a tie.

    Only the last anchor before and the first one after can win, and both are
    running values of one pass; notes and anchors of a page never meet as pairs. The anchor's columns
    in ``carry`` come along as ``anchor_<name>``.
    """
    at = F.when(is_anchor, F.struct(F.col(order).alias("at"), *carry))
    both = running(rows, keys, order, {"_before": ("max", at)}, backward={"_after": ("min", at)})
    back, ahead = F.col(order) - F.col("_before.at"), F.col("_after.at") - F.col(order)
    earlier = F.col("_before").isNotNull() & (F.col("_after").isNull() | (back <= ahead))
    chosen = both.where(is_note).withColumn("_chosen", F.when(earlier, F.col("_before")).otherwise(F.col("_after")))
    return chosen.select(
        *rows.columns, F.col("_chosen.at").alias("anchor_order"), *[F.col(f"_chosen.{c}").alias(f"anchor_{c}") for c in carry]
    )


def link(blocks: DataFrame) -> DataFrame:
    """Footnote links; a footnote on a page without main blocks has none."""
    rows = blocks.where((F.col("role") == "main") | (F.col("type") == "page_footnote"))
    found = nearest(
        rows.select("doc_id", "page_idx", "order_in_doc", "block_id", "role", "type"),
        ["doc_id", "page_idx"],
        "order_in_doc",
        F.col("role") == "main",
        F.col("type") == "page_footnote",
        ("block_id",),
    ).where(F.col("anchor_order").isNotNull())
    return found.select(
        "doc_id",
        F.col("anchor_block_id").alias("block_id"),
        F.col("block_id").alias("footnote_block_id"),
        F.lit(ATTACH_MODE).alias("attach_mode"),
        F.lit(CONFIDENCE).alias("confidence"),
    )
