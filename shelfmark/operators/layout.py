"""Views of stored blocks for inspection: boxes, page furniture, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_boxes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The box around all boxes of a group; short boxes do not count."""
    box = F.col("bbox_norm1000")
    return rows.where(F.size(box) >= 4).groupBy(*keys).agg(
        F.array(F.min(box[0]), F.min(box[1]), F.max(box[2]), F.max(box[3])).alias("box")
    )


def page_auxiliaries(aux: DataFrame) -> DataFrame:
    """Header, footer, number and footnote texts per page, in page order."""
    names = {"headers": "page_header", "footers": "page_footer", "numbers": "page_number", "footnotes": "page_footnote"}
    return aux.groupBy("doc_id", "page_idx").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("order_in_doc", "text")))),
                lambda s: s["text"],
            ).alias(name)
            for name, kind in names.items()
        ]
    )


def block_view(blocks: DataFrame) -> DataFrame:
    """Blocks as an inspector shows them: plain boxes, asset ids, level and table markup."""
    box = lambda c: F.when(F.size(c) >= 4, F.slice(c, 1, 4)).otherwise(F.array().cast("array<double>"))
    described = F.col("description") if "description" in blocks.columns else F.lit("")
    return blocks.select(
        "doc_id", "block_id", "page_idx", "order_in_doc", "section_id", "header_path", "type", "role",
        F.coalesce("text", F.lit("")).alias("text"),
        box(F.col("bbox_norm1000")).alias("bbox_norm1000"), box(F.col("bbox_page")).alias("bbox_page"),
        F.transform("assets", lambda a: a["asset_id"]).alias("assets"),
        F.col("metadata.title_level").alias("title_level"), F.col("metadata.table_html").alias("table_html"),
        described.alias("vlm_description"),
    )
