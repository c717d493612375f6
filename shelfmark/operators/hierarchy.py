"""Heading levels, section paths and group roots.

The heading stack of a document is six running maxima: slot L holds the last
title of level L, and it is still open as long as no shallower slot holds a
later title. So paths need no recursion and no per-document loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.session import cut
from shelfmark.operators.scan import running

MAX_LEVEL = 6
# Provider levels count only for at most this many titles, and
# only when they cover this share of them.
MAX_TITLES = 120
MIN_COVERAGE = 0.6
# Numbering patterns of headings.
CN_NUMBER = "[一二三四五六七八九十百零〇\\d]+"
NUMBERED = r"^\s*(\d+(?:\.\d+)*)"
CHAPTER = rf"^\s*第{CN_NUMBER}\s*[章篇部]"
SECTION = rf"^\s*第{CN_NUMBER}\s*节"
ENUMERATED = r"^\s*[一二三四五六七八九十]+\s*[、.．]"
PARENTHESISED = r"^\s*[（(]\s*\d+\s*[)）]"
CIRCLED = r"^\s*[①②③④⑤⑥⑦⑧⑨⑩⑪⑫]"


def heuristic_level(title: Column) -> Column:
    """Level from the numbering in front of a heading."""
    number = F.regexp_extract(title, NUMBERED, 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return (
        F.when(number != "", F.least(dots + 1, F.lit(MAX_LEVEL)))
        .when(title.rlike(CHAPTER), 1)
        .when(title.rlike(SECTION), 2)
        .when(title.rlike(PARENTHESISED) | title.rlike(CIRCLED), 3)
        .when(title.rlike(ENUMERATED), 1)
        .otherwise(1)
        .cast("int")
    )


def assign_levels(blocks: DataFrame, provider_levels: DataFrame | None = None, max_titles: int = MAX_TITLES) -> DataFrame:
    """Write heading levels back to ``metadata.title_level``.

    ``provider_levels(doc_id, i, level)`` numbers the non-blank titles of a
    document from 0. Documents with at most one such title stay as they are. Given levels of
    documents with more than ``max_titles`` titles are not used; ``generation.title_levels`` counts them.
    """
    titled = (F.col("type") == "title") & ~text.blank(F.col("text"))
    numbered = running(
        blocks, ["doc_id"], "order_in_doc", {"_i": ("sum", F.when(titled, 1).otherwise(0))}
    )
    totals = blocks.where(titled).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = numbered.join(totals, "doc_id", "left")
    guess = heuristic_level(text.strip(F.col("text")))
    if provider_levels is not None:
        levels = (
            provider_levels.where(F.col("level").isNotNull())
            .join(totals, "doc_id")
            .where((F.col("i") >= 0) & (F.col("i") < F.col("_n")) & (F.col("_n") <= max_titles))
            .groupBy("doc_id", "i", "_n")
            .agg(F.max(F.least(F.greatest("level", F.lit(1)), F.lit(MAX_LEVEL))).alias("_level"))
        )
        trusted = (
            levels.groupBy("doc_id", "_n").agg(F.count(F.lit(1)).alias("_have"))
            .where(F.col("_have") >= F.col("_n") * MIN_COVERAGE).select("doc_id")
        )
        levels = levels.join(trusted, "doc_id", "left_semi").select(
            "doc_id", (F.col("i") + 1).cast("long").alias("_i"), F.lit(True).alias("_title"), "_level"
        )
        joined = joined.withColumn("_title", titled).join(levels, ["doc_id", "_i", "_title"], "left")
        guess = F.coalesce(F.col("_level"), guess)
    level = F.when(titled & (F.coalesce("_n", F.lit(0)) > 1), guess.cast("int")).otherwise(
        F.col("metadata.title_level")
    )
    return joined.withColumn("metadata", F.col("metadata").withField("title_level", level)).select(
        *blocks.columns
    )


def _root_id() -> Column:
    return F.concat(F.lit("sec-root-"), F.col("doc_id"))


def section_key(order: Column) -> Column:
    return F.concat(F.lit("sec-"), F.col("doc_id"), F.lit("-"), order)


def with_sections(blocks: DataFrame) -> DataFrame:
    """Add ``section_path``, ``section_id`` and ``header_path`` to every block.

    ``section_path`` lists the open headings as (level, ord, title). Auxiliary
    blocks inherit the section that is open where they stand.
    """
    level = F.greatest(
        F.lit(1),
        F.least(F.coalesce(F.nullif(F.col("metadata.title_level"), F.lit(0)), F.lit(1)), F.lit(MAX_LEVEL)),
    )
    opens = (F.col("role") == "main") & (F.col("type") == "title")
    slots = {
        f"_slot{n}": (
            "max",
            F.when(
                opens & (level == n),
                F.struct(
                    F.col("order_in_doc").alias("ord"),
                    F.lit(n).alias("level"),
                    F.col("text").alias("title"),
                ),
            ),
        )
        for n in range(1, MAX_LEVEL + 1)
    }
    state = running(blocks, ["doc_id"], "order_in_doc", slots)
    live = []
    for n in range(1, MAX_LEVEL + 1):
        slot = F.col(f"_slot{n}")
        above = [F.coalesce(F.col(f"_slot{m}.ord"), F.lit(-1)) for m in range(1, n)]
        top = F.greatest(*above) if len(above) > 1 else (above[0] if above else F.lit(-1))
        live.append(F.when(slot.isNotNull() & (slot["ord"] > top), slot))
    path = F.filter(F.array(*live), lambda s: s.isNotNull())
    out = state.withColumn("section_path", path)
    last = F.try_element_at("section_path", F.lit(-1))
    return out.select(
        *blocks.columns,
        "section_path",
        F.coalesce(section_key(last["ord"]), _root_id()).alias("section_id"),
        F.transform("section_path", lambda s: s["title"]).alias("header_path"),
    )


def sections(blocks: DataFrame) -> DataFrame:
    """Section rows of blocks that carry a ``section_path``; one root per document.

    Auxiliary blocks widen the page span of the section they stand in.
    """
    spans = blocks.groupBy("doc_id", "section_id").agg(
        F.min("page_idx").alias("page_start"), F.max("page_idx").alias("page_end")
    )
    depth = F.size("section_path")
    own, above = F.element_at("section_path", -1), F.try_element_at("section_path", F.lit(-2))
    titles = blocks.where((F.col("role") == "main") & (F.col("type") == "title")).select(
        "doc_id",
        "section_id",
        F.coalesce(section_key(above["ord"]), _root_id()).alias("parent_section_id"),
        own["level"].alias("level"),
        own["title"].alias("title"),
        "header_path",
        depth.alias("depth"),
        own["ord"].alias("sec_ord"),
        F.lit(False).alias("synthetic"),
    )
    roots = blocks.groupBy("doc_id").agg(F.lit(1).alias("_one")).select(
        "doc_id",
        _root_id().alias("section_id"),
        F.lit(None).cast("string").alias("parent_section_id"),
        F.lit(0).alias("level"),
        F.lit("").alias("title"),
        F.array().cast("array<string>").alias("header_path"),
        F.lit(0).alias("depth"),
        F.lit(-1).cast("long").alias("sec_ord"),
        F.lit(True).alias("synthetic"),
    )
    return titles.unionByName(roots).join(spans, ["doc_id", "section_id"], "left")


def section_children(secs: DataFrame) -> DataFrame:
    """Parent to child sections as rows, numbered in document order."""
    kids = secs.where(~F.col("synthetic")).select(
        F.col("doc_id"),
        F.col("parent_section_id"),
        F.col("section_id").alias("child_section_id"),
        F.col("sec_ord"),
    )
    counted = running(kids, ["doc_id", "parent_section_id"], "sec_ord", {"_n": ("sum", F.lit(1))})
    return counted.select(
        "doc_id", "parent_section_id", "child_section_id", (F.col("_n") - 1).alias("child_no")
    )


def section_tree(secs: DataFrame) -> DataFrame:
    """Rows of stored sections as a tree: ``depth``, ``is_root`` and ``in_cycle``.

    A section without a known parent is a root of depth 0, the others are one deeper than
    their parent. Stored sections may be dirty: those that no root reaches, because their
    parents run in a circle, are flat rows at the end (``in_cycle``). The tree is walked level
    by level, as many times as it is deep; levels are written, so lineage stays short.
    """
    own = secs.drop("depth")
    known = own.select("doc_id", F.col("section_id").alias("parent_section_id")).distinct()
    level = cut(
        own.join(known, ["doc_id", "parent_section_id"], "left_anti").select(*own.columns, F.lit(0).alias("depth"))
    )
    child = cut(own.join(known, ["doc_id", "parent_section_id"], "left_semi").select(*own.columns))
    done, depth = level, 0
    while not child.isEmpty():
        depth += 1
        above = level.select("doc_id", F.col("section_id").alias("parent_section_id")).distinct()
        level = cut(child.join(above, ["doc_id", "parent_section_id"], "left_semi").select(*own.columns, F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        done = done.unionByName(level)
        child = cut(child.join(above, ["doc_id", "parent_section_id"], "left_anti").select(*own.columns))
    circles = child.withColumn("depth", F.lit(0))
    return done.withColumn("in_cycle", F.lit(False)).unionByName(circles.withColumn("in_cycle", F.lit(True))).withColumn(
        "is_root", (F.col("depth") == 0)
    )


def group_root(level: Column) -> Column:
    """Deepest open heading with a level of at most ``level``, or NULL for the root."""
    return F.try_element_at(
        F.filter("section_path", lambda s: s["level"] <= F.greatest(F.lit(1), level)), F.lit(-1)
    )


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Lines of Markdown documents as blocks: headings as titles, the rest as paragraphs."""
    # Fixed value: a heading line.
    heading = r"^(#{1,6})\s+(.*\S)\s*$"
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", r"\r\n|\r|\n", -1)).alias("line_no", "line"))
    hashes = F.regexp_extract("line", heading, 1)
    is_title = hashes != ""
    return lines.where(F.col("line").isNotNull()).select(
        "doc_id",
        F.lit(0).alias("page_idx"),
        F.col("line_no").cast("long").alias("order_in_doc"),
        F.when(is_title, "title").otherwise("paragraph").alias("type"),
        F.lit("main").alias("role"),
        F.when(is_title, text.strip(F.regexp_extract("line", heading, 2))).otherwise(F.col("line")).alias("text"),
        F.struct(F.when(is_title, F.length(hashes)).alias("title_level")).alias("metadata"),
    )
