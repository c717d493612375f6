"""Parent chunks, child chunks and text-document chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.functions.windows import MAX_CHARS, pack
from shelfmark.operators import hierarchy
from shelfmark.operators.scan import joined_text, running

# Chunk texts of visual blocks.
ATOMIC = ("list", "code", "image", "table", "equation")
PLACEHOLDERS = ("[表格]", "[图片]", "[公式]")
DEFAULT_LEVEL = 1
PREVIEW = 200
TABLE_TEXT = 500


def effective_level(own: Column, default: int = DEFAULT_LEVEL) -> Column:
    """The level set on a document, or the default when it is unset or 0."""
    return F.when(F.coalesce(own, F.lit(0)) > 0, own).otherwise(F.lit(default))


def caption(kind: str, c: Column) -> Column:
    c = text.strip(c)
    return F.when(c != "", F.concat(F.lit(f"[{kind}: "), c, F.lit("]"))).otherwise(F.lit(f"[{kind}]"))


def grouped(blocks: DataFrame, level: Column | int = DEFAULT_LEVEL) -> DataFrame:
    """Main blocks with the parent chunk they belong to at heading level ``level``."""
    level = F.lit(level) if isinstance(level, int) else level
    root = hierarchy.group_root(level)
    ord_ = F.coalesce(root["ord"], F.lit(-1))
    return blocks.where(F.col("role") == "main").select(
        *blocks.columns,
        ord_.cast("long").alias("root_ord"),
        F.concat(F.lit("pc-"), F.col("doc_id"), F.lit("-"), ord_).alias("parent_chunk_id"),
        F.coalesce(hierarchy.section_key(root["ord"]), F.concat(F.lit("sec-root-"), F.col("doc_id"))).alias(
            "parent_section_id"
        ),
        F.coalesce(root["title"], F.lit("")).alias("parent_title"),
        F.transform(
            F.filter("section_path", lambda s: s["level"] <= F.greatest(F.lit(1), level)), lambda s: s["title"]
        ).alias("parent_path"),
    )


def parent_chunks(members: DataFrame) -> DataFrame:
    """One row per group with at least one block that is no title.

    Titles of groups without such a block move to the front of the next group
    that has one. ``members`` comes from :func:`grouped`.
    """
    keys = ["doc_id", "root_ord"]
    heads = members.groupBy(*keys).agg(
        F.bool_or(F.col("type") != "title").alias("_full"),
        F.first("parent_chunk_id").alias("parent_chunk_id"),
        F.first("parent_section_id").alias("section_id"),
        F.first("parent_path").alias("header_path"),
        F.first("parent_title").alias("title"),
        F.min("page_idx").alias("page_start"),
        F.max("page_idx").alias("page_end"),
        F.count(F.lit(1)).alias("block_count"),
        F.sum(F.size("assets")).alias("asset_count"),
    )
    target = running(
        heads.select(*keys, "_full"),
        ["doc_id"],
        "root_ord",
        {},
        backward={"_target": ("min", F.when(F.col("_full"), F.col("root_ord")))},
    ).where(F.col("_target").isNotNull())
    kind, body = F.col("type"), F.col("text")
    piece = (
        F.when(~F.col("_full"), F.when(kind == "title", text.strip(body)))
        .when(kind == "image", caption("图片", body))
        .when(kind == "table", caption("表格", body))
        .otherwise(body)
    )
    pieces = (
        members.select(*keys, "order_in_doc", "type", "text")
        .join(target, keys)
        .select("doc_id", F.col("_target").alias("root_ord"), "order_in_doc", piece.alias("piece"))
        .where(F.coalesce("piece", F.lit("")) != "")
    )
    full = joined_text(pieces, keys, "order_in_doc", "piece", "\n\n", "text_full")
    return (
        heads.where("_full")
        .join(full, keys, "left")
        .withColumn("text_full", F.coalesce("text_full", F.lit("")))
        .withColumn("text_preview", F.substring("text_full", 1, PREVIEW))
        .drop("_full")
    )


def parent_blocks(members: DataFrame) -> DataFrame:
    """Parent to block in reading order, as rows."""
    return members.select("doc_id", "parent_chunk_id", "block_id", "order_in_doc")


def parent_page_labels(members: DataFrame, aux: DataFrame) -> DataFrame:
    """Headers, footers and page numbers of a parent's pages, each text once, in page order."""
    pages = members.select("doc_id", "parent_chunk_id", "page_idx").distinct()
    kinds = ["page_header", "page_footer", "page_number"]
    seen = (
        pages.join(aux.where(F.col("kind").isin(kinds) & (F.col("text") != "")), ["doc_id", "page_idx"])
        .groupBy("doc_id", "parent_chunk_id", "kind", "text")
        .agg(F.min(F.struct("page_idx", "order_in_doc")).alias("at"))
    )
    lists = seen.groupBy("doc_id", "parent_chunk_id").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("at", "text")))),
                lambda s: s["text"],
            ).alias(k + "s")
            for k in kinds
        ]
    )
    return lists


def retrieval_text() -> Column:
    """What a block is found by, per type."""
    body, meta, kind = F.col("text"), F.col("metadata"), F.col("type")
    override = F.nullif(F.coalesce(meta["retrieval_text_override"], F.lit("")), F.lit(""))
    markup = F.coalesce(meta["table_html"], F.lit(""))
    plain = F.nullif(text.strip_html(markup), F.lit(""))
    table = (
        F.when(text.strip(body) != "", caption("表格", body))
        .when(markup != "", F.coalesce(F.substring(plain, 1, TABLE_TEXT), F.lit("[表格]")))
        .otherwise(F.lit("[表格]"))
    )
    formula = F.coalesce(F.nullif(meta["math_content"], F.lit("")), F.nullif(body, F.lit("")), F.lit("[公式]"))
    by_type = (
        F.when(kind == "image", caption("图片", body))
        .when(kind == "table", table)
        .when(kind == "equation", formula)
        .otherwise(text.strip(body))
    )
    return F.coalesce(override, by_type)


def block_windows(body: Column) -> Column:
    """A short text whole, a longer one as windows of its sentences."""
    sents = text.sentences(body)
    return F.when(F.length(body) <= MAX_CHARS, F.array(body)).otherwise(
        F.when(F.size(sents) > 0, pack(sents)).otherwise(pack(F.array(body)))
    )


def child_chunks(members: DataFrame, page_numbers: DataFrame | None = None) -> DataFrame:
    """Retrievable pieces of parents; a title is never one.

    Lists, code, images, tables and formulas stay whole, paragraphs are cut into
    windows. All of it is a projection of the block, so nothing is shuffled.
    """
    body = members.where(F.col("type") != "title").withColumn("_text", retrieval_text())
    atomic = F.col("type").isin(*ATOMIC)
    real_asset = F.exists("assets", lambda a: text.suffix(F.coalesce(a["path"], F.lit(""))) != "")
    keep = (F.col("_text") != "") & ~(
        atomic & F.col("_text").isin(*PLACEHOLDERS) & ~real_asset
    )
    body = body.where(keep).withColumn(
        "_windows", F.when(atomic, F.array("_text")).otherwise(block_windows(text.strip(F.col("text"))))
    )
    carried = [c for c in body.columns if c not in ("_windows", "_text", "text", "section_path")]
    cut = body.withColumn("_total", F.size("_windows")).select(
        *carried, "_total", F.posexplode_outer("_windows").alias("_no", "_piece")
    )
    path = F.when(F.size("header_path") > 0, F.col("header_path")).otherwise(F.col("parent_path"))
    split = F.col("_total") > 1
    out = cut.select(
        F.concat(
            F.lit("cc-"), F.col("doc_id"), F.lit("-"), F.col("order_in_doc"), F.lit("-"), F.col("_no")
        ).alias("child_chunk_id"),
        "parent_chunk_id",
        "doc_id",
        F.col("parent_section_id").alias("section_id"),
        path.alias("header_path"),
        F.when(atomic, F.col("type")).otherwise("paragraph").alias("chunk_type"),
        "page_idx",
        "block_id",
        "order_in_doc",
        F.array("bbox_norm1000").alias("bbox_norm1000"),
        F.when(F.col("bbox_page").isNotNull(), F.array("bbox_page"))
        .otherwise(F.array().cast("array<array<double>>"))
        .alias("bbox_page"),
        F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n"), F.col("_piece")))
        .otherwise(F.col("_piece"))
        .alias("embedding_text"),
        F.col("_piece").alias("retrieval_text"),
        F.when(atomic, F.transform("assets", lambda a: a["asset_id"]))
        .otherwise(F.array().cast("array<string>"))
        .alias("assets"),
        F.transform(
            F.filter("assets", lambda a: a["asset_type"].isin("image", "chart_image") & (a["path"] != "")),
            lambda a: a["path"],
        ).alias("asset_paths"),
        F.lit("").alias("index_kind"),
        F.when(atomic, F.col("metadata.code_language")).alias("code_language"),
        atomic.alias("is_atomic"),
        split.alias("is_atomic_fragment"),
        F.when(split, F.col("_no")).alias("fragment_index"),
        F.when(split, F.col("_total")).alias("fragment_total"),
    )
    if page_numbers is not None:
        out = out.join(page_numbers, ["doc_id", "page_idx"], "left")
    return out


def page_numbers(aux: DataFrame) -> DataFrame:
    """The printed numbers of each page, in page order."""
    rows = aux.where((F.col("kind") == "page_number") & (F.col("text") != ""))
    return rows.groupBy("doc_id", "page_idx").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("order_in_doc", "text"))), lambda s: s["text"]
        ).alias("page_numbers")
    )


def text_sections(docs: DataFrame) -> DataFrame:
    """Markdown documents by heading, other text documents as one section.

    Needs ``doc_id, text, source_format``. Section bodies are the lines between
    two headings; blank ones are dropped, and a document whose headings leave
    nothing is taken whole.
    """
    marked = docs.where(F.col("source_format") == "md")
    lines = hierarchy.with_sections(hierarchy.markdown_blocks(marked))
    last = F.try_element_at("section_path", F.lit(-1))
    body_lines = lines.where(F.col("type") != "title").select(
        "doc_id",
        F.coalesce(last["ord"], F.lit(-1)).cast("long").alias("sec_ord"),
        "header_path",
        "order_in_doc",
        "text",
    )
    bodies = joined_text(body_lines, ["doc_id", "sec_ord", "header_path"], "order_in_doc", "text", "\n", "body")
    by_heading = bodies.withColumn("body", text.strip(F.col("body"))).where(F.col("body") != "")
    whole = docs.where(F.col("source_format") != "md").select(
        "doc_id",
        F.lit(-1).cast("long").alias("sec_ord"),
        F.array().cast("array<string>").alias("header_path"),
        text.strip(F.col("text")).alias("body"),
    )
    bare = marked.join(by_heading.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id",
        F.lit(-1).cast("long").alias("sec_ord"),
        F.array().cast("array<string>").alias("header_path"),
        text.strip(F.col("text")).alias("body"),
    )
    return by_heading.unionByName(whole).unionByName(bare).where(F.col("body") != "")


def plain_sections(docs: DataFrame) -> DataFrame:
    """Text documents without headings: the whole text is one section."""
    return docs.select(
        "doc_id",
        F.lit(-1).cast("long").alias("sec_ord"),
        F.array().cast("array<string>").alias("header_path"),
        text.strip(F.col("text")).alias("body"),
    ).where(F.col("body") != "")


def text_parents(secs: DataFrame) -> DataFrame:
    return secs.select(
        F.concat(F.lit("pc-"), F.col("doc_id"), F.lit("-"), F.col("sec_ord")).alias("parent_chunk_id"),
        "doc_id",
        "header_path",
        F.coalesce(F.try_element_at("header_path", F.lit(-1)), F.lit("")).alias("title"),
        F.col("body").alias("text_full"),
        F.substring("body", 1, PREVIEW).alias("text_preview"),
    )


def text_children(secs: DataFrame) -> DataFrame:
    """Windows of section bodies: blank-line paragraphs, then sentences, then windows."""
    segs = text.segments(F.col("body"))
    windows = F.when(F.length("body") <= MAX_CHARS, F.array("body")).otherwise(pack(segs))
    # Counted before the explode, so that its rows need not carry the whole array.
    counted = secs.withColumn("_windows", windows).withColumn("_total", F.size("_windows"))
    cut = counted.select(
        "doc_id", "sec_ord", "header_path", "_total", F.posexplode_outer("_windows").alias("_no", "_piece")
    )
    split = F.col("_total") > 1
    return cut.select(
        F.concat(
            F.lit("cc-"), F.col("doc_id"), F.lit("-"), F.col("sec_ord"), F.lit("-"), F.col("_no")
        ).alias("child_chunk_id"),
        F.concat(F.lit("pc-"), F.col("doc_id"), F.lit("-"), F.col("sec_ord")).alias("parent_chunk_id"),
        "doc_id",
        "header_path",
        F.lit("paragraph").alias("chunk_type"),
        F.when(
            F.size("header_path") > 0, F.concat(F.array_join("header_path", " > "), F.lit("\n"), F.col("_piece"))
        ).otherwise(F.col("_piece")).alias("embedding_text"),
        F.col("_piece").alias("retrieval_text"),
        F.lit("").alias("index_kind"),
        split.alias("is_atomic_fragment"),
        F.when(split, F.col("_no")).alias("fragment_index"),
        F.when(split, F.col("_total")).alias("fragment_total"),
    )


def reflow(blocks: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Write usable model texts back: visual blocks get new text, code and formulas an override."""
    joined = blocks.join(
        enrichments.where((F.col("status") == "ok") & (F.coalesce("enriched_text", F.lit("")) != ""))
        .select("doc_id", "block_id", "enriched_text"),
        ["doc_id", "block_id"],
        "left",
    )
    got = F.col("enriched_text").isNotNull()
    override = F.when(got & F.col("type").isin("code", "equation"), F.col("enriched_text")).otherwise(
        F.col("metadata.retrieval_text_override")
    )
    return joined.select(
        *[c for c in blocks.columns if c not in ("text", "metadata")],
        F.when(got & F.col("type").isin("image", "table"), F.col("enriched_text")).otherwise(F.col("text")).alias("text"),
        F.col("metadata").withField("retrieval_text_override", override).alias("metadata"),
    ).select(*blocks.columns)


def rechunk(blocks: DataFrame, documents: DataFrame, level: Column | int) -> tuple[DataFrame, DataFrame]:
    """Parents and children at a new level from stored blocks, without parsing again."""
    if isinstance(level, int) and level < 1:
        raise ValueError("the heading level of a parent must be at least 1")
    ready = documents.where(F.col("status").isin("indexed", "needs_review")).select("doc_id")
    members = grouped(blocks.join(ready, "doc_id", "left_semi"), level)
    return parent_chunks(members), child_chunks(members)
