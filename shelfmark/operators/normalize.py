"""Raw layout blocks to typed blocks.

Input is one row per raw block: ``doc_id, page_idx, raw_pos, block`` with the
block as JSON text. Everything is one projection per block; the only shuffle is
the numbering of the kept blocks.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import geometry, text
from shelfmark.operators.scan import number_rows
from shelfmark.session import cut

# Raw type -> block type.
TYPE_OF = {
    "title": "title",
    "paragraph": "paragraph",
    "list": "list",
    "image": "image",
    "table": "table",
    "equation_interline": "equation",
    "code": "code",
    "page_header": "page_header",
    "page_footer": "page_footer",
    "page_number": "page_number",
    "page_footnote": "page_footnote",
    "chart": "image",
    "index": "list",
}
AUXILIARY = ("page_header", "page_footer", "page_number", "page_footnote")
# Keys a block and its content may carry.
BLOCK_KEYS = ("type", "bbox", "content", "anchor", "sub_type")
CONTENT_KEYS = {
    "title": ("level", "title_content"),
    "paragraph": ("paragraph_content",),
    "list": ("list_type", "list_items", "attribute"),
    "index": ("list_type", "list_items", "attribute"),
    "code": ("code_content", "code_language", "code_caption"),
    "equation_interline": ("math_content", "math_type", "image_source"),
    "image": ("image_source", "image_caption", "image_footnote", "content"),
    "chart": ("image_source", "content", "chart_caption", "chart_footnote"),
    "table": (
        "html", "image_source", "table_caption", "table_footnote", "table_nest_level", "table_type",
    ),
    "page_header": ("page_header_content",),
    "page_footer": ("page_footer_content",),
    "page_number": ("page_number_content",),
    "page_footnote": ("page_footnote_content",),
}
# Raw type -> key that holds its text segments.
SEGMENT_KEY = {
    "title": "title_content",
    "code": "code_content",
    "image": "image_caption",
    "chart": "chart_caption",
    "table": "table_caption",
    "page_header": "page_header_content",
    "page_footer": "page_footer_content",
    "page_number": "page_number_content",
    "page_footnote": "page_footnote_content",
}
# Raw type -> (asset type, usage, id suffix).
ASSET_OF = {
    "equation_interline": ("equation_image", "qa_preferred", "eq"),
    "image": ("image", "primary", "img"),
    "chart": ("chart_image", "primary", "img"),
    "table": ("table_image", "primary", "tbl"),
}
_CONTENT_FIELDS = sorted(
    {k for keys in CONTENT_KEYS.values() for k in keys} | {"text"}
)
#: Levels of children that column expressions read; blocks with deeper ones are unnested before.
CHILD_DEPTH = 1
WIDE = 4096


def _lookup(pairs: dict[str, str], key: Column, default: Column | None = None) -> Column:
    hit = F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])[key]
    return hit if default is None else F.coalesce(hit, default)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _objects(raw: Column) -> Column:
    """The JSON objects of a JSON array, as text; other items are skipped."""
    items = F.from_json(raw, "array<string>")
    return F.coalesce(F.filter(items, lambda s: s.startswith("{")), _empty("string"))


def segment_text(segs: list) -> str:
    """Text of parsed segments in order; one without content stands for its children, at any depth."""
    out, open_lists = [], [iter(segs)]
    while open_lists:
        for seg in open_lists[-1]:
            if not isinstance(seg, dict):
                continue
            own = seg.get("content")
            if own not in (None, ""):
                out.append(own if isinstance(own, str) else json.dumps(own, ensure_ascii=False))
            elif isinstance(seg.get("children"), list):
                open_lists.append(iter(seg["children"]))
                break
        else:
            open_lists.pop()
    return "".join(out)


@F.pandas_udf(T.StringType())
def unnested(blocks: pd.Series) -> pd.Series:
    """Blocks as JSON whose outermost segments hold the text of all their children."""

    def one(block: str | None) -> str | None:
        try:
            read = json.loads(block) if block is not None else None
        except ValueError:
            return None
        content = read.get("content") if isinstance(read, dict) else None
        if not isinstance(content, dict):
            return None
        lists = [v for v in content.values() if isinstance(v, list)]
        lists += [i["item_content"] for v in lists for i in v if isinstance(i, dict) and isinstance(i.get("item_content"), list)]
        for seg in [s for v in lists for s in v if isinstance(s, dict)]:
            if seg.get("content") in (None, "") and isinstance(seg.get("children"), list):
                seg["content"] = segment_text(seg["children"])
        return json.dumps(read, ensure_ascii=False)

    return blocks.map(one)


def segments(raw: Column, depth: int = CHILD_DEPTH) -> Column:
    """Text segments as ``array<struct<type, content>>``.

    A segment without content takes the text of its ``children``, down to
    ``depth`` levels; ``parse_blocks`` brings deeper ones up first.
    """

    def one(seg: Column) -> Column:
        own = F.coalesce(seg["content"], F.lit(""))
        inner = joined(segments(seg["children"], depth - 1)) if depth > 0 else F.lit("")
        kind = F.when(F.coalesce(seg["type"], F.lit("text")).contains("equation"), "inline_equation")
        return F.struct(
            kind.otherwise("text").alias("type"),
            F.when(own != "", own).otherwise(inner).alias("content"),
        )

    read = F.transform(
        _objects(raw), lambda item: F.from_json(item, "type string, content string, children string")
    )
    return F.transform(read, one)


def joined(segs: Column) -> Column:
    return F.array_join(F.transform(segs, lambda s: s["content"]), "")


def list_text(raw: Column) -> Column:
    """List items as indented lines with their prefix; empty items are dropped."""

    def parts(it: Column) -> Column:
        return F.struct(
            F.repeat(F.lit("  "), F.greatest(F.lit(0), F.coalesce(it["ilevel"], F.lit(0)))).alias("indent"),
            F.coalesce(it["prefix"], F.lit("")).alias("prefix"),
            joined(segments(it["item_content"])).alias("body"),
        )

    read = F.transform(
        _objects(raw), lambda item: F.from_json(item, "item_content string, ilevel int, prefix string")
    )
    kept = F.filter(F.transform(read, parts), lambda p: p["body"] != "")
    lead = lambda p: F.when(p["prefix"] != "", F.concat(p["prefix"], F.lit(" "))).otherwise("")
    return F.array_join(F.transform(kept, lambda p: F.concat(p["indent"], lead(p), p["body"])), "\n")


def _asset_path(path: Column, base: Column) -> Column:
    """A path without a file suffix names a folder and is no asset."""
    named = text.suffix(F.coalesce(path, F.lit(""))) != ""
    full = F.when(base.isNotNull(), F.concat(base, F.lit("/"), path)).otherwise(path)
    return F.when(named, full)


def parse_blocks(raw: DataFrame) -> DataFrame:
    """Project raw blocks to types, text, segments, assets, boxes and flags."""
    # Columns cannot recurse: the few blocks with children of children pass through one UDF, all others as nulls.
    deep = F.when(F.col("block").rlike('(?s)"children".*"children"'), F.col("block"))
    top = raw.where(F.col("block").startswith("{")).withColumn("_flat", unnested(deep)).withColumn(
        "_b",
        F.from_json(F.coalesce("_flat", "block"), "type string, bbox string, content string, anchor string"),
    )
    top = top.select(
        *raw.columns,
        F.coalesce("_b.type", F.lit("paragraph")).alias("raw_type"),
        F.col("_b.bbox").alias("_bbox"),
        F.col("_b.content").alias("_content"),
        F.json_object_keys("block").alias("_keys"),
    )
    is_obj = F.coalesce(F.col("_content").startswith("{"), F.lit(False))
    known = top.select(
        *top.columns,
        _lookup(TYPE_OF, F.col("raw_type"), F.lit("paragraph")).alias("type"),
        F.when(
            is_obj,
            F.from_json("_content", ", ".join(f"`{k}` string" for k in _CONTENT_FIELDS)),
        ).alias("_c"),
        F.when(is_obj, F.json_object_keys("_content")).alias("_ckeys"),
    )
    kind, c = F.col("type"), F.col("_c")
    role = F.when(kind.isin(*AUXILIARY), "auxiliary").otherwise("main")

    seg_raw = F.lit(None).cast("string")
    for raw_kind, key in SEGMENT_KEY.items():
        seg_raw = F.when(F.col("raw_type") == raw_kind, c[key]).otherwise(seg_raw)
    seg_raw = F.when(kind == "paragraph", c["paragraph_content"]).otherwise(seg_raw)
    # An auxiliary block without segments may carry plain text.
    plain_aux = F.when(is_obj, c["text"]).otherwise(F.col("_content"))

    staged = known.select(
        *raw.columns, "raw_type", "type", role.alias("role"), "_bbox", "_keys", "_ckeys", "_content", "_c",
        F.coalesce(segments(seg_raw), _empty("struct<type string, content string>")).alias("_segs"),
        plain_aux.alias("_plain"),
    )
    lead = joined(F.col("_segs"))
    chart_data = F.coalesce(c["content"], F.lit(""))
    body = (
        F.when(kind == "list", list_text(c["list_items"]))
        .when(kind == "equation", F.coalesce(c["math_content"], F.lit("")))
        .when(
            F.col("raw_type") == "chart",
            F.concat_ws("\n", F.nullif(lead, F.lit("")), F.nullif(chart_data, F.lit(""))),
        )
        .when(
            (F.col("role") == "auxiliary") & (F.size("_segs") == 0),
            F.coalesce(F.col("_plain"), F.lit("")),
        )
        .otherwise(lead)
    )
    path = F.get_json_object("_c.image_source", "$.path")
    folder = F.regexp_replace(F.col("images_dir"), "/[^/]*$", "") if "images_dir" in raw.columns \
        else F.lit(None).cast("string")
    staged = staged.withColumn("text", body).withColumn("_path", _asset_path(path, folder))

    box = F.when(F.col("_bbox").isNull(), geometry.zero_box()).otherwise(geometry.norm_box(F.col("_bbox")))
    own_segs = (
        F.when(
            kind.isin("list"),
            F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("content"))),
        )
        .when(
            kind == "equation",
            F.array(F.struct(F.lit("inline_equation").alias("type"), F.col("text").alias("content"))),
        )
        .when(
            kind.isin("image", "table") | ((F.col("role") == "auxiliary") & (F.size("_segs") == 0)),
            F.when(
                F.col("text") != "",
                F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("content"))),
            ).otherwise(_empty("struct<type string, content string>")),
        )
        .otherwise(F.col("_segs"))
    )
    return staged.select(
        *raw.columns, "raw_type", "type", "role",
        box.alias("bbox_norm1000"),
        (F.col("_bbox").isNotNull() & (F.coalesce(F.size(F.from_json("_bbox", "array<double>")), F.lit(0)) >= 4))
        .alias("has_box"),
        F.col("text"),
        own_segs.alias("segments"),
        "_path", "_keys", "_ckeys", "_content", "_bbox",
        F.struct(
            F.when(kind == "title", F.coalesce(c["level"].try_cast("int"), F.lit(1))).alias("title_level"),
            F.when(kind == "code", c["code_language"]).alias("code_language"),
            F.when(kind == "list", c["list_type"]).alias("list_type"),
            F.when(kind == "equation", c["math_type"]).alias("math_type"),
            F.when(kind == "table", c["table_type"]).alias("table_type"),
            F.when(kind == "table", F.coalesce(c["html"], F.lit(""))).alias("table_html"),
            F.when(kind == "equation", F.coalesce(c["math_content"], F.lit(""))).alias("math_content"),
            F.lit(None).cast("string").alias("retrieval_text_override"),
        ).alias("metadata"),
    )


def is_ghost(row: Column) -> Column:
    """A visual block with no text, markup, formula or asset: the rest of a split one."""
    meta = row["metadata"]
    return (
        row["type"].isin("image", "table", "equation")
        & text.blank(row["text"])
        & text.blank(meta["table_html"])
        & text.blank(meta["math_content"])
        & row["_path"].isNull()
    )


def without_ghosts(parsed: DataFrame) -> DataFrame:
    """Drop ghosts. The test reads the parsed row, so no block is parsed twice for it."""
    row = F.struct(*parsed.columns)
    kept = parsed.select(F.explode_outer(F.filter(F.array(row), lambda r: ~is_ghost(r))).alias("r"))
    return kept.where(F.col("r").isNotNull()).select("r.*")


def normalize(raw: DataFrame, page_sizes: DataFrame | None = None) -> DataFrame:
    """Typed blocks, ghosts removed, numbered per page and per document."""
    parsed = cut(without_ghosts(parse_blocks(raw)))  # parsed once, numbered in several steps
    pos = [F.col("page_idx"), F.col("raw_pos")]
    spot = F.floor(F.col("raw_pos") / WIDE)
    numbered = number_rows(
        parsed, ["doc_id", "page_idx"], [F.col("raw_pos")], [[spot]], "order_in_page"
    )
    numbered = number_rows(
        numbered, ["doc_id"], pos, [[F.col("page_idx")], [spot]], "order_in_doc"
    )
    tag = F.substring(F.sha2(F.concat_ws(":", "doc_id", "page_idx", "raw_pos"), 256), 1, 6)
    numbered = numbered.withColumn(
        "block_id",
        F.format_string("p%04d-b%04d-%s", F.col("page_idx"), F.col("order_in_page"), tag),
    )
    if page_sizes is not None:
        numbered = numbered.join(page_sizes, ["doc_id", "page_idx"], "left")
    else:
        numbered = numbered.withColumns(
            {"width": F.lit(None).cast("double"), "height": F.lit(None).cast("double")}
        )
    width = F.coalesce("width", F.lit(1000.0))
    height = F.coalesce("height", F.lit(1000.0))
    asset_type, usage, end = (
        _lookup({k: v[i] for k, v in ASSET_OF.items()}, F.col("raw_type")) for i in range(3)
    )
    asset = F.struct(
        F.concat(F.lit("asset-"), F.col("block_id"), F.lit("-"), end).alias("asset_id"),
        asset_type.alias("asset_type"),
        F.col("_path").alias("path"),
        usage.alias("usage"),
        F.lit("image/jpeg").alias("mime"),
    )
    none = _empty("struct<asset_id string, asset_type string, path string, usage string, mime string>")
    return numbered.select(
        "doc_id", "page_idx", "order_in_page", "order_in_doc", "block_id", "raw_type", "type", "role",
        "bbox_norm1000",
        F.when(F.col("has_box"), geometry.page_box(F.col("bbox_norm1000"), width, height)).alias("bbox_page"),
        "text", "segments",
        F.when(F.col("_path").isNotNull() & asset_type.isNotNull(), F.array(asset)).otherwise(none).alias("assets"),
        "metadata",
        flags().alias("degraded"),
    )


def flags() -> Column:
    """What the block could not deliver as expected."""
    page = F.col("page_idx").cast("string")
    content_keys = F.create_map(
        *[v for k, keys in CONTENT_KEYS.items() for v in (F.lit(k), F.array(*[F.lit(x) for x in keys]))]
    )
    # An unknown type is read as a paragraph, and so are its content keys.
    allowed = F.coalesce(content_keys[F.col("raw_type")], content_keys[F.lit("paragraph")])
    extra_block = F.size(F.array_except("_keys", F.array(*[F.lit(k) for k in BLOCK_KEYS]))) > 0
    extra_content = F.size(F.array_except("_ckeys", allowed)) > 0
    short_box = F.col("_bbox").isNotNull() & ~F.col("has_box")
    found = F.array(
        F.when(~F.col("raw_type").isin(*TYPE_OF), F.concat(F.lit("unknown_type_"), "raw_type")),
        F.when(
            extra_block,
            F.concat(F.lit("unknown_keys_block[p"), page, F.lit(",type="), "raw_type", F.lit("]")),
        ),
        F.when(short_box, F.concat(F.lit("bad_bbox_p"), page, F.lit("-type"), "raw_type")),
        F.when(F.col("_content").isNull(), F.concat(F.lit("content_none_"), "block_id")),
        F.when(
            extra_content,
            F.concat(F.lit("unknown_keys_"), "block_id", F.lit(":"), "type", F.lit(".content")),
        ),
    )
    return F.filter(found, lambda s: s.isNotNull())


def auxiliary_items(blocks: DataFrame) -> DataFrame:
    """Headers, footers, page numbers and footnotes of each page, in page order."""
    return blocks.where(F.col("role") == "auxiliary").select(
        "doc_id", "page_idx", F.col("type").alias("kind"), "order_in_doc", "block_id", "text"
    )


def asset_rows(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "block_id", F.explode("assets").alias("a")).select(
        "doc_id", "block_id", "a.*"
    )


def document_flags(blocks: DataFrame) -> DataFrame:
    """One row per document: what it contains, its title and its warnings."""
    kind = F.col("type")
    has = lambda *kinds: F.bool_or(kind.isin(*kinds))
    titled = F.when((kind == "title") & (F.col("text") != ""), F.struct("order_in_doc", "text"))
    return blocks.groupBy("doc_id").agg(
        F.coalesce(F.min(titled)["text"], F.lit("")).alias("title"),
        (F.max("page_idx") + 1).alias("page_count"),
        has("image", "table").alias("has_multimodal"),
        has("code").alias("has_code"),
        has("table").alias("has_table"),
        has("equation").alias("has_equation"),
        F.sum(F.size("assets")).alias("asset_count"),
        F.count(F.lit(1)).alias("block_count"),
    )
