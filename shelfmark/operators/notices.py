"""What normalising raw blocks dropped or did not know, counted.

Each block gives a row for every key, type or shape that is not expected, with the level on which it
stands, and one when it is dropped as a ghost. The rows of a batch replace those of its documents in
a store, so the table accumulates over batches and replays do not count twice.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import normalize
from shelfmark.operators.quality import ITEM_KEYS, SEGMENT_KEYS
from shelfmark.sources import stores

LISTS = sorted({*normalize.SEGMENT_KEY.values(), "paragraph_content"})


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_keys(blocks: pd.Series) -> pd.Series:
    """Keys of the segments of a block below the first level of children, each once."""

    def one(block: str | None) -> list[str]:
        try:
            read = json.loads(block) if block is not None else None
        except ValueError:
            return []
        content = read.get("content") if isinstance(read, dict) else None
        if not isinstance(content, dict):
            return []
        lists = [v for v in content.values() if isinstance(v, list)]
        lists += [i["item_content"] for v in lists for i in v if isinstance(i, dict) and isinstance(i.get("item_content"), list)]
        found, todo = set(), [(s, 0) for v in lists for s in v if isinstance(s, dict)]
        while todo:
            seg, depth = todo.pop()
            if depth > 1:
                found |= set(seg)
            if isinstance(seg.get("children"), list):
                todo += [(s, depth + 1) for s in seg["children"] if isinstance(s, dict)]
        return sorted(found)

    return blocks.map(one)


def _keys(objects: Column) -> Column:
    """All keys of JSON objects, each once."""
    return F.array_distinct(F.flatten(F.transform(objects, lambda o: F.coalesce(F.json_object_keys(o), normalize._empty("string")))))


def _found(level: str, details: Column) -> Column:
    return F.transform(F.coalesce(details, normalize._empty("string")), lambda d: F.struct(F.lit(level).alias("level"), d.alias("detail")))


def _when(level: str, condition: Column, detail: Column) -> Column:
    return _found(level, F.when(F.coalesce(condition, F.lit(False)), F.array(detail)))


def notices(raw: DataFrame) -> DataFrame:
    """(doc_id, page_idx, raw_pos, level, detail) of raw blocks.

    Levels: ``block``, ``content``, ``image_source``, ``list_item`` and ``text_segment`` name a key that is not known
    there (segments at any depth); ``type`` an unknown block type; ``ghost`` a block that is dropped; ``bbox`` a short box;
    ``no_content`` a block without content. Each block is parsed once; a block names a key once a level.
    """
    names = lambda keys: F.array(*[F.lit(k) for k in keys])
    parsed = normalize.parse_blocks(raw)
    content = F.from_json("_content", ", ".join(f"`{k}` string" for k in [*LISTS, "list_items", "image_source"]))
    deep = F.when(F.col("block").rlike('(?s)"children".*"children"'), F.col("block"))
    parsed = parsed.withColumn("_part", content).withColumn("_nested", nested_keys(deep))
    items = normalize._objects(F.col("_part.list_items"))
    inner = F.flatten(F.transform(items, lambda i: normalize._objects(F.get_json_object(i, "$.item_content"))))
    segs = F.concat(inner, *[normalize._objects(F.col(f"_part.{k}")) for k in LISTS])
    kids = F.flatten(F.transform(segs, lambda s: normalize._objects(F.get_json_object(s, "$.children"))))
    known = F.create_map(*[v for k, keys in normalize.CONTENT_KEYS.items() for v in (F.lit(k), names(keys))])
    allowed = F.coalesce(known[F.col("raw_type")], known[F.lit("paragraph")])
    source = F.array(F.when(F.col("_part.image_source").startswith("{"), F.col("_part.image_source")))
    seg_keys = F.array_union(_keys(F.concat(segs, kids)), F.coalesce("_nested", normalize._empty("string")))
    found = F.concat(
        _found("block", F.array_except("_keys", names(normalize.BLOCK_KEYS))),
        _found("content", F.array_except("_ckeys", allowed)),
        _found("image_source", F.array_except(_keys(F.filter(source, lambda s: s.isNotNull())), names(["path"]))),
        _found("list_item", F.array_except(_keys(items), names(ITEM_KEYS))),
        _found("text_segment", F.array_except(seg_keys, names(SEGMENT_KEYS))),
        _when("type", ~F.col("raw_type").isin(*normalize.TYPE_OF), F.col("raw_type")),
        _when("bbox", F.col("_bbox").isNotNull() & ~F.col("has_box"), F.col("raw_type")),
        _when("no_content", F.col("_content").isNull(), F.col("raw_type")),
        _when("ghost", normalize.is_ghost(F.struct("type", "text", "metadata", "_path")), F.col("type")),
    )
    rows = parsed.select("doc_id", "page_idx", "raw_pos", F.explode_outer(found).alias("f")).where("f IS NOT NULL")
    return rows.select("doc_id", "page_idx", "raw_pos", "f.level", "f.detail")


def record(raw: DataFrame, path: str) -> int:
    """Add the notices of a batch to a store; those of its documents are replaced."""
    return stores.commit(raw.sparkSession, path, {"notices": notices(raw).hint("rebalance")}, gone=raw.select("doc_id"))


def counts(found: DataFrame) -> DataFrame:
    """(level, detail, n_blocks, n_docs, example): how often, and the first place, of each notice."""
    place = F.struct("doc_id", "page_idx", "raw_pos")
    per_doc = found.groupBy("level", "detail", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    return per_doc.groupBy("level", "detail").agg(
        F.sum("n").alias("n_blocks"), F.count(F.lit(1)).alias("n_docs"), F.min("at").alias("example")
    )
