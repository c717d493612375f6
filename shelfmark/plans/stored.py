"""Stores written and read back: versions, document units, chunk lines, named files, folder streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import notices, providers
from shelfmark.plans import corpora as C
from shelfmark.plans import records
from shelfmark.plans import sql as S
from shelfmark.plans.registry import query
from shelfmark.session import checkpoint_root, table
from shelfmark.sources import stores
from shelfmark.streaming import incremental


def folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/store-{uuid.uuid4().hex}"


@query("store_versions", """
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE 'old' END AS state, n_chars,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN lang END AS note FROM documents WHERE lang <> 'es'
""")
def store_versions(spark, sf):
    """A load, a batch with a new column, its replay, a removal, and a compaction in between."""
    root, docs = folder(spark), table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    stores.replace_in_store(docs.select("doc_id", "n_chars", F.lit("old").alias("state")), root)
    fresh = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    fresh = fresh.select("doc_id", "n_chars", F.lit("new").alias("state"), F.col("lang").alias("note"))
    stores.replace_in_store(fresh, root)
    stores.compact(spark, root)
    stores.replace_in_store(fresh, root)
    stores.replace_in_store(fresh.limit(0), root, gone=docs.where(F.col("lang") == "es"))
    return stores.read_store(spark, root).select("doc_id", "state", "n_chars", "note")


@query("stored_documents", f"""
WITH {S.TREE}, e AS (SELECT doc_id, block_id, type, doc_id LIKE 'A%' AND type IN ('image', 'table') AS told,
   array_to_string(list_filter([text, CASE type WHEN 'image' THEN 'image: images/' || ord || '.jpg' ELSE 'table: ' || text END], lambda x: x <> ''), chr(10)) AS made FROM tree)
SELECT doc_id, block_id, type, CASE WHEN told THEN 'ok' END AS status, CASE WHEN told THEN made END AS enriched_text FROM e
""")
def stored_documents(spark, sf):
    """Blocks and documents written as one version; documents with enriched blocks are read from there, others from the basic ones."""
    basic, enriched = folder(spark), folder(spark)
    blocks = C.tree(spark, sf)
    stores.write_ir({"blocks": blocks, "documents": blocks.select("doc_id").distinct()}, basic)
    plain = stores.read_store(spark, basic, "blocks")
    some = plain.where(F.col("doc_id").cast("string").startswith("A"))
    stores.write_ir({"blocks": providers.with_enrichment(some, providers.describe(some))}, enriched)
    return stores.read_ir(spark, basic, enriched).select("doc_id", "block_id", "type", "enrichment.status", "enrichment.enriched_text")


CHILD = "child_chunk_id string, doc_id long, parent_chunk_id string, embedding_text string"


@query("stored_chunks", f"""
WITH {S.CHUNKS} SELECT doc_id, count(*) AS n_chunks, count(DISTINCT parent_chunk_id) AS n_parents, sum(length(text)) AS n_chars FROM chunks GROUP BY doc_id
""")
def stored_chunks(spark, sf):
    """Chunks as lines of JSON, some documents written again with blank and broken lines among theirs."""
    root = folder(spark)
    columns = [c.split()[0] for c in CHILD.split(", ")]
    children = C.text_chunks(spark, sf).select(*columns)
    stores.write_chunks(C.text_parents(spark, sf).select("doc_id", "parent_chunk_id"), children, root)
    lines = stores.read_store(spark, root, "child_chunks").join(table(spark, sf, "documents").where("lang = 'fr'").select("doc_id"), "doc_id", "left_semi")
    broken = lines.select("doc_id", F.explode(F.array(F.lit(""), F.lit("  "), F.lit("no json"), F.expr("left(value, 30)"))).alias("value"))
    parents = stores.read_store(spark, root, "parent_chunks").join(lines.select("doc_id").distinct(), "doc_id", "left_semi")
    stores.commit(spark, root, {"child_chunks": lines.unionByName(broken), "parent_chunks": parents})
    found = stores.read_chunks(spark, root, "child_chunks", CHILD)
    pairs = found.join(stores.read_chunks(spark, root, "parent_chunks", "doc_id long, parent_chunk_id string"), ["doc_id", "parent_chunk_id"])
    return pairs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("parent_chunk_id").alias("n_parents"), F.sum(F.length("embedding_text")).alias("n_chars")
    )


def _below(root: str) -> F.Column:
    """The path of a file below a folder."""
    mark = root.rsplit("/", 1)[1] + "/"
    return F.substring_index("path", mark, -1)


@query("written_notes", """
SELECT '课堂录音/' || conv_id || '/Alge_bra' || conv_id || '第' || lpad(turn::VARCHAR, 2, '0') || '节课堂要点.md' AS path, text AS content FROM conversations WHERE role = 'assistant'
""")
def written_notes(spark, sf):
    """One file a note, under its own name, read back as files."""
    root = folder(spark)
    stores.write_notes(stores.note_files(records.notes(spark, sf)), root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_below(root).alias("path"), F.decode("content", "utf-8").alias("content"))


@query("registered_files", """
SELECT '课堂录音/' || conv_id || '/Alge_bra' || conv_id || '第' || lpad(turn::VARCHAR, 2, '0') || '节课堂要点.md' AS relative_path,
  CAST(strlen(text) AS BIGINT) AS size, 'md' AS source_format, 'review_note' AS folder_category, 'text_only' AS status, 1 AS n
FROM conversations WHERE role = 'assistant' AND strlen(text) > 0
""")
def registered_files(spark, sf):
    """Files of a folder registered by a stream that starts anew three times; the last time there is nothing to add."""
    root, store, checkpoint = folder(spark), folder(spark), folder(spark)
    notes = records.notes(spark, sf)
    for part in (notes.where("section_num < 4"), notes.where("section_num >= 4"), None):
        if part is not None:
            stores.write_notes(stores.note_files(part), root)
        incremental.register_files(spark, root, store, checkpoint).awaitTermination()
    rows = stores.read_store(spark, store)
    return rows.groupBy("relative_path", "size", "source_format", "folder_category", "status").agg(F.count(F.lit(1)).cast("int").alias("n"))


# ---- notices ------------------------------------------------------------------------------------


def odd_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as raw blocks of their customer; all but one kind in ten hold something unexpected."""
    text_ = '{"type":"text","content":"x"}'
    body = {
        0: f'{{"type":"paragraph","bbox":[0,0,9,9],"content":{{"paragraph_content":[{text_}]}}}}',
        1: '{"type":"table","bbox":[0,0,9,9],"content":{"html":" ","image_source":{"path":"images/"},"table_caption":[]}}',
        2: f'{{"type":"title","zz":1,"content":{{"level":1,"title_content":[{text_}]}}}}',
        3: f'{{"type":"paragraph","content":{{"paragraph_content":[{text_}],"rank":2,"other":[]}}}}',
        4: '{"type":"paragraph","content":{"paragraph_content":[{"content":"a","font":1},{"content":"","children":[{"children":[{"content":"b","ruby":""}],"tone":1}]}]}}',
        5: f'{{"type":"list","content":{{"list_items":[{{"item_content":[{text_}],"mark":"-"}},{{"item_content":[{{"content":"y","font":2}}]}},7]}}}}',
        6: f'{{"type":"weird","content":{{"paragraph_content":[{text_}]}}}}',
        7: '{"type":"code","bbox":[1,2],"content":null}',
        8: '{"type":"image","content":{"image_source":{"path":"images/a.jpg","sha":"1"},"image_caption":[]}}',
        9: '{"type":"equation_interline","content":{"math_content":"","math_type":"latex"}}',
    }
    kind = F.create_map(*[v for k, b in body.items() for v in (F.lit(k), F.lit(b))])
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("o_orderkey").alias("raw_pos"),
        kind[(F.col("o_orderkey") % 10).cast("int")].alias("block"),
    )


@query("notice_counts", """
WITH k(r, level, detail) AS (VALUES (1, 'ghost', 'table'), (9, 'ghost', 'equation'), (2, 'block', 'zz'), (3, 'content', 'rank'), (3, 'content', 'other'),
  (4, 'text_segment', 'font'), (5, 'text_segment', 'font'), (4, 'text_segment', 'tone'), (4, 'text_segment', 'ruby'), (5, 'list_item', 'mark'),
  (6, 'type', 'weird'), (7, 'bbox', 'code'), (7, 'no_content', 'code'), (8, 'image_source', 'sha'))
SELECT level, detail, count(*) AS n_blocks, count(DISTINCT o_custkey) AS n_docs, min({'d': o_custkey, 'p': o_orderkey}).p AS first_pos
FROM orders JOIN k ON o_orderkey % 10 = r GROUP BY level, detail
""")
def notice_counts(spark, sf):
    """Notices of all blocks, half of the documents recorded twice."""
    root, raw = folder(spark), odd_blocks(spark, sf)
    notices.record(raw, root)
    notices.record(raw.where("doc_id % 2 = 0"), root)
    found = notices.counts(stores.read_store(spark, root, "notices"))
    return found.select("level", "detail", "n_blocks", "n_docs", F.col("example.raw_pos").alias("first_pos"))
