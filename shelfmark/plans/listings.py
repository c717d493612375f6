"""Listings of the catalog: default columns, sections and dates in order, the documents behind hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import catalog, trace
from shelfmark.plans import corpora as C
from shelfmark.plans import records, search
from shelfmark.plans import sql as S
from shelfmark.plans.registry import query
from shelfmark.session import table
from shelfmark.sources import search_index


def _named(spark, sf):
    """Documents with a file name; some of their optional columns are missing."""
    n = F.col("doc_id")
    name = F.concat(F.lit("f"), n.cast("string"), F.when(n % 3 == 0, ".pdf").when(n % 3 == 1, ".md").otherwise(".TXT"))
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("kb_id"), name.alias("filename"), F.when(n % 4 == 1, F.concat(F.lit("资料/"), name)).alias("relative_path"),
        catalog.source_format(name).alias("source_format"), F.col("n_chars").alias("file_size"), F.when(n % 5 == 2, F.lit("w")).alias("warnings"),
        F.when(n % 7 == 3, F.lit(2)).alias("parent_heading_level"),
    )


_NAMED = """
nd AS (SELECT doc_id, source AS kb_id, 'f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' ELSE '.TXT' END AS filename,
   CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' ELSE 'txt' END AS source_format, n_chars FROM documents)
"""


@query("document_listing", f"""
WITH {_NAMED} SELECT doc_id, kb_id, filename, CASE WHEN doc_id % 4 = 1 THEN '资料/' || filename ELSE filename END AS relative_path, source_format, n_chars AS file_size,
  CASE WHEN doc_id % 5 = 2 THEN 'w' ELSE '' END AS warnings, '' AS origin_pdf_path, '' AS folder_category, '' AS bound_file_path,
  CASE WHEN doc_id % 7 = 3 THEN 2 ELSE 0 END AS parent_heading_level FROM nd
""")
def document_listing(spark, sf):
    """Documents with defaults for what they do not have."""
    return catalog.document_listing(_named(spark, sf)).select(
        "doc_id", "kb_id", "filename", "relative_path", "source_format", "file_size", "warnings", "origin_pdf_path", "folder_category",
        "bound_file_path", "parent_heading_level",
    )


@query("kb_listing", """
SELECT source AS kb_id, count(*) AS file_count, 'general' AS kb_type, '' AS bound_folder_path FROM documents GROUP BY source
""")
def kb_listing(spark, sf):
    kbs = catalog.file_counts(table(spark, sf, "documents").select(F.col("source").alias("kb_id")))
    return catalog.kb_listing(kbs).select("kb_id", "file_count", "kb_type", "bound_folder_path")


@query("section_listing", f"""
WITH {records._REC}, f AS (SELECT *, '/up/' || doc_id AS path FROM r), n AS (SELECT date, section_num, max(doc_id) AS note_doc_id FROM f WHERE p = '1' GROUP BY 1, 2)
SELECT date, row_number() OVER (PARTITION BY date ORDER BY section_num, doc_id) AS no, section_num, doc_id AS txt_doc_id, path AS txt_path,
  note_doc_id, '/up/' || note_doc_id AS note_path FROM f LEFT JOIN n USING (date, section_num) WHERE p NOT IN ('1', '2')
""")
def section_listing(spark, sf):
    """Recordings with their notes and the places of both, numbered in order within each date."""
    docs = records.recordings(spark, sf)
    bound = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/up/"), "doc_id"))
    docs = docs.withColumns({"bound_file_path": bound, "upload_path": F.concat(F.lit("/up/"), "doc_id")})
    return catalog.section_listing(docs).select("date", "no", "section_num", "txt_doc_id", "txt_path", "note_doc_id", "note_path")


@query("date_listing", f"""
WITH {records._REC} SELECT row_number() OVER (ORDER BY date) AS no, date, section_count, has_notes FROM (
  SELECT date, count(*) FILTER (p NOT IN ('1', '2')) AS section_count, bool_or(p = '1') AS has_notes FROM r GROUP BY date)
""")
def date_listing(spark, sf):
    """Dates of recordings in ascending order."""
    return catalog.date_listing(records.recordings(spark, sf)).select("no", "date", "section_count", "has_notes")


@query("hit_documents", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.keyword('and')}, {_NAMED}
SELECT query_id, rank::BIGINT AS rank, chunk_id, c.doc_id, CASE WHEN c.doc_id % 10 <> 0 THEN filename END AS filename, CASE WHEN c.doc_id % 10 <> 0 THEN source_format END AS source_format
FROM kw JOIN chunks c USING (chunk_id) LEFT JOIN nd USING (doc_id)
""")
def hit_documents(spark, sf):
    """Keyword hits with file name and format of their documents; some documents are not registered."""
    ix = search.index(spark, sf)
    found = search.with_docs(search_index.keyword_hits(ix.stored, ix.queries), ix)
    named = trace.with_documents(found, _named(spark, sf).where(F.col("doc_id") % 10 != 0))
    return named.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "doc_id", "filename", "source_format")


@query("hit_document_list", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.keyword('and')}, {_NAMED}
SELECT DISTINCT query_id, c.doc_id, filename, source_format FROM kw JOIN chunks c USING (chunk_id) JOIN nd USING (doc_id)
""")
def hit_document_list(spark, sf):
    """The documents that a query's hits come from, each once."""
    ix = search.index(spark, sf)
    return trace.documents_of(search.with_docs(search_index.keyword_hits(ix.stored, ix.queries), ix), _named(spark, sf))
