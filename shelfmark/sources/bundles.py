"""Reading extracted bundles, text files and gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text

# Fixed value: a bundle lies in <root>/<document>/extracted/.
DOC_OF_PATH = r"/([^/]+)/extracted/"
BLOCK_FILE = "content_list_v2.json"
# Suffixes an original file may have.
ORIGINALS = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".png", ".jpg", ".jpeg", ".xlsx", ".xls")

LAYOUT = (
    "pdf_info array<struct<page_idx int, page_size array<double>>>, "
    "_backend string, _version_name string"
)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of every file below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )


def role(name: Column) -> Column:
    """Role of a bundle file by its name, fixed or with a prefix."""
    low = F.lower(name)
    ext = text.suffix(low)
    return (
        F.when((low == BLOCK_FILE) | low.endswith("_" + BLOCK_FILE), "blocks")
        .when(low == "layout.json", "layout")
        .when(low == "full.md", "full_md")
        .when(low.endswith("_content_list.json"), "flat_list")
        .when(low.endswith("_model.json"), "model")
        .when(low.contains("_origin.") & ext.isin(*ORIGINALS), F.when(ext == ".pdf", "origin_pdf").otherwise("origin"))
        .otherwise("unexpected")
    )


def bundle_files(files: DataFrame, doc_of_path: str = DOC_OF_PATH) -> DataFrame:
    """(doc_id, name, path, role) of files directly in a bundle, and its image folder."""
    rows = files.select("path", F.regexp_extract("path", doc_of_path, 1).alias("doc_id")).where(F.col("doc_id") != "")
    inner = F.regexp_replace("path", f"^.*{doc_of_path}", "")
    rows = rows.withColumn("_inner", inner)
    top = F.split("_inner", "/")[0]
    nested = F.col("_inner").contains("/")
    return rows.select(
        "doc_id", top.alias("name"),
        F.when(nested, F.regexp_replace("path", f"({doc_of_path}[^/]+)/.*$", "$1")).otherwise(F.col("path")).alias("path"),
        F.when(nested, F.when(F.lower(top) == "images", "images_dir").otherwise("unexpected"))
        .otherwise(role(top)).alias("role"),
    ).distinct()


def manifest(files: DataFrame) -> DataFrame:
    """One row per document with the first path of every role."""
    roles = ["blocks", "layout", "full_md", "flat_list", "model", "origin_pdf", "images_dir"]
    return (
        files.groupBy("doc_id").pivot("role", roles).agg(F.min("path"))
        .select("doc_id", *[F.col(r).alias(r if r == "images_dir" else f"{r}_path") for r in roles])
    )


def read_whole(spark: SparkSession, paths: str | list[str], doc_of_path: str = DOC_OF_PATH) -> DataFrame:
    """(doc_id, path, content): one row per text file."""
    return (
        spark.read.text(paths, wholetext=True)
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), doc_of_path, 1).alias("doc_id"),
            F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"),
        )
    )


def _page_list(content: Column) -> Column:
    """The outer array of a block file; NULL for anything else."""
    return F.when(content.rlike(r"^\s*\["), F.from_json(content, "array<string>"))


def block_pages(files: DataFrame) -> DataFrame:
    """(doc_id, page_idx, page): the outer array of a block file. Files without one are in ``unread_files``."""
    rows = files.select("doc_id", _page_list(F.col("content")).alias("_p"))
    return rows.select("doc_id", F.posexplode_outer("_p").alias("page_idx", "page")).where(F.col("page_idx").isNotNull())


def unread_files(files: DataFrame) -> DataFrame:
    """(doc_id, message) of block files that hold no list; the other documents go on."""
    return files.where(_page_list(F.col("content")).isNull()).select("doc_id", F.lit("block_file_not_list").alias("message"))


def raw_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page_idx, raw_pos, block): the blocks of pages that are lists."""
    good = pages.where(F.col("page").startswith("["))
    return good.select(
        "doc_id", "page_idx", F.posexplode_outer(F.from_json("page", "array<string>")).alias("raw_pos", "block")
    ).where(F.col("block").isNotNull()).withColumn("raw_pos", F.col("raw_pos").cast("long"))


def broken_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, message) of pages that are no list."""
    return pages.where(~F.col("page").startswith("[")).select(
        "doc_id", F.concat(F.lit("page_"), F.col("page_idx").cast("string"), F.lit("_not_list")).alias("message")
    )


def page_sizes(layouts: DataFrame) -> DataFrame:
    """(doc_id, page_idx, width, height) out of layout files; a broken file yields none."""
    pages = layouts.select("doc_id", F.posexplode(F.from_json("content", LAYOUT)["pdf_info"]).alias("_pos", "p"))
    return pages.where(F.size("p.page_size") >= 2).groupBy(
        "doc_id", F.coalesce("p.page_idx", F.lit(0)).alias("page_idx")
    ).agg(F.max_by("p.page_size", "_pos").alias("_s")).select(
        "doc_id", "page_idx", F.col("_s")[0].alias("width"), F.col("_s")[1].alias("height")
    )


def layout_failures(layouts: DataFrame) -> DataFrame:
    """(doc_id, message) of layout files that are no JSON."""
    return layouts.where(F.try_parse_json("content").isNull()).select(
        "doc_id", F.lit("layout_load_failed").alias("message")
    )


def layout_meta(layouts: DataFrame) -> DataFrame:
    return layouts.select(
        "doc_id",
        F.get_json_object("content", "$._backend").alias("backend"),
        F.get_json_object("content", "$._version_name").alias("version"),
    )


def bundle_roots(files: DataFrame, doc_of_path: str = DOC_OF_PATH) -> DataFrame:
    """Documents that already have an extracted bundle."""
    doc = F.regexp_extract("path", doc_of_path, 1)
    return files.where(doc != "").groupBy(doc.alias("doc_id")).agg(F.count(F.lit(1)).alias("n_files"))


def read_text_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of text and Markdown files; a byte order mark is removed."""
    raw = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}")
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return raw.select(
        "path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("source_format"),
        F.regexp_replace("value", "^\\uFEFF", "").alias("text"),
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries; an entry without query or knowledge base, or no entry, is an error."""
    gold = spark.read.schema(
        "query string, kb_id string, relevant_doc_ids array<string>, relevant_child_chunk_ids array<string>"
    ).json(path, multiLine=True)
    lacking = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    n, bad = gold.agg(
        F.count(F.lit(1)), F.count_if(lacking("query") | lacking("kb_id"))
    ).first()
    if n == 0:
        raise ValueError("the gold set is empty")
    if bad:
        raise ValueError(f"{bad} entries of the gold set lack query or kb_id")
    return gold.withColumn("query_id", F.sha2(F.concat_ws("\x01", "kb_id", "query"), 256))
