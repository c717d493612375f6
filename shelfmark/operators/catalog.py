"""Catalog tables: folder sync, upserts, deletes, statistics and listings.

Tables are Parquet, so a change is a set of rows joined against the old table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators.scan import running

# Formats by file suffix, folders by name, refused media.
FORMATS = {
    ".pdf": "pdf", ".ppt": "pptx", ".pptx": "pptx", ".doc": "docx", ".docx": "docx",
    ".png": "png", ".jpg": "jpg", ".jpeg": "jpeg", ".txt": "txt", ".md": "md",
    ".xlsx": "xlsx", ".xls": "xlsx",
}
MEDIA = (
    ".m4a", ".mp3", ".wav", ".flac", ".ogg", ".aac", ".wma",
    ".mp4", ".avi", ".mov", ".mkv", ".webm", ".wmv", ".flv",
)
FOLDERS = {"课堂录音": "recording", "课件": "slides", "作业": "homework", "通知": "notice"}
NOTE_MARK = "课堂要点"
SKIP_NAMES = (".git", ".DS_Store", "Thumbs.db", "__pycache__")
# Formats a stored source may have.
SAFE_FORMATS = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "pptx": "pptx", "ppt": "pptx",
    "jpg": "jpg", "jpeg": "jpeg", "png": "png",
}


def _map(pairs: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])[key], F.lit(default))


def source_format(name: Column) -> Column:
    return _map(FORMATS, F.lower(text.suffix(name)), "unknown")


def safe_format(fmt: Column) -> Column:
    return _map(SAFE_FORMATS, F.lower(fmt), "pdf")


def folder_category(path: Column) -> Column:
    first, last = text.first_part(path), text.base_name(path)
    note = path.contains("/") & (F.lower(text.suffix(last)) == ".md") & last.contains(NOTE_MARK)
    return F.when((first == "课堂录音") & note, "review_note").otherwise(_map(FOLDERS, first, ""))


def clean_path(path: Column) -> Column:
    """Slashes unified, empty and ``.`` parts dropped; NULL when a part is ``..``."""
    parts = F.filter(
        F.split(text.strip(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda p: (p != "") & (p != ".")
    )
    return F.when(~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def indexable_text(category: Column, fmt: Column) -> Column:
    """Text and Markdown files, but never the text of a recording."""
    return fmt.isin("txt", "md") & ~((F.coalesce(category, F.lit("")) == "recording") & (fmt == "txt"))


def upload_verdict(name: Column) -> Column:
    ext = F.lower(text.suffix(name))
    return F.when(ext.isin(*MEDIA), "media").when(ext.isin(*FORMATS), "accepted").otherwise("unsupported")


def visible_files(files: DataFrame) -> DataFrame:
    """Files a folder sync takes. Needs ``relative_path, size``."""
    name = text.base_name(F.col("relative_path"))
    hidden = F.exists(F.split("relative_path", "/"), lambda p: p.startswith("."))
    return files.where(
        (F.col("size") > 0) & ~name.isin(*SKIP_NAMES) & ~name.startswith("~$") & ~hidden
        & ~F.lower(text.suffix(name)).isin(*MEDIA)
    )


def initial_status(name: Column) -> Column:
    return F.when(F.lower(text.suffix(name)).isin(".txt", ".md"), "text_only").otherwise("uploaded")


def folder_diff(disk: DataFrame, known: DataFrame) -> DataFrame:
    """One full outer join of files on disk and registered documents by path.

    ``disk(path, relative_path, size)``, ``known(path, doc_id, status)``.
    """
    here = disk.select("path", "relative_path", "size", F.lit(True).alias("_on_disk"))
    rows = here.join(known, "path", "full_outer")
    on_disk, registered = F.col("_on_disk").isNotNull(), F.col("doc_id").isNotNull()
    action = (
        F.when(on_disk & ~registered, "added")
        .when(on_disk & (F.col("status") == "missing"), "restored")
        .when(on_disk, "unchanged")
        .when(F.col("status") == "missing", "still_missing")
        .otherwise("missing")
    )
    return rows.withColumn("action", action).drop("_on_disk")


def folder_sync(disk: DataFrame, known: DataFrame) -> DataFrame:
    """The document table after a sync; syncing again changes nothing."""
    diff = folder_diff(disk, known)
    fresh = F.concat(F.lit("doc-"), F.substring(F.sha2("path", 256), 1, 16))
    status = (
        F.when(F.col("action").isin("added", "restored"), initial_status(F.col("relative_path")))
        .when(F.col("action") == "missing", "missing")
        .otherwise(F.col("status"))
    )
    kind = known.schema["doc_id"].dataType
    return diff.select(
        "path", F.coalesce(F.col("doc_id").cast("string"), fresh).cast(kind).alias("doc_id"), status.alias("status")
    )


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key, combined inside tasks before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert or replace by key: the newest of both sides stays; on a tie the new side wins."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [*order, "_side"]).drop("_side")


def replace_documents(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Purge the documents that come anew, then add their rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    keys = gone.select(key).distinct()
    return {name: t.join(keys, key, "left_anti") for name, t in tables.items()}


def delete_conversations(
    conversations: DataFrame, messages: DataFrame, gone: DataFrame, children: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Delete conversations and their messages, with direct children on request."""
    ids = gone.select("conversation_id")
    if children:
        kids = conversations.join(
            ids.withColumnRenamed("conversation_id", "parent_conversation_id"), "parent_conversation_id", "left_semi"
        ).select("conversation_id")
        ids = ids.unionByName(kids).distinct()
    return (
        conversations.join(ids, "conversation_id", "left_anti"),
        messages.join(ids, "conversation_id", "left_anti"),
    )


def add_column(old: DataFrame, name: str, default: Column) -> DataFrame:
    """A column added to a stored table and filled for its old rows."""
    return old.withColumn(name, F.coalesce(F.col(name), default) if name in old.columns else default)


def copy_documents(docs: DataFrame, target_kb: Column) -> DataFrame:
    """Copies of document rows for another knowledge base: metadata only, not indexed."""
    name = F.concat(text.stem(F.col("filename")), F.lit("_副本"), text.suffix(F.col("filename")))
    made = {
        "kb_id": target_kb,
        "filename": name,
        "status": F.lit("uploaded"),
        "doc_id": F.concat(F.lit("copy-"), F.col("doc_id").cast("string"), F.lit("-"), target_kb),
    }
    return docs.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def move_documents(docs: DataFrame, moves: DataFrame) -> DataFrame:
    """Apply ``moves(doc_id, kb_id, relative_path)``; NULL keeps the old value."""
    new = moves.select("doc_id", F.col("kb_id").alias("_kb"), F.col("relative_path").alias("_path"))
    picked = {"kb_id": F.coalesce("_kb", "kb_id"), "relative_path": F.coalesce("_path", "relative_path")}
    return docs.join(new, "doc_id", "left").select(
        *[picked[c].alias(c) if c in picked else F.col(c) for c in docs.columns]
    )


def document_stats(docs: DataFrame, **parts: DataFrame) -> DataFrame:
    """Row counts per document over any number of tables, 0 where a table has none."""
    out = docs
    for name, rows in parts.items():
        counted = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"{name}_count"))
        out = out.join(counted, "doc_id", "left")
    return out.na.fill(0, [f"{name}_count" for name in parts])


def file_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("kb_id").agg(F.count(F.lit(1)).alias("file_count"))


def folder_tree(docs: DataFrame) -> DataFrame:
    """Folders with their recursive file counts. Needs ``relative_path``."""
    parts = F.split("relative_path", "/")
    above = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0),
        lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), n.alias("depth")),
    )
    rows = docs.select(F.explode_outer(above).alias("f")).where(F.col("f").isNotNull())
    return rows.groupBy("f.path", "f.depth").agg(F.count(F.lit(1)).alias("n_files")).select(
        "path", "depth", "n_files"
    )


def next_sequence(messages: DataFrame) -> DataFrame:
    """The number the next message of each conversation gets."""
    return messages.groupBy("conversation_id").agg((F.max("sequence_num") + 1).alias("next_seq"))


def number_messages(messages: DataFrame, order: str) -> DataFrame:
    """0-based message numbers per conversation by a unique integer order."""
    ran = running(messages, ["conversation_id"], order, {"_n": ("sum", F.lit(1))})
    return ran.withColumn("sequence_num", F.col("_n") - 1).drop("_n")


def fork(messages: DataFrame, pivots: DataFrame) -> DataFrame:
    """Messages of forks: everything up to and including the pivot, numbered anew.

    ``pivots(conversation_id, new_conversation_id, message_id)``; an unknown
    pivot keeps the whole conversation. Sequence numbers are dense already, so
    the kept head keeps them.
    """
    at = pivots.join(
        messages.select("conversation_id", "message_id", F.col("sequence_num").alias("_upto")),
        ["conversation_id", "message_id"],
        "left",
    ).select("conversation_id", "new_conversation_id", "_upto")
    kept = messages.join(at, "conversation_id").where(
        F.col("_upto").isNull() | (F.col("sequence_num") <= F.col("_upto"))
    )
    return kept.select(
        F.col("new_conversation_id").alias("conversation_id"),
        F.col("conversation_id").alias("parent_conversation_id"),
        *[c for c in messages.columns if c != "conversation_id"],
    )


def review_dates(docs: DataFrame) -> DataFrame:
    """Recording dates with their number of text files and whether notes exist."""
    parts = F.split(F.replace("relative_path", F.lit("\\"), F.lit("/")), "/")
    rows = docs.where((F.col("status") != "missing") & (F.size(parts) >= 3) & (parts[0] == "课堂录音"))
    return rows.groupBy(parts[1].alias("date")).agg(
        F.count_if((F.col("folder_category") == "recording") & (F.col("source_format") == "txt")).alias("section_count"),
        F.bool_or(F.col("folder_category") == "review_note").alias("has_notes"),
    )


def review_sections(docs: DataFrame) -> DataFrame:
    """Recordings of a date with the notes of the same section number."""
    parts = F.split("relative_path", "/")
    rows = docs.where((F.col("status") != "missing") & (F.size(parts) >= 3) & (parts[0] == "课堂录音")).select(
        "doc_id", "folder_category", "source_format", parts[1].alias("date"),
        text.section_number(text.base_name(F.col("relative_path"))).alias("section_num"),
    ).where(F.col("section_num").isNotNull())
    notes = (
        rows.where(F.col("folder_category") == "review_note").groupBy("date", "section_num")
        .agg(F.max("doc_id").alias("note_doc_id"))
    )
    texts = rows.where((F.col("folder_category") == "recording") & (F.col("source_format") == "txt"))
    return texts.join(notes, ["date", "section_num"], "left").select(
        "date", "section_num", F.col("doc_id").alias("txt_doc_id"), "note_doc_id"
    )


def section_listing(docs: DataFrame) -> DataFrame:
    """Recordings with their notes and the places of both, numbered by section within each date.

    Needs also ``bound_file_path`` and ``upload_path``; the bound file goes first, without either the place is empty.
    Recordings of the same section follow each other by id.
    """
    filled = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    place = docs.select("doc_id", F.coalesce(filled("bound_file_path"), filled("upload_path"), F.lit("")).alias("path"))
    rows = review_sections(docs)
    for side in ("txt", "note"):
        rows = rows.join(place.select(F.col("doc_id").alias(f"{side}_doc_id"), F.col("path").alias(f"{side}_path")), f"{side}_doc_id", "left")
    order = Window.partitionBy("date").orderBy("section_num", "txt_doc_id")  # the recordings of one day
    return rows.withColumn("no", F.row_number().over(order).cast("long"))


def date_listing(docs: DataFrame) -> DataFrame:
    """Dates in ascending order, numbered; there are as many as days."""
    return review_dates(docs).withColumn("no", F.row_number().over(Window.orderBy("date")).cast("long")).orderBy("no")


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Optional columns filled, and added where the table has none."""
    have = set(rows.columns)
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in have else v for c, v in defaults.items()})


def document_listing(docs: DataFrame) -> DataFrame:
    """Documents as they are listed: the path is the file name where none is known, other gaps are empty."""
    empty = dict.fromkeys(("warnings", "origin_pdf_path", "folder_category", "bound_file_path"), F.lit(""))
    return with_defaults(docs, {"relative_path": F.col("filename"), **empty, "parent_heading_level": F.lit(0)})


def kb_listing(kbs: DataFrame) -> DataFrame:
    return with_defaults(kbs, {"kb_type": F.lit("general"), "bound_folder_path": F.lit("")})


def latest_status(events: DataFrame, key: str, status: str, order: Sequence[str]) -> DataFrame:
    """Current status per key out of a status event table."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status), F.count(F.lit(1)).alias("n_events"))


def newest(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """A listing: newest first, limited; runs as one top-k without a full sort."""
    return rows.orderBy(*order).limit(limit)


def deadlines(entries: DataFrame, today: Column) -> DataFrame:
    """(name, date, days_left) out of written dates; an unreadable date stays as NULL."""
    from shelfmark.functions.dates import days_left, natural_date

    day = natural_date(F.col("date_text"), today)
    return entries.withColumn("date", day).withColumn("days_left", days_left(F.col("date"), today))


def upcoming(rows: DataFrame, today: Column, within: int = 7) -> DataFrame:
    """Deadlines from today up to ``within`` days ahead; days are counted on reading."""
    left = F.datediff("date", today)
    return rows.withColumn("days_left", left).where((left >= 0) & (left <= within))
