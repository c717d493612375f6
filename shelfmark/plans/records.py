"""Catalog work over the given tables: conversations, folders, statuses, deadlines, deletes, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import catalog, extra_index
from shelfmark.plans import corpora as C
from shelfmark.plans import sql as S
from shelfmark.plans.registry import query
from shelfmark.session import checkpoint_root, table
from shelfmark.sources import stores
from shelfmark.streaming import incremental

# ---- conversations ------------------------------------------------------------------------------


def messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.concat("conv_id", F.lit("/"), "turn").alias("message_id"), "turn", "role", "text"
    )
    return catalog.number_messages(rows, "turn")


_MSG = """
msg AS (SELECT conv_id AS conversation_id, conv_id || '/' || turn AS message_id, turn, role, text,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence_num FROM conversations)
"""


@query("message_sequence", f"WITH {_MSG} SELECT conversation_id, message_id, sequence_num FROM msg")
def message_sequence(spark, sf):
    return messages(spark, sf).select("conversation_id", "message_id", "sequence_num")


@query("next_message", f"WITH {_MSG} SELECT conversation_id, max(sequence_num) + 1 AS next_seq FROM msg GROUP BY 1")
def next_message(spark, sf):
    return catalog.next_sequence(messages(spark, sf))


@query("conversation_fork", f"""
WITH {_MSG}, pv AS (SELECT conversation_id, CASE WHEN conversation_id % 5 = 0 THEN NULL ELSE min(sequence_num) FILTER (role = 'assistant') END AS upto FROM msg GROUP BY 1)
SELECT conversation_id + 1000000 AS conversation_id, conversation_id AS parent_conversation_id, message_id, sequence_num, role, text
FROM msg JOIN pv USING (conversation_id) WHERE upto IS NULL OR sequence_num <= upto
""")
def conversation_fork(spark, sf):
    """Every conversation forked behind its first answer; every fifth at a message nobody knows."""
    msg = messages(spark, sf)
    answers = msg.groupBy("conversation_id").agg(
        F.min_by("message_id", F.when(F.col("role") == "assistant", F.col("sequence_num"))).alias("message_id")
    )
    pivots = answers.select(
        "conversation_id", (F.col("conversation_id") + 1000000).alias("new_conversation_id"),
        F.when(F.col("conversation_id") % 5 == 0, "nowhere").otherwise(F.coalesce("message_id", F.lit("nowhere"))).alias("message_id"),
    )
    return catalog.fork(msg, pivots).select(
        "conversation_id", "parent_conversation_id", "message_id", "sequence_num", "role", "text"
    )


@query("recent_conversations", """
SELECT conv_id, max(turn) AS last_turn, sum(length(text)) AS n_chars FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, n_chars DESC, conv_id LIMIT 50
""")
def recent_conversations(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("n_chars")
    )
    return catalog.newest(rows, 50, F.col("last_turn").desc(), F.col("n_chars").desc(), F.col("conv_id"))


@query("delete_conversations", """
WITH c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 4 = 1 THEN conv_id - 1 END AS parent FROM conversations),
gone AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'), gone2 AS (SELECT conv_id FROM gone UNION SELECT c.conv_id FROM c JOIN gone g ON c.parent = g.conv_id)
SELECT conv_id AS conversation_id, count(*) AS n_messages FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM gone2) GROUP BY 1
""")
def delete_conversations(spark, sf):
    """Conversations deleted together with their direct forks."""
    msg = table(spark, sf, "conversations").withColumnRenamed("conv_id", "conversation_id")
    convs = msg.select("conversation_id").distinct().withColumn(
        "parent_conversation_id", F.when(F.col("conversation_id") % 4 == 1, F.col("conversation_id") - 1)
    )
    gone = msg.where(F.col("role") == "system").select("conversation_id").distinct()
    _, left = catalog.delete_conversations(convs, msg, gone, children=True)
    return left.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"))


# ---- folders and files ----------------------------------------------------------------------------

_EXT = {0: ".pdf", 1: ".md", 2: ".txt", 3: ".pptx", 4: ".mp4", 5: ".png", 6: ".docx"}
_TOP = {0: "课堂录音/260101", 1: "课件", 2: "作业", 3: "通知", 4: "misc"}


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of a folder: their path, size and name follow their id."""
    pick = lambda m, c: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])[c.cast("int")]
    n = F.col("doc_id")
    rel = F.concat(
        pick(_TOP, n % 5), F.lit("/"), F.when(n % 11 == 3, ".hidden/").otherwise(""), F.when(n % 13 == 4, "~$").otherwise(""),
        F.lit("第"), (n % 20).cast("string"), F.lit("节 "), "lang", F.when(n % 9 == 2, "课堂要点").otherwise(""), n.cast("string"), pick(_EXT, n % 7),
    )
    return table(spark, sf, "documents").select(
        "doc_id", "lang", F.col("source").alias("kb_id"), rel.alias("relative_path"), F.concat(F.lit("/folder/"), rel).alias("path"),
        F.when(n % 17 == 5, 0).otherwise(F.col("n_chars")).alias("size"),
    )


_FILES = f"""
f AS (SELECT doc_id, lang, source AS kb_id, n_chars, (CASE doc_id % 5 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _TOP.items())} END) || '/'
   || CASE WHEN doc_id % 11 = 3 THEN '.hidden/' ELSE '' END || CASE WHEN doc_id % 13 = 4 THEN '~$' ELSE '' END || '第' || (doc_id % 20) || '节 ' || lang
   || CASE WHEN doc_id % 9 = 2 THEN '课堂要点' ELSE '' END || doc_id || (CASE doc_id % 7 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _EXT.items())} END) AS relative_path,
   CASE WHEN doc_id % 17 = 5 THEN 0 ELSE n_chars END AS size FROM documents),
disk AS (SELECT *, '/folder/' || relative_path AS path FROM f WHERE size > 0 AND doc_id % 11 <> 3 AND doc_id % 13 <> 4 AND doc_id % 7 <> 4),
kn AS (SELECT '/folder/' || relative_path AS path, doc_id::VARCHAR AS doc_id, CASE WHEN lang = 'de' THEN 'missing' ELSE 'indexed' END AS status FROM f WHERE lang <> 'es'),
ff AS (SELECT coalesce(d.path, k.path) AS path, k.doc_id, k.status, d.relative_path, CASE WHEN d.path IS NOT NULL AND k.path IS NULL THEN 'added'
   WHEN d.path IS NOT NULL AND k.status = 'missing' THEN 'restored' WHEN d.path IS NOT NULL THEN 'unchanged'
   WHEN k.status = 'missing' THEN 'still_missing' ELSE 'missing' END AS action FROM disk d FULL OUTER JOIN kn k ON d.path = k.path)
"""


def _known(spark: SparkSession, sf: str) -> DataFrame:
    """Registered documents: all languages but one, one of them marked as missing."""
    rows = files(spark, sf).where(F.col("lang") != "es")
    return rows.select(
        "path", F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("lang") == "de", "missing").otherwise("indexed").alias("status")
    )


@query("visible_files", f"WITH {_FILES} SELECT doc_id, relative_path FROM disk")
def visible_files(spark, sf):
    return catalog.visible_files(files(spark, sf)).select("doc_id", "relative_path")


@query("folder_diff", f"WITH {_FILES} SELECT path, doc_id, action FROM ff")
def folder_diff(spark, sf):
    return catalog.folder_diff(catalog.visible_files(files(spark, sf)), _known(spark, sf)).select("path", "doc_id", "action")


@query("folder_sync", f"""
WITH {_FILES} SELECT path, coalesce(doc_id, 'doc-' || substr(sha256(path), 1, 16)) AS doc_id, CASE WHEN action IN ('added', 'restored')
  THEN CASE WHEN regexp_matches(relative_path, '\\.(txt|md)$') THEN 'text_only' ELSE 'uploaded' END WHEN action = 'missing' THEN 'missing' ELSE status END AS status FROM ff
""")
def folder_sync(spark, sf):
    """Two syncs in a row; the second changes nothing."""
    disk = catalog.visible_files(files(spark, sf))
    once = catalog.folder_sync(disk, _known(spark, sf))
    return catalog.folder_sync(disk, once)


@query("file_kinds", f"""
WITH {_FILES} SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' WHEN 2 THEN 'txt' WHEN 3 THEN 'pptx' WHEN 4 THEN 'unknown' WHEN 5 THEN 'png' ELSE 'docx' END AS source_format,
  CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 3 THEN 'pptx' WHEN 5 THEN 'png' WHEN 6 THEN 'docx' ELSE 'pdf' END AS stored_format,
  CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 7 = 1 AND doc_id % 9 = 2 THEN 'review_note' ELSE 'recording' END WHEN 1 THEN 'slides' WHEN 2 THEN 'homework' WHEN 3 THEN 'notice' ELSE '' END AS category,
  (doc_id % 7 = 1 OR (doc_id % 7 = 2 AND doc_id % 5 <> 0)) AS indexable, CASE WHEN doc_id % 7 = 4 THEN 'media' ELSE 'accepted' END AS verdict FROM f
""")
def file_kinds(spark, sf):
    rel = F.col("relative_path")
    fmt, cat = catalog.source_format(rel), catalog.folder_category(rel)
    return files(spark, sf).select(
        "doc_id", fmt.alias("source_format"), catalog.safe_format(fmt).alias("stored_format"), cat.alias("category"),
        catalog.indexable_text(cat, fmt).alias("indexable"), catalog.upload_verdict(rel).alias("verdict"),
    )


@query("clean_paths", f"""
WITH {_FILES} SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE relative_path END AS clean FROM f
""")
def clean_paths(spark, sf):
    """Messy spellings of a path; one that climbs out of its folder is refused."""
    rel = F.col("relative_path")
    messy = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/./"), rel)).when(F.col("doc_id") % 4 == 1, F.replace(rel, F.lit("/"), F.lit("\\")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("  "), F.replace(rel, F.lit("/"), F.lit("//")))).otherwise(F.concat(F.lit("../"), rel))
    )
    return files(spark, sf).select("doc_id", catalog.clean_path(messy).alias("clean"))


@query("file_counts", "SELECT source AS kb_id, count(*) AS file_count FROM documents GROUP BY 1")
def file_counts(spark, sf):
    return catalog.file_counts(files(spark, sf))


@query("folder_tree_counts", r"""
WITH p AS (SELECT str_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS parts FROM pages),
x AS (SELECT array_to_string(parts[1:d], '/') AS path, d AS depth FROM (SELECT parts, unnest(range(1, len(parts))) AS d FROM p))
SELECT path, depth, count(*) AS n_files FROM x GROUP BY 1, 2
""")
def folder_tree_counts(spark, sf):
    rel = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return catalog.folder_tree(table(spark, sf, "pages").select(rel.alias("relative_path")))


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as recordings and notes of a date folder, numbered by their key."""
    day = F.date_format("o_orderdate", "yyMMdd")
    note = F.col("o_orderpriority").startswith("1")
    ext = F.when(note, "课堂要点.md").when(F.col("o_orderpriority").startswith("2"), ".m4a").otherwise(".txt")
    rel = F.concat(F.lit("课堂录音/"), day, F.lit("/第"), (F.col("o_orderkey") % 12).cast("string"), F.lit("节"), ext)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), rel.alias("relative_path"), catalog.folder_category(rel).alias("folder_category"),
        catalog.source_format(rel).alias("source_format"), F.when(F.col("o_orderstatus") == "P", "missing").otherwise("indexed").alias("status"),
    )


_REC = """
r AS (SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%y%m%d') AS date, (o_orderkey % 12)::INT AS section_num, o_orderpriority[1] AS p FROM orders WHERE o_orderstatus <> 'P')
"""


@query("review_dates", f"WITH {_REC} SELECT date, count(*) FILTER (p NOT IN ('1', '2')) AS section_count, bool_or(p = '1') AS has_notes FROM r GROUP BY date")
def review_dates(spark, sf):
    return catalog.review_dates(recordings(spark, sf))


@query("review_sections", f"""
WITH {_REC}, n AS (SELECT date, section_num, max(doc_id) AS note_doc_id FROM r WHERE p = '1' GROUP BY 1, 2)
SELECT date, section_num, doc_id AS txt_doc_id, note_doc_id FROM r LEFT JOIN n USING (date, section_num) WHERE p NOT IN ('1', '2')
""")
def review_sections(spark, sf):
    return catalog.review_sections(recordings(spark, sf))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as notes: the conversation is the date, the turn the section."""
    return table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        F.lit("kb").alias("kb_id"), F.lit("Alge:bra").alias("course"), F.col("conv_id").cast("string").alias("date"),
        F.col("turn").alias("section_num"), F.col("text").alias("content"),
    )


@query("notes_export", """
SELECT 'kb' AS kb_id, conv_id::VARCHAR AS date, 'Alge:bra ' || conv_id || ' 课后复习讲义' AS title, '# Alge:bra ' || conv_id || ' 课后复习讲义' || chr(10) || chr(10)
  || string_agg('## 第 ' || turn || ' 节课堂要点' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown
FROM conversations WHERE role = 'assistant' GROUP BY conv_id
""")
def notes_export(spark, sf):
    return stores.notes_markdown(notes(spark, sf))


@query("note_files", """
SELECT '课堂录音/' || conv_id || '/Alge_bra' || conv_id || '第' || lpad(turn::VARCHAR, 2, '0') || '节课堂要点.md' AS path, text AS content FROM conversations WHERE role = 'assistant'
""")
def note_files(spark, sf):
    return stores.note_files(notes(spark, sf)).select("path", "content")


# ---- tables ---------------------------------------------------------------------------------------


@query("doc_stats", f"""
WITH {S.CHUNKS}
SELECT doc_id, (SELECT count(*) FROM chunks c WHERE c.doc_id = d.doc_id) AS child_chunks_count,
  (SELECT count(DISTINCT parent_chunk_id) FROM chunks c WHERE c.doc_id = d.doc_id) AS parent_chunks_count,
  (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS extra_indexes_count FROM documents d
""")
def doc_stats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return catalog.document_stats(
        docs, child_chunks=C.text_chunks(spark, sf), parent_chunks=C.text_parents(spark, sf), extra_indexes=table(spark, sf, "labels")
    )


@query("cascade_delete", """
WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'documents' AS tab, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM gone)
""")
def cascade_delete(spark, sf):
    labels = table(spark, sf, "labels")
    left = catalog.cascade_delete(
        {"documents": table(spark, sf, "documents"), "labels": labels}, labels.where(F.col("toxic") == 1)
    )
    count = lambda name: left[name].agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n"))
    return count("documents").unionByName(count("labels"))


@query("latest_status", """
SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, count(*) AS n_events FROM events GROUP BY user_id
""")
def latest_status(spark, sf):
    return catalog.latest_status(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("upserted_rows", """
WITH u AS (SELECT user_id, event_type, event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_type, event_id, value, k FROM u WHERE rn = 1
""")
def upserted_rows(spark, sf):
    """Clicks and views first, the rest of the events upserted over them by (user, type)."""
    ev = table(spark, sf, "events").select(
        "user_id", "event_type", "event_id", "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    early = F.col("value") < 20
    return catalog.upsert(ev.where(early), ev.where(~early), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value", "k"
    )


@query("replaced_documents", """
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE 'old' END AS version, n_chars FROM documents
""")
def replaced_documents(spark, sf):
    """Labelled documents come anew and replace their old rows; doing it twice changes nothing."""
    docs = table(spark, sf, "documents").select("doc_id", F.lit("old").alias("version"), "n_chars")
    fresh = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("version", F.lit("new"))
    return catalog.replace_documents(catalog.replace_documents(docs, fresh), fresh)


@query("copied_documents", f"""
WITH {_FILES}, b AS (SELECT doc_id, kb_id, regexp_extract(relative_path, '[^/]*$') AS filename FROM f)
SELECT 'copy-' || doc_id || '-archive' AS doc_id, 'archive' AS kb_id, regexp_extract(filename, '^(.*)\\.[^.]*$', 1) || '_副本' || regexp_extract(filename, '(\\.[^.]*)$', 1) AS filename, 'uploaded' AS status FROM b
""")
def copied_documents(spark, sf):
    docs = files(spark, sf).select("doc_id", "kb_id", text.base_name(F.col("relative_path")).alias("filename"), F.lit("indexed").alias("status"))
    return catalog.copy_documents(docs, F.lit("archive"))


@query("moved_documents", f"""
WITH {_FILES} SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL AND quality = 0 THEN 'attic' ELSE kb_id END AS kb_id, CASE WHEN toxic = 1 THEN 'moved/' || doc_id ELSE relative_path END AS relative_path
FROM f LEFT JOIN labels l USING (doc_id)
""")
def moved_documents(spark, sf):
    moves = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, "attic").alias("kb_id"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("moved/"), "doc_id")).alias("relative_path"),
    )
    return catalog.move_documents(files(spark, sf).select("doc_id", "kb_id", "relative_path"), moves)


@query("token_backfill", f"""
SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS fts_text, 'txt' AS source_format FROM documents
""")
def token_backfill(spark, sf):
    """Two columns added to a stored table and filled for its rows."""
    docs = C.documents(spark, sf).select("doc_id", "text")
    filled = catalog.add_column(docs, "fts_text", F.array_join(text.tokens(F.col("text")), " "))
    return catalog.add_column(filled, "source_format", F.lit("txt")).drop("text")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as extra index entries of their document's parent."""
    return table(spark, sf, "labels").select(
        F.concat(F.lit("ix-"), "doc_id").alias("index_id"), F.concat(F.lit("pc-"), "doc_id", F.lit("--1")).alias("parent_chunk_id"),
        F.when(F.col("quality") == 1, "summary").otherwise("custom").alias("kind"), F.concat(F.lit("quality "), "quality").alias("index_text"),
        (F.col("toxic") == 0).alias("enabled"), F.col("doc_id").alias("created_at"),
    )


@query("index_entries", """
SELECT 'ix-' || doc_id AS index_id, 'pc-' || doc_id || '--1' AS parent_chunk_id, CASE WHEN quality = 1 THEN 'summary' ELSE 'custom' END AS kind,
  CASE WHEN toxic = 1 THEN 'checked' ELSE 'quality ' || quality END AS index_text, toxic = 1 OR quality = 1 AS enabled FROM labels
""")
def index_entries(spark, sf):
    """Entries switched off for low quality, edited and switched on for toxic documents."""
    rows = entries(spark, sf)
    changes = table(spark, sf, "labels").select(
        F.concat(F.lit("ix-"), "doc_id").alias("index_id"),
        F.when(F.col("toxic") == 1, True).when(F.col("quality") == 0, False).alias("enabled"),
        F.when(F.col("toxic") == 1, "checked").alias("index_text"),
    )
    return extra_index.listing(extra_index.set_enabled(rows, changes)).drop("created_at")


@query("question_entries", """
SELECT event_id, 'why ' || event_type || '?' || chr(10) || 'when ' || user_id || '?' AS questions FROM events WHERE event_id % 3 > 0
""")
def question_entries(spark, sf):
    """Provider answers with questions, fenced or bare; broken answers give nothing."""
    body = F.to_json(F.struct(F.array(
        F.concat(F.lit(" why "), "event_type", F.lit("? ")), F.lit(" "), F.concat(F.lit("when "), "user_id", F.lit("?"))
    ).alias("questions")))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    answer = F.when(F.col("event_id") % 3 == 0, "{no json").when(F.col("event_id") % 3 == 1, fenced).otherwise(body)
    rows = table(spark, sf, "events").select("event_id", extra_index.question_text(answer).alias("questions"))
    return rows.where(F.col("questions").isNotNull())


# ---- dates ----------------------------------------------------------------------------------------

_TODAY = "1997-03-15"


def written_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates written in four ways, one of them unreadable."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    said = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.concat(F.month(day), F.lit("月"), F.dayofmonth(day), F.lit("日前")))
        .when(k == 2, F.concat(F.lit("due "), F.month(day), F.lit("/"), F.dayofmonth(day))).otherwise("13月45日")
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), said.alias("date_text"))


_DATES = f"""
wd AS (SELECT o_orderkey AS name, o_orderkey % 4 AS k, o_orderdate::DATE AS d,
   make_date(1997, month(o_orderdate), CASE WHEN month(o_orderdate) = 2 THEN least(day(o_orderdate), 28) ELSE day(o_orderdate) END) AS y FROM orders),
dl AS (SELECT name, CASE WHEN k = 0 THEN d WHEN k = 3 THEN NULL WHEN month(d) = 2 AND day(d) = 29 THEN NULL
   WHEN y < DATE '{_TODAY}' THEN y + INTERVAL 1 YEAR ELSE y END::DATE AS date FROM wd)
"""


@query("deadlines", f"WITH {_DATES} SELECT name, date::VARCHAR AS date, date_diff('day', DATE '{_TODAY}', date) AS days_left FROM dl")
def deadlines(spark, sf):
    out = catalog.deadlines(written_dates(spark, sf), F.lit(_TODAY).cast("date"))
    return out.select("name", F.col("date").cast("string").alias("date"), F.col("days_left").cast("long").alias("days_left"))


@query("upcoming_deadlines", f"""
WITH {_DATES} SELECT name, date::VARCHAR AS date, date_diff('day', DATE '{_TODAY}', date) AS days_left FROM dl WHERE date_diff('day', DATE '{_TODAY}', date) BETWEEN 0 AND 7
""")
def upcoming_deadlines(spark, sf):
    today = F.lit(_TODAY).cast("date")
    rows = catalog.upcoming(catalog.deadlines(written_dates(spark, sf), today), today).orderBy("days_left", "name")
    return rows.select("name", F.col("date").cast("string").alias("date"), F.col("days_left").cast("long").alias("days_left"))


# ---- streams --------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream; its path may be a file or a folder of files, which a pattern matches alike."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("incremental_index", f"""
WITH {S.CHUNKS} SELECT doc_id, count(*) AS n_chunks, sum(length(text)) AS n_chars FROM chunks GROUP BY doc_id
""")
def incremental_index(spark, sf):
    """The document stream indexed, then one batch replayed; the store equals the batch result."""
    root = _scratch(spark)
    incremental.index_documents(_stream(spark, sf, "documents"), f"{root}/chunks", f"{root}/checkpoint").awaitTermination()
    incremental.index_batch(table(spark, sf, "documents").where(F.col("lang") == "fr"), f"{root}/chunks")
    return stores.read_store(spark, f"{root}/chunks").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("embedding_text")).alias("n_chars")
    )


@query("run_events", """
SELECT user_id AS run_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS step, count(*) AS n_events FROM events GROUP BY 1
""")
def run_events(spark, sf):
    """Events appended from a stream; the newest step of every run."""
    root = _scratch(spark)
    events = _stream(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("step"), "ts", F.col("event_id").alias("event_no")
    )
    incremental.append_events(events, f"{root}/events", f"{root}/checkpoint").awaitTermination()
    return incremental.current_step(spark.read.parquet(f"{root}/events"))
