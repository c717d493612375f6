"""Incremental jobs: files that appear, documents that change, run events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators import catalog, chunking
from shelfmark.session import SMALL_CODEC, cut
from shelfmark.sources import folders, stores


def register_batch(files: DataFrame, table: str) -> None:
    """Register the files of one batch once; a file seen before keeps its row."""
    spark = files.sparkSession
    known = stores.read_store(spark, table) if stores.versions(spark, table) else files.limit(0)
    rows = catalog.visible_files(folders.unknown(files, known)).select(
        "path", "relative_path", "size",
        F.concat(F.lit("doc-"), F.substring(F.sha2("path", 256), 1, 16)).alias("doc_id"),
        catalog.initial_status(F.col("relative_path")).alias("status"),
        catalog.source_format(F.col("relative_path")).alias("source_format"),
        catalog.folder_category(F.col("relative_path")).alias("folder_category"),
    )
    stores.replace_in_store(rows, table)


def list_new(spark: SparkSession, root: str, listed: str) -> None:
    """Append (path, size) of the files below ``root`` that the table ``listed`` does not name; without any nothing is written."""
    folders.make_folder(spark, listed)
    found = folders.files_below(spark, root)
    fresh = cut(folders.unknown(found, spark.read.schema(folders.FILES).parquet(listed)), SMALL_CODEC)
    if not fresh.isEmpty():
        fresh.write.mode("append").option("compression", SMALL_CODEC).parquet(listed)


def register_files(spark: SparkSession, root: str, table: str, checkpoint: str) -> StreamingQuery:
    """Files below ``root`` as a stream of registrations.

    The stream reads a table of the files, ``listed`` in ``checkpoint``, to which each start adds what is new. So
    its log and the driver hold a few parts of that table, and not every file. Its own state is in ``stream``; what
    Spark's file source has left in ``checkpoint`` is not read, the files are listed once more then.
    """
    mark = re.sub("^[a-z0-9]+:/*", "/", root.rstrip("/")) + "/"
    listed = f"{checkpoint}/listed"
    list_new(spark, root, listed)
    found = (
        spark.readStream.schema(folders.FILES).option("maxFileAge", "36500d").parquet(listed)  # no part is too old
        .withColumn("relative_path", F.substring("path", F.locate(mark, "path") + len(mark), F.length("path")))
    )
    return (
        found.writeStream.foreachBatch(lambda df, _: register_batch(df, table))
        .option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    )


def index_batch(docs: DataFrame, table: str) -> None:
    """Chunk one batch of text documents and replace their chunks in the store.

    A document that comes several times in a batch counts once, by its newest text; without
    ``updated_at``, or at the same time, by the greatest text. Markdown (``source_format``
    "md") is cut by heading.
    """
    docs = catalog.latest(docs, ["doc_id"], [c for c in ("updated_at", "text") if c in docs.columns])
    marked = "source_format" in docs.columns
    sections = chunking.text_sections(docs) if marked else chunking.plain_sections(docs)
    children = chunking.text_children(sections)
    stores.replace_in_store(children, table, gone=docs.select("doc_id"))


def index_documents(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """A stream of documents into the chunk store; replays leave it as it is."""
    return (
        stream.writeStream.foreachBatch(lambda df, _: index_batch(df, table))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def append_events(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Progress events of runs, appended; the file sink writes each batch once."""
    return (
        stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def current_step(events: DataFrame) -> DataFrame:
    """The newest step of every run."""
    return catalog.latest_status(events, "run_id", "step", ["ts", "event_no"])
