"""Writing and reading the tables of a knowledge base.

A store is a folder of versions. A batch writes the rows of its documents, and the keys of the
documents that it replaces or removes, into folders of its own; one appended row in ``log`` then
makes all tables of the batch visible together. A batch costs what it holds, a reader sees whole
versions only, and a job that dies leaves nothing visible. Rows of documents that a later version
names are passed over when they are read; ``compact`` writes the live rows as one version.
A store has one writer at a time.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.utils import AnalysisException

from shelfmark.functions import text
from shelfmark.operators.catalog import replace_documents
from shelfmark.operators.scan import joined_text
from shelfmark.session import SMALL_CODEC

LOG = "version long, folder string, tables array<string>, base boolean"
ROWS = "rows"


def versions(spark: SparkSession, path: str) -> list[Row]:
    """The committed versions that readers need, oldest first: those since the last compaction.

    The list has a row a batch; compaction keeps it short.
    """
    try:
        log = sorted(spark.read.schema(LOG).parquet(f"{path}/log").collect(), key=lambda r: r.version)
    except AnalysisException:  # nothing was written yet
        return []
    last = max((i for i, r in enumerate(log) if r.base), default=0)
    return log[last:]


def commit(
    spark: SparkSession, path: str, tables: Mapping[str, DataFrame], key: str = "doc_id", gone: DataFrame | None = None, base: bool = False,
) -> int:
    """Write the rows of ``tables`` as one version and make them visible together; returns the version.

    Every document in any of them replaces its rows in all of them. ``gone(key)`` names documents that
    leave without new rows. Null keys count as one document. Rows are a function of their document, so the same
    batch twice changes nothing. ``base`` leaves all earlier versions behind.
    """
    known = versions(spark, path)
    version = known[-1].version + 1 if known else 1
    folder = f"v{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.withColumn("_version", F.lit(version)).write.option("compression", SMALL_CODEC).parquet(f"{path}/{folder}/{name}")
    if known and not base:  # the first version replaces nothing
        keys = [spark.read.parquet(f"{path}/{folder}/{name}").select(key) for name in tables]
        keys += [gone.select(key)] if gone is not None else []
        every = keys[0]
        for more in keys[1:]:
            every = every.unionByName(more)
        every.distinct().withColumn("_last", F.lit(version)).write.parquet(f"{path}/{folder}/_replaced")
    row = [(version, folder, list(tables), base)]
    spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return version


def read_store(
    spark: SparkSession, path: str, name: str = ROWS, key: str = "doc_id", only: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The live rows of one table as of now; later versions do not change what was returned.

    ``only`` narrows the rows before they are held against what was replaced; it must keep ``key``.
    """
    known = versions(spark, path)
    parts = [f"{path}/{v.folder}/{name}" for v in known if name in v.tables]
    if not parts:
        raise FileNotFoundError(f"no committed version of {name} below {path}")
    rows = spark.read.option("mergeSchema", "true").parquet(*parts)
    rows = rows if only is None else only(rows)
    later = [f"{path}/{v.folder}/_replaced" for v in known[1:]]
    if later:
        # Only what later batches name is joined, not the keys of the whole store.
        last = spark.read.parquet(*later).groupBy(F.col(key).alias("_key")).agg(F.max("_last").alias("_last"))
        rows = rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_version") < F.col("_last")), "left_anti")
    return rows.drop("_version")


def compact(
    spark: SparkSession, path: str, key: str = "doc_id", lay_out: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None
) -> int:
    """The live rows of all tables as one version, from which readers start; ``lay_out`` orders some of them."""
    names = {name for v in versions(spark, path) for name in v.tables}
    live = {name: read_store(spark, path, name, key) for name in sorted(names)}
    return commit(spark, path, {name: (lay_out or {}).get(name, lambda d: d.hint("rebalance"))(df) for name, df in live.items()}, key, base=True)


def replace_in_store(df: DataFrame, path: str, key: str = "doc_id", gone: DataFrame | None = None) -> None:
    """Replace the rows of the documents in ``df`` in a store of one table."""
    commit(df.sparkSession, path, {ROWS: df.hint("rebalance")}, key, gone)


def write_ir(tables: Mapping[str, DataFrame], root: str) -> int:
    """Blocks, sections, pages and documents of a batch, visible together."""
    spark = next(iter(tables.values())).sparkSession
    return commit(spark, root, {name: df.hint("rebalance") for name, df in tables.items()})


def read_ir(spark: SparkSession, basic: str, enriched: str, table: str = "blocks") -> DataFrame:
    """Enriched rows where a document has them, else the basic ones."""
    plain = read_store(spark, basic, table)
    if not any(table in v.tables for v in versions(spark, enriched)):
        return plain
    return replace_documents(plain, read_store(spark, enriched, table))


def write_chunks(parents: DataFrame, children: DataFrame, root: str) -> int:
    """Parent and child chunks as lines of JSON in a column ``value``, visible together."""
    line = lambda df: df.select("doc_id", F.to_json(F.struct(*df.columns)).alias("value"))
    return commit(parents.sparkSession, root, {"parent_chunks": line(parents), "child_chunks": line(children)})


def read_chunks(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Chunks of one kind (``schema`` as DDL); blank and malformed lines are skipped."""
    return parsed_lines(read_store(spark, root, name).select("value"), schema)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Lines of JSON (``value``) as rows; blank and malformed ones, and those that are no objects, are skipped."""
    read = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value").startswith("{")).select(read.alias("r")).where("r._bad IS NULL")
    return rows.select("r.*").drop("_bad")


def index_rows(children: DataFrame, vectors: DataFrame) -> DataFrame:
    """Children with their vectors; a different number of both is an error."""
    joined = children.join(vectors.select("child_chunk_id", "embedding"), "child_chunk_id", "full_outer")
    lost = F.raise_error(F.concat(F.lit("chunk and vector do not pair up: "), F.col("child_chunk_id")))
    paired = F.col("doc_id").isNotNull() & F.col("embedding").isNotNull()
    return joined.withColumn("embedding", F.when(paired, F.col("embedding")).otherwise(lost.cast("array<float>")))


def append_deviations(deviations: DataFrame, path: str) -> None:
    """Append reports of documents with deviations; clean ones have no rows to write."""
    deviations.write.mode("append").json(path)


def write_probe(counts: DataFrame, summary: DataFrame, root: str) -> None:
    summary.write.mode("overwrite").json(f"{root}/totals")
    counts.write.mode("overwrite").json(f"{root}/reports")


def notes_markdown(notes: DataFrame) -> DataFrame:
    """One Markdown text per (kb, date): title, then sections by number.

    Needs ``kb_id, course, date, section_num, content``.
    """
    piece = F.concat(
        F.lit("## 第 "), F.col("section_num").cast("string"), F.lit(" 节课堂要点\n\n"), F.col("content")
    )
    body = joined_text(
        notes.withColumn("_piece", piece), ["kb_id", "course", "date"], "section_num", "_piece", "\n\n", "body"
    )
    title = F.concat(F.col("course"), F.lit(" "), F.col("date"), F.lit(" 课后复习讲义"))
    return body.select(
        "kb_id", "date", title.alias("title"), F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("body")).alias("markdown")
    )


def note_files(notes: DataFrame) -> DataFrame:
    """(kb_id, path, content): one file per section with a safe name."""
    name = F.concat(
        text.safe_file_name(F.col("course")), F.col("date"), F.lit("第"),
        F.lpad(F.col("section_num").cast("string"), 2, "0"), F.lit("节课堂要点.md"),
    )
    return notes.select(
        "kb_id", F.concat(F.lit("课堂录音/"), F.col("date"), F.lit("/"), name).alias("path"), "content"
    )


class NoteWriter(DataSourceWriter):
    """Files of the names that the rows give, below one folder. A task writes under names of its own; the job's end renames them."""

    def __init__(self, options: Mapping[str, str], overwrite: bool) -> None:
        self.root, self.attempt = options["path"], uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        import posixpath

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        task, written = uuid.uuid4().hex, []
        try:
            for row in rows:
                if any(part in ("", ".", "..") for part in row["path"].split("/")):
                    raise ValueError(f"not a path below the folder: {row['path']!r}")
                store.create_dir(posixpath.dirname(f"{root}/{row['path']}"), recursive=True)
                written.append(row["path"])
                with store.open_output_stream(made_as(root, row["path"], task)) as out:
                    out.write((row["content"] or "").encode())
        except Exception:
            for made in (made_as(root, path, task) for path in written):
                if store.get_file_info(made).type != fs.FileType.NotFound:
                    store.delete_file(made)
            raise
        return Written.of(task, written)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.each(messages, lambda store, made, path: store.move(made, path))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.each(messages, lambda store, made, path: store.delete_file(made))

    def each(self, messages: list[WriterCommitMessage | None], act) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        for message in messages:
            for path in message.paths() if message is not None else ():
                act(store, made_as(root, path, message.task), f"{root}/{path}")


def made_as(root: str, path: str, task: str) -> str:
    """The name under which a task writes the file of ``path``."""
    folder, _, name = f"{root}/{path}".rpartition("/")
    return f"{folder}/.{name}.{task}"


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: its name and the paths below the folder, sorted and packed."""

    task: str
    packed: bytes

    @classmethod
    def of(cls, task: str, paths: list[str]) -> Written:
        return cls(task, zlib.compress("\0".join(sorted(paths)).encode(), 6))

    def paths(self) -> list[str]:
        found = zlib.decompress(self.packed).decode()
        return found.split("\0") if found else []


class NoteFiles(DataSource):
    """``df.write.format("note_files").save(folder)`` for rows of (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NoteWriter(self.options, overwrite)


def write_notes(files: DataFrame, root: str) -> None:
    """One file a note, under the name its ``path`` gives below ``root``; a note of the same path replaces it.

    Files appear when all tasks are done; a job that fails leaves none. Each path is written once: of
    rows with the same path the one with the greatest content stays.
    """
    files.sparkSession.dataSource.register(NoteFiles)
    once = files.groupBy("path").agg(F.max("content").alias("content"))
    once.write.format("note_files").mode("append").save(root)
