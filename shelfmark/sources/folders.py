"""Files below a folder. Tasks list them, so that the driver holds no list of them.

Spark's own file sources keep the status of every file in the driver, several times for a stream.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import SMALL_CODEC, checkpoint_root, cut

FILES = "path string, size long"
ENTRIES = f"{FILES}, folder boolean"
#: Entries after which a task leaves the folders that it has found to the next round.
OWN = 20_000
#: Rows of a batch; of a piece that the driver writes.
BATCH, PIECE = 8192, 50_000


def passed_over(name: str, folder: bool = False) -> bool:
    """Names that Spark's file sources do not read."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


def entries(path: str) -> Iterator[tuple[str, int, bool]]:
    """(path, size, folder) of what lies in a local folder; what goes away meanwhile is left out."""
    try:
        found = os.scandir(path.removeprefix("file:"))
    except (FileNotFoundError, NotADirectoryError):
        return
    with found:
        for entry in found:
            try:
                entry.name.encode()
                folder = entry.is_dir()
                if (folder or entry.is_file()) and not passed_over(entry.name, folder):
                    yield f"{path.rstrip('/')}/{entry.name}", 0 if folder else entry.stat().st_size, folder
            except (FileNotFoundError, UnicodeEncodeError):  # Spark cannot open a name that is no text either
                continue


def walked(tops: Iterator[str], own: int = OWN) -> Iterator[tuple[str, int, bool]]:
    """Files below ``tops``, and folders that were left; every top is listed itself."""
    seen = 0
    for top in tops:
        left = [top]
        while left:
            for path, size, folder in entries(left.pop()):
                seen += 1
                if folder and seen < own:
                    left.append(path)
                else:
                    yield path, size, folder
            if seen >= own:
                yield from ((path, 0, True) for path in left)
                left = []


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = walked(path for batch in batches for path in batch.column("path").to_pylist())
    while piece := list(islice(rows, BATCH)):
        path, size, folder = zip(*piece, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(folder, pa.bool_())], ["path", "size", "folder"])


def by_tasks(spark: SparkSession, tops: DataFrame) -> DataFrame:
    """Files below local folders (``path``), which all executors share. A round lists the folders that the one before left."""
    found, cores = [], spark.sparkContext.defaultParallelism
    while n := tops.count():
        # a task has few folders, for one of them may hold much
        step = cut(tops.repartition(min(n, max(4 * cores, n // 4000))).mapInArrow(_walk, ENTRIES), SMALL_CODEC)
        found.append(step.where("NOT folder").select("path", "size"))
        tops = step.where("folder").select("path")
    files = spark.createDataFrame([], FILES)
    for more in found:
        files = files.unionByName(more)
    return files


def by_client(spark: SparkSession, store, top) -> DataFrame:
    """Files below a folder of a store that only Spark's JVM opens: the driver reads one after the other and writes them in pieces."""
    base, left = top.toString().rstrip("/"), store.listFiles(top, True)

    def rows():
        while left.hasNext():
            status = left.next()
            path = status.getPath().toString()
            *folders, name = path[len(base) + 1:].split("/")
            if not passed_over(name) and not any(passed_over(x, True) for x in folders):
                yield path, status.getLen()

    out, files = f"{checkpoint_root(spark)}/shelfmark-{uuid.uuid4().hex}", rows()
    spark.createDataFrame([], FILES).write.parquet(out)
    while piece := list(islice(files, PIECE)):
        spark.createDataFrame(piece, FILES).coalesce(1).write.mode("append").option("compression", SMALL_CODEC).parquet(out)
    return spark.read.schema(FILES).parquet(out)


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file below ``root``, the same files under the same paths as Spark's ``binaryFile`` has, and empty ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    tops = store.globStatus(path)
    if tops is None:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {root}")
    folders = [x.getPath() for x in tops if x.isDirectory()]
    files = spark.createDataFrame([(x.getPath().toString(), x.getLen()) for x in tops if not x.isDirectory()], FILES)
    local = [(x.toString(),) for x in folders if x.toString().startswith("file:/")]
    if local:
        files = files.unionByName(by_tasks(spark, spark.createDataFrame(local, "path string")))
    for top in folders[len(local):]:  # a store is local or not
        files = files.unionByName(by_client(spark, store, top))
    return files


def unknown(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files, each once, whose path ``known`` does not hold.

    Counted by path, not joined: stored paths pack so well that Spark takes millions of them for small and
    would send them all through the driver.
    """
    rest = [c for c in files.columns if c != "path"]
    every = files.withColumn("_known", F.lit(False)).unionByName(known.select("path", F.lit(True).alias("_known")), allowMissingColumns=True)
    once = every.groupBy("path").agg(F.max("_known").alias("_known"), *[F.max(c).alias(c) for c in rest])
    return once.where("NOT _known").select(*files.columns)


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(at)
