"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells; a row falls into the cell its id hashes to, and the next
virtual node clockwise names its home shard. A shard takes the rows of its own cells up to
its bound; the rows beyond it walk on clockwise to the next virtual nodes whose shard has
room. Only rows of overfull shards move, and every bound holds.

Which rows move is settled by counts of cells alone: Spark counts the rows of each cell, the
walk is done on that table (``CELLS`` rows at every input size), and gives each cell a few
runs of ranks with a shard and a first slot each: at most one run a cell and one more for
every shard that becomes full. Rows then find their run by cell and rank. Texts are read
once, where they lie, for size and checksum.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = 1 << 14
NODES = 128
SHARDS = 40
Runs = list[tuple[int, int, int, int, int]]


def ring_nodes(shards: int, nodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in clockwise order."""
    return sorted(
        (int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % cells, s)
        for s in range(shards) for v in range(nodes)
    )


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """The most rows of each shard; without slack they differ by one at most and are all used up."""
    if slack:
        return [-(-int(total * (1 + slack)) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, nodes: int, cells: int, slack: float) -> Runs:
    """Runs (cell, first rank, last rank, shard, first slot) of all rows counted by cell."""
    ring = ring_nodes(shards, nodes, cells)
    at = [c for c, _ in ring]
    room, used = bounds(sum(counts.values()), shards, slack), [0] * shards
    runs: Runs = []
    over: list[tuple[int, int, int, int]] = []

    def put(cell: int, rank: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n:
            runs.append((cell, rank, rank + n - 1, shard, used[shard]))
            used[shard] += n
        return n

    for cell in sorted(counts):
        node = bisect.bisect_left(at, cell) % len(ring)
        n = put(cell, 0, counts[cell], ring[node][1])
        if n < counts[cell]:
            over.append((cell, n, counts[cell] - n, node))
    for cell, rank, left, node in over:
        while left:
            node = (node + 1) % len(ring)
            n = put(cell, rank, left, ring[node][1])
            rank, left = rank + n, left - n
    return runs


def position(key: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(cells)).cast("int")


def sharded(
    docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, cells: int = CELLS, slack: float = 0.0,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, size, text_crc32, home_shard, shard and slot of every row.

    ``size`` is the bytes of the text plus 16, ``text_crc32`` the unsigned CRC-32 of the text
    (null: of no bytes). With ``slack`` 0 the shards' row counts differ by one at most; with a
    larger one a shard has at most ``1 + slack`` times the mean and fewer rows move. ``slot``
    numbers the rows of a shard from 0 without gaps. Rows of a cell are ranked by the hash of
    their id, then id, checksum and size; equal rows get slots of their own, and as they are
    equal it doesn't matter which has which. Null ids share a cell for each checksum, so many
    of them spread over the ring. Other columns are not read. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    key = F.when(F.col("doc_id").isNull(), F.concat(F.lit("-"), F.col("text_crc32"))).otherwise(F.col("doc_id").cast("string"))
    rows = rows.withColumn("cell", position(key, cells))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    ids = ids.withColumn("text_crc32", F.when(F.col("doc_id").isNull(), F.crc32(body)))
    counts = {r[0]: r[1] for r in ids.groupBy(position(key, cells).alias("cell")).count().collect()}
    runs = docs.sparkSession.createDataFrame(
        walk(counts, shards, nodes, cells, slack), "cell int, low int, high int, shard int, base long"
    )
    homes = ring_nodes(shards, nodes, cells)
    at = [c for c, _ in homes]
    home = docs.sparkSession.createDataFrame(
        [(c, homes[bisect.bisect_left(at, c) % len(homes)][1]) for c in counts], "cell int, home_shard int"
    )
    places = F.broadcast(runs.join(home, "cell"))  # at most cells + shards rows
    order = Window.partitionBy("cell").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    return (
        ranked.join(places, "cell").where(F.col("rank").between(F.col("low"), F.col("high")))
        .select(
            "doc_id", "size", "text_crc32", "home_shard", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot")
        )
    )
