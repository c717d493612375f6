"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut

SALTS = 8


def _with_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and its neighbours; a hub's edges are spread by salt."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): the root is the least node of its component.

    Large stars hang the larger neighbours of a node on its least neighbour, small stars the
    smaller ones; edges shrink to one star a component in a logarithmic number of rounds. Each
    round is written, so its lineage is short.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large)
        small = _with_min(large)
        rows = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = cut(rows.where("u != v").distinct())
        tops = after.select(F.col("v").alias("u")).distinct()
        settled = after.join(tops, "u", "left_semi").limit(1).count() == 0
        twice = after.count() != after.select("u").distinct().count()
        if settled and not twice:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after
