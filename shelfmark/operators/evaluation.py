"""Retrieval quality against labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The cut-offs of a report.
KS = (1, 3, 5, 10)


def relevance(hits: DataFrame, gold_docs: DataFrame, gold_chunks: DataFrame | None = None) -> DataFrame:
    """Hits with a 0/1 flag; a document or chunk counts once, at its first hit.

    ``gold_docs(query_id, doc_id)``; a chunk label beats a document label.
    """
    docs = gold_docs.select("query_id", "doc_id", F.lit(True).alias("_doc")).distinct()
    flagged = hits.join(docs, ["query_id", "doc_id"], "left")
    if gold_chunks is not None:
        chunks = gold_chunks.select("query_id", "chunk_id", F.lit(True).alias("_chunk")).distinct()
        flagged = flagged.join(chunks, ["query_id", "chunk_id"], "left")
    else:
        flagged = flagged.withColumn("_chunk", F.lit(None).cast("boolean"))
    unit = F.when(F.col("_chunk"), F.concat(F.lit("c"), F.col("chunk_id").cast("string"))).when(
        F.col("_doc"), F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    )
    extra = [c for c in ("config",) if c in hits.columns]
    # Hit lists are short by construction, so is every window here.
    first = F.row_number().over(Window.partitionBy(*extra, "query_id", "_unit").orderBy("rank")) == 1
    return (
        flagged.withColumn("_unit", unit)
        .withColumn("rel", F.when(F.col("_unit").isNotNull() & first, 1).otherwise(0))
        .drop("_doc", "_chunk", "_unit")
    )


def relevant_counts(queries: DataFrame, gold_docs: DataFrame, gold_chunks: DataFrame | None = None) -> DataFrame:
    """Number of relevant items per query: chunk labels if any, else document labels, at least 1."""
    docs = gold_docs.groupBy("query_id").agg(F.count(F.lit(1)).alias("_d"))
    out = queries.select("query_id").join(docs, "query_id", "left")
    if gold_chunks is not None:
        out = out.join(
            gold_chunks.groupBy("query_id").agg(F.count(F.lit(1)).alias("_c")), "query_id", "left"
        )
    else:
        out = out.withColumn("_c", F.lit(None).cast("long"))
    n = F.coalesce(F.nullif(F.col("_c"), F.lit(0)), F.col("_d"), F.lit(0))
    return out.select("query_id", F.greatest(n, F.lit(1)).cast("long").alias("n_relevant"))


def query_metrics(flags: DataFrame, counts: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Hit, recall and nDCG at each k, and reciprocal rank, for every query."""
    keys = [c for c in ("config",) if c in flags.columns] + ["query_id"]
    rel, rank = F.col("rel"), F.col("rank")
    sums = []
    for k in ks:
        inside = rank < k
        sums += [
            F.sum(F.when(inside, rel).otherwise(0)).alias(f"_n{k}"),
            F.sum(F.when(inside, rel / F.log2(rank + 2)).otherwise(0.0)).alias(f"_g{k}"),
        ]
    per = flags.groupBy(*keys).agg(*sums, F.max(F.when(rel == 1, 1.0 / (rank + 1))).alias("_rr"))
    # With several configurations the caller adds the queries without hits in macro().
    base = per.join(counts, "query_id") if len(keys) > 1 else counts.join(per, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = []
    for k in ks:
        ideal = F.aggregate(
            F.sequence(F.lit(0), F.least("n_relevant", F.lit(k)).cast("int") - 1),
            F.lit(0.0),
            lambda acc, i: acc + 1.0 / F.log2(i + 2),
        )
        out += [
            F.when(zero(f"_n{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
            (F.least(zero(f"_n{k}"), F.col("n_relevant")) / F.col("n_relevant")).alias(f"recall_{k}"),
            (zero(f"_g{k}") / ideal).alias(f"ndcg_{k}"),
        ]
    return base.select(*keys, "n_relevant", F.coalesce("_rr", F.lit(0.0)).alias("mrr"), *out)


def macro(per_query: DataFrame, n_queries: DataFrame | None = None, configs: list[str] | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """Averages over queries, per configuration; a query without hits counts as zero.

    ``n_queries`` is a one-row table with ``n``; needed where queries without
    hits have no row. ``configs`` names all configurations: one that finds
    nothing at all has a row of zeros.
    """
    names = ["mrr"] + [f"{m}_{k}" for k in ks for m in ("hit", "recall", "ndcg")]
    keys = [c for c in ("config",) if c in per_query.columns]
    sums = per_query.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in names], F.count(F.lit(1)).alias("_n")
    )
    if configs is not None:
        every = per_query.sparkSession.createDataFrame([(c,) for c in configs], "config string")
        sums = every.join(sums, "config", "left").na.fill(0)
    if n_queries is not None:
        sums = sums.withColumn("_n", n_queries.select("n").scalar())
    return sums.select(*keys, F.col("_n").alias("n_queries"), *[F.round(F.col(c) / F.col("_n"), 6).alias(c) for c in names])
