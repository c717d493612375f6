"""Search traces: what each stage found, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.functions.numbers import digits

SNIPPET = 400


def _brief(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    body = F.coalesce(F.nullif(F.col("retrieval_text"), F.lit("")), F.col("embedding_text"))
    about = chunks.select(
        F.col("child_chunk_id").alias("chunk_id"), "parent_chunk_id", "doc_id", "chunk_type", "index_kind",
        "header_path", "retrieval_text", "embedding_text", text.snippet(body, SNIPPET).alias("text"),
    )
    return about.join(hits, "chunk_id")


def keyword_tokens(keyword: Column) -> Column:
    """Tokens of a keyword that can be shown as a match; single letters and ideographs are dropped."""
    words = F.regexp_extract_all(keyword, F.lit(f"([A-Za-z0-9]+|[{text.IDEOGRAPH}]{{2,}})"), F.lit(1))
    return F.filter(
        F.concat(words, text.tokens(keyword)), lambda t: ~t.rlike(f"^([A-Za-z]|[{text.IDEOGRAPH}])$")
    )


def plan_tokens(plans: DataFrame) -> DataFrame:
    """(query_id, keywords, toks): tokens of a plan, first spelling first, with their keywords."""
    words = plans.select("query_id", F.posexplode("keywords").alias("k", "keyword"))
    toks = words.select("query_id", "k", F.posexplode(keyword_tokens(F.col("keyword"))).alias("t", "tok"))
    one = toks.groupBy("query_id", F.lower("tok").alias("low")).agg(
        F.min(F.struct("k", "t", "tok")).alias("at"), F.collect_set("k").alias("of")
    )
    lists = one.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "low", "of"))).alias("toks"))
    return plans.select("query_id", "keywords").join(lists, "query_id", "left")


def vector_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return _brief(hits, chunks).select(
        "query_id", "rank", "chunk_id", "parent_chunk_id", "doc_id", "chunk_type", "index_kind", "text",
        digits(F.col("score"), 4).alias("score"),
    )


def keyword_hits(hits: DataFrame, chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """Keyword hits with the plan tokens they contain and the keywords those belong to.

    Latin tokens match whole words in any case, other tokens match anywhere.
    """
    rows = _brief(hits, chunks).join(plan_tokens(plans), "query_id")
    hay = F.concat(F.col("retrieval_text"), F.lit("\n"), F.col("embedding_text"))
    rows = rows.withColumn("_hay", hay).withColumn(
        "_words", F.array_distinct(F.regexp_extract_all(F.lower("_hay"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    )

    def found(t: Column) -> Column:
        as_word = F.array_contains(F.col("_words"), t["low"])
        return F.when(t["low"].rlike("^[a-z0-9]+$"), as_word).otherwise(F.col("_hay").contains(t["at"]["tok"]))

    rows = rows.withColumn("_found", F.coalesce(F.filter("toks", found), F.array()))
    words = F.filter("keywords", lambda k, i: F.exists("_found", lambda t: F.array_contains(t["of"], i)))
    return rows.select(
        "query_id", "rank", "chunk_id", "doc_id", "index_kind", "text", digits(F.col("score"), 4).alias("score"),
        F.transform("_found", lambda t: t["at"]["tok"]).alias("matched_tokens"), words.alias("matched_keywords"),
    )


def fusion(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    return _brief(fused, chunks).select(
        "query_id", "rank", "chunk_id", "doc_id", "index_kind", "text", "vec_rank",
        digits(F.col("vec_score"), 4).alias("vec_score"), "kw_rank", digits(F.col("kw_score"), 4).alias("kw_score"),
        digits(F.col("score"), 5).alias("rrf_score"),
    )


def reranked(final: DataFrame, chunks: DataFrame) -> DataFrame:
    return _brief(final, chunks).select(
        "query_id", "rank", "prev_rank", "delta", "chunk_id", "parent_chunk_id", "doc_id", "chunk_type",
        "index_kind", "text", digits(F.col("score"), 4).alias("rerank_score"), "degraded",
    )


def counts(queries: DataFrame, **stages: DataFrame) -> DataFrame:
    """Hits per query and stage, zero where a stage found nothing."""
    out = queries.select("query_id")
    for name, hits in stages.items():
        n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, "query_id", "left")
    return out.na.fill(0, list(stages))


def matched_keywords(kw_trace: DataFrame) -> DataFrame:
    """All keywords a query matched in any hit."""
    return (
        kw_trace.select("query_id", F.explode("matched_keywords").alias("keyword")).distinct()
        .groupBy("query_id").agg(F.array_sort(F.collect_list("keyword")).alias("matched_keywords"))
    )


def min_max(hits: DataFrame, score: str = "score") -> DataFrame:
    """Scores of a hit list scaled to 0-1; equal scores all become 1."""
    low = hits.groupBy("query_id").agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return hits.join(low, "query_id").withColumn(
        "norm",
        F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
        .otherwise(1.0),
    ).drop("_lo", "_hi")


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with ``filename`` and ``source_format`` of their documents; empty where a document is not registered."""
    return hits.join(docs.select("doc_id", "filename", "source_format"), "doc_id", "left")


def documents_of(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, filename, source_format): the registered documents of each query's hits, each once."""
    found = hits.where(F.col("doc_id").isNotNull()).select("query_id", "doc_id").distinct()
    return found.join(docs.select("doc_id", "filename", "source_format"), "doc_id").select("query_id", "doc_id", "filename", "source_format")
