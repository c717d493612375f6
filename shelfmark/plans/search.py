"""Chunking, recall, fusion, reranking and traces over the documents."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.functions.windows import pack
from shelfmark.operators import chunking, context, evaluation, extra_index, providers, trace
from shelfmark.operators import postings as P
from shelfmark.operators import retrieval as R
from shelfmark.operators import vectors as V
from shelfmark.plans import corpora as C
from shelfmark.plans import sql as S
from shelfmark.plans.registry import query
from shelfmark.session import SMALL_CODEC, checkpoint_root, cut, table
from shelfmark.sources import search_index


@dataclass
class Index:
    """The stored index of the text documents, and the queries put to it."""

    stored: search_index.SearchIndex
    queries: DataFrame

    @property
    def chunks(self) -> DataFrame:
        return self.stored.chunks

    @property
    def toks(self) -> DataFrame:
        return self.stored.toks


#: Index folders of this application by what they were built from: built by the first search, read by all.
_BUILT: dict[tuple, str] = {}


def built_from(spark: SparkSession, sf: str) -> tuple:
    """What an index of ``documents`` depends on: its files, when they were last written, and their rows."""
    docs = table(spark, sf, "documents")
    state = docs.agg(F.max("_metadata.file_modification_time"), F.count(F.lit(1))).first()
    return (spark.conf.get("spark.app.id"), sf, hash(tuple(sorted(docs.inputFiles()))), *state)


def index(spark: SparkSession, sf: str) -> Index:
    """The search index of ``documents``, written once an application and anew when the table changes."""
    key = built_from(spark, sf)
    if key not in _BUILT:
        root = f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}"
        search_index.add_batch(C.text_chunks(spark, sf), table(spark, sf, "documents"), root)
        _BUILT[key] = root
    return Index(search_index.opened(spark, _BUILT[key]), C.queries(spark, sf))


def embedded(ix: Index) -> tuple[DataFrame, DataFrame]:
    asked = providers.embed(ix.queries, "text", text_type="query")
    return asked.select("query_id", "kb_id", "embedding"), ix.stored.vectors.select("chunk_id", "doc_id", "embedding")


def hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score")


# ---- chunking -------------------------------------------------------------------------------


@query("sentence_windows", f"""
WITH one AS (SELECT doc_id, {S.strip('text')} AS body FROM documents),
sents AS (SELECT doc_id, body, {S.sentences('body')} AS segs FROM one WHERE body <> ''),
folded AS (SELECT doc_id, CASE WHEN length(body) <= 500 THEN {{'o': [body], 'c': ''}} ELSE {S.FOLD.format(segs='segs')} END AS st FROM sents),
wins AS (SELECT doc_id, {S.CLOSE} AS w FROM folded)
SELECT doc_id, no AS window_no, total AS window_total, body AS window_text FROM
 (SELECT doc_id, unnest(w) AS body, unnest(range(len(w))) AS no, len(w) AS total FROM wins)
""")
def sentence_windows(spark, sf):
    docs = C.documents(spark, sf).select("doc_id", text.strip(F.col("text")).alias("body"))
    whole = F.when(F.length("body") <= 500, F.array("body")).otherwise(pack(text.sentences(F.col("body"))))
    wins = docs.where("body <> ''").select("doc_id", whole.alias("w"))
    return wins.select("doc_id", F.size("w").cast("long").alias("window_total"), F.posexplode_outer("w")).select(
        "doc_id", F.col("pos").cast("long").alias("window_no"), "window_total", F.col("col").alias("window_text")
    )


@query("child_chunks_text", f"""
WITH {S.CHUNKS}
SELECT chunk_id AS child_chunk_id, parent_chunk_id, doc_id, text AS embedding_text, total > 1 AS is_atomic_fragment,
  CASE WHEN total > 1 THEN no END AS fragment_index, CASE WHEN total > 1 THEN total END AS fragment_total FROM chunks
""")
def child_chunks_text(spark, sf):
    return C.text_chunks(spark, sf).select(
        "child_chunk_id", "parent_chunk_id", "doc_id", "embedding_text", "is_atomic_fragment",
        F.col("fragment_index").cast("long").alias("fragment_index"),
        F.col("fragment_total").cast("long").alias("fragment_total"),
    )


@query("text_documents_indexed", f"""
WITH {S.CHUNKS}
SELECT kb_id, count(DISTINCT parent_chunk_id) AS parents, count(*) AS children, sum(length(text)) AS n_chars
FROM chunks GROUP BY kb_id
""")
def text_documents_indexed(spark, sf):
    kb = table(spark, sf, "documents").select("doc_id", F.col("source").alias("kb_id"))
    per_doc = C.text_chunks(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("children"), F.sum(F.length("embedding_text")).alias("n_chars")
    )
    return per_doc.join(kb, "doc_id").groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("parents"), F.sum("children").alias("children"), F.sum("n_chars").alias("n_chars")
    )


@query("corpus_stats", f"""
WITH {S.CHUNKS}
SELECT term, count(*) AS df, sum(tf) AS cf FROM
 (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM ctoks) GROUP BY 1, 2)
GROUP BY term
""")
def corpus_stats(spark, sf):
    posts = P.postings(P.tokenized(C.text_chunks(spark, sf)))
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("corpus_totals", f"""
WITH {S.CHUNKS}
SELECT count(*) AS n_chunks, round(sum(len(toks)) / count(*), 6) AS avg_len FROM ctoks
""")
def corpus_totals(spark, sf):
    return P.corpus_totals(P.tokenized(C.text_chunks(spark, sf))).withColumn("avg_len", F.round("avg_len", 6))


# ---- recall legs -----------------------------------------------------------------------------


@query("bm25_topk", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.keyword('or')} SELECT query_id, chunk_id, rank, score FROM kw
""")
def bm25_topk(spark, sf):
    ix = index(spark, sf)
    return hits(search_index.keyword_hits(ix.stored, ix.queries, mode="or"))


def updated_index(spark: SparkSession, sf: str) -> search_index.SearchIndex:
    """An index of three batches: old texts of some documents and one that goes; the true texts; those once more."""
    docs = C.documents(spark, sf)
    root = f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}"
    goes = F.lit(-1).cast("long").alias("doc_id")
    old = docs.where(F.col("doc_id") % 7 == 0).withColumn("text", F.concat(F.lit("former words. "), F.coalesce("text", F.lit(""))))
    old = old.unionByName(old.where("doc_id = 0").withColumn("doc_id", goes))
    for rows in (old, docs, docs.where(F.col("doc_id") % 5 == 0)):
        names = rows.select("doc_id").unionByName(spark.range(1).select(goes))
        search_index.add_batch(chunking.text_children(chunking.plain_sections(rows)), names, root)
    return search_index.opened(spark, root)


@query("indexed_bm25", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.keyword('or')} SELECT query_id, chunk_id, rank, score FROM kw
""")
def indexed_bm25(spark, sf):
    """Keyword hits from stored postings after documents were replaced, removed and replayed."""
    return hits(search_index.keyword_hits(updated_index(spark, sf), C.queries(spark, sf), mode="or"))


@query("indexed_vector", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.vector()} SELECT query_id, chunk_id, rank, score FROM vec
""")
def indexed_vector(spark, sf):
    """Vector hits from stored vectors after the same batches."""
    asked = providers.embed(C.queries(spark, sf), "text", text_type="query").select("query_id", "embedding")
    return hits(search_index.vector_hits(updated_index(spark, sf), asked))


@query("index_rows", f"""
WITH {S.CHUNKS} SELECT doc_id, count(*) AS chunks, sum(len(toks))::BIGINT AS tokens, sum(len(list_distinct(toks)))::BIGINT AS postings, count(*) AS vectors
FROM ctoks GROUP BY doc_id
""")
def index_rows(spark, sf):
    """What the index holds of each document after the same batches."""
    ix = updated_index(spark, sf)
    chunks = ix.chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("doc_len").alias("tokens"))
    posts = ix.postings.groupBy("doc_id").agg(F.count("*").alias("postings"))
    return chunks.join(posts, "doc_id", "left").join(ix.vectors.groupBy("doc_id").agg(F.count("*").alias("vectors")), "doc_id").na.fill(0)


@query("bm25_and_topk", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.keyword('and')} SELECT query_id, chunk_id, rank, score FROM kw
""")
def bm25_and_topk(spark, sf):
    ix = index(spark, sf)
    return hits(search_index.keyword_hits(ix.stored, ix.queries, mode="and"))


_READY = """
ready AS (SELECT doc_id, source AS kb_id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'needs_review' ELSE 'indexed' END AS status
  FROM documents LEFT JOIN labels USING (doc_id))
"""
_IN_SCOPE = """EXISTS (SELECT 1 FROM q qq JOIN chunks cc ON cc.kb_id = qq.kb_id JOIN ready r ON r.doc_id = cc.doc_id
  WHERE qq.query_id = kw_s.query_id AND cc.chunk_id = kw_s.chunk_id AND r.status IN ('indexed', 'needs_review'))"""


@query("kb_scoped_bm25", f"""
WITH {S.CHUNKS}, {S.QUERY}, {_READY}, {S.keyword('or', where=_IN_SCOPE)} SELECT query_id, chunk_id, rank, score FROM kw
""")
def kb_scoped_bm25(spark, sf):
    ix = index(spark, sf)
    scope = R.scoped_documents(C.registered(spark, sf))
    return hits(search_index.keyword_hits(ix.stored, ix.queries, mode="or", scope=scope))


@query("kb_scope", f"""
WITH {_READY} SELECT kb_id, count(*) AS n_docs FROM ready WHERE status IN ('indexed', 'needs_review') GROUP BY kb_id
""")
def kb_scope(spark, sf):
    return R.scoped_documents(C.registered(spark, sf)).groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_docs"))


@query("text_vector_topk", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.vector()} SELECT query_id, chunk_id, rank, score FROM vec
""")
def text_vector_topk(spark, sf):
    ix = index(spark, sf)
    return hits(R.vector_search(*embedded(ix)))


@query("kb_scoped_vector", f"""
WITH {S.CHUNKS}, {S.QUERY}, {_READY}, {S.vector(where="cc.kb_id = qq.kb_id AND cc.doc_id IN (SELECT doc_id FROM ready WHERE status IN ('indexed', 'needs_review'))")}
SELECT query_id, chunk_id, rank, score FROM vec
""")
def kb_scoped_vector(spark, sf):
    ix = index(spark, sf)
    return hits(R.vector_search(*embedded(ix), scope=R.scoped_documents(C.registered(spark, sf))))


_LABEL_TOP = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
parts AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e) GROUP BY 1, 2),
cent AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM parts GROUP BY 1),
ls AS (SELECT query_id, vec_id AS chunk_id, e.label, round(list_cosine_similarity(cent.v, e.v), 6) AS score FROM cent CROSS JOIN e),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM ls) WHERE rank < 20)
"""


def _label_hits(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings")
    asked = V.centroids(vecs, "label").withColumnRenamed("label", "query_id")
    return V.top_cosine(asked, vecs.select(F.col("vec_id").alias("chunk_id"), "embedding"), 20)


@query("vector_topk", f"WITH {_LABEL_TOP} SELECT query_id, chunk_id, rank, score FROM lt")
def vector_topk(spark, sf):
    return hits(_label_hits(spark, sf))


@query("phrase_topk", f"""
WITH {S.CHUNKS}, {S.QUERY},
p AS (SELECT query_id, {S.tokens('text')} AS ph FROM q),
m AS (SELECT query_id, chunk_id, len(toks) AS doc_len,
    len(list_filter(range(1, len(toks) - len(ph) + 2), lambda i: toks[i:i + len(ph) - 1] = ph)) AS tf
  FROM p JOIN ctoks ON len(toks) >= len(ph)
    AND contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || array_to_string(ph, ' ') || ' ')),
d AS (SELECT query_id, count(*) AS df FROM m GROUP BY 1),
t AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avg_len FROM ctoks),
s AS (SELECT query_id, chunk_id, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
   * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score FROM m JOIN d USING (query_id), t)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM s) WHERE rank < 20
""")
def phrase_topk(spark, sf):
    ix = index(spark, sf)
    return hits(search_index.phrase_search(ix.stored, ix.queries))


# ---- fusion, rerank, traces --------------------------------------------------------------------

_LEGS = f"{S.CHUNKS}, {S.QUERY}, {S.vector()}, {S.keyword('or')}, {S.fused()}"
_LEGS_AND = f"{S.CHUNKS}, {S.QUERY}, {S.vector()}, {S.keyword('and')}, {S.fused()}"


@dataclass
class Found:
    ix: Index
    vec: DataFrame
    kw: DataFrame
    fused: DataFrame


def recall(spark: SparkSession, sf: str, mode: str = "or") -> Found:
    """Both legs and their fusion; the short hit lists are kept for the steps that follow."""
    ix = index(spark, sf)
    vec = R.vector_search(*embedded(ix))
    kw = search_index.keyword_hits(ix.stored, ix.queries, mode=mode)
    return Found(ix, vec, kw, cut(R.fuse(vec, kw)))


def _fusion_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "query_id", "chunk_id", F.col("vec_rank").cast("long").alias("vec_rank"),
        F.col("kw_rank").cast("long").alias("kw_rank"), F.col("rank").cast("long").alias("rank"),
        F.round("score", 9).alias("score"),
    )


@query("rrf_fusion", f"WITH {_LEGS} SELECT query_id, chunk_id, vec_rank, kw_rank, rank, round(score, 9) AS score FROM fus")
def rrf_fusion(spark, sf):
    return _fusion_rows(recall(spark, sf).fused)


@query("hybrid_search", f"WITH {_LEGS_AND} SELECT query_id, chunk_id, vec_rank, kw_rank, rank, round(score, 9) AS score FROM fus")
def hybrid_search(spark, sf):
    ix = index(spark, sf)
    return _fusion_rows(search_index.hybrid_hits(ix.stored, ix.queries, embedded(ix)[0]))


@query("rerank_delta", f"""
WITH {_LEGS}, {S.coverage()} SELECT query_id, chunk_id, prev_rank, rank, delta, score FROM rr
""")
def rerank_delta(spark, sf):
    f = recall(spark, sf)
    out = R.rerank(f.fused, f.ix.queries, f.ix.chunks)
    return out.select(
        "query_id", "chunk_id", F.col("prev_rank").cast("long").alias("prev_rank"), F.col("rank").cast("long").alias("rank"),
        F.col("delta").cast("long").alias("delta"), "score",
    )


@query("rerank_degraded", f"""
WITH {_LEGS} SELECT query_id, chunk_id, rank, round(score, 9) AS score, true AS degraded FROM fus WHERE rank < 5
""")
def rerank_degraded(spark, sf):
    f = recall(spark, sf)
    out = R.rerank(f.fused, f.ix.queries, f.ix.chunks, scorer=lambda q, d: F.lit(None).cast("double"))
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), "degraded")


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_PLAN_SPLIT = text.PLAN_SPLIT.replace("'", "''")
_PLAN = f"""
pw AS (SELECT query_id, {S.strip('text')} AS text, list_filter(str_split_regex({S.strip('text')}, '{_PLAN_SPLIT}'),
   lambda w: w <> '' AND NOT list_contains([{_STOP}], lower(w)) AND (length(w) >= 2 OR regexp_matches(w, '^[\\p{{L}}\\p{{N}}]$'))) AS ws FROM q),
plan AS (SELECT query_id, text, CASE WHEN len(ws) = 0 THEN [text] ELSE ({S.distinct('ws')})[1:8] END AS keywords FROM pw)
"""


@query("query_plans", f"""
WITH {S.QUERY}, {_PLAN} SELECT query_id, array_to_string(keywords, '|') AS keywords, text AS semantic_query, 'fallback' AS source FROM plan
""")
def query_plans(spark, sf):
    return R.plain_plan(C.queries(spark, sf)).select(
        "query_id", F.array_join("keywords", "|").alias("keywords"), "semantic_query", "source"
    )


def planned(spark: SparkSession, sf: str) -> tuple[Found, DataFrame]:
    """The composed search: plan, both legs (keywords joined by OR), fusion."""
    ix = index(spark, sf)
    plans = cut(R.plain_plan(ix.queries))
    words = plans.select("query_id", F.array_join("keywords", " ").alias("text"))
    asked = providers.embed(plans.select("query_id", "kb_id", "semantic_query"), "semantic_query", text_type="query")
    vec = R.vector_search(asked, ix.stored.vectors)
    kw = search_index.keyword_hits(ix.stored, words, mode="or")
    return Found(ix, vec, kw, cut(R.fuse(vec, kw))), plans


_PLANNED = f"""{S.CHUNKS}, {S.QUERY}, {_PLAN}, qk AS (SELECT query_id, array_to_string(keywords, ' ') AS text FROM plan),
{S.vector()}, {S.keyword('or', queries='qk')}, {S.fused()}"""


@query("search_with_parents", f"""
WITH {_PLANNED}, {S.coverage()}
SELECT query_id, rank, chunk_id, 'pc-' || c.doc_id || '--1' AS parent_chunk_id, score, substr(d.body, 1, 2800) AS context
FROM rr JOIN chunks c USING (chunk_id) JOIN tsecs d ON d.doc_id = c.doc_id
""")
def search_with_parents(spark, sf):
    f, plans = planned(spark, sf)
    final = R.rerank(f.fused, plans.select("query_id", F.col("rewritten_question").alias("text")), f.ix.chunks)
    srcs = context.sources(final, f.ix.chunks, C.text_parents(spark, sf))
    return srcs.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "parent_chunk_id", "score", "context")


@query("trace_vector_hits", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.vector()}
SELECT query_id, rank, chunk_id, doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END AS text,
  {S.digits('score', 4)} AS score FROM vec JOIN chunks USING (chunk_id)
""")
def trace_vector_hits(spark, sf):
    ix = index(spark, sf)
    return trace.vector_hits(R.vector_search(*embedded(ix)), ix.chunks).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "doc_id", "text", "score"
    )


_LATIN = "regexp_extract_all(k, '[A-Za-z0-9]+')"
_KT = f"""list_filter(list_concat({_LATIN}, {S.tokens('k')}), lambda t: NOT regexp_matches(t, '^[A-Za-z]$'))"""
_MATCHED = f"""
kw_kt AS (SELECT query_id, keywords, list_transform(keywords, lambda k: {_KT}) AS kts FROM plan),
kw_toks AS (SELECT *, flatten(kts) AS every FROM kw_kt),
kw_uniq AS (SELECT *, list_filter(every, lambda t, i: list_position(list_transform(every, lambda x: lower(x)), lower(t)) = i) AS toks FROM kw_toks),
kw_m AS (SELECT kw.query_id, kw.chunk_id, kw.rank, kw.score, keywords, kts, c.doc_id, c.text,
   list_filter(toks, lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9]+$')
      THEN list_contains(regexp_extract_all(lower(c.text), '[\\p{{L}}\\p{{N}}_]+'), lower(t))
      ELSE contains(c.text || chr(10) || c.text, t) END) AS matched
  FROM kw JOIN kw_uniq USING (query_id) JOIN chunks c USING (chunk_id)),
kw_t AS (SELECT *, list_filter(keywords, lambda w, i: len(list_filter(kts[i], lambda t: list_contains(list_transform(matched, lambda x: lower(x)), lower(t)))) > 0) AS matched_keywords FROM kw_m)
"""


@query("retrieval_trace", f"""
WITH {_PLANNED}, {_MATCHED}
SELECT query_id, rank, chunk_id, doc_id, {S.digits('score', 4)} AS score, array_to_string(matched, '|') AS matched_tokens,
  array_to_string(matched_keywords, '|') AS matched_keywords FROM kw_t
""")
def retrieval_trace(spark, sf):
    f, plans = planned(spark, sf)
    return trace.keyword_hits(f.kw, f.ix.chunks, plans).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "doc_id", "score",
        F.array_join("matched_tokens", "|").alias("matched_tokens"), F.array_join("matched_keywords", "|").alias("matched_keywords"),
    )


@query("trace_matched_keywords", f"""
WITH {_PLANNED}, {_MATCHED}
SELECT query_id, string_agg(k, '|' ORDER BY k) AS matched_keywords FROM
  (SELECT DISTINCT query_id, unnest(matched_keywords) AS k FROM kw_t) GROUP BY query_id
""")
def trace_matched_keywords(spark, sf):
    f, plans = planned(spark, sf)
    return trace.matched_keywords(trace.keyword_hits(f.kw, f.ix.chunks, plans)).select(
        "query_id", F.array_join("matched_keywords", "|").alias("matched_keywords")
    )


@query("trace_fusion", f"""
WITH {_PLANNED} SELECT query_id, rank, chunk_id, doc_id, vec_rank, {S.digits('vec_score', 4)} AS vec_score, kw_rank,
  {S.digits('kw_score', 4)} AS kw_score, {S.digits('score', 5)} AS rrf_score FROM fus JOIN chunks USING (chunk_id)
""")
def trace_fusion(spark, sf):
    f, _ = planned(spark, sf)
    long = lambda c: F.col(c).cast("long").alias(c)
    return trace.fusion(f.fused, f.ix.chunks).select(
        "query_id", long("rank"), "chunk_id", "doc_id", long("vec_rank"), "vec_score", long("kw_rank"), "kw_score", "rrf_score"
    )


@query("trace_reranked", f"""
WITH {_PLANNED}, {S.coverage()} SELECT query_id, rank, prev_rank, delta, chunk_id, doc_id, {S.digits('score', 4)} AS rerank_score, false AS degraded
FROM rr JOIN chunks USING (chunk_id)
""")
def trace_reranked(spark, sf):
    f, plans = planned(spark, sf)
    final = R.rerank(f.fused, plans.select("query_id", F.col("rewritten_question").alias("text")), f.ix.chunks)
    long = lambda c: F.col(c).cast("long").alias(c)
    return trace.reranked(final, f.ix.chunks).select(
        "query_id", long("rank"), long("prev_rank"), long("delta"), "chunk_id", "doc_id", "rerank_score", "degraded"
    )


@query("trace_counts", f"""
WITH {_LEGS}
SELECT q.query_id, (SELECT count(*) FROM vec v WHERE v.query_id = q.query_id) AS vector,
  (SELECT count(*) FROM kw k WHERE k.query_id = q.query_id) AS keyword,
  (SELECT count(*) FROM fus f WHERE f.query_id = q.query_id) AS fused FROM q
""")
def trace_counts(spark, sf):
    f = recall(spark, sf)
    return trace.counts(f.ix.queries, vector=f.vec, keyword=f.kw, fused=f.fused)


@query("score_scale", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.vector()}
SELECT query_id, chunk_id, round(CASE WHEN max(score) OVER w > min(score) OVER w
  THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END, 6) AS norm
FROM vec WINDOW w AS (PARTITION BY query_id)
""")
def score_scale(spark, sf):
    ix = index(spark, sf)
    found = R.vector_search(*embedded(ix))
    return trace.min_max(found).select("query_id", "chunk_id", F.round("norm", 6).alias("norm"))


# ---- contexts ---------------------------------------------------------------------------------


@query("citations", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.keyword('or')}
SELECT query_id, rank + 1 AS "index", chunk_id, parent_chunk_id, doc_id, substr(text, 1, 300) AS retrieval_text, {S.digits('score', 4)} AS score
FROM kw JOIN chunks USING (chunk_id)
""")
def citations(spark, sf):
    ix = index(spark, sf)
    found = search_index.keyword_hits(ix.stored, ix.queries, mode="or")
    srcs = context.sources(found, ix.chunks, C.text_parents(spark, sf))
    return context.citations(srcs).select(
        "query_id", F.col("index").cast("long").alias("index"), "chunk_id", "parent_chunk_id", "doc_id", "retrieval_text", "score"
    )


@query("prompt_sources", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.keyword('or', limit=5)}
SELECT query_id, string_agg('[来源' || (rank + 1) || '] 第1页 · （无标题）' || chr(10) || substr(d.body, 1, 2800) || chr(10), chr(10) ORDER BY rank) AS sources
FROM kw JOIN chunks c USING (chunk_id) JOIN tsecs d ON d.doc_id = c.doc_id GROUP BY query_id
""")
def prompt_sources(spark, sf):
    ix = index(spark, sf)
    found = search_index.keyword_hits(ix.stored, ix.queries, 5, mode="or")
    return context.prompt_blocks(context.sources(found, ix.chunks, C.text_parents(spark, sf)))


_FIRST = S.sentences('body')


def _summaries(parents: DataFrame) -> DataFrame:
    """The first sentence of every parent as its summary entry."""
    return parents.select(
        "parent_chunk_id", F.concat(F.col("parent_chunk_id"), F.lit("-s")).alias("index_id"), F.lit("summary").alias("kind"),
        F.try_element_at(text.sentences(F.col("text_full")), F.lit(1)).alias("index_text"), F.lit(True).alias("enabled"),
    )


@query("extra_index_search", f"""
WITH {S.CHUNKS}, {S.QUERY},
entries AS (SELECT 'ci-pc-' || doc_id || '--1-s' AS chunk_id, 'pc-' || doc_id || '--1' AS parent_chunk_id,
   {S.strip(f'({_FIRST})[1]')} AS text FROM tsecs WHERE len({_FIRST}) > 0),
both_ AS (SELECT chunk_id, parent_chunk_id, '' AS index_kind, toks FROM ctoks UNION ALL
   SELECT chunk_id, parent_chunk_id, 'summary', {S.tokens('text')} FROM entries),
{S.keyword('or', corpus='both_')}
SELECT query_id, rank, chunk_id, parent_chunk_id, index_kind, score FROM kw JOIN both_ USING (chunk_id)
""")
def extra_index_search(spark, sf):
    parents = C.text_parents(spark, sf)
    every = extra_index.searchable(C.text_chunks(spark, sf), _summaries(parents), parents)
    stored = cut(P.tokenized(every, keep=("parent_chunk_id", "index_kind")), SMALL_CODEC)
    found = R.keyword_search(C.queries(spark, sf), stored, mode="or")
    return found.join(stored.select("chunk_id", "parent_chunk_id", "index_kind"), "chunk_id").select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "parent_chunk_id", "index_kind", "score"
    )


# Tasks ask with groups of five queries; the second round asks with the head of the best hit.
_TASKS = f"""
one AS (SELECT query_id // 5 AS task_id, query_id % 5 AS query_no, rank, chunk_id, score FROM kw),
r1 AS (SELECT task_id, chunk_id, min({{'query_no': query_no, 'rank': rank}}) AS spot FROM one GROUP BY 1, 2)
"""


def _round(found: DataFrame) -> DataFrame:
    return found.select(
        F.floor(F.col("query_id") / 5).alias("task_id"), (F.col("query_id") % 5).alias("query_no"),
        F.col("rank").cast("long").alias("rank"), "chunk_id", "score",
    )


@query("multi_query_gather", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.keyword('or', limit=5)}, {_TASKS}
SELECT task_id, chunk_id, spot.query_no AS query_no, spot.rank AS rank FROM r1
""")
def multi_query_gather(spark, sf):
    ix = index(spark, sf)
    found = search_index.keyword_hits(ix.stored, ix.queries, 5, mode="or")
    return context.merge_queries(_round(found)).select("task_id", "chunk_id", "query_no", "rank")


@query("two_round_gather", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.keyword('or', limit=5)}, {_TASKS},
q2 AS (SELECT query_id, c.text FROM kw JOIN chunks c USING (chunk_id) WHERE rank = 0),
{S.keyword('or', queries='q2', out='kw2', limit=10)},
two AS (SELECT query_id // 5 AS task_id, query_id % 5 AS query_no, rank, chunk_id FROM kw2),
r2 AS (SELECT task_id, chunk_id, min({{'query_no': query_no, 'rank': rank}}) AS spot FROM two
  WHERE (task_id, chunk_id) NOT IN (SELECT (task_id, chunk_id) FROM r1) GROUP BY 1, 2)
SELECT task_id, chunk_id, spot.query_no AS query_no, spot.rank AS rank, 1 AS round FROM r1
UNION ALL SELECT task_id, chunk_id, spot.query_no, spot.rank, 2 FROM r2
""")
def two_round_gather(spark, sf):
    ix = index(spark, sf)
    found = search_index.keyword_hits(ix.stored, ix.queries, 5, mode="or")
    # The offline judge asks again with the best hit of every query.
    again = found.where(F.col("rank") == 0).join(ix.chunks.select("chunk_id", F.col("embedding_text").alias("text")), "chunk_id")
    more = search_index.keyword_hits(ix.stored, again.select("query_id", "text"), 10, mode="or")
    both = context.second_round(context.merge_queries(_round(found)), _round(more))
    return both.select("task_id", "chunk_id", "query_no", "rank", "round")


# ---- evaluation -------------------------------------------------------------------------------


def gold(ix: Index, spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc_id): documents that hold the passage as one run of tokens."""
    return passages(ix.queries, C.documents(spark, sf))


def passages(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id) of each document that holds all tokens of a query side by side; tokens are made where they are read."""
    docs = P.tokenized(documents, "doc_id", "text", keep=())
    return R.phrase_runs(queries, docs).select("query_id", F.col("chunk_id").alias("doc_id"))


def with_docs(found: DataFrame, ix: Index) -> DataFrame:
    return found.join(ix.chunks.select("chunk_id", "doc_id"), "chunk_id")


@query("gold_pairs", f"WITH {S.QUERY}, {S.GOLD} SELECT query_id, doc_id FROM gold")
def gold_pairs(spark, sf):
    return passages(C.queries(spark, sf), C.documents(spark, sf))


@query("relevance_flags", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.GOLD}, {S.keyword('or')}, h AS (SELECT kw.*, doc_id FROM kw JOIN chunks USING (chunk_id)), {S.flags('h', 'fl')}
SELECT query_id, rank, chunk_id, doc_id, rel FROM fl
""")
def relevance_flags(spark, sf):
    ix = index(spark, sf)
    found = with_docs(search_index.keyword_hits(ix.stored, ix.queries, mode="or"), ix)
    return evaluation.relevance(found, gold(ix, spark, sf)).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "doc_id", "rel"
    )


@query("eval_metrics", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.GOLD}, {S.keyword('or')}, h AS (SELECT kw.*, doc_id FROM kw JOIN chunks USING (chunk_id)), {S.flags('h', 'fl')},
m AS (SELECT query_id, {S.metrics('fl')} FROM gold_n LEFT JOIN fl USING (query_id) GROUP BY query_id)
SELECT count(*) AS n_queries, {S.averages()} FROM m
""")
def eval_metrics(spark, sf):
    ix = index(spark, sf)
    labels = cut(gold(ix, spark, sf))
    found = with_docs(search_index.keyword_hits(ix.stored, ix.queries, mode="or"), ix)
    counts = evaluation.relevant_counts(ix.queries, labels)
    return evaluation.macro(evaluation.query_metrics(evaluation.relevance(found, labels), counts))


def _by_config(configs: dict[str, DataFrame], ix: Index, labels: DataFrame) -> DataFrame:
    """Average metrics of several hit tables; queries and configurations without hits count as zero."""
    every = None
    for name, found in configs.items():
        part = found.select(F.lit(name).alias("config"), "query_id", "chunk_id", "rank")
        every = part if every is None else every.unionByName(part)
    flagged = evaluation.relevance(with_docs(every, ix), labels)
    counts = evaluation.relevant_counts(ix.queries, labels)
    n = ix.queries.agg(F.count(F.lit(1)).alias("n"))
    return evaluation.macro(evaluation.query_metrics(flagged, counts), n, list(configs))


def _config_metrics(*configs: str) -> str:
    names = ", ".join(f"('{c}')" for c in configs)
    return f"""
{S.flags('hh', 'fl', 'config')},
m AS (SELECT config, query_id, {S.metrics('fl')} FROM fl JOIN gold_n USING (query_id) GROUP BY config, query_id),
every AS (SELECT * FROM (VALUES {names}) v(config) LEFT JOIN m USING (config))
SELECT config, (SELECT count(*) FROM q) AS n_queries, {S.averages('(SELECT count(*) FROM q)', 'coalesce(sum({c}), 0)')} FROM every GROUP BY config
"""


@query("tokenizer_ablation", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.GOLD}, {S.keyword('or', limit=10)},
rawt AS (SELECT * REPLACE ([lower(text)] AS toks) FROM ctoks), {S.keyword('or', corpus='rawt', out='kraw', limit=10)},
p AS (SELECT query_id, {S.tokens('text')} AS ph FROM q),
pm AS (SELECT query_id, chunk_id, len(toks) AS doc_len,
    len(list_filter(range(1, len(toks) - len(ph) + 2), lambda i: toks[i:i + len(ph) - 1] = ph)) AS tf
  FROM p JOIN ctoks ON len(toks) >= len(ph)
    AND contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || array_to_string(ph, ' ') || ' ')),
pd AS (SELECT query_id, count(*) AS df FROM pm GROUP BY 1),
ps AS (SELECT query_id, chunk_id, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
   * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score FROM pm JOIN pd USING (query_id), kw_tot),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM ps),
hh AS (SELECT a.*, doc_id FROM (SELECT 'phrase' AS config, query_id, chunk_id, rank FROM pr WHERE rank < 10
  UNION ALL SELECT 'tokens', query_id, chunk_id, rank FROM kw
  UNION ALL SELECT 'raw', query_id, chunk_id, rank FROM kraw) a JOIN chunks USING (chunk_id)),
{_config_metrics('phrase', 'tokens', 'raw')}
""")
def tokenizer_ablation(spark, sf):
    ix = index(spark, sf)
    labels = cut(gold(ix, spark, sf))
    # Raw text is one term a chunk, which no word of a query equals.
    raw = ix.chunks.select("chunk_id", F.array(F.lower("embedding_text")).alias("toks"))
    unsplit = ix.toks.drop("toks").join(raw, "chunk_id").select(*ix.toks.columns)
    legs = {
        "phrase": search_index.phrase_search(ix.stored, ix.queries, 10),
        "raw": R.keyword_search(ix.queries, unsplit, 10, mode="or"),
        "tokens": search_index.keyword_hits(ix.stored, ix.queries, 10, mode="or"),
    }
    return _by_config(legs, ix, labels)


@query("config_comparison", f"""
WITH {S.CHUNKS}, {S.QUERY}, {S.GOLD}, {S.vector()}, {S.keyword('or')}, {S.keyword('and', out='kwa')}, {S.fused(kw='kwa', limit=10)},
{S.coverage()},
hh AS (SELECT a.*, doc_id FROM (SELECT 'bm25' AS config, query_id, chunk_id, rank FROM kw WHERE rank < 10
  UNION ALL SELECT 'vector', query_id, chunk_id, rank FROM vec WHERE rank < 10 UNION ALL SELECT 'rrf', query_id, chunk_id, rank FROM fus
  UNION ALL SELECT 'rrf_rerank', query_id, chunk_id, rank FROM rr) a JOIN chunks USING (chunk_id)),
{_config_metrics('bm25', 'vector', 'rrf', 'rrf_rerank')}
""")
def config_comparison(spark, sf):
    ix = index(spark, sf)
    labels = cut(gold(ix, spark, sf))
    vec = R.vector_search(*embedded(ix))
    kw_or = search_index.keyword_hits(ix.stored, ix.queries, mode="or")
    kw_and = search_index.keyword_hits(ix.stored, ix.queries, mode="and")
    rrf = cut(R.fuse(vec, kw_and, 10))
    legs = {
        "bm25": kw_or.where(F.col("rank") < 10), "vector": vec.where(F.col("rank") < 10), "rrf": rrf,
        "rrf_rerank": R.rerank(rrf, ix.queries, ix.chunks),
    }
    return _by_config(legs, ix, labels)


@query("vector_label_eval", f"""
WITH {_LABEL_TOP},
fl AS (SELECT query_id, rank, CASE WHEN label = query_id THEN 1 ELSE 0 END AS rel FROM lt),
gold_n AS (SELECT label AS query_id, count(*) AS n_relevant FROM embeddings GROUP BY 1),
m AS (SELECT query_id, {S.metrics('fl')} FROM gold_n LEFT JOIN fl USING (query_id) GROUP BY query_id)
SELECT count(*) AS n_queries, {S.averages()} FROM m
""")
def vector_label_eval(spark, sf):
    vecs = table(spark, sf, "embeddings")
    labels = vecs.select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"))
    found = _label_hits(spark, sf).withColumn("doc_id", F.col("chunk_id"))
    counts = evaluation.relevant_counts(labels.select("query_id").distinct(), labels)
    return evaluation.macro(evaluation.query_metrics(evaluation.relevance(found, labels), counts))
