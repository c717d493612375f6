"""Recall, fusion, rerank and metrics against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from shelfmark.operators import context, evaluation, providers, trace
from shelfmark.operators import postings as P
from shelfmark.operators import retrieval as R
from shelfmark.operators import vectors as V

WORDS = [f"w{i}" for i in range(30)]


def corpus(spark, n=120):
    rnd = random.Random(5)
    rows = [(f"c{i:03d}", i % 7, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 30)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "child_chunk_id string, doc_id int, embedding_text string")


def brute(rows, query, mode):
    toks = {c: t.split() for c, _, t in rows}
    avg = sum(map(len, toks.values())) / len(toks)
    terms = list(dict.fromkeys(query.split()))
    out = []
    for c, ts in toks.items():
        score, hit = 0.0, 0
        for t in terms:
            tf = ts.count(t)
            df = sum(t in o for o in toks.values())
            if tf:
                hit += 1
                idf = math.log((len(toks) - df + 0.5) / (df + 0.5))
                score += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        if hit and (mode == "or" or hit == len(terms)):
            out.append((c, round(score, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:20]


def test_keyword_search_both_ways(spark):
    rows, df = corpus(spark)
    asked = [("q1", "w1 w2"), ("q2", "w3 w4 w5 w3"), ("q3", "nothing here")]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    toks = P.tokenized(df)
    for mode in ("or", "and"):
        got = R.keyword_search(queries, toks, mode=mode).orderBy("query_id", "rank").collect()
        for qid, body in asked:
            mine = [(r.chunk_id, r.score) for r in got if r.query_id == qid]
            assert mine == brute(rows, body, mode), (qid, mode)


def test_scope_keeps_global_statistics(spark):
    rows, df = corpus(spark)
    queries = spark.createDataFrame([("q", "w1 w2", "kb1")], "query_id string, text string, kb_id string")
    scope = spark.createDataFrame([("kb1", 1), ("kb1", 3), ("kb2", 2)], "kb_id string, doc_id int")
    want = {c: s for c, s in brute(rows, "w1 w2", "or")}
    doc = {c: d for c, d, _ in rows}
    got = R.keyword_search(queries, P.tokenized(df), mode="or", scope=scope).collect()
    assert got and all(doc[r.chunk_id] in (1, 3) for r in got)
    assert all(want[r.chunk_id] == r.score for r in got if r.chunk_id in want)


def test_cosine_in_one_or_more_passes(spark):
    rnd = np.random.default_rng(2)
    vecs = rnd.normal(size=(300, 8)).astype(np.float32)
    asked = rnd.normal(size=(9, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vecs)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id long, embedding array<float>")
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    sims = np.round(unit(asked) @ unit(vecs).T, 6)
    for kw in ({}, {"query_block": 4}):
        got = V.top_cosine(q, v, 5, **kw).orderBy("query_id", "rank").collect()
        for i in range(9):
            want = sorted(range(300), key=lambda j: (-sims[i, j], j))[:5]
            assert [r.chunk_id for r in got if r.query_id == i] == want


def test_phrase_counts_overlaps(spark):
    rows = [("c1", "a a a b"), ("c2", "a b"), ("c3", "ba ab")]
    toks = P.tokenized(spark.createDataFrame(rows, "child_chunk_id string, embedding_text string"), keep=())
    queries = spark.createDataFrame([("q", "a a"), ("z", "absent word")], "query_id string, text string")
    assert [r.chunk_id for r in R.phrase_search(queries, toks).collect()] == ["c1"]


def hits(spark, ids):
    return spark.createDataFrame([("q", c, i, 1.0 - i / 10) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank int, score double")


def test_fusion_and_rerank(spark):
    fused = R.fuse(hits(spark, ["d7", "m4", "p9"]), hits(spark, ["a3", "m4"]))
    rows = fused.orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["m4", "d7", "a3", "p9"]  # d7 and a3 tie, the vector list comes first
    assert abs(rows[0].score - (1 / 62 + 1 / 62)) < 1e-12
    chunks = spark.createDataFrame(
        [("d7", "x"), ("m4", "y"), ("p9", "x y z"), ("a3", "n")], "child_chunk_id string, retrieval_text string"
    ).withColumn("header_path", F.array().cast("array<string>"))
    queries = spark.createDataFrame([("q", "x y z")], "query_id string, text string")
    top = R.rerank(fused, queries, chunks).orderBy("rank").collect()
    assert top[0].chunk_id == "p9" and top[0].prev_rank == 3 and top[0].delta == 3 and not top[0].degraded
    bad = R.rerank(fused, queries, chunks, scorer=lambda q, d: F.lit(None).cast("double")).orderBy("rank").collect()
    assert [r.chunk_id for r in bad] == ["m4", "d7", "a3", "p9"] and all(r.degraded for r in bad)


def test_matched_tokens(spark):
    plans = spark.createDataFrame([("q", ["on 山谷", "off 河岸", "GPS", "雪地车"])], "query_id string, keywords array<string>")
    chunks = spark.createDataFrame([("c", "walking ON a path through 山谷 by gps")], "child_chunk_id string, retrieval_text string").select(
        "*", F.lit("").alias("embedding_text"), *[F.lit("").alias(c) for c in ("parent_chunk_id", "doc_id", "chunk_type", "index_kind")],
        F.array().cast("array<string>").alias("header_path"),
    )
    row = trace.keyword_hits(hits(spark, ["c"]), chunks, plans).first()
    assert row.matched_tokens == ["on", "山谷", "GPS"] and row.matched_keywords == ["on 山谷", "GPS"]


def test_query_plans(spark):
    asked = spark.createDataFrame([("a", "如何 use the loop"), ("b", "x")], "query_id string, text string")
    plans = spark.createDataFrame(
        [("a", '```json\n{"keywords":["k"," k ",""],"semantic_query":"s"}\n```'), ("b", "{broken")], "query_id string, answer string"
    )
    got = {r.query_id: r for r in R.plain_plan(asked, plans).collect()}
    assert got["a"].source == "llm" and got["a"].keywords == ["k"] and got["a"].rewritten_question == "如何 use the loop"
    assert got["b"].source == "fallback" and got["b"].keywords == ["x"]


def test_metrics(spark):
    found = spark.createDataFrame(
        [("q", "c1", "d1", 0), ("q", "c2", "d1", 1), ("q", "c3", "d2", 2)], "query_id string, chunk_id string, doc_id string, rank int"
    )
    docs = spark.createDataFrame([("q", "d1"), ("q", "d2")], "query_id string, doc_id string")
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    flags = evaluation.relevance(found, docs)
    assert [r.rel for r in flags.orderBy("rank").collect()] == [1, 0, 1]
    m = {r.query_id: r for r in evaluation.query_metrics(flags, evaluation.relevant_counts(queries, docs)).collect()}
    assert m["q"].mrr == 1.0 and m["q"].recall_1 == 0.5 and m["q"].recall_3 == 1.0
    assert abs(m["q"].ndcg_3 - (1 + 0.5) / (1 + 1 / math.log2(3))) < 1e-9
    assert m["none"].mrr == 0 and m["none"].hit_10 == 0
    label = spark.createDataFrame([("q", "c2")], "query_id string, chunk_id string")
    both = evaluation.relevance(found, docs, label)
    assert [r.rel for r in both.orderBy("rank").collect()] == [1, 1, 1]


def test_second_round(spark):
    cols = "task_id int, query_no int, rank int, chunk_id string, score double"
    first = context.merge_queries(spark.createDataFrame([(1, 0, 0, "c1", 1.0), (1, 1, 0, "c1", 1.0)], cols))
    more = spark.createDataFrame([(1, 0, 0, "c1", 1.0), (1, 0, 1, "c2", 0.5)], cols)
    got = {(r.chunk_id, r.round) for r in context.second_round(first, more).collect()}
    assert got == {("c1", 1), ("c2", 2)}


def test_context_order_and_cap(spark):
    rows = spark.createDataFrame(
        [("p", 0, "paragraph", "one", None, None, None), ("p", 1, "image", "", "a cat", None, "i.jpg"),
         ("p", 2, "table", "cap", None, "<table>", None), ("p", 3, "paragraph", "two", None, None, None)],
        "parent_chunk_id string, order_in_doc long, type string, text string, description string, table_html string, picture string",
    )
    assert context.head_of_parents(rows).first().body == "one\n\n[图片: a cat]\n\n<table>\n\ntwo"
    assert context.head_of_parents(rows, 6).first().body == "one\n\n["
    segs = [(r.kind, r.content) for r in context.segments(rows).orderBy("segment_no").collect()]
    assert segs == [("text", "one\n\n（下图：a cat）"), ("image", "i.jpg"), ("text", "<table>\n\ntwo")]


def test_failing_provider_marks_rows(spark):
    class Down:
        def describe(self, kind, content):
            raise RuntimeError("down")

    rows = spark.createDataFrame(
        [("d", "b1", "equation", "x", [], (None,)), ("d", "b2", "image", "cap", [], (None,))],
        "doc_id string, block_id string, type string, text string, assets array<struct<asset_type:string,path:string>>, metadata struct<table_html:string>",
    )
    got = {r.block_id: (r.status, r.enriched_text) for r in providers.describe(rows, Down()).collect()}
    assert got == {"b1": ("partial_failed", "[数学公式]: x"), "b2": ("skipped", None)}


def test_term_frequencies_are_counted_inside_tasks(spark, monkeypatch):
    texts = ["red red green", "green blue", "", "red stone", "blue blue blue"]
    toks = P.tokenized(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts * 20)], "child_chunk_id string, embedding_text string"), keep=())
    terms = spark.createDataFrame([(q, t) for q, t in enumerate(["red", "blue", "red", "none", "stone"])], "query_id int, term string")
    for block in (100, 2):
        monkeypatch.setattr(R, "TERM_BLOCK", block)
        found = R.frequency_of(toks.repartition(3), terms)
        assert {r.term: r.df for r in found.collect()} == {"red": 40, "blue": 40, "stone": 20}
    assert R.frequency_of(toks, terms.where("query_id < 0")).count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_only_texts_of_hit_parents_are_shuffled(spark):
    rows = [(f"p{d}", d, random.Random(d).randbytes(1200).hex()) for d in range(1500)]
    parents = spark.createDataFrame(rows, "parent_chunk_id string, doc_id int, text_full string").select(
        "*", F.array().cast("array<string>").alias("header_path"), F.substring("text_full", 1, 9).alias("text_preview")
    )
    chunks = parents.select(
        F.concat(F.lit("c"), "doc_id").alias("child_chunk_id"), "parent_chunk_id", "doc_id", "header_path", F.col("text_preview").alias("retrieval_text")
    )
    hits = spark.createDataFrame([("q", "c7", 0, 2.0), ("q", "c9", 1, 1.0), ("r", "c7", 0, 3.0)], "query_id string, chunk_id string, rank int, score double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        before = shuffled(spark)
        got = context.sources(hits, chunks, parents.repartition(3)).collect()
        texts = shuffled(spark) - before
        before = shuffled(spark)
        parents.repartition(3).select(F.max("text_full")).collect()
        once = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r.query_id, r.rank, r.context) for r in got) == [("q", 0, rows[7][2]), ("q", 1, rows[9][2]), ("r", 0, rows[7][2])]
    # The test itself deals out the parents once; beside that nearly nothing is shuffled.
    assert texts < 1.3 * once


def test_gold_writes_no_tokens(spark, monkeypatch):
    from shelfmark.plans import search

    written = []
    for module in (search, R, V):
        whole = module.cut
        monkeypatch.setattr(module, "cut", lambda df, *more, whole=whole: written.append(df.columns) or whole(df, *more))
    sf = "/root/testdata/sf0.001"
    got = {(r.query_id, r.doc_id) for r in search.gold_pairs(spark, sf).collect()}
    assert written and not any("toks" in columns for columns in written)
    docs = P.tokenized(search.C.documents(spark, sf), "doc_id", "text", keep=())
    ranked = R.phrase_search(search.C.queries(spark, sf), docs, limit=None).collect()
    assert got == {(r.query_id, r.chunk_id) for r in ranked} and got


def test_large_tables_of_a_search_are_packed_small(spark, monkeypatch):
    from shelfmark.plans import search

    codecs, whole = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df, *more: codecs.append((df.columns, more)) or whole(df, *more))
    assert search.extra_index_search(spark, "/root/testdata/sf0.001").count() > 0
    assert [more for columns, more in codecs if "toks" in columns] == [("zstd",)]
