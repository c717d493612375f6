"""Model stages over whole tables: descriptions, summaries, questions, levels, plans, rounds of search.

The models are offline and fail for some inputs, so every outcome has rows.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from shelfmark.operators import context, generation, hierarchy, providers
from shelfmark.operators import retrieval as R
from shelfmark.plans import corpora as C
from shelfmark.plans import search, structure
from shelfmark.plans import sql as S
from shelfmark.plans.registry import query
from shelfmark.session import cut, table
from shelfmark.sources import search_index


class Unsteady(generation.OfflineModel):
    """Fails for every input whose length leaves 3 when divided by 7."""

    def one(self, kind: str, body: str) -> str:
        if len(body) % 7 == 3:
            raise RuntimeError("refused")
        return super().one(kind, body)


class UnsteadyDescriber(providers.EchoDescriber):
    def describe(self, kind: str, content: str) -> str:
        if len(content) % 5 == 2:
            raise RuntimeError("refused")
        return super().describe(kind, content)


@query("described_blocks", f"""
WITH {S.TREE}, a AS (SELECT doc_id, block_id, type, ord, CASE WHEN type = 'table' AND ord % 7 = 3 THEN '' ELSE text END AS text FROM tree WHERE type IN ('image', 'table')),
b AS (SELECT *, CASE type WHEN 'image' THEN 'images/' || ord || '.jpg' ELSE nullif(text, '') END AS ask FROM a),
s AS (SELECT *, CASE WHEN ask IS NULL THEN 'skipped' WHEN length(ask) % 5 = 2 THEN 'partial_failed' ELSE 'ok' END AS status FROM b)
SELECT doc_id, block_id, type, status, CASE WHEN status = 'ok' THEN array_to_string(list_filter([text, type || ': ' || ask], lambda x: x <> ''), chr(10)) END AS enriched_text FROM s
""")
def described_blocks(spark, sf):
    """Pictures and tables described; some have no input and for some the model fails."""
    blocks = C.tree(spark, sf)
    emptied = (F.col("type") == "table") & (F.col("order_in_doc") % 7 == 3)
    blocks = blocks.withColumn("text", F.when(emptied, "").otherwise(F.col("text")))
    return providers.describe(blocks, UnsteadyDescriber()).select("doc_id", "block_id", "type", "status", "enriched_text")


def _entries_sql(kind: str, made: str) -> str:
    return f"""
WITH b AS (SELECT 'pc-' || doc_id AS parent_chunk_id, substr(CASE WHEN doc_id % 10 = 4 THEN '' ELSE {S.strip('text')} END, 1, 6000) AS body FROM documents),
s AS (SELECT *, CASE WHEN body = '' THEN 'skipped' WHEN length(body) % 7 = 3 THEN 'partial_failed' ELSE 'ok' END AS status FROM b)
SELECT parent_chunk_id, '{kind}-' || parent_chunk_id AS index_id, '{kind}' AS kind, CASE WHEN status = 'ok' THEN {made} END AS index_text, status = 'ok' AS enabled, status FROM s
"""


def _parents(spark, sf):
    body = F.when(F.col("doc_id") % 10 == 4, " ").otherwise(F.col("text"))
    return C.documents(spark, sf).select(F.concat(F.lit("pc-"), "doc_id").alias("parent_chunk_id"), body.alias("text_full"))


@query("summary_entries", _entries_sql("summary", S.strip("substr(body, 1, 60)")))
def summary_entries(spark, sf):
    """Summaries of parents as index entries."""
    return generation.entries(_parents(spark, sf), Unsteady(), "summary")


@query("hypothesis_entries", _entries_sql("hypo_question", "'What follows from ' || substr(body, 1, 60) || '?'"))
def hypothesis_entries(spark, sf):
    """Likely questions about parents as index entries."""
    return generation.entries(_parents(spark, sf), Unsteady(), "hypo_question")


_MOST = 80
_PARTS = f"""
p AS (SELECT p_brand AS doc_id, p_partkey, (CASE p_size % 8 {structure._CASES} END) || p_name AS t, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
l AS (SELECT *, CASE WHEN n > 1 AND n <= {_MOST} THEN least(1 + length(t) - length(replace(t, '.', '')), 6) END AS given FROM p)
"""


def _titles(spark, sf):
    return structure.titled_parts(spark, sf).withColumn("page_idx", F.lit(0))


@query("model_levels", f"WITH {_PARTS} SELECT doc_id, p_partkey, CASE WHEN n > 1 THEN coalesce(given, {structure._HEUR}) ELSE 1 END AS level FROM l")
def model_levels(spark, sf):
    """Heading levels of a model; documents with too many titles keep those of their numbering."""
    blocks = _titles(spark, sf)
    levels, _ = generation.title_levels(blocks, generation.OfflineModel(), _MOST)
    out = hierarchy.assign_levels(blocks, levels, _MOST).where(F.col("type") == "title")
    return out.select("doc_id", F.floor(F.col("order_in_doc") / 2).alias("p_partkey"), F.col("metadata.title_level").alias("level"))


@query("level_outcomes", f"WITH {_PARTS} SELECT doc_id, n AS n_titles, CASE WHEN n > 1 AND n <= {_MOST} THEN 'ok' ELSE 'skipped' END AS status FROM l GROUP BY ALL")
def level_outcomes(spark, sf):
    """Which documents the model gave levels, and which were passed over for their number of titles."""
    return generation.title_levels(_titles(spark, sf), generation.OfflineModel(), _MOST)[1]


@query("model_plans", f"""
WITH {S.QUERY}, w AS (SELECT query_id, {S.strip('text')} AS t FROM q),
s AS (SELECT *, length(t) % 7 <> 3 AS ok, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS words FROM w)
SELECT query_id, CASE WHEN ok THEN array_to_string(words[1:12], ' ') ELSE t END AS semantic_query, CASE WHEN ok THEN 'llm' ELSE 'fallback' END AS source FROM s
""")
def model_plans(spark, sf):
    """Query plans of a model, and of the rules where it fails."""
    questions = C.queries(spark, sf)
    plans = generation.plan_answers(questions, Unsteady())
    return R.plain_plan(questions, plans).select("query_id", "semantic_query", "source")


class Judge:
    """Complete for even tasks; fails for those that leave 3 when divided by 4; asks others for what their first source says."""

    def answer(self, kind: str, texts: list[str]) -> list[str]:
        return [self.one(t) for t in texts]

    def one(self, prompt: str) -> str:
        task = int(prompt.split("\n", 1)[0].split()[1])
        if task % 4 == 3:
            raise RuntimeError("refused")
        if task % 2 == 0:
            return json.dumps({"status": "complete", "new_queries": [{"query": "not asked"}]})
        first = prompt.split("[来源1]\n", 1)[1].split("\n---\n", 1)[0]
        return "```json\n" + json.dumps({"status": "incomplete", "new_queries": [{"query": first, "keywords": []}, {"query": " "}]}) + "\n```"


_ROUNDS = f"""
{S.CHUNKS}, {S.QUERY}, {S.vector()}, {S.keyword('and')}, {S.fused(limit=5)},
one AS (SELECT query_id // 5 AS task_id, query_id % 5 AS query_no, rank, chunk_id FROM fus),
r1 AS (SELECT task_id, chunk_id, min({{'query_no': query_no, 'rank': rank}}) AS spot FROM one GROUP BY 1, 2),
f1 AS (SELECT task_id, chunk_id, row_number() OVER (PARTITION BY task_id ORDER BY spot.query_no, spot.rank, chunk_id) AS no FROM r1),
q2 AS (SELECT task_id AS query_id, {S.strip('c.text')} AS text FROM f1 JOIN chunks c USING (chunk_id) WHERE f1.no = 1 AND task_id % 4 = 1),
{S.vector('vec2', queries='q2')}, {S.keyword('and', queries='q2', out='kw2')}, {S.fused('vec2', 'kw2', 'fus2', 10)},
r2 AS (SELECT query_id AS task_id, chunk_id, rank FROM fus2 WHERE (query_id, chunk_id) NOT IN (SELECT (task_id, chunk_id) FROM r1))
"""


def _gathered(spark, sf):
    ix = search.index(spark, sf)

    def find(asking, k):
        told = providers.embed(asking, "text", text_type="query").select("query_id", "embedding")
        return search_index.hybrid_hits(ix.stored, asking, told, k)

    task = F.floor(F.col("query_id") / 5)
    queries = cut(ix.queries.select(task.alias("task_id"), (F.col("query_id") % 5).alias("query_no"), "text"))
    tasks = queries.select("task_id").distinct().select("task_id", F.concat(F.lit("task "), "task_id").alias("task"))
    return context.gather_rounds(queries, tasks, ix.chunks, find, Judge())


@query("gathered_rounds", f"""
WITH {_ROUNDS}
SELECT task_id, chunk_id, spot.query_no AS query_no, spot.rank::BIGINT AS rank, 1 AS round FROM r1 UNION ALL SELECT task_id, chunk_id, 0, rank::BIGINT, 2 FROM r2
""")
def gathered_rounds(spark, sf):
    """Tasks of five queries over the hybrid search; a judge ends most after round 1."""
    return _gathered(spark, sf)[0].select("task_id", "chunk_id", "query_no", F.col("rank").cast("long").alias("rank"), "round")


@query("round_log", f"""
WITH {_ROUNDS}, t AS (SELECT DISTINCT task_id FROM r1)
SELECT task_id, 1 AS round, CASE WHEN task_id % 4 = 3 THEN 'partial_failed' ELSE 'ok' END AS status, (SELECT count(*) FROM q2 WHERE query_id = t.task_id) AS n_queries,
  (SELECT count(*) FROM r2 WHERE r2.task_id = t.task_id) AS n_added FROM t
""")
def round_log(spark, sf):
    """What the judge said of each task and what it brought."""
    return _gathered(spark, sf)[1]
