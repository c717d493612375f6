"""What language models add: summaries, likely questions, heading levels, query plans.

Every stage asks through ``model_stage`` and reads the answers with columns; an answer that can't be
read counts as a failed one and leaves the rule-based result in place.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import extra_index, hierarchy
from shelfmark.operators.model_stage import Model, asked

# Input size and the part of titles that must have a level.
PARENT_INPUT = 6000
FIRST_CHARS = 60


class OfflineModel:
    """Deterministic answers from the input itself, for tests and for runs without a network."""

    def answer(self, kind: str, texts: list[str]) -> list[str]:
        return [self.one(kind, t) for t in texts]

    def one(self, kind: str, body: str) -> str:
        if kind == "summary":
            return body[:FIRST_CHARS]
        if kind == "hypo_question":
            return "```json\n" + json.dumps({"questions": [f"What follows from {body[:FIRST_CHARS]}?", " "]}) + "\n```"
        if kind == "levels":
            titles = re.findall(r"^\[(\d+)\] \(\d+\) (.*)$", body, re.MULTILINE)
            return json.dumps({"items": [{"i": int(i), "level": 1 + t.count(".")} for i, t in titles]})
        if kind == "plan":
            words = body.split()
            return json.dumps({"keywords": words[:4], "semantic_query": " ".join(words[:12]), "rewritten_question": body})
        raise ValueError(f"no task {kind}")


def entries(parents: DataFrame, model: Model, kind: str, keep: str | None = None) -> DataFrame:
    """Index entries of one kind (``summary`` or ``hypo_question``) for parents (``parent_chunk_id``, ``text_full``).

    Returns parent_chunk_id, index_id, kind, index_text, enabled and status; only entries with a text are
    enabled. Inputs are cut at ``PARENT_INPUT`` signs. Equal texts are asked about once.
    """
    body = F.substring(text.strip(F.coalesce(F.col("text_full"), F.lit(""))), 1, PARENT_INPUT)
    told = asked(parents.select("parent_chunk_id", "text_full"), F.lit(kind), body, model, keep=keep)
    made = extra_index.question_text(F.col("answer")) if kind == "hypo_question" else F.nullif(text.strip(F.col("answer")), F.lit(""))
    told = told.withColumn("index_text", made)
    status = F.when((F.col("status") == "ok") & F.col("index_text").isNull(), "partial_failed").otherwise(F.col("status"))
    return told.select(
        "parent_chunk_id", F.concat_ws("-", F.lit(kind), "parent_chunk_id").alias("index_id"), F.lit(kind).alias("kind"), "index_text",
        F.col("index_text").isNotNull().alias("enabled"), status.alias("status"),
    )


def title_levels(blocks: DataFrame, model: Model, most: int = hierarchy.MAX_TITLES, keep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Heading levels by a model: (doc_id, i, level) for ``hierarchy.assign_levels``, and how each document fared.

    A document's titles go into one question, so documents of more than ``most`` titles are passed over;
    the second table (doc_id, n_titles, status) says which, and ``partial_failed`` where no level could be read.
    """
    titled = blocks.where((F.col("type") == "title") & ~text.blank(F.col("text")))
    totals = titled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_titles"))
    asking = titled.join(totals.where((F.col("n_titles") > 1) & (F.col("n_titles") <= most)), "doc_id")
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("order_in_doc")) - 1  # at most ``most`` rows a document
    line = F.format_string("[%d] (%d) %s", F.col("i"), F.col("page_idx") + 1, text.strip(F.col("text")))
    numbered = asking.select("doc_id", "page_idx", "text", i.alias("i"))
    prompts = numbered.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda s: s["line"]), "\n").alias("prompt"))
    told = asked(totals.join(prompts, "doc_id", "left"), F.lit("levels"), F.col("prompt"), model, keep=keep)
    items = F.from_json(text.strip_code_fence(F.col("answer")), "items array<struct<i:int,level:int>>")["items"]
    told = told.withColumn("_items", items)
    levels = told.select("doc_id", F.explode_outer("_items").alias("it")).where("it IS NOT NULL").select("doc_id", "it.i", "it.level")
    status = F.when((F.col("status") == "ok") & (F.coalesce(F.size("_items"), F.lit(0)) < 1), "partial_failed").otherwise(F.col("status"))
    return levels, told.select("doc_id", "n_titles", status.alias("status"))


def plan_answers(questions: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """(query_id, answer) for ``retrieval.plain_plan``; failed and blank questions have no answer."""
    told = asked(questions.select("query_id", "text"), F.lit("plan"), text.strip(F.col("text")), model, keep=keep)
    return told.where(F.col("status") == "ok").select("query_id", "answer")
