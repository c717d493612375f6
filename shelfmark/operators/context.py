"""Answer contexts: parents of hits, their blocks in reading order, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.functions.numbers import digits
from shelfmark.operators.model_stage import Model, asked
from shelfmark.operators.scan import joined_text, running
from shelfmark.session import cut

CONTEXT_CAP = 2800
CITATION = 300
CAPTION = 50
# Assets that can stand in a context as pictures.
PICTURES = ("image", "chart_image", "table_image", "equation_image")


def block_text() -> Column:
    """A block as plain context: picture description, table markup, else its text."""
    described = text.strip(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("text"), F.lit("")))
    markup = text.strip(F.coalesce(F.col("table_html"), F.lit("")))
    body = text.strip(F.coalesce(F.col("text"), F.lit("")))
    named = lambda kind, c: F.when(c != "", F.concat(F.lit(f"[{kind}: "), c, F.lit("]"))).otherwise(f"[{kind}]")
    return (
        F.when(F.col("type") == "image", named("图片", described))
        .when(F.col("type") == "table", F.when(markup != "", markup).otherwise(named("表格", body)))
        .otherwise(body)
    )


def head_of_parents(parent_rows: DataFrame, cap: int = CONTEXT_CAP) -> DataFrame:
    """(parent_chunk_id, body): block texts joined in order, cut at ``cap`` characters.

    A running length tells which blocks can reach into the first ``cap``
    characters, so a parent of any size brings together a bounded piece.
    ``parent_rows`` has ``parent_chunk_id, order_in_doc`` and the block columns.
    """
    pieces = parent_rows.select(
        "parent_chunk_id", "order_in_doc", block_text().alias("piece")
    ).where(F.col("piece") != "")
    ran = running(
        pieces, ["parent_chunk_id"], "order_in_doc", {"_len": ("sum", F.length("piece") + 2)}
    ).where(F.col("_len") - F.length("piece") - 4 < cap)  # a piece counts with the gap before it
    whole = joined_text(
        ran.withColumn("piece", F.substring("piece", 1, cap)), ["parent_chunk_id"], "order_in_doc", "piece", "\n\n", "body"
    )
    return whole.select("parent_chunk_id", F.substring("body", 1, cap).alias("body"))


def sources(
    hits: DataFrame, chunks: DataFrame, parents: DataFrame, parent_rows: DataFrame | None = None,
    cap: int = CONTEXT_CAP,
) -> DataFrame:
    """One context per hit: rendered blocks, else the stored parent text, else the hit itself.

    Hits are short lists: they are written with their chunks, and only texts of their parents meet a shuffle.
    """
    about = chunks.select(
        F.col("child_chunk_id").alias("chunk_id"), "parent_chunk_id", "doc_id",
        F.col("header_path").alias("_own_path"), "retrieval_text",
    )
    wanted = cut(about.join(hits.select("query_id", "chunk_id", "rank", "score"), "chunk_id"))
    named = cut(wanted.select("parent_chunk_id").distinct())
    stored = parents.join(named, "parent_chunk_id", "left_semi").select(
        "parent_chunk_id",
        F.col("header_path").alias("_path"),
        *[F.col(c) if c in parents.columns else F.lit(0).alias(c) for c in ("page_start", "page_end")],
        F.substring(text.strip(F.col("text_full")), 1, cap).alias("_full"),
        F.substring(text.strip(F.col("text_preview")), 1, cap).alias("_preview"),
    )
    out = wanted.join(stored, "parent_chunk_id", "left")
    body = F.lit(None).cast("string")
    if parent_rows is not None:
        needed = parent_rows.join(named, "parent_chunk_id", "left_semi")
        out = out.join(head_of_parents(needed, cap), "parent_chunk_id", "left")
        body = F.col("body")
    filled = lambda c: F.when(~text.blank(c), c)
    context = F.coalesce(filled(body), filled(F.col("_full")), filled(F.col("_preview")), F.col("retrieval_text"), F.lit(""))
    path = F.when(F.coalesce(F.size("_path"), F.lit(0)) > 0, F.col("_path")).otherwise(F.col("_own_path"))
    return out.select(
        "query_id", "rank", "chunk_id", "parent_chunk_id", "doc_id", path.alias("header_path"),
        F.coalesce("page_start", F.lit(0)).alias("page_start"), F.coalesce("page_end", F.lit(0)).alias("page_end"),
        F.substring(context, 1, cap).alias("context"), "retrieval_text", "score",
    )


def citations(srcs: DataFrame) -> DataFrame:
    return srcs.select(
        "query_id", (F.col("rank") + 1).alias("index"), "chunk_id", "parent_chunk_id", "doc_id", "header_path",
        "page_start", "page_end", F.substring("retrieval_text", 1, CITATION).alias("retrieval_text"),
        digits(F.col("score"), 4).alias("score"),
    )


def prompt_blocks(srcs: DataFrame) -> DataFrame:
    """Numbered source blocks of a query joined in rank order; hit lists are short."""
    one = F.concat(
        F.lit("[来源"), (F.col("rank") + 1).cast("string"), F.lit("] "),
        text.page_label(F.col("page_start"), F.col("page_end")), F.lit(" · "),
        text.breadcrumb(F.col("header_path")), F.lit("\n"), F.col("context"), F.lit("\n"),
    )
    return srcs.withColumn("_one", one).groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "_one"))), lambda s: s["_one"]), "\n"
        ).alias("sources")
    )


def segments(parent_rows: DataFrame) -> DataFrame:
    """Text and picture segments of parents in reading order.

    ``parent_rows`` also has ``picture``, the path of the block's first usable
    picture. A picture closes the text run in front of it with a pointer line.
    """
    shown = F.col("type").isin("image", "table") & F.col("picture").isNotNull()
    rows = parent_rows.withColumn("_shown", shown)
    rows = running(
        rows, ["parent_chunk_id"], "order_in_doc", {"_upto": ("sum", F.when(F.col("_shown"), 1).otherwise(0))}
    )
    run = F.col("_upto") - F.when(F.col("_shown"), 1).otherwise(0)
    named = text.strip(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("text"), F.lit("")))
    pointer = F.when(named != "", F.concat(F.lit("（下图："), F.substring(named, 1, CAPTION), F.lit("）"))).otherwise("（下图）")
    pieces = rows.select(
        "parent_chunk_id", run.alias("run"), "order_in_doc",
        F.when(F.col("_shown"), pointer).otherwise(block_text()).alias("piece"),
    ).where(F.col("piece") != "")
    texts = joined_text(pieces, ["parent_chunk_id", "run"], "order_in_doc", "piece", "\n\n", "content").select(
        "parent_chunk_id", (F.col("run") * 2).alias("segment_no"), F.lit("text").alias("kind"), "content"
    )
    pictures = rows.where("_shown").select(
        "parent_chunk_id", (run * 2 + 1).alias("segment_no"), F.lit("image").alias("kind"),
        F.col("picture").alias("content"),
    )
    return texts.unionByName(pictures)


def picture_paths(hits: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Picture paths of a query's hits, first occurrences, at most ``limit``; none for a limit of 0."""
    rows = (
        hits.join(
            chunks.select(F.col("child_chunk_id").alias("chunk_id"), "asset_paths"), "chunk_id"
        )
        .select("query_id", "rank", F.posexplode("asset_paths").alias("pos", "path"))
        .groupBy("query_id", "path").agg(F.min(F.struct("rank", "pos")).alias("at"))
    )
    w = Window.partitionBy("query_id").orderBy("at")
    return (
        rows.withColumn("no", F.row_number().over(w)).where(F.col("no") <= max(limit, 0))
        .select("query_id", "no", "path")
    )


def merge_queries(hits: DataFrame) -> DataFrame:
    """Hits of several queries of one task, each chunk at its first appearance.

    Needs ``task_id, query_no, rank, chunk_id``.
    """
    first = hits.groupBy("task_id", "chunk_id").agg(F.min(F.struct("query_no", "rank", "score")).alias("at"))
    return first.select("task_id", "chunk_id", "at.*")


def second_round(first: DataFrame, found: DataFrame) -> DataFrame:
    """Append what a second round of queries found and the first had not."""
    fresh = merge_queries(found).join(first.select("task_id", "chunk_id"), ["task_id", "chunk_id"], "left_anti")
    return first.withColumn("round", F.lit(1)).unionByName(fresh.withColumn("round", F.lit(2)))


def judge_prompts(found: DataFrame, chunks: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, prompt): the task and the texts of its chunks, numbered in order of appearance.

    A task has as many chunks as its queries and their limits allow, so its texts fit in one row.
    """
    order = Window.partitionBy("task_id").orderBy("round", "query_no", "rank", "chunk_id")
    numbered = found.withColumn("_no", F.row_number().over(order)).select("task_id", "chunk_id", "_no")
    texts = chunks.select("chunk_id", F.col("embedding_text").alias("_text"))
    piece = F.struct("_no", F.concat(F.lit("[来源"), F.col("_no").cast("string"), F.lit("]\n"), "_text").alias("_piece"))
    joined = texts.join(numbered, "chunk_id").groupBy("task_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["_piece"]), "\n---\n").alias("_sources")
    )
    return joined.join(tasks.select("task_id", "task"), "task_id").select("task_id", F.concat_ws("\n", "task", "_sources").alias("prompt"))


def new_queries(told: DataFrame) -> DataFrame:
    """(task_id, query_no, text) that judges asked for; tasks they call complete, and unreadable answers, give none."""
    read = F.from_json(
        text.strip_code_fence(F.col("answer")), "status string, new_queries array<struct<query:string,keywords:array<string>>>"
    )
    open_tasks = told.where(F.col("status") == "ok").select("task_id", read.alias("r")).where("r.status <> 'complete'")
    rows = open_tasks.select("task_id", F.posexplode_outer("r.new_queries").alias("query_no", "q")).where("q IS NOT NULL")
    body = text.strip(F.concat_ws(" ", F.array_join(F.coalesce("q.keywords", F.array().cast("array<string>")), " "), "q.query"))
    return rows.select("task_id", "query_no", body.alias("text")).where(F.col("text") != "")


def gather_rounds(
    queries: DataFrame, tasks: DataFrame, chunks: DataFrame, search: Callable[[DataFrame, int], DataFrame], judge: Model,
    first_k: int = 5, more_k: int = 10, rounds: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Rounds of search until a judge calls a task complete.

    ``queries(task_id, query_no, text)`` are those of round 1 and ``tasks(task_id, task)`` what the judge is told;
    ``search(queries(query_id, text), k)`` gives hits. After each round but the last the judge sees the
    chunks of every task that is still open and names further queries, whose unseen chunks are
    added. A task is closed by the verdict "complete", by a verdict without queries, by a judge that
    fails, and by a round that adds nothing. Returns the chunks (task_id, chunk_id, query_no, rank, round) and, for
    every judged round, (task_id, round, status, n_queries, n_added).
    """
    def hits(asking: DataFrame, k: int, n: int) -> DataFrame:
        numbered = asking.withColumn("query_id", F.concat_ws("/", "task_id", "query_no"))
        found = search(numbered.select("query_id", "text"), k).select("query_id", "chunk_id", "rank", "score")
        named = numbered.select("query_id", "task_id", "query_no")
        return merge_queries(found.join(named, "query_id")).select("task_id", "chunk_id", "query_no", "rank", F.lit(n).alias("round"))

    all_found = cut(hits(queries, first_k, 1))
    open_tasks, log = tasks.select("task_id", "task"), None
    for n in range(2, rounds + 1):
        prompts = judge_prompts(all_found, chunks, open_tasks)
        told = cut(asked(prompts, F.lit("judge"), F.col("prompt"), judge).select("task_id", "answer", "status"))
        asking = cut(new_queries(told))
        fresh = cut(hits(asking, more_k, n).join(all_found.select("task_id", "chunk_id"), ["task_id", "chunk_id"], "left_anti"))
        count = lambda df, name: df.groupBy("task_id").agg(F.count(F.lit(1)).alias(name))
        step = told.select("task_id", F.lit(n - 1).alias("round"), "status").join(count(asking, "n_queries"), "task_id", "left")
        step = step.join(count(fresh, "n_added"), "task_id", "left").na.fill(0, ["n_queries", "n_added"])
        log = step if log is None else log.unionByName(step)
        all_found = all_found.unionByName(fresh)
        open_tasks = open_tasks.join(fresh.select("task_id").distinct(), "task_id", "left_semi")
    if log is None:
        log = tasks.sparkSession.createDataFrame([], "task_id string, round int, status string, n_queries long, n_added long")
    return all_found, log
