"""Model stages: equal inputs asked once, bounded batches, errors by row, kept answers, rounds of search."""

import json
import os
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from shelfmark.operators import context, generation, hierarchy, providers
from shelfmark.operators import retrieval as R
from shelfmark.operators.model_stage import asked, batches_of, called

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this folder


class Counting:
    """Notes every call as a file of its texts; fails for texts with "bad", and for batches of an odd number with "odd"."""

    def __init__(self, folder):
        self.folder = str(folder)

    def answer(self, kind, texts):
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as out:
            json.dump([kind, texts], out)
        if any("bad" in t for t in texts):
            raise RuntimeError("bad text")
        return [f"{kind}:{t}" for t in texts]

    def calls(self):
        return [json.load(open(os.path.join(self.folder, f))) for f in os.listdir(self.folder)]


def test_batches_are_bounded():
    assert [(s.start, s.stop) for s in batches_of(["a"] * 7, 3)] == [(0, 3), (3, 6), (6, 7)]
    assert [(s.start, s.stop) for s in batches_of(["aaaa", "a", "aaaaaaaaa", "a"], 9, 5)] == [(0, 2), (2, 3), (3, 4)]
    assert list(batches_of([], 3)) == []


def test_errors_stay_with_their_text(tmp_path):
    got = called(Counting(tmp_path), "k", ["a", "bad", "c"])
    assert [a for a, _ in got] == ["k:a", None, "k:c"] and "bad text" in got[1][1]

    class Short:
        def answer(self, kind, texts):
            return texts[:-1] if len(texts) > 1 else [None]

    assert called(Short(), "k", ["a", "b"]) == [(None, "no text")] * 2


def rows(spark):
    data = [(i, "s", ["x", "y", None, " ", "bad one", "y"][i % 6]) for i in range(600)] + [(None, "t", "x"), (None, "t", "x")]
    return spark.createDataFrame(data, "n long, kind string, body string").withColumn("answer", F.lit("old")).repartition(3)


def test_equal_inputs_are_asked_once(spark, tmp_path):
    model = Counting(tmp_path)
    got = asked(rows(spark), F.col("kind"), F.col("body"), model, batch=2)
    assert got.columns == ["n", "kind", "body", "answer", "status"] and got.count() == 602
    found = {(r.kind, r.body, r.answer, r.status) for r in got.collect()}
    assert found == {
        ("s", "x", "s:x", "ok"), ("s", "y", "s:y", "ok"), ("s", None, None, "skipped"), ("s", " ", None, "skipped"),
        ("s", "bad one", None, "partial_failed"), ("t", "x", "t:x", "ok"),
    }
    calls = model.calls()
    assert all(len(texts) <= 2 for _, texts in calls)
    single = [(k, t) for k, texts in calls for t in texts if "bad" not in "".join(texts)]
    assert sorted(single) == sorted(set(single))  # no text is asked twice but for those beside a failing one


def test_answers_are_kept_and_failures_are_not(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    model, keep = Counting(tmp_path / "calls"), str(tmp_path / "answers")
    first = asked(rows(spark), F.col("kind"), F.col("body"), model, batch=1, keep=keep)
    assert first.where("status = 'ok'").count() == 302
    n = len(model.calls())
    more = rows(spark).unionByName(spark.createDataFrame([(1, "s", "new", "")], "n long, kind string, body string, answer string"))
    again = asked(more, F.col("kind"), F.col("body"), model, batch=1, keep=keep)
    assert again.where("status = 'ok'").count() == 303
    assert sorted(t for _, texts in model.calls()[:] for t in texts).count("bad one") == 2 and len(model.calls()) == n + 2


def test_no_rows(spark, tmp_path):
    model = Counting(tmp_path)
    assert asked(rows(spark).limit(0), F.col("kind"), F.col("body"), model).collect() == [] and model.calls() == []


def test_entries_plans_and_levels(spark):
    class Model(generation.OfflineModel):
        def one(self, kind, body):
            if body.startswith("fail"):
                raise RuntimeError
            return "no json" if body.startswith("odd") and kind == "hypo_question" else super().one(kind, body)

    parents = spark.createDataFrame([("a", " body " * 3000), ("b", None), ("c", "fail x"), ("d", "odd y")], "parent_chunk_id string, text_full string")
    got = {r.parent_chunk_id: (r.status, r.enabled, r.index_text) for r in generation.entries(parents, Model(), "hypo_question").collect()}
    assert got["a"][:2] == ("ok", True) and got["b"] == ("skipped", False, None)
    assert got["c"] == ("partial_failed", False, None) and got["d"] == ("partial_failed", False, None)
    assert {r.status for r in generation.entries(parents, Model(), "summary").collect()} == {"ok", "skipped", "partial_failed"}

    asking = spark.createDataFrame([(1, "what is x"), (2, "fail y"), (3, " ")], "query_id long, text string")
    plans = {r.query_id: r.source for r in R.plain_plan(asking, generation.plan_answers(asking, Model())).collect()}
    assert plans == {1: "llm", 2: "fallback", 3: "fallback"}

    schema = "doc_id string, page_idx int, order_in_doc long, type string, text string, metadata struct<title_level:int>"
    titles = [("d", 0, i, "title" if i != 1 else "paragraph", t, (1,)) for i, t in enumerate(["1.1 a", "no title", "b", " ", "2.1.1 c"])]
    titles += [("many", 0, i, "title", f"1.{i}", (1,)) for i in range(9)] + [("one", 0, 0, "title", "1.1", (4,))]
    levels, outcome = generation.title_levels(spark.createDataFrame(titles, schema), Model(), most=8)
    assert {r.doc_id: (r.n_titles, r.status) for r in outcome.collect()} == {"d": (3, "ok"), "many": (9, "skipped"), "one": (1, "skipped")}
    assert sorted((r.doc_id, r.i, r.level) for r in levels.collect()) == [("d", 0, 2), ("d", 1, 1), ("d", 2, 3)]
    out = hierarchy.assign_levels(spark.createDataFrame(titles, schema), levels, 8)
    got = {(r.doc_id, r.order_in_doc): r.metadata.title_level for r in out.collect()}
    assert got["d", 0] == 2 and got["d", 2] == 1 and got["d", 4] == 3 and got["one", 0] == 4


def test_describe_in_batches(spark, tmp_path):
    model = Counting(tmp_path)
    asset = "array<struct<asset_id:string,asset_type:string,path:string>>"
    data = [("d", f"b{i}", "table", ["same", "bad", ""][i % 3], [], ("",)) for i in range(9)]
    blocks = spark.createDataFrame(data, f"doc_id string, block_id string, type string, text string, assets {asset}, metadata struct<table_html:string>")
    got = providers.describe(blocks, model)
    assert sorted((r.status, r.enriched_text) for r in got.collect() if r.enriched_text) == [("ok", "same\ntable:same")] * 3
    assert {r.status for r in got.collect()} == {"ok", "partial_failed", "skipped"}
    assert sum(t == "same" for _, texts in model.calls() for t in texts) <= 2


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_rounds_end_task_by_task(spark, rounds):
    """Task t is judged incomplete t times; every query finds the chunks named after its text and "all"."""
    chunks = spark.createDataFrame([(c, c) for c in ["q1", "q2", "n0", "n1", "n2", "all"]], "chunk_id string, embedding_text string")

    def search(queries, k):
        found = queries.select("query_id", F.explode(F.split(F.concat(F.col("text"), F.lit(" all")), " ")).alias("chunk_id"))
        return found.join(chunks, "chunk_id").select("query_id", "chunk_id", F.lit(0).alias("rank"), F.lit(1.0).alias("score")).limit(1000)

    class Judge:
        def answer(self, kind, texts):
            return [self.one(t) for t in texts]

        def one(self, prompt):
            task, seen = int(prompt.split()[1]), prompt.count("\nn")
            if task == 9:
                raise RuntimeError("down")
            if task == 8:
                return "not json"
            if task == 7:
                return json.dumps({"status": "incomplete", "new_queries": [{"query": "q1", "keywords": ["q2"]}]})  # nothing new
            return json.dumps({"status": "complete" if seen >= task else "incomplete", "new_queries": [{"query": f"n{seen}"}, {"query": None}]})

    ids = [0, 1, 2, 7, 8, 9]
    queries = spark.createDataFrame([(t, n, f"q{n + 1}") for t in ids for n in range(2)], "task_id long, query_no int, text string")
    tasks = spark.createDataFrame([(t, f"task {t}") for t in ids], "task_id long, task string")
    found, log = context.gather_rounds(queries, tasks, chunks, search, Judge(), rounds=rounds)
    got = {t: sorted((r.chunk_id, r.round) for r in found.collect() if r.task_id == t) for t in ids}
    start = [("all", 1), ("q1", 1), ("q2", 1)]
    for t in ids:
        extra = [(f"n{i}", i + 2) for i in range(min(t if t < 7 else 0, rounds - 1))]
        assert got[t] == sorted(start + extra)
    judged = {(r.task_id, r.round): (r.status, r.n_queries, r.n_added) for r in log.collect()}
    if rounds == 1:
        assert judged == {}
    else:
        assert judged[0, 1] == ("ok", 0, 0) and judged[9, 1] == ("partial_failed", 0, 0) and judged[8, 1] == ("ok", 0, 0)
        assert judged[7, 1] == ("ok", 1, 0) and judged[2, 1] == ("ok", 1, 1) and (7, 2) not in judged and (0, 2) not in judged
