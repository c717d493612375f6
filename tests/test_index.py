import random

import numpy as np
from pyspark.sql import functions as F

from shelfmark.operators import hierarchy, providers
from shelfmark.operators import retrieval as R
from shelfmark.operators import vectors as V
from shelfmark.sources import bundles, search_index, stores


def chunks(spark, rows):
    return spark.createDataFrame([(f"c{d}-{k}", d, t) for d, k, t in rows], "child_chunk_id string, doc_id long, embedding_text string")


def ids(spark, *docs):
    return spark.createDataFrame([(d,) for d in docs], "doc_id long")


def test_batches_replace_remove_and_replay(spark, tmp_path):
    root = str(tmp_path / "index")
    first = [(1, 0, "red green blue"), (1, 1, "red red"), (2, 0, "green tea"), (3, 0, "")]
    assert search_index.add_batch(chunks(spark, first), ids(spark, 1, 2, 3), root) == 1
    second = [(1, 0, "white"), (4, 0, "green green tea cup")]
    for version in (2, 3):
        assert search_index.add_batch(chunks(spark, second), ids(spark, 1, 2, 4), root) == version
        index = search_index.opened(spark, root)
        assert sorted(r.chunk_id for r in index.chunks.collect()) == ["c1-0", "c3-0", "c4-0"]
        assert sorted((r.term, r.tf, r.positions) for r in index.postings.collect()) == [
            ("cup", 1, [3]), ("green", 2, [0, 1]), ("tea", 1, [2]), ("white", 1, [0])
        ]
        assert index.vectors.count() == 3
    queries = spark.createDataFrame([("q", "green tea"), ("p", "tea green"), ("z", "")], "query_id string, text string")
    found = search_index.keyword_hits(index, queries, mode="and")
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == {("q", "c4-0"), ("p", "c4-0")}
    assert [(r.query_id, r.chunk_id, r.tf) for r in search_index.phrase_hits(index, queries).collect()] == [("q", "c4-0", 1)]
    asked = providers.embed(queries.where("query_id = 'q'"), "text").select("query_id", "embedding")
    assert search_index.vector_hits(index, asked, 1).first().chunk_id == "c4-0"
    search_index.compact(spark, root)
    assert index.postings.count() == 4 and index.chunks.count() == 3 and index.totals().first().n_chunks == 3
    assert len(stores.versions(spark, root)) == 1
    search_index.add_batch(chunks(spark, [(5, 0, "tea")]), ids(spark, 5), root)
    assert index.chunks.count() == 4


def test_phrases_from_positions(spark, tmp_path):
    rng = random.Random(2)
    texts = [(d, k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(12)))) for d in range(40) for k in range(2)]
    root = str(tmp_path / "index")
    search_index.add_batch(chunks(spark, texts), ids(spark, *range(40)), root)
    index = search_index.opened(spark, root)
    asked = [("q1", "a b"), ("q2", "a a a"), ("q3", "d c b a"), ("q4", "zz a"), ("q5", ""), ("q6", "c")]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    pick = lambda df: sorted((r.query_id, r.chunk_id, r.score) for r in df.collect())
    want = pick(R.phrase_search(queries, index.toks, limit=None))
    assert pick(search_index.phrase_search(index, queries, None)) == want and len(want) > 20
    for mode in ("and", "or"):
        assert pick(search_index.keyword_hits(index, queries, None, mode)) == pick(R.keyword_search(queries, index.toks, 10_000, mode))


def test_an_unfinished_batch_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "index")
    search_index.add_batch(chunks(spark, [(1, 0, "kept")]), ids(spark, 1), root)
    chunks(spark, [(1, 0, "lost")]).withColumn("version", F.lit(2)).write.parquet(f"{root}/v2-dead/chunks")
    assert [r.embedding_text for r in search_index.opened(spark, root).chunks.collect()] == ["kept"]


def test_ideographs_share_vectors(spark):
    rows = providers.embed(spark.createDataFrame([("雪山",), ("大雪山脚下",)], "t string"), "t").collect()
    dot = sum(a * b for a, b in zip(rows[0].embedding, rows[1].embedding))
    assert dot != 0


def test_one_bad_file_leaves_the_others(spark):
    files = spark.createDataFrame([(1, "[[{\"a\":1}]]"), (2, "{}"), (3, "")], "doc_id int, content string")
    assert [r.doc_id for r in bundles.raw_blocks(bundles.block_pages(files)).collect()] == [1]
    assert sorted(r.doc_id for r in bundles.unread_files(files).collect()) == [2, 3]


def test_circles_are_flat(spark):
    rows = [("d", "a", "b"), ("d", "b", "a"), ("d", "r", None), ("d", "k", "r"), ("d", "g", "k"), ("d", "o", "gone")]
    secs = spark.createDataFrame(rows, "doc_id string, section_id string, parent_section_id string")
    got = {r.section_id: (r.depth, r.is_root, r.in_cycle) for r in hierarchy.section_tree(secs).collect()}
    assert got == {"a": (0, True, True), "b": (0, True, True), "r": (0, True, False), "k": (1, False, False), "g": (2, False, False), "o": (0, True, False)}


def test_only_short_hit_lists_leave_a_task(spark, tmp_path, monkeypatch):
    """A word of all chunks and all queries: no pair of them is shuffled, and a batch is one table."""
    root = str(tmp_path / "index")
    rows = [(d, 0, "common " * (d % 5 + 1) + f"own{d}") for d in range(200)]
    search_index.add_batch(chunks(spark, rows), ids(spark, *range(200)), root)
    assert stores.versions(spark, root)[0].tables == ["chunks"]
    index = search_index.opened(spark, root)
    queries = spark.createDataFrame([(f"q{i}", f"common own{i}") for i in range(30)], "query_id string, text string")
    left, ranked = [], V.ranked
    monkeypatch.setattr(V, "ranked", lambda found, k: left.append((found.count(), found.rdd.getNumPartitions())) or ranked(found, k))
    for mode in ("or", "and"):
        got = search_index.keyword_hits(index, queries, 3, mode).collect()
        want = search_index.keyword_hits(index, queries, None, mode)
        want = R.top(want, 3, R.by_score()).collect()
        pick = lambda found: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in found)
        assert pick(got) == pick(want)
    assert len(left) == 2 and all(n <= 30 * 3 * parts for n, parts in left)


def test_copies_tie_by_id():
    best = V.Best(np.array(["a", "b"]), 2)
    for at in range(0, 40, 10):
        best.add(np.full((10, 2), 0.5), np.array([f"c{99 - i}" for i in range(at, at + 10)]))
    assert sorted(zip(best.kept["q"], best.kept["chunk_id"])) == [(0, "c60"), (0, "c61"), (1, "c60"), (1, "c61")]


def test_vectors_are_stored_packed(spark, tmp_path):
    import pyarrow as pa

    class Lengths:
        def embed(self, texts, text_type):
            return np.array([[len(t), 0.5, -1.0] for t in texts], np.float32)

    rows = chunks(spark, [(1, 0, "soil and water"), (2, 0, "stone"), (3, 0, "water water")])
    docs = rows.select("doc_id").distinct()
    for name, provider in (("hashed", None), ("given", Lengths())):
        root = str(tmp_path / name)
        search_index.add_batch(rows, docs, root, provider)
        stored = search_index.opened(spark, root).vectors
        assert dict(stored.dtypes)["embedding"] == "binary"
        plain = {r.child_chunk_id: list(r.embedding) for r in providers.embed(rows, "embedding_text", provider).collect()}
        assert {r.chunk_id: np.frombuffer(r.embedding, "<f4").tolist() for r in stored.collect()} == plain
        asked = providers.embed(rows.selectExpr("child_chunk_id AS query_id", "embedding_text"), "embedding_text", provider)
        best = search_index.vector_hits(search_index.opened(spark, root), asked.select("query_id", "embedding"), 1)
        assert all(r.query_id == r.chunk_id and r.score == 1.0 for r in best.collect())
    part = pa.array([np.arange(i, i + 3, dtype="<f4").tobytes() for i in range(4)], pa.binary()).slice(1, 2)
    assert V.rows_of(part).tolist() == [[1, 2, 3], [2, 3, 4]]


def test_a_text_is_written_once(spark, tmp_path):
    """Retrieval texts equal to the embedded ones are not stored again; all come back as they were."""
    import glob

    import pyarrow.parquet as pq

    rows = [("c1", 1, "a b", "a b"), ("c2", 2, "Head\nc d", "c d"), ("c3", 3, "", ""), ("c4", 4, "e", None), ("c5", 5, "f", "f")]
    given = spark.createDataFrame(rows, "child_chunk_id string, doc_id long, embedding_text string, retrieval_text string")
    root = str(tmp_path / "index")
    search_index.add_batch(given.where("doc_id < 5"), ids(spark, 1, 2, 3, 4), root)
    search_index.add_batch(given.where("doc_id = 5"), ids(spark, 5), root)
    index = search_index.opened(spark, root)
    for _ in range(2):
        assert sorted(tuple(r) for r in index.chunks.select(*given.columns).collect()) == rows
        files = [pq.ParquetFile(f) for f in glob.glob(f"{root}/{stores.versions(spark, root)[0].folder}/chunks/*.parquet")]
        stored = [t for f in files for t in f.read(["retrieval_text"]).column(0).to_pylist() if t is not None]
        assert stored == ["c d"]
        kinds = {f.metadata.row_group(g).column(0).compression for f in files for g in range(f.metadata.num_row_groups)}
        assert kinds == {"ZSTD"}
        search_index.compact(spark, root)
