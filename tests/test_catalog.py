"""Sources, stores, catalog changes and streams."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalog, normalize
from shelfmark.sources import bundles, stores
from shelfmark.streaming import incremental


def test_bundles(spark, tmp_path):
    root = tmp_path / "kb"
    for doc, pages in {"d1": [[{"type": "paragraph", "content": {"paragraph_content": [{"content": "hi"}]}}], "x"], "d2": []}.items():
        folder = root / doc / "extracted"
        (folder / "images").mkdir(parents=True)
        (folder / "u_content_list_v2.json").write_text(json.dumps(pages))
        (folder / "images" / "a.jpg").write_text("x")
    (root / "d1" / "extracted" / "layout.json").write_text(json.dumps({"pdf_info": [{"page_idx": 0, "page_size": [612, 792]}], "_backend": "vlm"}))
    (root / "d2" / "extracted" / "layout.json").write_text("{")
    files = bundles.bundle_files(bundles.list_files(spark, str(root)))
    man = {r.doc_id: r for r in bundles.manifest(files).collect()}
    assert man["d1"].blocks_path.endswith("u_content_list_v2.json") and man["d1"].images_dir.endswith("/images")
    pages = bundles.block_pages(bundles.read_whole(spark, str(root / "*" / "extracted" / "*_v2.json")))
    assert [r.message for r in bundles.broken_pages(pages).collect()] == ["page_1_not_list"]
    lay = bundles.read_whole(spark, str(root / "*" / "extracted" / "layout.json"))
    assert [r.doc_id for r in bundles.layout_failures(lay).collect()] == ["d2"]
    out = normalize.normalize(bundles.raw_blocks(pages), bundles.page_sizes(lay)).collect()
    assert [(r.doc_id, r.text) for r in out] == [("d1", "hi")]


def test_gold(spark, tmp_path):
    good, bad, none = (tmp_path / f"{n}.json" for n in ("good", "bad", "none"))
    good.write_text(json.dumps([{"query": "q", "kb_id": "k", "relevant_doc_ids": ["d"]}]))
    bad.write_text(json.dumps([{"query": "q"}]))
    none.write_text("[]")
    assert bundles.read_gold(spark, str(good)).first().relevant_doc_ids == ["d"]
    for path in (bad, none):
        with pytest.raises(ValueError):
            bundles.read_gold(spark, str(path))


def test_text_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿# T".encode())
    (tmp_path / "b.bin").write_text("no")
    got = bundles.read_text_documents(spark, str(tmp_path)).collect()
    assert [(r.source_format, r.text) for r in got] == [("md", "# T")]


def test_store_replaces_and_replays(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda data: spark.createDataFrame(data, "doc_id int, piece string")
    stores.replace_in_store(rows([(1, "a"), (1, "b"), (2, "c")]), path)
    for _ in range(2):
        stores.replace_in_store(rows([(1, "x")]), path)
    read = lambda: sorted((r.doc_id, r.piece) for r in stores.read_store(spark, path).collect())
    assert read() == [(1, "x"), (2, "c")]
    stores.replace_in_store(rows([]), path, gone=spark.createDataFrame([(2,)], "doc_id int"))
    assert read() == [(1, "x")]


def test_folder_sync_is_idempotent(spark):
    disk = spark.createDataFrame([("/f/a.txt", "a.txt", 1), ("/f/b.pdf", "b.pdf", 1)], "path string, relative_path string, size long")
    known = spark.createDataFrame([("/f/b.pdf", "k1", "missing"), ("/f/c.md", "k2", "indexed")], "path string, doc_id string, status string")
    once = catalog.folder_sync(disk, known)
    rows = {r.path: r.status for r in once.collect()}
    assert rows == {"/f/a.txt": "text_only", "/f/b.pdf": "uploaded", "/f/c.md": "missing"}
    assert sorted(catalog.folder_sync(disk, once).collect()) == sorted(once.collect())


def test_file_stream_registers_once(spark, tmp_path):
    root, table = tmp_path / "in", str(tmp_path / "table")
    (root / "课堂录音" / "260101").mkdir(parents=True)
    (root / "课堂录音" / "260101" / "第1节.txt").write_text("x")
    (root / "~$tmp.docx").write_text("x")
    run = lambda: incremental.register_files(spark, str(root), table, str(tmp_path / "cp")).awaitTermination()
    run()
    (root / "b.pdf").write_text("y")
    run()
    run()
    got = sorted((r.source_format, r.status) for r in stores.read_store(spark, table).collect())
    assert got == [("pdf", "uploaded"), ("txt", "text_only")]


def test_index_rows_must_pair(spark):
    kids = spark.createDataFrame([("c1", "d")], "child_chunk_id string, doc_id string")
    vec = spark.createDataFrame([("c1", [1.0]), ("c2", [2.0])], "child_chunk_id string, embedding array<float>")
    assert stores.index_rows(kids, vec.where("child_chunk_id = 'c1'")).count() == 1
    with pytest.raises(Exception, match="do not pair|pair up"):
        stores.index_rows(kids, vec).collect()


def test_fork(spark):
    msg = spark.createDataFrame([("c", f"m{i}", i) for i in range(4)], "conversation_id string, message_id string, sequence_num long")
    piv = spark.createDataFrame([("c", "n1", "m1"), ("c", "n2", "gone")], "conversation_id string, new_conversation_id string, message_id string")
    got = catalog.fork(msg, piv).groupBy("conversation_id").count().collect()
    assert {r.conversation_id: r["count"] for r in got} == {"n1": 2, "n2": 4}


def test_upsert_prefers_new(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 5, "old")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 5, "new"), (3, 1, "new")], "k int, t int, v string")
    assert sorted((r.k, r.v) for r in catalog.upsert(old, new, ["k"], ["t"]).collect()) == [(1, "new"), (2, "old"), (3, "new")]
