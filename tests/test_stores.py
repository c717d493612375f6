"""Versioned stores, document units, chunk lines, named files and listings."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfmark.operators import catalog, trace
from shelfmark.sources import stores


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def docs(spark, keys, piece):
    return spark.createDataFrame([(k, f"{piece}{i}") for k in keys for i in range(20)], "doc_id long, piece string")


def read(spark, path, name=stores.ROWS):
    return sorted((str(r.doc_id), r.piece) for r in stores.read_store(spark, path, name).collect())


def rows(keys, piece):
    return [(str(k), f"{piece}{i}") for k in keys for i in range(20)]


def test_a_batch_writes_what_it_holds(spark, tmp_path):
    path = str(tmp_path / "s")
    stores.replace_in_store(docs(spark, range(3000), "a"), path)
    whole = size(path)
    stores.replace_in_store(docs(spark, [5, 9], "b"), path)
    assert size(path) - whole < whole / 10
    want = sorted(rows([k for k in range(3000) if k not in (5, 9)], "a") + rows([5, 9], "b"))
    assert read(spark, path) == want
    stores.compact(spark, path)
    assert read(spark, path) == want and len(stores.versions(spark, path)) == 1


def test_readers_see_whole_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        stores.read_store(spark, path)
    unit = lambda keys, p: {"blocks": docs(spark, keys, p), "pages": docs(spark, keys, p.upper())}
    stores.write_ir(unit([1, 2], "a"), path)
    before = stores.read_store(spark, path, "blocks")
    stores.write_ir(unit([2, 3], "b"), path)
    assert sorted((str(r.doc_id), r.piece) for r in before.collect()) == sorted(rows([1, 2], "a"))
    for name, f in (("blocks", str), ("pages", str.upper)):
        assert read(spark, path, name) == sorted(rows([1], f("a")) + rows([2, 3], f("b")))
    docs(spark, [1], "lost").write.parquet(f"{path}/v3-dead/blocks")  # a job that died before its row was appended
    assert len(read(spark, path, "blocks")) == 60


def test_a_failing_batch_leaves_the_store_as_it_is(spark, tmp_path):
    path = str(tmp_path / "s")
    stores.replace_in_store(docs(spark, [1], "a"), path)
    bad = docs(spark, [1], "b").withColumn("piece", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        stores.write_ir({stores.ROWS: docs(spark, [1], "c"), "other": bad}, path)
    assert read(spark, path) == sorted(rows([1], "a"))


def test_removals_replays_null_keys_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "s")
    odd = spark.createDataFrame([(None, "n"), (1, "x"), (2, "y")], "doc_id long, piece string")
    for _ in range(3):
        stores.replace_in_store(odd, path)
    assert read(spark, path) == [("1", "x"), ("2", "y"), ("None", "n")]
    stores.replace_in_store(odd.limit(0), path, gone=spark.createDataFrame([(2,), (None,), (77,)], "doc_id long"))
    assert read(spark, path) == [("1", "x")]
    stores.replace_in_store(spark.createDataFrame([(2, "again", 5)], "doc_id long, piece string, extra int"), path)
    got = {r.doc_id: (r.piece, r.extra) for r in stores.read_store(spark, path).collect()}
    assert got == {1: ("x", None), 2: ("again", 5)}


def test_enriched_rows_come_first(spark, tmp_path):
    basic, told = str(tmp_path / "b"), str(tmp_path / "e")
    stores.write_ir({"blocks": docs(spark, [1, 2], "a")}, basic)
    assert stores.read_ir(spark, basic, told).count() == 40
    stores.write_ir({"blocks": docs(spark, [2], "z").withColumn("enrichment", F.lit("t"))}, told)
    got = {(r.doc_id, r.piece[0], r.enrichment) for r in stores.read_ir(spark, basic, told).collect()}
    assert got == {(1, "a", None), (2, "z", "t")}


def test_broken_lines_are_skipped(spark):
    lines = ['{"a": 1, "b": "x"}', "", "  ", "[1]", "null", '{"a": 1', '{"a": "no number"}', '{"b": "only"}', None, ' {"a": 3, "z": 9}']
    got = stores.parsed_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "a int, b string").collect()
    assert sorted((str(r.a), r.b) for r in got) == [("1", "x"), ("3", None), ("None", "only")]


def files_below(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


def test_one_named_file_a_note(spark, tmp_path):
    root = str(tmp_path / "notes")
    data = [("课堂/1/第01节.md", "é\n"), ("课堂/1/b c.md", ""), ("top.md", None), ("课堂/2/x.md", "a"), ("课堂/2/x.md", "b")]
    for _ in range(2):
        stores.write_notes(spark.createDataFrame(data, "path string, content string").repartition(3), root)
        assert files_below(root) == {"课堂/1/第01节.md": "é\n".encode(), "课堂/1/b c.md": b"", "top.md": b"", "课堂/2/x.md": b"b"}
    stores.write_notes(spark.createDataFrame([("top.md", "new")], "path string, content string"), root)
    assert files_below(root)["top.md"] == b"new" and len(files_below(root)) == 4


@pytest.mark.parametrize("bad", ["../out.md", "a//b.md", "/abs.md"])
def test_a_failed_job_leaves_no_note(spark, tmp_path, bad):
    root = str(tmp_path / "notes")
    data = [(f"n{i}.md", "x") for i in range(40)] + [(bad, "x")]
    with pytest.raises(Exception, match="not a path"):
        stores.write_notes(spark.createDataFrame(data, "path string, content string").repartition(4), root)
    assert files_below(root) == {} if os.path.isdir(root) else True
    assert not os.path.exists(str(tmp_path / "out.md"))


def test_listings_are_in_order(spark):
    names = [("260102", 2, 3), ("260101", 10, 1), ("260101", 9, 2), ("260101", 9, 5)]
    rel = [(i, f"课堂录音/{d}/第{n}节.txt", "recording", "txt", "indexed", "", f"/u/{i}") for d, n, i in names]
    rel += [(9, "课堂录音/260101/第9节课堂要点.md", "review_note", "md", "indexed", "/b/9", "/u/9")]
    df = spark.createDataFrame(
        rel, "doc_id long, relative_path string, folder_category string, source_format string, status string, bound_file_path string, upload_path string"
    )
    got = [(r.date, r.no, r.section_num, r.txt_doc_id, r.txt_path, r.note_path) for r in catalog.section_listing(df).orderBy("date", "no").collect()]
    assert got == [
        ("260101", 1, 9, 2, "/u/2", "/b/9"), ("260101", 2, 9, 5, "/u/5", "/b/9"), ("260101", 3, 10, 1, "/u/1", None), ("260102", 1, 2, 3, "/u/3", None),
    ]
    assert [r.date for r in catalog.date_listing(df).collect()] == ["260101", "260102"]


def test_hits_without_a_document_stay(spark):
    hits = spark.createDataFrame([("q", "c1", 1), ("q", "c2", 1), ("q", "c3", None), ("q", "c4", 8)], "query_id string, chunk_id string, doc_id long")
    known = spark.createDataFrame([(1, "a.pdf", "pdf", "x")], "doc_id long, filename string, source_format string, chunk_id string")
    got = {r.chunk_id: r.filename for r in trace.with_documents(hits, known).collect()}
    assert got == {"c1": "a.pdf", "c2": "a.pdf", "c3": None, "c4": None}
    assert [tuple(r) for r in trace.documents_of(hits, known).collect()] == [("q", 1, "a.pdf", "pdf")]


def test_note_messages_do_not_hold_whole_names(tmp_path):
    import pickle

    rows = [Row(path=f"课堂录音/{d}/Alge_bra{d}第{n:02d}节课堂要点.md", content=f"{d} {n}") for d in range(20) for n in range(10)]
    writer = stores.NoteWriter({"path": str(tmp_path)}, False)
    message = writer.write(iter(rows))
    assert len(pickle.dumps(message)) < 20 * len(rows)
    assert not [f for f in tmp_path.rglob("*.md") if not f.name.startswith(".")]
    writer.commit([message, None])
    assert {str(f.relative_to(tmp_path)): f.read_text() for f in tmp_path.rglob("*") if f.is_file()} == {r.path: r.content for r in rows}
    gone = writer.write(iter(rows[:3]))
    writer.abort([gone])
    assert len([f for f in tmp_path.rglob("*") if f.is_file()]) == len(rows)
