import os

import pytest

from shelfmark.plans import records
from shelfmark.sources import folders, stores
from shelfmark.streaming import incremental


def test_a_table_in_several_files_is_streamed_whole(spark, tmp_path):
    words = spark.createDataFrame([(i, f"text number {i}.", "fr" if i % 3 == 0 else "de") for i in range(9)], "doc_id long, text string, lang string")
    for name, parts in (("one", 1), ("many", 3)):
        folder = tmp_path / name / "documents.parquet"
        words.repartition(parts).write.parquet(str(folder))
        if name == "one":
            file = next(folder.glob("*.parquet"))
            (tmp_path / "file").mkdir()
            (tmp_path / "file" / "documents.parquet").write_bytes(file.read_bytes())
    for name in ("one", "many", "file"):
        got = records.incremental_index(spark, str(tmp_path / name)).collect()
        assert sorted((r.doc_id, r.n_chunks) for r in got) == [(i, 1) for i in range(9)], name


def written(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x" * len(name))


def test_a_file_is_no_line_of_the_stream_log(spark, tmp_path):
    root, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), tmp_path / "cp"
    run = lambda: incremental.register_files(spark, str(root), table, str(checkpoint)).awaitTermination()
    read = lambda: sorted((r.path, r.relative_path, r.size) for r in stores.read_store(spark, table).collect())
    want = lambda names: sorted((f"file:{root}/{n}", n, len(n)) for n in names)
    root.mkdir()
    run()
    assert not stores.versions(spark, table)
    first, more = [f"课件/{d}/{n}.pdf" for d in range(40) for n in range(8)], ["课件/0/new.pdf", "top.md"]
    written(root, first)
    run()
    assert read() == want(first)
    logged = [line for f in checkpoint.glob("**/sources/0/[0-9]*") for line in f.read_text().splitlines()]
    assert 0 < len(logged) < 30 and not any(".pdf" in line for line in logged)
    written(root, more)
    os.utime(root / "top.md", (1e9, 1e9))  # older than a week before the newest
    run()
    assert read() == want(first + more)
    gone = stores.read_store(spark, table).where("relative_path = 'top.md'")
    stores.replace_in_store(gone.limit(0), table, gone=gone)
    for _ in range(2):
        run()  # a removed row does not come back, and nothing is written
    assert read() == want([*first, "课件/0/new.pdf"]) and len(stores.versions(spark, table)) == 3
    other = incremental.register_files(spark, str(root), table, str(tmp_path / "cp2"))
    other.awaitTermination()
    assert read() == want(first + more)


ODD = [
    "a b.md", "p%20q.md", "h#x.md", "co:lon.md", "课/第1节.md", "_no.md", "_a=b.md", ".no.md", "no._COPYING_", "_metadata/yes.md", "_no/x.md", ".no/x.md",
    "k=v/x.md", "{br}[1].md", "q?.md", "st*r.md", "new\nline.md", "_common_metadata.md", "a.md.crc", "deep/1/2/3/4/5/6/x.md",
]


def odd_folder(tmp_path):
    root = tmp_path / "o d"
    written(root, ODD)
    written(tmp_path, ["far/sub/f.md"])
    (root / "link").symlink_to(tmp_path / "far")
    (root / "broken.md").symlink_to(tmp_path / "gone")
    return root


def as_spark_has_them(spark, root):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return sorted(tuple(r) for r in found.collect())


def test_tasks_list_the_files_that_spark_reads(spark, tmp_path):
    root = odd_folder(tmp_path)
    (root / os.fsdecode(b"bad\xff.md")).write_text("x")
    for at in (str(root), f"file:{root}", f"file://{root}/"):
        assert sorted(tuple(r) for r in folders.files_below(spark, at).collect()) == as_spark_has_them(spark, at)
    (root / "empty.md").touch()
    assert [r.size for r in folders.files_below(spark, str(root)).where("path LIKE '%empty.md'").collect()] == [0]
    with pytest.raises(Exception, match="does not exist"):
        folders.files_below(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("own", [1, 2, 5, 1000])
def test_rounds_leave_no_folder_out(tmp_path, own):
    root = odd_folder(tmp_path)
    left, files, rounds = [f"file:{root}"], [], 0
    while left:
        found = [*folders.walked(iter(left), own)]
        files += [path for path, _, folder in found if not folder]
        left, rounds = [path for path, _, folder in found if folder], rounds + 1
    assert len(files) == len({*files}) and sorted(files) == sorted(path for path, _, folder in folders.walked(iter([f"file:{root}"])) if not folder)
    assert rounds == 1 if own == 1000 else 1 < rounds <= 8


def test_a_store_that_only_spark_opens(spark, tmp_path):
    root = odd_folder(tmp_path)
    (root / "co:lon.md").unlink()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.only.link./in", root.as_uri())
    try:
        run = lambda: incremental.register_files(spark, "viewfs://only/in", str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
        run()
        written(root, ["later/x.md"])
        run()
        got = sorted((r.path, r.size) for r in stores.read_store(spark, str(tmp_path / "t")).collect())
        assert got == as_spark_has_them(spark, "viewfs://only/in") and len(got) == 15
    finally:
        conf.unset("fs.viewfs.mounttable.only.link./in")
