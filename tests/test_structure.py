"""Normalising, hierarchy and chunking on small documents."""

import json
import random

from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import chunking, footnotes, hierarchy, normalize, quality
from shelfmark.operators.scan import number_rows, running
from shelfmark.plans import corpora

RAW = "doc_id string, page_idx int, raw_pos long, block string"
META = "title_level int, code_language string, table_html string, math_content string, retrieval_text_override string"
BLOCK = (
    "doc_id string, page_idx int, order_in_doc long, type string, role string, text string, "
    f"metadata struct<{META.replace(' ', ':').replace(',:', ',')}>, bbox_norm1000 array<double>, bbox_page array<double>, "
    "assets array<struct<asset_id:string,asset_type:string,path:string>>"
)


def raw(spark, blocks, page=0):
    return spark.createDataFrame([("d", page, i, json.dumps(b)) for i, b in enumerate(blocks)], RAW)


def blocks(spark, rows, doc="d"):
    """rows: (type, text, level) or (type, text, level, page)."""
    data = []
    for i, r in enumerate(rows):
        kind, body, level = r[:3]
        role = "auxiliary" if kind.startswith("page_") else "main"
        data.append((doc, r[3] if len(r) > 3 else 0, i, kind, role, body, (level, None, None, None, None), [0.0] * 4, None, []))
    return spark.createDataFrame(data, BLOCK).withColumn("block_id", F.concat(F.lit("b"), "order_in_doc"))


def test_normalise(spark):
    seg = lambda t: [{"type": "text", "content": t}]
    out = normalize.normalize(raw(spark, [
        {"type": "title", "bbox": [1, 2, 3, 4], "content": {"level": 2, "title_content": [
            {"content": "A"}, {"type": "hyperlink", "content": "", "children": [{"content": "link"}]}]}},
        {"type": "weird", "content": {"paragraph_content": seg("x"), "zz": 1}, "q": 2},
        {"type": "list", "bbox": [1, 2, 3], "content": {"list_items": [
            {"item_content": seg("i1"), "ilevel": 1, "prefix": "-"}, "bad", {"item_content": []}, {"item_content": seg("i2")}]}},
        {"type": "table", "content": {"html": "", "image_source": {"path": "images/"}}},
        {"type": "table", "content": {"html": "<t>", "image_source": {"path": "images/a.jpg"}}},
        {"type": "chart", "content": {"content": "data", "chart_caption": seg("cap"), "image_source": {"path": "images/c.jpg"}}},
        {"type": "page_footer", "content": {"text": "old"}},
        {"type": "code"},
    ])).orderBy("order_in_doc").collect()
    assert [r.type for r in out] == ["title", "paragraph", "list", "table", "image", "page_footer", "code"]
    assert [r.order_in_doc for r in out] == list(range(7))
    assert out[0].text == "Alink" and out[0].metadata.title_level == 2 and out[0].bbox_page == [1, 2, 3, 4]
    assert out[1].degraded[:2] == ["unknown_type_weird", "unknown_keys_block[p0,type=weird]"]
    assert out[2].text == "  - i1\ni2" and out[2].degraded == ["bad_bbox_p0-typelist"]
    assert out[3].assets[0].path == "images/a.jpg" and out[3].degraded == []
    assert out[4].text == "cap\ndata" and out[4].assets[0].asset_type == "chart_image"
    assert out[5].role == "auxiliary" and out[5].text == "old"
    assert out[6].degraded == [f"content_none_{out[6].block_id}"]


def nested(rng, depth):
    """Segments with their children ``depth`` levels deep, and their text."""
    if depth == 0:
        return [{"type": "text", "content": f"é{rng.randrange(100)}\""}], None
    inner, _ = nested(rng, depth - 1)
    return [{"content": f"a{depth} "}, "no segment", {"type": "hyperlink", "content": rng.choice(["", None]), "children": inner},
            {"content": "", "children": "no list"}, {"content": "own", "children": [{"content": "not read"}]}], None


def flat(segs):
    own = [s for s in segs if isinstance(s, dict)]
    return "".join(s.get("content") or (flat(s["children"]) if isinstance(s.get("children"), list) else "") for s in own)


def test_segments_of_any_depth(spark):
    rng = random.Random(3)
    rows, want = [], []
    for depth in [0, 1, 2, 3, 8, 9, 12, 40, 120]:
        segs = nested(rng, depth)[0]
        rows.append({"type": "paragraph", "bbox": [0.5, 1e2, 3, 4], "content": {"paragraph_content": segs}})
        rows.append({"type": "list", "content": {"list_items": [{"item_content": segs, "prefix": "-"}, {"item_content": [{"content": "x"}]}]}})
        want += [flat(segs), f"- {flat(segs)}\nx"]
    broken = [{"type": "paragraph", "content": '"children" and "children"'}, {"type": "paragraph", "content": None, '"children"': '"children"'}]
    out = normalize.normalize(raw(spark, rows + broken)).orderBy("order_in_doc").collect()
    assert [r.text for r in out] == [*want, "", ""]
    assert all(r.segments[0].type == "text" and len(r.segments) == 1 for r in out[1:-2:2])
    assert out[4].bbox_norm1000 == out[0].bbox_norm1000  # a block read anew keeps its numbers


def test_paths_match_a_stack(spark):
    rnd = random.Random(3)
    rows = [("title", f"t{i}", rnd.randint(1, 6)) if rnd.random() < 0.4 else ("paragraph", f"p{i}", None) for i in range(400)]
    got = hierarchy.with_sections(blocks(spark, rows)).orderBy("order_in_doc").collect()
    stack = []
    for row, (kind, body, level) in zip(got, rows):
        if kind == "title":
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, body))
        assert row.header_path == [t for _, t in stack]


def test_scans_across_ranges(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("o"), (F.col("id") * 37 % 101).alias("v"))
    out = running(df, ["k"], "o", {"m": ("max", F.col("v")), "s": ("sum", F.col("v"))}, width=64).orderBy("o").collect()
    back = running(df, ["k"], "o", {"s": ("sum", F.col("v"))}, backward={"m": ("min", F.col("v")), "t": ("sum", F.col("v"))}, width=64).orderBy("o").collect()
    vals = [i * 37 % 101 for i in range(1000)]
    for i in range(1000):
        assert out[i].m == max(vals[: i + 1]) and out[i].s == sum(vals[: i + 1]) and back[i].m == min(vals[i:])
    shuffled = spark.range(500).select(F.lit("k").alias("k"), (F.col("id") * 7 % 500 * 3).alias("o"))
    num = number_rows(shuffled, ["k"], [F.col("o")], [[F.floor(F.col("o") / 200)], [F.floor(F.col("o") / 20)]], "n").collect()
    assert all(r.n == r.o / 3 for r in num)


GARDEN = [
    ("title", "Part A: Soil", 1), ("title", "A1 Clay", 2), ("paragraph", "heavy", None), ("title", "A2 Sand", 2), ("paragraph", "light", None),
    ("title", "Part B: Water", 1, 1), ("title", "B1 Rain", 2, 1), ("paragraph", "soft", None, 1), ("paragraph", "free", None, 1),
]


def parents_of(spark, rows, level):
    members = chunking.grouped(hierarchy.with_sections(blocks(spark, rows)), level)
    return chunking.parent_chunks(members).orderBy("root_ord").collect(), chunking.child_chunks(members).orderBy("order_in_doc").collect()


def test_granularity(spark):
    parents, kids = parents_of(spark, GARDEN, 1)
    assert [p.title for p in parents] == ["Part A: Soil", "Part B: Water"] and len(kids) == 4
    assert kids[1].header_path == ["Part A: Soil", "A2 Sand"]
    assert kids[1].embedding_text == "Part A: Soil > A2 Sand\nlight"
    parents, again = parents_of(spark, GARDEN, 2)
    assert [p.title for p in parents] == ["A1 Clay", "A2 Sand", "B1 Rain"] and len(again) == 4
    assert parents[2].text_full == "Part B: Water\n\nB1 Rain\n\nsoft\n\nfree"
    assert {k.parent_chunk_id for k in again} <= {p.parent_chunk_id for p in parents}


def test_pending_titles_and_no_titles(spark):
    rows = [("title", "A", 1), ("title", "B", 1), ("title", "C", 1), ("paragraph", "x", None), ("title", "lost", 1)]
    parents, _ = parents_of(spark, rows, 1)
    assert [p.text_full for p in parents] == ["A\n\nB\n\nC\n\nx"]
    parents, kids = parents_of(spark, [("paragraph", "only", None)], 1)
    assert len(parents) == 1 and parents[0].title == "" and len(kids) == 1


def test_auxiliary_blocks_widen_sections_only(spark):
    rows = [("title", "A", 1, 0), ("page_footer", "f", None, 1), ("paragraph", "x", None, 0)]
    tree = hierarchy.with_sections(blocks(spark, rows))
    sec = hierarchy.sections(tree).where("title = 'A'").first()
    parent = chunking.parent_chunks(chunking.grouped(tree, 1)).first()
    assert (sec.page_start, sec.page_end) == (0, 1) and (parent.page_start, parent.page_end) == (0, 0)


def test_children_of_visual_blocks(spark):
    tree = hierarchy.with_sections(blocks(spark, [("table", "", None), ("image", "a cat", None), ("equation", "x", None), ("title", "t", 1)]))
    kids = chunking.child_chunks(chunking.grouped(tree, 1)).orderBy("order_in_doc").collect()
    assert [k.retrieval_text for k in kids] == ["[图片: a cat]", "x"]


def test_footnotes(spark):
    rows = [("paragraph", "a", None), ("page_footnote", "n1", None), ("paragraph", "b", None), ("page_footnote", "n2", None, 5)]
    links = footnotes.link(blocks(spark, rows)).collect()
    assert [(r.block_id, r.footnote_block_id) for r in links] == [("b0", "b1")]


def test_provider_levels(spark):
    rows = [("title", f"{i}.1 x", 1) for i in range(1, 6)]
    level = lambda have: [
        r.l for r in hierarchy.assign_levels(
            blocks(spark, rows), spark.createDataFrame([("d", i, 9) for i in range(have)], "doc_id string, i long, level int")
        ).orderBy("order_in_doc").select(F.col("metadata.title_level").alias("l")).collect()
    ]
    assert level(3) == [6, 6, 6, 2, 2] and level(2) == [2] * 5
    single = hierarchy.assign_levels(blocks(spark, [("title", "1.2.3 x", 1)])).first()
    assert single.metadata.title_level == 1


def test_markdown(spark):
    md = "﻿intro\n# A\nx\n\ny\n## B\n\n# C\nz"
    docs = spark.createDataFrame([("d", md.lstrip("﻿"), "md"), ("t", " plain ", "txt"), ("h", "# only", "md")], "doc_id string, text string, source_format string")
    got = {(r.doc_id, tuple(r.header_path)): r.body for r in chunking.text_sections(docs).collect()}
    assert got == {("d", ()): "intro", ("d", ("A",)): "x\n\ny", ("d", ("C",)): "z", ("t", ()): "plain", ("h", ()): "# only"}


def test_audit_follows_children(spark):
    deep = {"type": "text", "content": "a", "children": [{"children": [{"children": [{"children": [{"type": "odd"}]}]}]}]}
    found = quality.audit_blocks(raw(spark, [
        {"type": "paragraph", "content": {"paragraph_content": [deep]}}, 7, {"type": "title", "content": {"level": 5}},
        {"type": "image", "bbox": None, "content": {"image_source": {"path": 3}}},
    ])).collect()
    said = {(r.block_idx, r.issue) for r in found}
    assert (0, "other segment type: odd") in said and (1, "block is no object: int") in said
    assert (2, "core key is absent: title_content") in said
    assert (3, "picture path is no text: int") in said
    counts = quality.deviation_counts(quality.audit_blocks(raw(spark, [{"type": "code", "content": {"code_content": []}}])),
                                      spark.createDataFrame([("d",)], "doc_id string")).first()
    assert counts.is_clean


def test_every_text_tag_of_a_page_is_a_block(spark, tmp_path):
    html = (
        "<html><head><title>Name</title></head><body><header>top</header><div><div class='a'>note</div></div><h1>One</h1><h3>Deep<b>er</b></h3>"
        "<p>text</p><table><caption></caption><tr><th>k</th><td>v</td><td><p>in</p></td></tr></table><dl><dt>term</dt><dd>said</dd></dl>"
        "<pre>x = 1</pre><blockquote>quoted</blockquote><figcaption>Fig</figcaption><footer>end</footer></body></html>"
    )
    spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = corpora.page_elements(spark, str(tmp_path)).orderBy("raw_pos").collect()
    assert [(r.tag, r.body) for r in got] == [
        ("title", "Name"), ("header", "top"), ("div", "note"), ("h1", "One"), ("h3", "Deep er"), ("p", "text"), ("th", "k"), ("td", "v"), ("p", "in"),
        ("dt", "term"), ("dd", "said"), ("pre", "x = 1"), ("blockquote", "quoted"), ("figcaption", "Fig"), ("footer", "end"),
    ]
    blocks = normalize.normalize(corpora.page_blocks(spark, str(tmp_path))).orderBy("order_in_doc").collect()
    kinds = {r.text: (r.type, r.metadata.title_level) for r in blocks}
    assert len(blocks) == 15 and kinds["Name"] == ("title", 1) and kinds["Deep er"] == ("title", 3) and kinds["note"][0] == "paragraph"
    assert kinds["top"][0] == "page_header" and kinds["end"][0] == "page_footer"


def test_document_warnings_build_the_tree_once(spark, monkeypatch):
    from shelfmark.plans import structure

    built, tree = [], structure.C.tree
    monkeypatch.setattr(structure.C, "tree", lambda *a: built.append(a) or tree(*a))
    assert structure.document_warnings(spark, "/root/testdata/sf0.001").count() == 5 and len(built) == 1


def test_chunk_checks_write_ids_and_no_texts(spark, monkeypatch):
    from shelfmark.operators import quality

    kept, cut = [], quality.cut
    monkeypatch.setattr(quality, "cut", lambda df: kept.append(df.columns) or cut(df))
    parents = spark.createDataFrame([("p1", "d", "s", 0, 1, "long")], "parent_chunk_id string, doc_id string, section_id string, page_start int, page_end int, text_full string")
    rows = [("c1", "p1", " "), ("c2", "p2", "x"), ("c3", "p2", "y"), ("c4", None, "z")]
    kids = spark.createDataFrame([(c, "d", p, "paragraph", t) for c, p, t in rows], "child_chunk_id string, doc_id string, parent_chunk_id string, chunk_type string, embedding_text string")
    got = sorted((r.check, r.ctx, r.times) for r in quality.check_chunks(parents, kids).collect())
    assert got == [("child_text_blank", "c1", 1), ("parent_missing", "p2", 2)]
    assert len(kept) == 2 and not {"text_full", "embedding_text"} & {c for cols in kept for c in cols}


def test_equal_raw_blocks_are_audited_once(spark, monkeypatch):
    seen, audit = [], quality._audit_units
    monkeypatch.setattr(quality, "_audit_units", lambda units: seen.append(units.count()) or audit(units))
    texts = ['{"type":"mystery","bbox":null}', '{"type":"paragraph","bbox":[1,2],"content":{"colour":1,"paragraph_content":[{"type":"x"}]}}', "[1]", "no JSON", None]
    rows = [(d, p, k, texts[(d + p + k) % 5]) for d in range(4) for p in range(3) for k in range(5)]
    raw = spark.createDataFrame(rows, "doc_id int, page_idx int, raw_pos long, block string")
    got = {}
    for r in quality.audit_blocks(raw).collect():
        at = f"blocks[p{r.page_idx}][b{r.block_idx}]"
        assert r.location.startswith(at)
        got.setdefault((r.doc_id, r.page_idx, r.block_idx), []).append((r.step, r.severity, r.location[len(at):], r.issue))
    assert seen == [5]
    want = {
        texts[0]: [(2, "error", "", "other block type: mystery"), (2, "info", "", "content is absent"), (2, "info", ".bbox", "box is null")],
        texts[1]: [(2, "warning", ".bbox", "box length: 2"), (3, "warning", ".content", "other content keys: colour"),
                   (4, "warning", ".content.paragraph_content[0].type", "other segment type: x")],
        texts[2]: [(0, "error", "", "block is no object: list")],
        texts[3]: [(0, "error", "", None)], None: [(0, "error", "", None)],
    }
    assert {k: sorted(v, key=str) for k, v in got.items()} == {(d, p, k): sorted(want[t], key=str) for d, p, k, t in rows}


def test_small_keys_are_numbered_and_carried_without_ranges(spark, monkeypatch):
    from shelfmark.operators import scan

    rows = [("big", i, i * 7 % 50) for i in range(50)] + [(k, i, 9 - i) for k in "abc" for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i long, x long")
    ranges = [[F.floor(F.col("x") / 8)]]
    want = {tuple(r) for r in scan.number_rows(df, ["k"], [F.col("x")], ranges, "no").collect()}
    for small in (2, 10, 100):
        assert {tuple(r) for r in scan.number_rows(df, ["k"], [F.col("x")], ranges, "no", small=small).collect()} == want

    cuts, cut = [], scan.cut
    monkeypatch.setattr(scan, "cut", lambda d: cuts.append(d) or cut(d))
    state = lambda width: {
        tuple(r) for r in scan.running(
            df, ["k"], "i", {"m": ("max", F.col("x")), "s": ("sum", F.col("x"))}, backward={"l": ("min", F.col("x"))}, width=width
        ).collect()
    }
    whole = state(100)
    assert len(cuts) == 1  # one range: nothing to carry
    assert state(8) == whole and len(cuts) == 3
    by_key = {}
    for k, i, x in rows:
        by_key.setdefault(k, []).append((i, x))
    for k, i, x, m, s, low in whole:
        before, after = [v for j, v in by_key[k] if j <= i], [v for j, v in by_key[k] if j >= i]
        assert (m, s, low) == (max(before), sum(before), min(after))
