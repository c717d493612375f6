"""Hierarchy, parents, children and contexts over the heading tree of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import geometry
from shelfmark.operators import chunking, context, footnotes, hierarchy, layout, normalize, quality
from shelfmark.operators.scan import WIDTH
from shelfmark.plans import corpora as C
from shelfmark.plans import sql as S
from shelfmark.plans.registry import query
from shelfmark.session import table

PATH = "array_to_string(header_path, ' > ')"


def path(c: str = "header_path"):
    return F.array_join(c, " > ").alias("path")


@query("heading_paths", f"WITH {S.TREE} SELECT doc_id, ord AS order_in_doc, block_id, type, section_id, {PATH} AS path FROM tree")
def heading_paths(spark, sf):
    return C.tree(spark, sf).select("doc_id", "order_in_doc", "block_id", "type", "section_id", path())


_SECTIONS = f"""{S.TREE},
span AS (SELECT doc_id, section_id, min(page_idx) AS page_start, max(page_idx) AS page_end FROM tree GROUP BY 1, 2),
sec AS (SELECT doc_id, section_id, CASE WHEN len(path_ords) > 1 THEN 'sec-' || doc_id || '-' || path_ords[len(path_ords) - 1]
      ELSE 'sec-root-' || doc_id END AS parent_section_id, level, text AS title, {PATH} AS path, len(path_ords) AS depth, ord AS sec_ord
    FROM tree WHERE type = 'title'
  UNION ALL SELECT DISTINCT doc_id, 'sec-root-' || doc_id, NULL, 0, '', '', 0, -1 FROM tree)
"""


@query("section_spans", f"""
WITH {_SECTIONS} SELECT doc_id, section_id, parent_section_id, level, title, path, depth, page_start, page_end FROM sec LEFT JOIN span USING (doc_id, section_id)
""")
def section_spans(spark, sf):
    return hierarchy.sections(C.tree(spark, sf)).select(
        "doc_id", "section_id", "parent_section_id", "level", "title", path(), "depth", "page_start", "page_end"
    )


@query("section_children", f"""
WITH {_SECTIONS} SELECT doc_id, parent_section_id, section_id AS child_section_id,
  row_number() OVER (PARTITION BY parent_section_id ORDER BY sec_ord) - 1 AS child_no FROM sec WHERE level > 0
""")
def section_children(spark, sf):
    return hierarchy.section_children(hierarchy.sections(C.tree(spark, sf)))


@query("section_tree", f"""
WITH RECURSIVE {_SECTIONS}, kept AS (SELECT * FROM sec WHERE level <> 2),
up AS (SELECT k.doc_id, k.section_id, p.section_id AS above FROM kept k LEFT JOIN kept p ON p.doc_id = k.doc_id AND p.section_id = k.parent_section_id),
walk AS (SELECT doc_id, section_id, 0 AS depth FROM up WHERE above IS NULL
  UNION ALL SELECT u.doc_id, u.section_id, w.depth + 1 FROM up u JOIN walk w ON w.doc_id = u.doc_id AND w.section_id = u.above)
SELECT doc_id, section_id, depth, depth = 0 AS is_root FROM walk
""")
def section_tree(spark, sf):
    """Stored sections whose middle level got lost: their children become roots."""
    secs = hierarchy.sections(C.tree(spark, sf)).where(F.col("level") != 2)
    return hierarchy.section_tree(secs).select("doc_id", "section_id", "depth", "is_root")


_CIRCLES = """
cs AS (SELECT o_custkey AS doc_id, o_orderkey AS section_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL
  ELSE coalesce(lag(o_orderkey) OVER w, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderkey) OVER (PARTITION BY o_custkey) END) END AS parent_section_id
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
"""


@query("section_circles", f"""
WITH RECURSIVE {_CIRCLES},
up AS (SELECT c.*, p.section_id AS above FROM cs c LEFT JOIN cs p ON p.doc_id = c.doc_id AND p.section_id = c.parent_section_id),
walk AS (SELECT doc_id, section_id, 0 AS depth FROM up WHERE above IS NULL
  UNION ALL SELECT u.doc_id, u.section_id, w.depth + 1 FROM up u JOIN walk w ON w.doc_id = u.doc_id AND w.section_id = u.above)
SELECT doc_id, section_id, coalesce(depth, 0) AS depth, coalesce(depth, 0) = 0 AS is_root, depth IS NULL AS in_cycle FROM cs LEFT JOIN walk USING (doc_id, section_id)
""")
def section_circles(spark, sf):
    """Orders of a customer as sections below the one before; some customers' parents run in a circle."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("section_id"))
    w = Window.partitionBy("doc_id")
    first = F.when(F.col("doc_id") % 2 == 0, F.max("section_id").over(w))
    parent = F.when(F.col("section_id") % 3 != 0, F.coalesce(F.lag("section_id").over(w.orderBy("section_id")), first))
    return hierarchy.section_tree(orders.withColumn("parent_section_id", parent)).select(
        "doc_id", "section_id", "depth", "is_root", "in_cycle"
    )


# ---- heading levels -------------------------------------------------------------------------

_PREFIX = {0: "1.2.3 ", 1: "第三章 ", 2: "第2节 ", 3: "（4）", 4: "③", 5: "二、", 6: "2 ", 7: ""}


def titled_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as numbered headings, one document per brand, each followed by a paragraph."""
    part = table(spark, sf, "part")
    lead = F.create_map(*[x for k, v in _PREFIX.items() for x in (F.lit(k), F.lit(v))])[F.col("p_size") % 8]
    rows = part.select(F.col("p_brand").alias("doc_id"), "p_partkey", "p_size", F.concat(lead, "p_name").alias("text"))
    title = rows.select("doc_id", (F.col("p_partkey") * 2).alias("order_in_doc"), "text", F.lit("title").alias("type"), "p_size")
    body = rows.select(
        "doc_id", (F.col("p_partkey") * 2 + 1).alias("order_in_doc"), F.concat(F.lit("About "), "text").alias("text"),
        F.lit("paragraph").alias("type"), "p_size",
    )
    return title.unionByName(body).select(
        "*", F.lit("main").alias("role"), F.struct(F.when(F.col("type") == "title", 1).alias("title_level")).alias("metadata")
    )


_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in _PREFIX.items())
_HEUR = r"""CASE WHEN regexp_extract(t, '^\s*(\d+(?:\.\d+)*)', 1) <> '' THEN
    least(length(regexp_extract(t, '^\s*(\d+(?:\.\d+)*)', 1)) - length(replace(regexp_extract(t, '^\s*(\d+(?:\.\d+)*)', 1), '.', '')) + 1, 6)
  WHEN regexp_matches(t, '^\s*第[一二三四五六七八九十百零〇\d]+\s*[章篇部]') THEN 1
  WHEN regexp_matches(t, '^\s*第[一二三四五六七八九十百零〇\d]+\s*节') THEN 2
  WHEN regexp_matches(t, '^\s*[（(]\s*\d+\s*[)）]') OR regexp_matches(t, '^\s*[①②③④⑤⑥⑦⑧⑨⑩⑪⑫]') THEN 3 ELSE 1 END"""


@query("title_levels", f"""
WITH p AS (SELECT p_partkey, (CASE p_size % 8 {_CASES} END) || p_name AS t FROM part)
SELECT p_partkey, t AS title, {_HEUR} AS level FROM p
""")
def title_levels(spark, sf):
    rows = titled_parts(spark, sf).where(F.col("type") == "title")
    return rows.select(
        F.floor(F.col("order_in_doc") / 2).alias("p_partkey"), F.col("text").alias("title"),
        hierarchy.heuristic_level(F.col("text")).alias("level"),
    )


@query("assigned_levels", f"""
WITH p AS (SELECT p_brand AS doc_id, p_partkey, p_size, (CASE p_size % 8 {_CASES} END) || p_name AS t,
   row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
l AS (SELECT *, CASE WHEN p_size % 3 <> 0 AND n <= 120 THEN least(greatest(p_size % 9, 1), 6) END AS given FROM p),
c AS (SELECT *, count(given) OVER (PARTITION BY doc_id) AS have FROM l)
SELECT doc_id, p_partkey, CASE WHEN n > 1 AND have >= n * 0.6 THEN coalesce(given, {_HEUR}) WHEN n > 1 THEN {_HEUR} ELSE 1 END AS level FROM c
""")
def assigned_levels(spark, sf):
    """Provider levels for two thirds of the headings; the gaps are filled by their numbering."""
    blocks = titled_parts(spark, sf)
    titles = hierarchy.running(
        blocks.where(F.col("type") == "title"), ["doc_id"], "order_in_doc", {"i": ("sum", F.lit(1))}
    )
    given = titles.select(
        "doc_id", (F.col("i") - 1).alias("i"), F.when(F.col("p_size") % 3 != 0, (F.col("p_size") % 9).cast("int")).alias("level")
    )
    out = hierarchy.assign_levels(blocks, given).where(F.col("type") == "title")
    return out.select("doc_id", F.floor(F.col("order_in_doc") / 2).alias("p_partkey"), F.col("metadata.title_level").alias("level"))


# ---- parents --------------------------------------------------------------------------------


def _register_levels(level: int) -> None:
    @query(f"group_roots_l{level}", f"""
    WITH {S.TREE}, {S.groups(level)} SELECT doc_id, ord AS order_in_doc, 'pc-' || doc_id || '-' || root_ord AS parent_chunk_id FROM gm
    """)
    def roots(spark, sf):
        return chunking.grouped(C.tree(spark, sf), level).select("doc_id", "order_in_doc", "parent_chunk_id")

    @query(f"parent_chunks_l{level}", f"""
    WITH {S.TREE}, {S.groups(level)} SELECT parent_chunk_id, doc_id, section_id, title, {PATH} AS path, page_start, page_end,
      block_count, asset_count, text_full, substr(text_full, 1, 200) AS text_preview FROM gparents
    """)
    def parents(spark, sf):
        return chunking.parent_chunks(chunking.grouped(C.tree(spark, sf), level)).select(
            "parent_chunk_id", "doc_id", "section_id", "title", path(), "page_start", "page_end", "block_count", "asset_count",
            "text_full", "text_preview",
        )


for _level in (1, 2, 3):
    _register_levels(_level)


@query("rechunk_by_document", f"""
WITH {S.TREE},
lv AS (SELECT r_name AS doc_id, CASE WHEN r_regionkey % 4 > 0 THEN r_regionkey % 4 ELSE 1 END AS n,
   CASE WHEN r_regionkey % 5 = 4 THEN 'failed' ELSE 'indexed' END AS status FROM region),
g AS (SELECT t.*, CASE n WHEN 1 THEN coalesce(l1, -1) WHEN 2 THEN coalesce(greatest(l1, l2), -1) ELSE coalesce(greatest(l1, l2, l3), -1) END AS root_ord
   FROM tree t JOIN lv USING (doc_id) WHERE role = 'main' AND status IN ('indexed', 'needs_review'))
SELECT doc_id, 'pc-' || doc_id || '-' || root_ord AS parent_chunk_id, count(*) FILTER (type <> 'title') AS children
FROM g GROUP BY 1, 2 HAVING count(*) FILTER (type <> 'title') > 0
""")
def rechunk_by_document(spark, sf):
    """A new heading level per document, from stored blocks, for documents that are indexed."""
    docs = table(spark, sf, "region").select(
        F.col("r_name").alias("doc_id"), chunking.effective_level(F.col("r_regionkey") % 4).alias("lvl"),
        F.when(F.col("r_regionkey") % 5 == 4, "failed").otherwise("indexed").alias("status"),
    )
    blocks = C.tree(spark, sf).join(docs.select("doc_id", "lvl"), "doc_id")
    parents, children = chunking.rechunk(blocks, docs, F.col("lvl"))
    n = children.groupBy("parent_chunk_id").agg(F.count(F.lit(1)).alias("children"))
    return parents.select("doc_id", "parent_chunk_id").join(n, "parent_chunk_id").select("doc_id", "parent_chunk_id", "children")


@query("parent_page_labels", f"""
WITH {S.TREE}, {S.groups(1)},
pg AS (SELECT DISTINCT doc_id, root_ord, page_idx FROM gm JOIN gh USING (doc_id, root_ord) WHERE is_full),
lab AS (SELECT pg.doc_id, pg.root_ord, a.type, a.text, min(a.ord) AS o FROM pg JOIN tree a ON a.doc_id = pg.doc_id AND a.page_idx = pg.page_idx
   AND a.role = 'auxiliary' GROUP BY 1, 2, 3, 4)
SELECT 'pc-' || doc_id || '-' || root_ord AS parent_chunk_id,
  coalesce(string_agg(text, '|' ORDER BY o) FILTER (type = 'page_header'), '') AS page_headers,
  coalesce(string_agg(text, '|' ORDER BY o) FILTER (type = 'page_number'), '') AS page_numbers FROM lab GROUP BY doc_id, root_ord
""")
def parent_page_labels(spark, sf):
    blocks = C.tree(spark, sf)
    members = chunking.grouped(blocks, 1)
    full = chunking.parent_chunks(members).select("parent_chunk_id")
    labels = chunking.parent_page_labels(members, normalize.auxiliary_items(blocks)).join(full, "parent_chunk_id", "left_semi")
    return labels.select(
        "parent_chunk_id", F.array_join("page_headers", "|").alias("page_headers"),
        F.array_join("page_numbers", "|").alias("page_numbers"),
    )


# ---- children -------------------------------------------------------------------------------

_CHILD_TEXT = """CASE type WHEN 'image' THEN '[图片: ' || text || ']' WHEN 'table' THEN '[表格: ' || text || ']' ELSE text END"""


@query("child_chunks_tree", f"""
WITH {S.TREE}, {S.groups(2)}
SELECT 'cc-' || m.doc_id || '-' || m.ord || '-0' AS child_chunk_id, 'pc-' || m.doc_id || '-' || m.root_ord AS parent_chunk_id, m.type AS chunk_type,
  {PATH.replace('header_path', 'm.header_path')} || chr(10) || {_CHILD_TEXT.replace('type', 'm.type', 1).replace('text', 'm.text')} AS embedding_text,
  'Page ' || m.page_idx AS page_numbers, CASE WHEN m.type = 'image' THEN 'images/' || m.ord || '.jpg' ELSE '' END AS asset_paths,
  m.type <> 'paragraph' AS is_atomic
FROM gm m WHERE m.type <> 'title'
""")
def child_chunks_tree(spark, sf):
    blocks = C.tree(spark, sf)
    labels = chunking.page_numbers(normalize.auxiliary_items(blocks))
    return chunking.child_chunks(chunking.grouped(blocks, 2), labels).select(
        "child_chunk_id", "parent_chunk_id", "chunk_type", "embedding_text", F.array_join("page_numbers", "|").alias("page_numbers"),
        F.array_join("asset_paths", "|").alias("asset_paths"), "is_atomic",
    )


@query("granularity_counts", " UNION ALL ".join(f"""
SELECT * FROM (WITH {S.TREE}, {S.groups(n)} SELECT {n} AS parent_level, (SELECT count(*) FROM gparents) AS parents,
  (SELECT count(*) FROM gm WHERE type <> 'title') AS children)""" for n in (1, 2, 3)))
def granularity_counts(spark, sf):
    """Parents shrink or grow with the level, children stay the same."""
    blocks = C.tree(spark, sf)
    rows = None
    for n in (1, 2, 3):
        members = chunking.grouped(blocks, n)
        parents = chunking.parent_chunks(members).agg(F.count(F.lit(1)).alias("parents"))
        kids = chunking.child_chunks(members).select("parent_chunk_id").agg(F.count(F.lit(1)).alias("children"))
        one = parents.select(F.lit(n).alias("parent_level"), "parents", kids.scalar().alias("children"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("block_links", f"""
WITH {S.TREE}, {S.groups(1)}
SELECT doc_id, block_id, 'pc-' || doc_id || '-' || root_ord AS parent_chunk_id, (type <> 'title')::INT AS n_children FROM gm
""")
def block_links(spark, sf):
    """Block to parent and block to children, the inverted views of the chunk tables."""
    members = chunking.grouped(C.tree(spark, sf), 1)
    kids = chunking.child_chunks(members).groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).cast("int").alias("n_children"))
    return chunking.parent_blocks(members).join(kids, ["doc_id", "block_id"], "left").select(
        "doc_id", "block_id", "parent_chunk_id", F.coalesce("n_children", F.lit(0)).alias("n_children")
    )


# ---- footnotes and geometry -----------------------------------------------------------------


@query("footnote_links", f"""
WITH {S.TREE}, m AS (SELECT * FROM tree WHERE role = 'main'), n AS (SELECT * FROM tree WHERE type = 'page_footnote')
SELECT n.doc_id, m.block_id, n.block_id AS footnote_block_id, 'inline_append' AS attach_mode, 0.8::DOUBLE AS confidence
FROM n JOIN m ON m.doc_id = n.doc_id AND m.page_idx = n.page_idx
QUALIFY row_number() OVER (PARTITION BY n.block_id ORDER BY abs(m.ord - n.ord), m.ord) = 1
""")
def footnote_links(spark, sf):
    return footnotes.link(C.tree(spark, sf))


_LINES = """
li AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey
   ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord FROM lineitem)
"""


@query("nearest_anchor", f"""
WITH {_LINES}, p AS (SELECT n.l_orderkey, n.ord, m.ord AS anchor, row_number() OVER (PARTITION BY n.l_orderkey, n.ord
   ORDER BY abs(m.ord - n.ord), m.ord) AS rn FROM li n JOIN li m ON m.l_orderkey = n.l_orderkey AND m.l_returnflag <> 'R' WHERE n.l_returnflag = 'R')
SELECT l_orderkey, ord, anchor AS anchor_order FROM p WHERE rn = 1
""")
def nearest_anchor(spark, sf):
    """Returned lines as notes, the other lines of their order as anchors."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    cols = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    lines = C.number_rows(li, ["l_orderkey"], cols, [[F.col("l_linenumber"), F.floor(F.col("l_partkey") / 65536)]], "ord", small=WIDTH)
    note = F.col("l_returnflag") == "R"
    out = footnotes.nearest(lines, ["l_orderkey"], "ord", ~note, note).where(F.col("anchor_order").isNotNull())
    return out.select("l_orderkey", "ord", "anchor_order")


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as boxes: some reversed, some beyond the page, some all zero."""
    x0, y0 = F.col("l_quantity") * 20, F.col("l_tax") * 5000
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_idx"), F.col("l_orderkey").alias("n"),
        F.when(F.col("l_discount") == 0, geometry.zero_box())
        .otherwise(F.array(x0, y0, x0 + F.col("l_discount") * 1000 - 20, y0 + 25)).alias("bbox_norm1000"),
    )


_BOX = """
bx AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_idx, l_orderkey AS n, CASE WHEN l_discount = 0 THEN [0.0::DOUBLE, 0.0, 0.0, 0.0]
   ELSE [l_quantity * 20, l_tax * 5000, l_quantity * 20 + l_discount * 1000 - 20, l_tax * 5000 + 25] END AS b FROM lineitem)
"""


@query("bbox_union", f"""
WITH {_BOX} SELECT doc_id, page_idx, round(min(b[1]), 6) AS x0, round(min(b[2]), 6) AS y0, round(max(b[3]), 6) AS x1, round(max(b[4]), 6) AS y1
FROM bx GROUP BY 1, 2
""")
def bbox_union(spark, sf):
    out = layout.union_boxes(_boxes(spark, sf), ["doc_id", "page_idx"])
    return out.select("doc_id", "page_idx", *[F.round(F.col("box")[i], 6).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


_CLIP = "greatest(0.0::DOUBLE, least(1000.0::DOUBLE, b[{}]))"
_L, _T, _R, _B = (_CLIP.format(i) for i in (1, 2, 3, 4))


@query("percent_boxes", f"""
WITH {_BOX}, c AS (SELECT doc_id, page_idx, n, {_L} AS l, {_T} AS t, {_R} AS r, {_B} AS b FROM bx)
SELECT doc_id, count(*) FILTER (r > l AND b > t) AS drawable, count(*) AS n_boxes,
  round(sum(CASE WHEN r > l AND b > t THEN (r - l) / 10 * (b - t) / 10 END), 4) AS area, bool_or(r > l AND b > t) AS has_geometry FROM c GROUP BY doc_id
""")
def percent_boxes(spark, sf):
    box = _boxes(spark, sf).select("doc_id", geometry.percent_box(F.col("bbox_norm1000")).alias("p"))
    return box.groupBy("doc_id").agg(
        F.count("p").alias("drawable"), F.count(F.lit(1)).alias("n_boxes"),
        F.round(F.sum(F.col("p.width") * F.col("p.height")), 4).alias("area"), F.bool_or(F.col("p").isNotNull()).alias("has_geometry"),
    )


@query("page_boxes", f"""
WITH {_BOX} SELECT doc_id, page_idx, round(sum(b[1] / 1000 * 612), 4) AS x0, round(sum(b[2] / 1000 * 792), 4) AS y0,
  round(sum(b[3] / 1000 * 612), 4) AS x1, round(sum(b[4] / 1000 * 792), 4) AS y1 FROM bx GROUP BY 1, 2
""")
def page_boxes(spark, sf):
    scaled = _boxes(spark, sf).select(
        "doc_id", "page_idx", geometry.page_box(F.col("bbox_norm1000"), F.lit(612.0), F.lit(792.0)).alias("b")
    )
    return scaled.groupBy("doc_id", "page_idx").agg(
        *[F.round(F.sum(F.col("b")[i]), 4).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    )


@query("box_lists", f"""
WITH {_BOX} SELECT doc_id, count(*) AS n_boxes, round(sum(b[3]), 4) AS x1 FROM bx WHERE n % 3 > 0 GROUP BY doc_id
""")
def box_lists(spark, sf):
    """Boxes stored as JSON text; malformed texts and short boxes read as nothing."""
    stored = F.to_json(F.array("bbox_norm1000"))
    broken = F.when(F.col("n") % 3 == 0, F.when(F.col("n") % 2 == 0, "[[1,2").otherwise("[[1,2,3]]")).otherwise(stored)
    rows = _boxes(spark, sf).select("doc_id", F.explode(geometry.box_list(broken)).alias("b"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_boxes"), F.round(F.sum(F.col("b")[2]), 4).alias("x1"))


@query("section_boxes", f"""
WITH {S.TREE} SELECT doc_id, section_id, page_idx, min((ord % 500)::DOUBLE) AS x0, min((ord % 700)::DOUBLE) AS y0,
  max((ord % 500 + 40)::DOUBLE) AS x1, max((ord % 700 + 20)::DOUBLE) AS y1 FROM tree GROUP BY 1, 2, 3
""")
def section_boxes(spark, sf):
    out = layout.union_boxes(C.tree(spark, sf), ["doc_id", "section_id", "page_idx"])
    return out.select("doc_id", "section_id", "page_idx", *[F.col("box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("parent_boxes", f"""
WITH {S.TREE}, {S.groups(2)}, u AS (SELECT 'pc-' || doc_id || '-' || root_ord AS parent_chunk_id, page_idx, min((ord % 500)::DOUBLE) AS x0,
   min((ord % 700)::DOUBLE) AS y0, max((ord % 500 + 40)::DOUBLE) AS x1, max((ord % 700 + 20)::DOUBLE) AS y1 FROM gm GROUP BY 1, 2)
SELECT parent_chunk_id, page_idx, x0 / 10 AS "left", y0 / 10 AS top, (x1 - x0) / 10 AS width, (y1 - y0) / 10 AS height FROM u
""")
def parent_boxes(spark, sf):
    out = layout.union_boxes(chunking.grouped(C.tree(spark, sf), 2), ["parent_chunk_id", "page_idx"])
    return out.select("parent_chunk_id", "page_idx", geometry.percent_box(F.col("box")).alias("p")).select(
        "parent_chunk_id", "page_idx", "p.*"
    )


# ---- documents, checks ----------------------------------------------------------------------


@query("document_flags", f"""
WITH {S.TREE} SELECT doc_id, arg_min(text, ord) FILTER (type = 'title' AND text <> '') AS title, max(page_idx) + 1 AS page_count,
  bool_or(type IN ('image', 'table')) AS has_multimodal, false AS has_code, bool_or(type = 'table') AS has_table,
  false AS has_equation, count(*) FILTER (type = 'image') AS asset_count, count(*) AS block_count,
  bool_or(type = 'page_footnote') AS has_footnote FROM tree GROUP BY doc_id
""")
def document_flags(spark, sf):
    blocks = C.tree(spark, sf)
    noted = footnotes.link(blocks).select("doc_id").distinct().withColumn("_f", F.lit(True))
    return normalize.document_flags(blocks).join(noted, "doc_id", "left").withColumn(
        "has_footnote", F.coalesce("_f", F.lit(False))
    ).drop("_f")


@query("used_types", f"""
WITH {S.TREE} SELECT doc_id, string_agg(type, '|' ORDER BY type) AS used FROM (SELECT DISTINCT doc_id, type FROM tree) GROUP BY doc_id
""")
def used_types(spark, sf):
    return C.tree_blocks(spark, sf).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("used"))


@query("page_auxiliaries", f"""
WITH {S.TREE} SELECT doc_id, page_idx, string_agg(text, '|' ORDER BY ord) FILTER (type = 'page_header') AS headers,
  string_agg(text, '|' ORDER BY ord) FILTER (type = 'page_number') AS numbers, string_agg(text, '|' ORDER BY ord) FILTER (type = 'page_footnote') AS footnotes
FROM tree WHERE role = 'auxiliary' GROUP BY 1, 2
""")
def page_auxiliaries(spark, sf):
    return layout.page_auxiliaries(normalize.auxiliary_items(C.tree(spark, sf))).select(
        "doc_id", "page_idx", *[F.array_join(c, "|").alias(c) for c in ("headers", "numbers", "footnotes")]
    )


@query("document_coverage", f"""
WITH {S.TREE} SELECT doc_id, count(*) AS main_blocks, round(count(*) FILTER (type = 'title') / count(*), 6) AS title_ratio,
  round(count(*) FILTER (text <> '') / count(*), 6) AS text_ratio FROM tree WHERE role = 'main' GROUP BY doc_id
""")
def document_coverage(spark, sf):
    return quality.title_coverage(C.tree_blocks(spark, sf))


_SPOILED = """
sp AS (SELECT *, CASE WHEN ord % 50 = 7 THEN '' ELSE text END AS text2, CASE WHEN ord % 60 = 11 THEN '' ELSE section_id END AS section2,
   CASE WHEN ord % 40 = 3 THEN -1 ELSE page_idx END AS page2, CASE WHEN ord % 70 = 5 THEN 'p-twice' ELSE block_id END AS block2,
   CASE WHEN ord % 30 = 2 THEN 2000.0 ELSE (ord % 500 + 40)::DOUBLE END AS x1, CASE WHEN ord % 30 = 4 THEN -5.0 ELSE (ord % 700 + 20)::DOUBLE END AS y1 FROM tree)
"""


_VIOLATIONS = """
SELECT doc_id, 'text_blank' AS "check", 'warning' AS severity, block2 AS ctx, count(*) AS times FROM sp WHERE type IN ('title', 'paragraph', 'list', 'code') AND text2 = '' GROUP BY ALL
UNION ALL SELECT doc_id, 'section_missing', 'warning', block2, count(*) FROM sp WHERE role = 'main' AND section2 = '' GROUP BY ALL
UNION ALL SELECT doc_id, 'page_idx_negative', 'error', block2, count(*) FROM sp WHERE page2 < 0 GROUP BY ALL
UNION ALL SELECT doc_id, 'bbox_range', 'warning', block2, count(*) FROM sp WHERE x1 > 1010 GROUP BY ALL
UNION ALL SELECT doc_id, 'bbox_order', 'warning', block2, count(*) FROM sp WHERE NOT ((ord % 500) < x1 AND (ord % 700) < y1) GROUP BY ALL
UNION ALL SELECT doc_id, 'block_id_repeated', 'error', block2, count(*) - 1 FROM sp GROUP BY doc_id, block2 HAVING count(*) > 1
"""


def spoiled_blocks(blocks: DataFrame) -> DataFrame:
    """The tree after some of its blocks were spoiled."""
    n = F.col("order_in_doc")
    box = F.col("bbox_norm1000")
    return blocks.withColumns({
        "text": F.when(n % 50 == 7, "").otherwise(F.col("text")),
        "section_id": F.when(n % 60 == 11, "").otherwise(F.col("section_id")),
        "page_idx": F.when(n % 40 == 3, -1).otherwise(F.col("page_idx")),
        "block_id": F.when(n % 70 == 5, "p-twice").otherwise(F.col("block_id")),
        "order_in_page": n,
        "bbox_norm1000": F.array(
            box[0], box[1], F.when(n % 30 == 2, 2000.0).otherwise(box[2]), F.when(n % 30 == 4, -5.0).otherwise(box[3])
        ),
    })


@query("block_violations", f"WITH {S.TREE}, {_SPOILED} {_VIOLATIONS}")
def block_violations(spark, sf):
    found = quality.check_blocks(spoiled_blocks(C.tree(spark, sf)))
    return found.groupBy("doc_id", "check", "severity", "ctx").agg(F.sum("times").alias("times"))


@query("violations", f"""
WITH {S.TREE}, {S.groups(2)},
kept AS (SELECT * FROM gparents WHERE title <> 'MACHINERY'),
kid AS (SELECT m.doc_id, 'cc-' || m.doc_id || '-' || m.ord || '-0' AS cid, 'pc-' || m.doc_id || '-' || m.root_ord AS pid, m.ord,
   CASE WHEN m.ord % 45 = 8 THEN 'movie' ELSE m.type END AS type, CASE WHEN m.ord % 35 = 6 THEN ' ' ELSE 'x' END AS body FROM gm m WHERE m.type <> 'title')
SELECT doc_id, 'child_text_blank' AS "check", 'error' AS severity, cid AS ctx, 1 AS times FROM kid WHERE trim(body) = ''
UNION ALL SELECT doc_id, 'child_type_unknown', 'warning', cid, 1 FROM kid WHERE type = 'movie'
UNION ALL SELECT doc_id, 'parent_missing', 'warning', pid, count(*) FROM kid WHERE pid NOT IN (SELECT parent_chunk_id FROM kept) GROUP BY doc_id, pid
UNION ALL SELECT doc_id, 'parent_pages_reversed', 'warning', parent_chunk_id, 1 FROM kept WHERE title = 'BUILDING'
""")
def violations(spark, sf):
    """Chunk checks after some parents got lost and some chunks were spoiled."""
    members = chunking.grouped(C.tree(spark, sf), 2)
    parents = chunking.parent_chunks(members).where(F.col("title") != "MACHINERY").withColumn(
        "page_start", F.when(F.col("title") == "BUILDING", F.col("page_end") + 1).otherwise(F.col("page_start"))
    )
    n = F.col("order_in_doc")
    kids = chunking.child_chunks(members).withColumns({
        "chunk_type": F.when(n % 45 == 8, "movie").otherwise(F.col("chunk_type")),
        "embedding_text": F.when(n % 35 == 6, " ").otherwise(F.col("embedding_text")),
    })
    return quality.check_chunks(parents, kids)


@query("document_warnings", f"""
WITH {S.TREE}, {_SPOILED}, v AS (SELECT DISTINCT doc_id, severity, "check", ctx FROM ({_VIOLATIONS})),
r AS (SELECT doc_id, substr("check" || ': ' || ctx, 1, 40) AS message, row_number() OVER (PARTITION BY doc_id ORDER BY severity, "check", ctx) AS no FROM v)
SELECT doc_id, coalesce(string_agg(DISTINCT message, '|' ORDER BY message), '') AS warnings,
  CASE WHEN count(message) > 0 THEN 'needs_review' ELSE 'indexed' END AS status FROM (SELECT DISTINCT doc_id FROM tree) d LEFT JOIN r USING (doc_id) WHERE no <= 3 OR no IS NULL GROUP BY doc_id
""")
def document_warnings(spark, sf):
    """The first messages of all checks, and the status that follows."""
    blocks = C.tree(spark, sf)
    found = quality.check_blocks(spoiled_blocks(blocks)).dropDuplicates(["doc_id", "check", "ctx"])
    docs = blocks.select("doc_id").distinct()
    return quality.document_status(docs, quality.top_messages(found)).select(
        "doc_id", F.array_join("warnings", "|").alias("warnings"), "status"
    )


# ---- contexts -------------------------------------------------------------------------------


def _rows(members: DataFrame) -> DataFrame:
    """Blocks of parents as an answer context needs them."""
    return members.select(
        "parent_chunk_id", "order_in_doc", "type", "text", F.lit(None).cast("string").alias("description"),
        F.when(F.col("order_in_doc") % 3 == 0, F.concat(F.lit("<table>"), "order_in_doc", F.lit("</table>"))).alias("table_html"),
        F.when(F.col("order_in_doc") % 2 == 0, F.try_element_at("assets", F.lit(1))["path"]).alias("picture"),
    )


_PIECE = """CASE WHEN type = 'image' THEN '[图片: ' || text || ']' WHEN type = 'table' AND ord % 3 = 0 THEN '<table>' || ord || '</table>'
  WHEN type = 'table' THEN '[表格: ' || text || ']' ELSE text END"""


@query("parent_context", f"""
WITH {S.TREE}, {S.groups(2)}
SELECT 'pc-' || doc_id || '-' || root_ord AS parent_chunk_id, substr(string_agg({_PIECE}, chr(10) || chr(10) ORDER BY ord), 1, 2800) AS body
FROM gm GROUP BY doc_id, root_ord
""")
def parent_context(spark, sf):
    return context.head_of_parents(_rows(chunking.grouped(C.tree(spark, sf), 2)))


@query("context_segments", f"""
WITH {S.TREE}, {S.groups(2)},
s AS (SELECT *, 'pc-' || doc_id || '-' || root_ord AS pid, (type = 'image' AND ord % 2 = 0) AS shown FROM gm),
r AS (SELECT *, sum(shown::INT) OVER (PARTITION BY pid ORDER BY ord) - shown::INT AS run FROM s)
SELECT pid AS parent_chunk_id, run * 2 AS segment_no, 'text' AS kind,
  string_agg(CASE WHEN shown THEN '（下图：' || substr(text, 1, 50) || '）' ELSE {_PIECE} END, chr(10) || chr(10) ORDER BY ord) AS content FROM r GROUP BY pid, run
UNION ALL SELECT pid, run * 2 + 1, 'image', 'images/' || ord || '.jpg' FROM r WHERE shown
""")
def context_segments(spark, sf):
    return context.segments(_rows(chunking.grouped(C.tree(spark, sf), 2)))


@query("picture_paths", f"""
WITH {S.TREE}, p AS (SELECT doc_id, 'images/' || ord || '.jpg' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS no FROM tree WHERE type = 'image')
SELECT doc_id AS query_id, no, path FROM p WHERE no <= 10
""")
def picture_paths(spark, sf):
    """Every child of a document as a hit, in reading order; the first ten pictures go out."""
    kids = chunking.child_chunks(chunking.grouped(C.tree(spark, sf), 1))
    found = kids.select(F.col("doc_id").alias("query_id"), F.col("child_chunk_id").alias("chunk_id"), F.col("order_in_doc").alias("rank"))
    return context.picture_paths(found, kids, 10)


@query("asset_rows", f"""
WITH {S.TREE} SELECT doc_id, block_id, 'asset-' || ord AS asset_id, 'image' AS asset_type, 'images/' || ord || '.jpg' AS path FROM tree WHERE type = 'image'
""")
def asset_rows(spark, sf):
    return normalize.asset_rows(C.tree_blocks(spark, sf))


@query("block_projection", f"""
WITH {S.TREE} SELECT block_id, page_idx, ord AS order_in_doc, section_id, {PATH} AS path, type, role, text,
  CASE WHEN type = 'image' THEN 'asset-' || ord ELSE '' END AS assets, level AS title_level FROM tree
""")
def block_projection(spark, sf):
    return layout.block_view(C.tree(spark, sf)).select(
        "block_id", "page_idx", "order_in_doc", "section_id", path(), "type", "role", "text", F.array_join("assets", "|").alias("assets"), "title_level"
    )
