"""Raw blocks: normalising web pages, Markdown sections, audits and bundle listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators.scan import joined_text
from shelfmark.operators import chunking, hierarchy, normalize, providers, quality
from shelfmark.plans import corpora as C
from shelfmark.plans import sql as S
from shelfmark.plans.registry import query
from shelfmark.session import cut, table
from shelfmark.sources import bundles


@query("page_blocks", f"""
WITH {S.ELEMENTS}
SELECT doc_id, page_idx, raw_pos AS order_in_page, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS order_in_doc, block_id, type, role, text,
  raw_pos * 40.0::DOUBLE AS y0, (raw_pos * 40 + 30) / 1000.0 * 792 AS page_y1 FROM pb
""")
def page_blocks(spark, sf):
    """Web pages as raw blocks, normalised; the page size comes from a layout."""
    raw = C.page_blocks(spark, sf)
    sizes = raw.select("doc_id", "page_idx").distinct().select("*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return normalize.normalize(raw, sizes).select(
        "doc_id", "page_idx", "order_in_page", "order_in_doc", "block_id", "type", "role", "text",
        F.col("bbox_norm1000")[1].alias("y0"), F.round(F.col("bbox_page")[3], 6).alias("page_y1"),
    )


#: Segments nested in segments: 1 to 14 levels, with text before and after each inner one.
_LEVELS = "(1 + c_custkey % 14)"


@query("nested_segments", f"""
SELECT c_nationkey AS doc_id, CAST(c_custkey AS BIGINT) AS raw_pos,
  CASE c_custkey % 3 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'list' ELSE 'title' END AS type,
  list_aggregate(list_transform(range({_LEVELS}, 0, -1), lambda n: 'L' || n || ' '), 'string_agg', '') || c_name || repeat('|', {_LEVELS}) AS text,
  CASE c_custkey % 3 WHEN 1 THEN 1 ELSE 3 END AS n_segments FROM customer
""")
def nested_segments(spark, sf):
    """Blocks whose text lies up to 14 levels of children deep."""
    at = lambda text: F.format_string('{"type":"text","content":"%s"}', text)
    inner = F.aggregate(
        F.sequence(F.lit(1), F.expr(_LEVELS).cast("int")), F.concat(F.lit("["), at(F.col("c_name")), F.lit("]")),
        lambda below, n: F.concat(
            F.lit("["), at(F.concat(F.lit("L"), n.cast("string"), F.lit(" "))), F.lit(',{"type":"hyperlink","content":"","children":'),
            below, F.lit("},"), at(F.lit("|")), F.lit("]"),
        ),
    )
    paragraph, listed, title = (
        F.concat(F.lit(f'{{"type":"{kind}","bbox":[0,0,10,10],"content":{{{before}'), inner, F.lit(f"{after}}}}}"))
        for kind, before, after in (
            ("paragraph", '"paragraph_content":', ""), ("list", '"list_items":[{"item_content":', "}]"), ("title", '"level":2,"title_content":', ""),
        )
    )
    third = F.col("c_custkey") % 3
    raw = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("c_custkey").cast("long").alias("raw_pos"),
        F.when(third == 0, paragraph).when(third == 1, listed).otherwise(title).alias("block"),
    )
    return normalize.parse_blocks(raw).select("doc_id", "raw_pos", "type", "text", F.size("segments").alias("n_segments"))


def stored_pages(spark: SparkSession, sf: str) -> DataFrame:
    return cut(hierarchy.with_sections(normalize.normalize(C.page_blocks(spark, sf))))


@query("page_documents", f"""
WITH {S.ELEMENTS}
SELECT doc_id, coalesce(arg_min(text, pos) FILTER (type = 'title' AND text <> ''), '') AS title, max(page_idx) + 1 AS page_count, count(*) AS block_count FROM pb GROUP BY doc_id
""")
def page_documents(spark, sf):
    flags = normalize.document_flags(normalize.normalize(C.page_blocks(spark, sf)))
    return flags.select("doc_id", "title", "page_count", "block_count")


@query("page_children", f"""
WITH {S.ELEMENTS},
po AS (SELECT *, max(CASE WHEN type = 'title' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS root,
   row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord FROM pb),
pt AS (SELECT p.*, t.text AS title FROM po p LEFT JOIN po t ON t.doc_id = p.doc_id AND t.pos = p.root),
pm AS (SELECT doc_id, ord, type, title, {S.strip('text')} AS bd FROM pt WHERE role = 'main' AND type <> 'title' AND {S.strip('text')} <> ''),
ps AS (SELECT *, {S.sentences('bd')} AS segs FROM pm),
pf AS (SELECT *, CASE WHEN type = 'list' OR length(bd) <= 500 THEN {{'o': [bd], 'c': ''}} ELSE {S.FOLD.format(segs='segs')} END AS st FROM ps),
pw AS (SELECT *, {S.CLOSE} AS w FROM pf),
px AS (SELECT doc_id, ord, type, title, unnest(w) AS piece, unnest(range(len(w))) AS no, len(w) AS total FROM pw)
SELECT 'cc-' || doc_id || '-' || ord || '-' || no AS child_chunk_id, doc_id, type AS chunk_type,
  CASE WHEN title IS NULL THEN piece ELSE title || chr(10) || piece END AS embedding_text,
  CASE WHEN total > 1 THEN no END AS fragment_index, CASE WHEN total > 1 THEN total END AS fragment_total FROM px
""")
def page_children(spark, sf):
    kids = chunking.child_chunks(chunking.grouped(stored_pages(spark, sf), 1))
    return kids.select(
        "child_chunk_id", "doc_id", "chunk_type", "embedding_text", F.col("fragment_index").cast("long").alias("fragment_index"),
        F.col("fragment_total").cast("long").alias("fragment_total"),
    )


@query("block_type_rollup", f"""
WITH {S.ELEMENTS}, d AS (SELECT doc_id, type AS raw_type FROM pb)
SELECT doc_id, raw_type, count(*) AS n FROM d GROUP BY ROLLUP (doc_id, raw_type)
""")
def block_type_rollup(spark, sf):
    raw = C.page_blocks(spark, sf)
    return quality.block_types(raw.select("doc_id", F.get_json_object("block", "$.type").alias("raw_type")))


def markdown_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages rewritten as Markdown: headings, sub-headings for list items, lines of text."""
    el = C.page_elements(spark, sf).where(~F.col("tag").isin("header", "footer"))
    level = F.regexp_extract("tag", "^h([1-6])$", 1).try_cast("int")
    line = F.when(F.col("tag") == "title", F.concat(F.lit("# "), "body")).when(
        level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "body")
    ).when(F.col("tag") == "li", F.concat(F.lit("## "), "body")).otherwise(F.col("body"))
    lines = el.select("doc_id", (F.col("page_idx") * C.PER_PAGE + F.col("raw_pos")).alias("pos"), line.alias("line"))
    docs = joined_text(lines, ["doc_id"], "pos", "line", "\n", "text")
    return docs.withColumn("source_format", F.when(F.col("doc_id") % 10 == 9, "txt").otherwise("md"))


@query("markdown_sections", f"""
WITH {S.ELEMENTS},
ml AS (SELECT doc_id, pos, CASE WHEN tag = 'title' THEN '# ' || body WHEN tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN repeat('#', substr(tag, 2)::INT) || ' ' || body
   WHEN tag = 'li' THEN '## ' || body ELSE body END AS line FROM pel WHERE tag NOT IN ('header', 'footer')),
md AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM ml GROUP BY doc_id),
ls AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS line, unnest(range(len(str_split(text, chr(10))))) AS no FROM md WHERE doc_id % 10 <> 9),
lh AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s+(.*\\S)\\s*$', 1)) AS lvl, regexp_extract(line, '^(#{{1,6}})\\s+(.*\\S)\\s*$', 2) AS head FROM ls),
lw AS (SELECT *, max(CASE WHEN lvl = 1 THEN no END) OVER w AS s1, max(CASE WHEN lvl = 2 THEN no END) OVER w AS s2 FROM lh
   WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)),
lp AS (SELECT *, CASE WHEN s2 > coalesce(s1, -1) THEN s2 END AS l2 FROM lw),
lb AS (SELECT doc_id, s1, l2, {S.strip("string_agg(line, chr(10) ORDER BY no)")} AS body FROM lp WHERE lvl = 0 GROUP BY doc_id, s1, l2),
secs AS (SELECT b.doc_id, coalesce(greatest(b.s1, b.l2), -1) AS sec_ord,
    array_to_string(list_filter([h1.head, h2.head], lambda x: x IS NOT NULL), ' > ') AS path, b.body
  FROM lb b LEFT JOIN lh h1 ON h1.doc_id = b.doc_id AND h1.no = b.s1 LEFT JOIN lh h2 ON h2.doc_id = b.doc_id AND h2.no = b.l2 WHERE b.body <> '')
SELECT * FROM secs UNION ALL
SELECT doc_id, -1, '', {S.strip('text')} FROM md WHERE doc_id % 10 = 9 OR doc_id NOT IN (SELECT doc_id FROM secs)
""")
def markdown_sections(spark, sf):
    secs = chunking.text_sections(cut(markdown_pages(spark, sf)))
    return secs.select("doc_id", "sec_ord", F.array_join("header_path", " > ").alias("path"), "body")


# ---- audits -----------------------------------------------------------------------------------

_X = "round(l_extendedprice / 90, 0)::INT"
_ODD = f"""
ob AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_returnflag AS f, l_quantity::INT AS q, l_linestatus AS s, {_X} AS x,
   printf('blocks[p%d][b%d]', l_linenumber, l_partkey) AS loc FROM lineitem),
od AS (
  SELECT doc_id, n, 'info' AS severity, loc || '.bbox' AS location, 'box is null' AS issue FROM ob WHERE q = 1
  UNION ALL SELECT doc_id, n, 'warning', loc || '.bbox', 'box length: 3' FROM ob WHERE q <> 1 AND s <> 'F'
  UNION ALL SELECT doc_id, n, 'warning', loc || '.bbox', 'box number out of range: ' || x FROM ob WHERE q <> 1 AND s = 'F' AND x > 1050
  UNION ALL SELECT doc_id, n, 'error', loc, 'other block type: mystery' FROM ob WHERE n = 7
  UNION ALL SELECT doc_id, n, 'info', loc || '.content', 'content keys of other type mystery: hint' FROM ob WHERE n = 7
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content.level', 'level is not 1 to 3: ' || (q % 5) FROM ob WHERE n = 1 AND q % 5 IN (0, 4)
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content.title_content[0].type', 'other segment type: footmark' FROM ob WHERE n = 1 AND f = 'R'
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content', 'other content keys: colour' FROM ob WHERE n = 2 AND f = 'A'
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content', 'core key is absent: paragraph_content' FROM ob WHERE n = 2 AND f = 'N'
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content.paragraph_content[0].type', 'other segment type: footmark' FROM ob WHERE n = 2 AND f = 'R'
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content.attribute', 'other list attribute: bullets' FROM ob WHERE n = 3 AND f = 'N'
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content.list_items[0].ilevel', 'item level is negative: -1' FROM ob WHERE n = 3 AND q % 13 = 0
  UNION ALL SELECT doc_id, n, 'info', loc || '.content.list_items[0].ilevel', 'item level is large: 11' FROM ob WHERE n = 3 AND q % 13 = 12
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content.list_items[0].item_content[0].type', 'other segment type: footmark' FROM ob WHERE n = 3 AND f = 'R'
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content', 'core key is absent: html' FROM ob WHERE n = 4 AND f = 'N'
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content.table_type', 'other table type: pivot' FROM ob WHERE n = 4 AND f = 'A'
  UNION ALL SELECT doc_id, n, 'info', loc || '.content.image_source.path', 'picture lies outside images/: pics/a.jpg' FROM ob WHERE n = 5 AND f = 'R'
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content.image_source.path', 'picture source has no path' FROM ob WHERE n = 5 AND f = 'N'
  UNION ALL SELECT doc_id, n, 'warning', loc || '.content.math_type', 'other math type: tex' FROM ob WHERE n = 6 AND f = 'A')
"""


@query("deviations", f"WITH {_ODD} SELECT doc_id, n AS page_idx, severity, location, issue FROM od")
def deviations(spark, sf):
    return quality.audit_blocks(C.odd_blocks(spark, sf)).select("doc_id", "page_idx", "severity", "location", "issue")


@query("deviation_top10", f"""
WITH {_ODD} SELECT substr(issue, 1, 60) AS issue, count(*) AS n FROM od GROUP BY 1 ORDER BY n DESC, issue LIMIT 10
""")
def deviation_top10(spark, sf):
    return quality.frequent_issues(quality.audit_blocks(C.odd_blocks(spark, sf)))


_COUNTS = """
docs AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem),
dc AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count,
   count(*) FILTER (severity = 'info') AS info_count, count(severity) = 0 AS is_clean FROM docs LEFT JOIN od USING (doc_id) GROUP BY doc_id)
"""


def _counted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    found = cut(quality.audit_blocks(C.odd_blocks(spark, sf)))
    docs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    return found, quality.deviation_counts(found, docs)


@query("deviation_counts", f"WITH {_ODD}, {_COUNTS} SELECT * FROM dc")
def deviation_counts(spark, sf):
    return _counted(spark, sf)[1]


@query("audit_summary", f"""
WITH {_ODD}, {_COUNTS} SELECT count(*) AS total, count(*) FILTER (is_clean) AS clean, count(*) FILTER (error_count > 0) AS with_errors,
  count(*) FILTER (warning_count > 0 AND error_count = 0) AS warnings_only, sum(error_count) AS error_count, sum(warning_count) AS warning_count FROM dc
""")
def audit_summary(spark, sf):
    return quality.corpus_summary(_counted(spark, sf)[1])


@query("audit_lines", f"""
WITH {_ODD}, {_COUNTS},
f AS (SELECT doc_id, string_agg(substr(issue, 1, 60), '; ' ORDER BY rn) AS issues FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
   ORDER BY n, regexp_extract(location, '\\[b(\\d+)\\]', 1)::INT, CASE WHEN issue LIKE 'other block type%' OR issue LIKE 'box%' THEN 2
     WHEN issue LIKE '%segment%' THEN 4 WHEN issue LIKE 'item%' THEN 5 WHEN issue LIKE 'picture source%' THEN 6 ELSE 3 END, location, issue) AS rn
   FROM od WHERE severity <> 'info') WHERE rn <= 3 GROUP BY doc_id)
SELECT doc_id, '[format_probe] ' || error_count || 'e/' || warning_count || 'w/' || info_count || 'i: ' || coalesce(issues, '') AS summary
FROM dc LEFT JOIN f USING (doc_id) WHERE NOT is_clean
""")
def audit_lines(spark, sf):
    found, counts = _counted(spark, sf)
    return quality.summary_lines(found, counts)


def layouts(spark: SparkSession, sf: str) -> DataFrame:
    """A layout file per supplier; its balance and key decide what is odd about it."""
    k = F.col("s_suppkey")
    page = F.to_json(
        F.struct(
            F.lit(0).alias("page_idx"), F.array(F.lit(612.0), F.lit(792.0)).alias("page_size"), F.when(k % 4 == 1, "x").alias("stamp")
        )
    )
    doc = F.concat(
        F.lit('{"pdf_info":['), page, F.lit('],"_backend":"'), F.when(k % 5 == 2, "cloud").otherwise("hybrid"),
        F.lit('","_version_name":"'), F.when(k % 3 == 0, "3.9.0").otherwise("3.2.1"), F.lit('","_ocr_enable":'),
        F.when(k % 7 == 3, '"yes"').otherwise("true"), F.lit("}"),
    )
    body = F.when(k % 11 == 5, F.lit(None)).when(k % 13 == 6, "{broken").when(k % 17 == 8, "[]").otherwise(doc)
    return table(spark, sf, "supplier").select(k.alias("doc_id"), body.alias("content"))


_FINE = "s_suppkey % 11 <> 5 AND s_suppkey % 13 <> 6 AND s_suppkey % 17 <> 8"


@query("layout_deviations", f"""
SELECT s_suppkey AS doc_id, 'info' AS severity, 'layout.json' AS location, 'no layout file' AS issue FROM supplier WHERE s_suppkey % 11 = 5
UNION ALL SELECT s_suppkey, 'error', 'layout.json', 'no JSON' FROM supplier WHERE s_suppkey % 11 <> 5 AND s_suppkey % 13 = 6
UNION ALL SELECT s_suppkey, 'error', 'layout.json', 'top is no object: list' FROM supplier WHERE s_suppkey % 11 <> 5 AND s_suppkey % 13 <> 6 AND s_suppkey % 17 = 8
UNION ALL SELECT s_suppkey, 'warning', 'layout.json._version_name', 'other version: 3.9.0' FROM supplier WHERE {_FINE} AND s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'warning', 'layout.json._backend', 'other backend: cloud' FROM supplier WHERE {_FINE} AND s_suppkey % 5 = 2
UNION ALL SELECT s_suppkey, 'info', 'layout.json._ocr_enable', '_ocr_enable is no truth value: str' FROM supplier WHERE {_FINE} AND s_suppkey % 7 = 3
UNION ALL SELECT s_suppkey, 'info', 'layout.json.pdf_info[0]', 'other page keys: stamp' FROM supplier WHERE {_FINE} AND s_suppkey % 4 = 1
""")
def layout_deviations(spark, sf):
    rows = layouts(spark, sf).withColumnRenamed("content", "layout")
    return quality.audit_layout(rows).select("doc_id", "severity", "location", "issue")


@query("layout_pages", f"""
SELECT s_suppkey AS doc_id, 0 AS page_idx, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, CASE WHEN s_suppkey % 5 = 2 THEN 'cloud' ELSE 'hybrid' END AS backend,
  CASE WHEN s_suppkey % 3 = 0 THEN '3.9.0' ELSE '3.2.1' END AS version FROM supplier WHERE {_FINE}
""")
def layout_pages(spark, sf):
    rows = layouts(spark, sf)
    return bundles.page_sizes(rows).join(bundles.layout_meta(rows), "doc_id")


# ---- bundle listings ---------------------------------------------------------------------------

_NAMES = {
    0: "a1_content_list_v2.json", 1: "layout.json", 2: "full.md", 3: "a1_origin.pdf", 4: "images/7.jpg",
    5: "a1_model.json", 6: "surprise.bin", 7: "a1_content_list.json", 8: "b2_content_list_v2.json",
}


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """A file listing with one file per order below its customer's bundle."""
    name = F.create_map(*[x for k, v in _NAMES.items() for x in (F.lit(k), F.lit(v))])[(F.col("o_orderkey") % 9).cast("int")]
    return table(spark, sf, "orders").select(
        F.concat(F.lit("/kb/"), "o_custkey", F.lit("/extracted/"), name).alias("path"), F.col("o_orderkey").alias("size")
    )


_LIST = f"""
fl AS (SELECT DISTINCT o_custkey::VARCHAR AS doc_id, CASE o_orderkey % 9 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _NAMES.items())} END AS name FROM orders)
"""


@query("bundle_manifest", f"""
WITH {_LIST}, p AS (SELECT doc_id, name, '/kb/' || doc_id || '/extracted/' || name AS path FROM fl)
SELECT doc_id, min(path) FILTER (name LIKE '%content_list_v2.json') AS blocks_path, min(path) FILTER (name = 'layout.json') AS layout_path,
  min(path) FILTER (name = 'full.md') AS full_md_path, min(path) FILTER (name LIKE '%_content_list.json') AS flat_list_path,
  min(path) FILTER (name LIKE '%_model.json') AS model_path, min(path) FILTER (name LIKE '%_origin.pdf') AS origin_pdf_path,
  CASE WHEN count(*) FILTER (name LIKE 'images/%') > 0 THEN '/kb/' || doc_id || '/extracted/images' END AS images_dir
FROM p GROUP BY doc_id
""")
def bundle_manifest(spark, sf):
    return bundles.manifest(bundles.bundle_files(listing(spark, sf)))


@query("bundle_deviations", f"""
WITH {_LIST}
SELECT doc_id, 'warning' AS severity, 'file of no known role: surprise.bin' AS issue FROM fl WHERE name = 'surprise.bin'
UNION ALL SELECT doc_id, 'error', 'no block file' FROM fl GROUP BY doc_id HAVING count(*) FILTER (name LIKE '%content_list_v2.json') = 0
UNION ALL SELECT doc_id, 'error', CASE doc_id::INT % 3 WHEN 1 THEN 'top is no list: dict' ELSE 'no JSON' END FROM fl WHERE name LIKE '%content_list_v2.json' AND doc_id::INT % 3 <> 0
""")
def bundle_deviations(spark, sf):
    files = bundles.bundle_files(listing(spark, sf))
    kind = F.col("doc_id").cast("long") % 3
    content = F.when(kind == 0, "[]").when(kind == 1, "{}").otherwise("{broken")
    texts = files.where(F.col("role") == "blocks").select("doc_id", content.alias("content"))
    return quality.audit_bundles(bundles.manifest(files), files, texts).select("doc_id", "severity", "issue")


def block_files(spark: SparkSession, sf: str) -> DataFrame:
    """A block file per order: no list for every seventh, else three pages of which one may be no list."""
    k = F.col("o_orderkey")
    block = F.concat(F.lit('{"type":"paragraph","n":'), k.cast("string"), F.lit("}"))
    middle = F.when(k % 5 == 2, '{"a":1}').when(k % 5 == 3, '"x"').otherwise(F.concat(F.lit("["), block, F.lit(","), block, F.lit("]")))
    pages = F.concat(F.lit(" [["), block, F.lit("],"), middle, F.lit(",[]]"))
    return table(spark, sf, "orders").select(k.alias("doc_id"), F.when(k % 7 == 3, '{"no":"list"}').when(k % 7 == 4, "").otherwise(pages).alias("content"))


_READ = "o_orderkey % 7 NOT IN (3, 4)"


@query("block_file_failures", f"""
SELECT o_orderkey AS doc_id, 'block_file_not_list' AS message FROM orders WHERE NOT ({_READ})
UNION ALL SELECT o_orderkey, 'page_1_not_list' FROM orders WHERE {_READ} AND o_orderkey % 5 IN (2, 3)
""")
def block_file_failures(spark, sf):
    """What cannot be read of block files; one bad file leaves the others alone."""
    files = block_files(spark, sf)
    return bundles.unread_files(files).unionByName(bundles.broken_pages(bundles.block_pages(files)))


@query("block_file_blocks", f"""
SELECT o_orderkey AS doc_id, 0 AS page_idx, 0::BIGINT AS raw_pos, o_orderkey::BIGINT AS n FROM orders WHERE {_READ}
UNION ALL SELECT o_orderkey, 1, unnest([0, 1])::BIGINT, o_orderkey FROM orders WHERE {_READ} AND o_orderkey % 5 NOT IN (2, 3)
""")
def block_file_blocks(spark, sf):
    blocks = bundles.raw_blocks(bundles.block_pages(block_files(spark, sf)))
    return blocks.select("doc_id", "page_idx", "raw_pos", F.get_json_object("block", "$.n").cast("long").alias("n"))


@query("page_deviations", f"""
SELECT o_orderkey AS doc_id, 1 AS page_idx, 'error' AS severity, 'blocks[p1]' AS location,
  'page is no list: ' || CASE o_orderkey % 5 WHEN 2 THEN 'dict' ELSE 'str' END AS issue FROM orders WHERE {_READ} AND o_orderkey % 5 IN (2, 3)
""")
def page_deviations(spark, sf):
    found = quality.audit_pages(bundles.block_pages(block_files(spark, sf)))
    return found.select("doc_id", "page_idx", "severity", "location", "issue")


@query("bundle_roots", "SELECT o_custkey::VARCHAR AS doc_id, count(*) AS n_files FROM orders GROUP BY 1")
def bundle_roots(spark, sf):
    return bundles.bundle_roots(listing(spark, sf))


# ---- model stages -------------------------------------------------------------------------------


@query("enriched_children", f"""
WITH {S.TREE}, e AS (SELECT *, array_to_string(list_filter([text, CASE type WHEN 'image' THEN 'image: images/' || ord || '.jpg' ELSE 'table: ' || text END],
   lambda x: x <> ''), chr(10)) AS made FROM tree WHERE role = 'main' AND type <> 'title')
SELECT doc_id, block_id, type AS chunk_type, CASE type WHEN 'image' THEN '[图片: ' || made || ']' WHEN 'table' THEN '[表格: ' || made || ']' ELSE text END AS retrieval_text FROM e
""")
def enriched_children(spark, sf):
    """Pictures and tables described by the offline provider, their texts written back, then chunked."""
    blocks = C.tree(spark, sf)
    told = chunking.reflow(blocks, providers.describe(blocks))
    return chunking.child_chunks(chunking.grouped(told, 1)).select("doc_id", "block_id", "chunk_type", "retrieval_text")


@query("enrich_status", f"""
WITH {S.TREE} SELECT doc_id, type, 'ok' AS status, count(*) AS n FROM tree WHERE type IN ('image', 'table') GROUP BY 1, 2
""")
def enrich_status(spark, sf):
    found = providers.describe(C.tree(spark, sf))
    return found.groupBy("doc_id", "type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("embedded_chunks", f"""
WITH {S.CHUNKS}, {S.hashed('ctoks', 'chunk_id', 'cv')}
SELECT chunk_id AS child_chunk_id, coalesce(sum(v * v), 0) AS squared, count(*) FILTER (v <> 0) AS slots
FROM ctoks LEFT JOIN cv USING (chunk_id) GROUP BY 1
""")
def embedded_chunks(spark, sf):
    got = providers.embed(C.text_chunks(spark, sf).select("child_chunk_id", "embedding_text"), "embedding_text")
    return got.select("child_chunk_id", *_vector_shape())


def _vector_shape() -> list:
    v = F.col("embedding")
    return [
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("squared"),
        F.size(F.filter(v, lambda x: x != 0)).cast("long").alias("slots"),
    ]


_RUNS = "str_split(translate(substr(s_name, 10) || '-' || s_suppkey % 10 || '-' || s_suppkey * 7919, '0123456789-', '甲乙丙丁戊己庚辛壬癸 '), ' ')"
_IDEOGRAPHS = f"""
ir AS (SELECT s_suppkey, {_RUNS} AS runs FROM supplier),
it AS (SELECT s_suppkey, list_concat(['phone'], flatten(list_transform(runs, lambda r: CASE WHEN length(r) < 2 THEN [r]
  ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))) AS toks FROM ir)
"""


def ideographs(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of ideographs: numbers of a supplier, digit by digit."""
    digits = F.concat_ws("-", F.substring("s_name", 10, 99), (F.col("s_suppkey") % 10).cast("string"), (F.col("s_suppkey") * 7919).cast("string"))
    body = F.translate(digits, "0123456789-", "甲乙丙丁戊己庚辛壬癸 ")
    return table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Phone "), body).alias("body"))


@query("ideograph_tokens", f"WITH {_IDEOGRAPHS} SELECT s_suppkey, array_to_string(toks, ' ') AS tokens FROM it")
def ideograph_tokens(spark, sf):
    """Runs of ideographs as pairs of neighbours, beside words."""
    return ideographs(spark, sf).select("s_suppkey", F.array_join(text.tokens(F.col("body")), " ").alias("tokens"))


@query("ideograph_vectors", f"""
WITH {_IDEOGRAPHS}, {S.hashed('it', 's_suppkey', 'iv')}
SELECT s_suppkey, sum(v * v) AS squared, count(*) FILTER (v <> 0) AS slots FROM iv GROUP BY 1
""")
def ideograph_vectors(spark, sf):
    """Vectors of ideograph texts share slots where they share pairs."""
    return providers.embed(ideographs(spark, sf), "body").select("s_suppkey", *_vector_shape())


@query("html_text", rf"""
SELECT page_id, {S.strip("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS plain, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages
""")
def html_text(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.strip_html(F.col("html")).alias("plain"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title")
    )
