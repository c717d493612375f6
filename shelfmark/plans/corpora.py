"""Inputs that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import chunking, hierarchy
from shelfmark.operators.scan import number_rows
from shelfmark.session import cut, spread, table

# An opening tag of a text element and what follows it up to the next other tag.
ELEMENT = r"<(title|h[1-6]|p|li|dt|dd|div|td|th|caption|figcaption|blockquote|pre|header|footer)(?: [^>]*)?>((?:[^<]+|</?(?:b|a|br)(?: [^>]*)?>)*)"
#: Elements that often only hold others: without text of their own they are no block.
HOLDERS = ("dt", "dd", "div", "td", "th", "caption", "figcaption", "blockquote", "pre", "header")
PER_PAGE = 20


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Child chunks of the text documents."""
    return chunking.text_children(chunking.plain_sections(documents(spark, sf)))


def text_parents(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.text_parents(chunking.plain_sections(documents(spark, sf)))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark passages as queries, each against one source as its knowledge base."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), "text",
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("kb_id"),
    )


def registered(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a knowledge base (their source) and a status taken from their labels."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("kb_id"), "lang", "n_chars")
    labels = table(spark, sf, "labels")
    status = (
        F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "needs_review").otherwise("indexed")
    )
    return docs.join(labels, "doc_id", "left").select("doc_id", "kb_id", "lang", "n_chars", status.alias("status"))


# ---- a heading tree out of the star tables ----------------------------------------------------


def tree_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Unnumbered blocks: one document per region, headings for nation, segment and customer.

    ``page_idx, seg, cust, item`` give the reading order.
    """
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("doc_id"))
    nation = table(spark, sf, "nation").join(region, "n_regionkey").select(
        "doc_id", F.col("n_nationkey").alias("page_idx"), "n_name"
    )
    customer = table(spark, sf, "customer").join(
        nation.select("doc_id", F.col("page_idx").alias("c_nationkey")), "c_nationkey"
    )
    orders = table(spark, sf, "orders").join(
        customer.select("doc_id", "c_nationkey", "c_mktsegment", F.col("c_custkey").alias("o_custkey")), "o_custkey"
    )
    none = F.lit(-1).cast("long")

    def block(rows, seg, cust, item, kind, level, body, role="main"):
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return rows.select(
            "doc_id", F.col("page_idx").cast("int"), as_col(seg).alias("seg"), as_col(cust).cast("long").alias("cust"),
            as_col(item).cast("long").alias("item"), as_col(kind).alias("type"), F.lit(role).alias("role"),
            as_col(level).cast("int").alias("title_level"), as_col(body).alias("text"),
        )

    cust_page = customer.withColumnRenamed("c_nationkey", "page_idx")
    order_page = orders.withColumnRenamed("c_nationkey", "page_idx")
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(first == "2", "list").when(first == "3", "table").when(first == "4", "image").otherwise("paragraph")
    parts = [
        block(nation, "", -2, none, "page_header", None, F.concat(F.lit("Atlas of "), "doc_id"), "auxiliary"),
        block(nation, "", -1, none, "title", 1, F.col("n_name")),
        block(cust_page.select("doc_id", "page_idx", "c_mktsegment").distinct(), F.col("c_mktsegment"), -1, none,
              "title", 2, F.col("c_mktsegment")),
        block(cust_page, F.col("c_mktsegment"), F.col("c_custkey"), none, "title", 3 + F.col("c_custkey") % 2,
              F.col("c_name")),
        block(order_page, F.col("c_mktsegment"), F.col("o_custkey"), F.col("o_orderkey"), kind, None,
              F.concat(F.lit("Order "), "o_orderkey", F.lit(" is "), "o_orderstatus", F.lit("."))),
        block(nation, "~", 0, none, "page_number", None, F.concat(F.lit("Page "), "page_idx"), "auxiliary"),
        block(nation, "~", 1, none, "page_footnote", None, F.concat(F.lit("Note on "), "n_name"), "auxiliary"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tree_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered blocks of the tree with the columns of stored blocks."""
    rows = tree_rows(spark, sf)
    near = F.floor(F.col("cust") / 4096)
    far = F.floor(F.col("item") / 65536)
    order = [F.col("page_idx"), F.col("seg"), F.col("cust"), F.col("item")]
    ranges = [[F.col("page_idx"), F.col("seg"), near], [F.col("cust"), far]]
    out = number_rows(rows, ["doc_id"], order, ranges, "order_in_doc")
    spot = F.col("order_in_doc").cast("double")
    return out.select(
        "doc_id", "page_idx", "order_in_doc",
        F.format_string("p%04d-b%d", F.col("page_idx"), F.col("order_in_doc")).alias("block_id"),
        "type", "role", "text",
        F.array((spot % 500), (spot % 700), spot % 500 + 40, spot % 700 + 20).alias("bbox_norm1000"),
        F.lit(None).cast("array<double>").alias("bbox_page"),
        F.when(
            F.col("type") == "image",
            F.array(
                F.struct(
                    F.concat(F.lit("asset-"), F.col("order_in_doc")).alias("asset_id"),
                    F.lit("image").alias("asset_type"),
                    F.concat(F.lit("images/"), F.col("order_in_doc"), F.lit(".jpg")).alias("path"),
                )
            ),
        ).otherwise(F.array().cast("array<struct<asset_id string, asset_type string, path string>>")).alias("assets"),
        F.struct(
            F.col("title_level"),
            F.lit(None).cast("string").alias("code_language"),
            F.lit(None).cast("string").alias("table_html"),
            F.lit(None).cast("string").alias("math_content"),
            F.lit(None).cast("string").alias("retrieval_text_override"),
        ).alias("metadata"),
    )


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """The stored blocks with their sections: written once, then read by what follows."""
    return cut(hierarchy.with_sections(tree_blocks(spark, sf)))


# ---- raw blocks out of web pages ----------------------------------------------------------------


def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, page_idx, raw_pos, tag, body) of the text elements of each page."""
    found = spread(table(spark, sf, "pages"), "page_id").select(
        F.col("page_id").alias("doc_id"),
        F.posexplode_outer(F.regexp_extract_all("html", F.lit(ELEMENT), F.lit(0))).alias("pos", "el"),
    ).where(F.col("el").isNotNull())
    return found.select(
        "doc_id", F.floor(F.col("pos") / PER_PAGE).cast("int").alias("page_idx"),
        (F.col("pos") % PER_PAGE).cast("long").alias("raw_pos"),
        F.regexp_extract("el", "^<([a-z0-9]+)", 1).alias("tag"), text.strip_html(F.col("el")).alias("body"),
    ).where(~F.col("tag").isin(*HOLDERS) | (F.col("body") != ""))


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Raw blocks as a layout parser would write them."""
    el = page_elements(spark, sf)
    seg = F.array(F.struct(F.lit("text").alias("type"), F.col("body").alias("content")))
    item = F.array(
        F.struct(F.lit("text").alias("item_type"), seg.alias("item_content"), F.lit(1).alias("ilevel"), F.lit("-").alias("prefix"))
    )
    heading = F.col("tag").rlike("^(title|h[1-6])$")
    level = F.coalesce(F.regexp_extract("tag", "^h([1-6])$", 1).try_cast("int"), F.lit(1))
    kinds = [
        (heading, "title", F.struct(level.alias("level"), seg.alias("title_content"))),
        (F.col("tag").isin("li", "dt", "dd"), "list", F.struct(F.lit("unordered").alias("list_type"), item.alias("list_items"))),
        (F.col("tag") == "header", "page_header", F.struct(seg.alias("page_header_content"))),
        (F.col("tag") == "footer", "page_footer", F.struct(seg.alias("page_footer_content"))),
        (F.lit(True), "paragraph", F.struct(seg.alias("paragraph_content"))),
    ]
    y = F.col("raw_pos") * 40
    made = [
        F.when(
            met,
            F.to_json(F.struct(F.lit(kind).alias("type"), F.array(F.lit(50), y, F.lit(950), y + 30).alias("bbox"), content.alias("content"))),
        )
        for met, kind, content in kinds
    ]
    block = F.coalesce(*made)
    return el.select("doc_id", "page_idx", "raw_pos", block.alias("block"))


# ---- raw blocks with deviations out of line items ------------------------------------------------


def odd_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A raw block per line item whose type follows its line number and whose faults follow its flags."""
    li = spread(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    flag, n, q = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    seg = F.array(F.struct(F.when(flag == "R", "footmark").otherwise("text").alias("type"), F.lit("line").alias("content")))
    content = {
        1: ("title", F.struct((q % 5).alias("level"), seg.alias("title_content"))),
        2: ("paragraph", F.struct(F.when(flag != "N", seg).alias("paragraph_content"), F.when(flag == "A", 1).alias("colour"))),
        3: ("list", F.struct(
            F.when(flag == "N", "bullets").otherwise("ordered").alias("attribute"),
            F.array(F.struct(seg.alias("item_content"), (q % 13 - 1).alias("ilevel"))).alias("list_items"))),
        4: ("table", F.struct(
            F.when(flag != "N", "<table></table>").alias("html"), F.when(flag == "A", "pivot").otherwise("simple").alias("table_type"))),
        5: ("image", F.struct(F.struct(
            F.when(flag == "R", "pics/a.jpg").when(flag == "A", "images/a.jpg").alias("path")).alias("image_source"))),
        6: ("equation_interline", F.struct(
            F.lit("x").alias("math_content"), F.when(flag == "A", "tex").otherwise("latex").alias("math_type"))),
        7: ("mystery", F.struct(F.lit("?").alias("hint"))),
    }
    x = F.round(F.col("l_extendedprice") / 90, 0).cast("int")
    box = F.when(q == 1, "null").when(
        F.col("l_linestatus") == "F", F.to_json(F.array(F.lit(0), F.lit(0), x, F.lit(10)))
    ).otherwise(F.to_json(F.array(F.lit(0), F.lit(0), F.lit(10))))
    block = F.lit(None).cast("string")
    for number, (kind, body) in content.items():
        made = F.concat(F.lit(f'{{"type":"{kind}","bbox":'), box, F.lit(',"content":'), F.to_json(body), F.lit("}"))
        block = F.when(n == number, made).otherwise(block)
    return li.select(
        F.col("l_orderkey").alias("doc_id"), n.alias("page_idx"), F.col("l_partkey").alias("raw_pos"), block.alias("block")
    )
