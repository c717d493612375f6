"""SQL fragments shared by the counterparts of the queries."""

from __future__ import annotations

# Fixed values, stated here by themselves: white space of the text rules, and its trimming.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIM = f"^{SPACE}+|{SPACE}+$"
_NOT_SPACE = "[^" + SPACE[1:]


def strip(c: str) -> str:
    return f"regexp_replace({c}, '{_TRIM}', '', 'g')"


def sentences(c: str) -> str:
    marked = f"regexp_replace({c}, '([。！？!?.…]){SPACE}*', '\\1' || chr(1), 'g')"
    return f"list_filter(str_split({marked}, chr(1)), lambda s: regexp_matches(s, '{_NOT_SPACE}'))"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"


def digits(c: str, n: int) -> str:
    return f"floor({c} * {float(10**n)}::DOUBLE + 0.5) / {float(10**n)}::DOUBLE"


def distinct(c: str) -> str:
    """Distinct items in order of first appearance."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


FOLD = """list_reduce(
  list_transform({segs}, lambda x: {{'o': []::VARCHAR[], 'c': x}}),
  lambda a, t: CASE
    WHEN length(t.c) > 500 THEN {{
      'o': list_concat(list_concat(a.o, CASE WHEN a.c <> '' THEN [a.c] ELSE []::VARCHAR[] END),
                       list_transform(range(0, (length(t.c) - 1) // 500 + 1), lambda i: substr(t.c, i * 500 + 1, 500))),
      'c': ''}}
    WHEN length(a.c) + length(t.c) <= 500 THEN {{'o': a.o, 'c': a.c || t.c}}
    ELSE {{'o': list_append(a.o, a.c), 'c': right(a.c, 75) || t.c}} END,
  {{'o': []::VARCHAR[], 'c': ''}})"""

CLOSE = """CASE WHEN st.c = '' THEN st.o
  WHEN len(st.o) > 0 AND length(st.c) < 300 THEN list_append(st.o[1:len(st.o) - 1], st.o[len(st.o)] || st.c)
  ELSE list_append(st.o, st.c) END"""

CHUNKS = f"""
tsecs AS (SELECT * FROM (SELECT doc_id, lang, source, {strip('text')} AS body FROM documents) WHERE body <> ''),
tsegs AS (SELECT *, flatten(list_transform(
    list_filter(list_transform(str_split(regexp_replace(body, '\\n{SPACE}*\\n', chr(2), 'g'), chr(2)),
                lambda p: {strip('p')}), lambda p: p <> ''),
    lambda p: {sentences('p')})) AS segs FROM tsecs),
tfold AS (SELECT doc_id, lang, source, body,
    CASE WHEN length(body) <= 500 THEN {{'o': [body], 'c': ''}} ELSE {FOLD.format(segs='segs')} END AS st FROM tsegs),
twin AS (SELECT doc_id, lang, source, {CLOSE} AS w FROM tfold),
chunks AS (SELECT 'cc-' || doc_id || '--1-' || no AS chunk_id, 'pc-' || doc_id || '--1' AS parent_chunk_id, doc_id, lang,
    source AS kb_id, no, total, body AS text
  FROM (SELECT doc_id, lang, source, len(w) AS total, unnest(w) AS body, unnest(range(len(w))) AS no FROM twin)),
ctoks AS (SELECT *, {tokens('text')} AS toks FROM chunks)
"""

QUERY = """
q AS (SELECT item_id AS query_id, text, 'src' || (item_id % 20) AS kb_id FROM benchmark)
"""


def keyword(mode: str, corpus: str = "ctoks", queries: str = "q", out: str = "kw", limit: int = 20, cap: int = 24,
            where: str = "true", per_query: str = "text") -> str:
    """CTEs that end in ``out(query_id, chunk_id, score, rank)``."""
    p = out
    want = f"WHERE hit = n_terms AND {where}" if mode == "and" else f"WHERE {where}"
    return f"""
{p}_qd AS (SELECT query_id, {tokens(per_query)} AS t FROM {queries}),
{p}_qt AS (SELECT query_id, (list_distinct_ordered)[1:{cap}] AS ts FROM (SELECT query_id, {distinct('t')} AS list_distinct_ordered FROM {p}_qd)),
{p}_q AS (SELECT query_id, len(ts) AS n_terms, unnest(ts) AS term FROM {p}_qt),
{p}_post AS (SELECT chunk_id, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM
    (SELECT chunk_id, len(toks) AS doc_len, unnest(toks) AS term FROM {corpus}) GROUP BY chunk_id, term),
{p}_tot AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avg_len FROM {corpus}),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_post GROUP BY term),
{p}_w AS (SELECT query_id, chunk_id, n_terms,
    CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
      * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS w
    FROM {p}_q JOIN {p}_post USING (term) JOIN {p}_df USING (term), {p}_tot),
{p}_s AS (SELECT query_id, chunk_id, round(sum(w), 6) AS score, count(*) AS hit, any_value(n_terms) AS n_terms
    FROM {p}_w GROUP BY query_id, chunk_id),
{p}_k AS (SELECT query_id, chunk_id, score FROM {p}_s {want}),
{p} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank
    FROM {p}_k) WHERE rank < {limit})
"""


def hashed(rows: str, key: str, out: str) -> str:
    """Sparse hashed term counts (key, slot, v) of ``rows(key, toks)``."""
    return f"""
{out}_t AS (SELECT {key}, md5(term) AS h, count(*) AS tf FROM (SELECT {key}, unnest(toks) AS term FROM {rows}) GROUP BY {key}, term),
{out} AS (SELECT {key}, ('0x' || substr(h, 1, 4))::INTEGER % 256 AS slot,
    sum(CASE WHEN ('0x' || substr(h, 5, 1))::INTEGER % 2 = 0 THEN tf ELSE -tf END)::DOUBLE AS v FROM {out}_t GROUP BY 1, 2)
"""


def vector(out: str = "vec", limit: int = 20, corpus: str = "ctoks", queries: str = "q", where: str = "true") -> str:
    """CTEs that end in ``out(query_id, chunk_id, score, rank)`` by hashed cosine."""
    p = out
    return f"""
{p}_qtoks AS (SELECT query_id, {tokens('text')} AS toks FROM {queries}),
{hashed(f'{p}_qtoks', 'query_id', f'{p}_qv')},
{hashed(corpus, 'chunk_id', f'{p}_cv')},
{p}_qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM {p}_qv GROUP BY 1),
{p}_cn AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM {p}_cv GROUP BY 1),
{p}_dot AS (SELECT query_id, chunk_id, sum(a.v * b.v) AS d FROM {p}_qv a JOIN {p}_cv b USING (slot) GROUP BY 1, 2),
{p}_s AS (SELECT qq.query_id, cc.chunk_id, cc.kb_id, cc.doc_id,
      round(coalesce(d / nullif(qn.n * cn.n, 0), 0), 6) AS score
    FROM {queries} qq CROSS JOIN {corpus} cc
    LEFT JOIN {p}_dot dd ON dd.query_id = qq.query_id AND dd.chunk_id = cc.chunk_id
    LEFT JOIN {p}_qn qn ON qn.query_id = qq.query_id LEFT JOIN {p}_cn cn ON cn.chunk_id = cc.chunk_id
    WHERE {where}),
{p} AS (SELECT query_id, chunk_id, score + 0.0 AS score, rank FROM (SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM {p}_s) WHERE rank < {limit})
"""


def fused(vec: str = "vec", kw: str = "kw", out: str = "fus", limit: int = 15) -> str:
    return f"""
{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, vec_rank NULLS LAST, kw_rank NULLS LAST) - 1 AS rank FROM (
    SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id,
      v.rank AS vec_rank, v.score AS vec_score, k.rank AS kw_rank, k.score AS kw_score,
      coalesce(1.0::DOUBLE / (v.rank + 61), 0) + coalesce(1.0::DOUBLE / (k.rank + 61), 0) AS score
    FROM {vec} v FULL OUTER JOIN {kw} k ON v.query_id = k.query_id AND v.chunk_id = k.chunk_id)) WHERE rank < {limit})
"""


def coverage(fus: str = "fus", out: str = "rr", top_n: int = 5, queries: str = "q", corpus: str = "ctoks") -> str:
    return f"""
{out}_s AS (SELECT f.query_id, f.chunk_id, f.rank AS prev_rank,
    round(len(list_filter(list_distinct({tokens('qq.text')}), lambda t: list_contains(c.toks, t)))::DOUBLE
      / len(list_distinct({tokens('qq.text')})), 6) AS score
  FROM {fus} f JOIN {queries} qq USING (query_id) JOIN {corpus} c USING (chunk_id)),
{out} AS (SELECT *, prev_rank - rank AS delta FROM (SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prev_rank) - 1 AS rank FROM {out}_s) WHERE rank < {top_n})
"""


GOLD = f"""
gdocs AS (SELECT doc_id, ' ' || array_to_string({tokens('text')}, ' ') || ' ' AS flat FROM documents),
gold AS (SELECT query_id, doc_id FROM q JOIN gdocs
    ON contains(flat, ' ' || array_to_string({tokens('q.text')}, ' ') || ' ')),
gold_n AS (SELECT query_id, greatest(count(doc_id), 1) AS n_relevant FROM q LEFT JOIN gold USING (query_id) GROUP BY 1)
"""

KS = (1, 3, 5, 10)


def flags(hits: str, out: str, config: str | None = None) -> str:
    """``out``: hits with rel, each relevant document counted at its first hit."""
    extra = "config, " if config else ""
    return f"""
{out} AS (SELECT *, CASE WHEN gdoc IS NOT NULL AND row_number() OVER (PARTITION BY {extra}query_id, gdoc ORDER BY rank) = 1
    THEN 1 ELSE 0 END AS rel
  FROM (SELECT h.*, g.doc_id AS gdoc FROM {hits} h LEFT JOIN gold g ON g.query_id = h.query_id AND g.doc_id = h.doc_id))
"""


def metrics(flagged: str, config: bool = False) -> str:
    """Select list of the metrics of one query group; needs n_relevant."""
    cols = ["coalesce(max(CASE WHEN rel = 1 THEN 1.0::DOUBLE / (rank + 1) END), 0) AS mrr"]
    for k in KS:
        n = f"coalesce(sum(CASE WHEN rank < {k} THEN rel END), 0)"
        ideal = f"list_sum(list_transform(range(0, least(any_value(n_relevant), {k})), lambda i: 1.0::DOUBLE / log2(i + 2)))"
        cols += [
            f"CASE WHEN {n} > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_{k}",
            f"least({n}, any_value(n_relevant))::DOUBLE / any_value(n_relevant) AS recall_{k}",
            f"coalesce(sum(CASE WHEN rank < {k} THEN rel / log2(rank + 2) END), 0) / {ideal} AS ndcg_{k}",
        ]
    return ", ".join(cols)


def averages(divisor: str = "count(*)", total: str = "sum({c})") -> str:
    names = ["mrr"] + [f"{m}_{k}" for k in KS for m in ("hit", "recall", "ndcg")]
    return ", ".join(f"round({total.format(c=c)} / {divisor}, 6) AS {c}" for c in names)


TREE = """
tr AS (
  SELECT r_name AS doc_id, n_nationkey AS page_idx, '' AS seg, -2 AS cust, -1 AS item, 'page_header' AS type, 'auxiliary' AS role,
         NULL::INT AS level, 'Atlas of ' || r_name AS text FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT r_name, n_nationkey, '', -1, -1, 'title', 'main', 1, n_name FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT DISTINCT r_name, n_nationkey, c_mktsegment, -1, -1, 'title', 'main', 2, c_mktsegment
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT r_name, n_nationkey, c_mktsegment, c_custkey, -1, 'title', 'main', (3 + c_custkey % 2)::INT, c_name
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT r_name, n_nationkey, c_mktsegment, c_custkey, o_orderkey,
      CASE o_orderpriority[1] WHEN '2' THEN 'list' WHEN '3' THEN 'table' WHEN '4' THEN 'image' ELSE 'paragraph' END, 'main', NULL,
      'Order ' || o_orderkey || ' is ' || o_orderstatus || '.'
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT r_name, n_nationkey, '~', 0, -1, 'page_number', 'auxiliary', NULL, 'Page ' || n_nationkey
    FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT r_name, n_nationkey, '~', 1, -1, 'page_footnote', 'auxiliary', NULL, 'Note on ' || n_name
    FROM nation JOIN region ON r_regionkey = n_regionkey),
tb0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, seg, cust, item) - 1 AS ord FROM tr),
tb AS (SELECT *, printf('p%04d-b%d', page_idx, ord) AS block_id FROM tb0),
ts AS (SELECT *,
    max(CASE WHEN type = 'title' AND level = 1 THEN ord END) OVER w AS s1,
    max(CASE WHEN type = 'title' AND level = 2 THEN ord END) OVER w AS s2,
    max(CASE WHEN type = 'title' AND level = 3 THEN ord END) OVER w AS s3,
    max(CASE WHEN type = 'title' AND level = 4 THEN ord END) OVER w AS s4
  FROM tb WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
tl AS (SELECT * EXCLUDE (s1, s2, s3, s4), s1 AS l1,
    CASE WHEN s2 > coalesce(s1, -1) THEN s2 END AS l2,
    CASE WHEN s3 > greatest(coalesce(s1, -1), coalesce(s2, -1)) THEN s3 END AS l3,
    CASE WHEN s4 > greatest(coalesce(s1, -1), coalesce(s2, -1), coalesce(s3, -1)) THEN s4 END AS l4 FROM ts),
tp AS (SELECT b.*, list_filter([b.l1, b.l2, b.l3, b.l4], lambda x: x IS NOT NULL) AS path_ords,
    list_filter([t1.text, t2.text, t3.text, t4.text], lambda x: x IS NOT NULL) AS header_path
  FROM tl b LEFT JOIN tb t1 ON t1.doc_id = b.doc_id AND t1.ord = b.l1 LEFT JOIN tb t2 ON t2.doc_id = b.doc_id AND t2.ord = b.l2
  LEFT JOIN tb t3 ON t3.doc_id = b.doc_id AND t3.ord = b.l3 LEFT JOIN tb t4 ON t4.doc_id = b.doc_id AND t4.ord = b.l4),
tree AS (SELECT *, CASE WHEN len(path_ords) = 0 THEN 'sec-root-' || doc_id ELSE 'sec-' || doc_id || '-' || path_ords[len(path_ords)] END AS section_id
  FROM tp)
"""


def groups(level: int) -> str:
    """Members and parents of the tree at a heading level."""
    live = ", ".join(f"l{i}" for i in range(1, min(level, 4) + 1))
    root = f"coalesce(greatest({live}), -1)" if level > 1 else "coalesce(l1, -1)"
    return f"""
gm AS (SELECT *, {root} AS root_ord FROM tree WHERE role = 'main'),
gh AS (SELECT doc_id, root_ord, bool_or(type <> 'title') AS is_full, min(page_idx) AS page_start, max(page_idx) AS page_end,
    count(*) AS block_count, count(*) FILTER (type = 'image') AS asset_count FROM gm GROUP BY 1, 2),
gt AS (SELECT *, min(CASE WHEN is_full THEN root_ord END) OVER (PARTITION BY doc_id ORDER BY root_ord
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS target FROM gh),
gp AS (SELECT m.doc_id, t.target AS root_ord, m.ord,
    CASE WHEN NOT t.is_full THEN CASE WHEN m.type = 'title' THEN trim(m.text) END
      WHEN m.type = 'image' THEN '[图片: ' || trim(m.text) || ']' WHEN m.type = 'table' THEN '[表格: ' || trim(m.text) || ']'
      ELSE m.text END AS piece
  FROM gm m JOIN gt t USING (doc_id, root_ord) WHERE t.target IS NOT NULL),
gx AS (SELECT doc_id, root_ord, string_agg(piece, chr(10) || chr(10) ORDER BY ord) AS text_full FROM gp WHERE piece <> '' GROUP BY 1, 2),
gparents AS (SELECT 'pc-' || h.doc_id || '-' || h.root_ord AS parent_chunk_id, h.doc_id, h.root_ord,
    CASE WHEN h.root_ord = -1 THEN 'sec-root-' || h.doc_id ELSE 'sec-' || h.doc_id || '-' || h.root_ord END AS section_id,
    coalesce(b.text, '') AS title, coalesce(b.header_path, []) AS header_path, page_start, page_end, block_count, asset_count,
    coalesce(text_full, '') AS text_full
  FROM gh h LEFT JOIN gx USING (doc_id, root_ord) LEFT JOIN tree b ON b.doc_id = h.doc_id AND b.ord = h.root_ord WHERE is_full)
"""


ELEMENTS = rf"""
pel0 AS (SELECT page_id AS doc_id,
    unnest(regexp_extract_all(html, '<(title|h[1-6]|p|li|dt|dd|div|td|th|caption|figcaption|blockquote|pre|header|footer)(?: [^>]*)?>((?:[^<]+|</?(?:b|a|br)(?: [^>]*)?>)*)')) AS el,
    unnest(range(len(regexp_extract_all(html, '<(title|h[1-6]|p|li|dt|dd|div|td|th|caption|figcaption|blockquote|pre|header|footer)(?: [^>]*)?>((?:[^<]+|</?(?:b|a|br)(?: [^>]*)?>)*)')))) AS pos FROM pages),
pel AS (SELECT doc_id, (pos // 20)::INT AS page_idx, pos % 20 AS raw_pos, pos, regexp_extract(el, '^<([a-z0-9]+)', 1) AS tag,
    {strip("regexp_replace(el, '<[^>]+>', ' ', 'g')")} AS body FROM pel0
    WHERE regexp_extract(el, '^<([a-z0-9]+)', 1) NOT IN ('dt', 'dd', 'div', 'td', 'th', 'caption', 'figcaption', 'blockquote', 'pre', 'header') OR body <> ''),
pb AS (SELECT *, CASE WHEN tag IN ('title', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN 'title' WHEN tag IN ('li', 'dt', 'dd') THEN 'list' WHEN tag = 'header' THEN 'page_header'
    WHEN tag = 'footer' THEN 'page_footer' ELSE 'paragraph' END AS type,
    CASE WHEN tag IN ('header', 'footer') THEN 'auxiliary' ELSE 'main' END AS role,
    CASE WHEN tag IN ('li', 'dt', 'dd') THEN CASE WHEN body <> '' THEN '  - ' || body ELSE '' END ELSE body END AS text,
    printf('p%04d-b%04d-', page_idx, raw_pos) || substr(sha256(doc_id || ':' || page_idx || ':' || raw_pos), 1, 6) AS block_id FROM pel)
"""
