"""Queries over the engine's operators, each with SQL that finds the same from the relational rows, without parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import text as X
from lathe.operators import chunks as C
from lathe.operators import document_edges as DE
from lathe.operators import edges as E
from lathe.operators import split as S
from lathe.operators import tables as TB
from lathe.operators.lines import doc_lines
from lathe.plans import rendered as R
from lathe.plans.rules import schema
from lathe.sources import store
from lathe.sources.scratch import staged

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


I = "WITH " + R.ITEMS_SQL  # noqa: E741
J = lambda c: F.array_join(c, "|")


# --- splitting ---------------------------------------------------------------------------------------------------


@query("split_tables_parts", I + f""",
p AS (SELECT *, CASE WHEN n < 5 THEN 1 ELSE (n + 4) // 5 END AS parts FROM r), q AS (SELECT *, least((tt - 1) // (n // parts), parts - 1) AS part FROM p)
SELECT 'doc_' || k AS document_id, 'Bảng ' || k AS ten_bang, (part + 1) || '/' || parts AS phan_so, count(*)::INT AS so_hang_du_lieu,
  '{R.HEADER.replace("'", "''")}' || chr(10) || '{S.SEPARATOR}' || chr(10) || string_agg(line, chr(10) ORDER BY tt) AS noi_dung_bang FROM q GROUP BY k, part, parts""")
def split_tables_parts(spark, sf_dir):
    return S.split_tables(R.rendered_orders(spark, sf_dir)).select("document_id", "ten_bang", "phan_so", "so_hang_du_lieu", "noi_dung_bang")


@query("split_hierarchy", I + " SELECT 'doc_' || k AS document_id, 'Bảng ' || k AS ten_bang, 'I. Trạng thái ' || status AS muc_chinh, '1. Ưu tiên ' || priority AS muc_cap_1, NULL::VARCHAR AS muc_cap_2 FROM o")
def split_hierarchy(spark, sf_dir):
    return S.headed_tables(R.rendered_orders(spark, sf_dir)).select("document_id", "ten_bang", "tieu_de_muc.muc_chinh", "tieu_de_muc.muc_cap_1", "tieu_de_muc.muc_cap_2")


@query("split_stolen_table", I + """,
t AS (SELECT o_custkey, k, k % 3 <> 0 AS has, coalesce(sum((k % 3 <> 0)::INT) OVER (PARTITION BY o_custkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM o),
h AS (SELECT o_custkey, g, min(k) AS first_k, max(CASE WHEN has THEN k END) AS table_k FROM t GROUP BY 1, 2)
SELECT 'doc_c' || o_custkey AS document_id, 'Bảng ' || first_k AS ten_bang, (SELECT count(*) FROM i WHERE i.k = table_k) AS n_rows FROM h WHERE table_k IS NOT NULL""")
def split_stolen_table(spark, sf_dir):
    return S.headed_tables(R.rendered_customers(spark, sf_dir)).select("document_id", "ten_bang", F.size("rows").cast("long").alias("n_rows"))


# --- tables ------------------------------------------------------------------------------------------------------


@query("table_runs", I + " SELECT 'doc_' || k AS document_id, 0 AS table_idx, 4 AS start_line, (5 + count(*))::INT AS end_line, count(*)::INT AS row_count, 5 AS column_count, 'pricing' AS table_type FROM i GROUP BY k")
def table_runs(spark, sf_dir):
    return TB.parse_tables(R.rendered_orders(spark, sf_dir)).select("document_id", "table_idx", "start_line", "end_line", "row_count", "column_count", "table_type")


@query("table_lines_anti", I + " SELECT 'doc_' || k AS document_id, unnest([0, 1, 2, 3, (6 + count(*))::INT]) AS line_no FROM i GROUP BY k")
def table_lines_anti(spark, sf_dir):
    return TB.table_lines(doc_lines(R.rendered_orders(spark, sf_dir))).where("table is null").select("document_id", "line_no")


@query("table_cells_unpivot", I + " SELECT 'doc_' || k AS document_id, (tt - 1)::INT AS row_no, c.col_no, c.value::DOUBLE AS value FROM i, LATERAL (VALUES (0, tt::BIGINT), (2, q::BIGINT), (3, q::BIGINT + 1), (4, price)) AS c(col_no, value)")
def table_cells_unpivot(spark, sf_dir):
    return TB.numeric_cells(TB.parse_tables(R.rendered_orders(spark, sf_dir))).select("document_id", "row_no", "col_no", "value")


@query("table_headers_classify", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'pricing' WHEN 1 THEN 'schedule' WHEN 2 THEN 'comparison' WHEN 3 THEN 'data' WHEN 4 THEN 'pricing' ELSE 'unknown' END AS table_type FROM part")
def table_headers_classify(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, ("Giá VND", "Thời gian", "So sánh", "Số liệu", "Data Price", "Tên"))), (F.col("p_size") % 6 + 1).cast("int"))
    return R.table(spark, sf_dir, "part").select("p_partkey", TB.table_type(F.array("p_brand", head)).alias("table_type"))


@query("table_container_columns", "SELECT p_partkey, '20'' DC' AS container, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END AS col_idx FROM part UNION ALL SELECT p_partkey, '40''HC', 2 FROM part")
def table_container_columns(spark, sf_dir):
    heads = F.array(F.col("p_brand"), F.lit("Cont 20' DC"), F.lit("40'HC"), F.when(F.col("p_size") % 2 == 0, "20' DC").otherwise("Giá"))
    return R.table(spark, sf_dir, "part").select("p_partkey", F.explode(TB.container_columns(heads)).alias("container", "col_idx"))


@query("table_row_groups", "SELECT 'doc_' || l_orderkey AS document_id, l_returnflag AS key, count(*)::INT AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY ALL")
def table_row_groups(spark, sf_dir):
    cell = F.concat(F.lit(" "), F.col("flag"), F.lit(" "))
    rows = R.items(spark, sf_dir).groupBy(F.concat(F.lit("doc_"), F.col("k").cast("string")).alias("document_id")).agg(F.collect_list(F.array(F.col("tt").cast("string"), cell, F.regexp_extract("item", r"(\d+)", 1))).alias("rows"))
    found = TB.group_rows(rows.withColumn("table_idx", F.lit(0)), 1)
    return found.select("document_id", "key", F.size("rows").alias("n"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + F.get(r, F.lit(2)).cast("long")).alias("parts"))


@query("table_to_dict", "SELECT p_partkey, u.key, u.value FROM part, LATERAL (VALUES ('A', p_brand), ('B', p_size::VARCHAR), ('C', '')) AS u(key, value)")
def table_to_dict(spark, sf_dir):
    heads = F.array(*map(F.lit, ("B", "A", "B", "C")))
    rows = F.array(F.array(F.lit("x"), F.col("p_brand"), F.col("p_size").cast("string")))
    return R.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.get(TB.row_maps(heads, rows), F.lit(0))).alias("key", "value"))


@query("table_caption_id", "SELECT 'doc_' || o_orderkey AS document_id, 'Đơn giá ' || o_orderpriority AS caption, 'Bảng ' || o_orderkey AS table_id, 'sau ' || o_orderstatus AS context_after FROM orders")
def table_caption_id(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    docs = R.table(spark, sf_dir, "orders").select(F.concat(F.lit("doc_"), k).alias("document_id"), F.concat(F.lit("trước\nBảng "), k, F.lit(": Đơn giá "), "o_orderpriority", F.lit("\n| a | b |\n|---|:--:|\n| 1 | 2 |\nsau "), "o_orderstatus").alias("text"))
    return TB.parse_tables(docs).select("document_id", "caption", "table_id", "context_after")


@query("table_find_by_id", "SELECT 'doc_' || o_orderkey AS document_id, 0 AS table_idx FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND contains(o_orderkey::VARCHAR, '7') AND starts_with(o_orderkey::VARCHAR, '7')")
def table_find_by_id(spark, sf_dir):
    return TB.find_table(TB.parse_tables(R.rendered_orders(spark, sf_dir)), "bảng 7").select("document_id", "table_idx")


@query("table_markdown", I + " SELECT 'doc_' || k AS document_id, '" + R.HEADER.replace("'", "''") + "' || chr(10) || '" + R.DASHES + "' || chr(10) || string_agg(line, chr(10) ORDER BY tt) AS md FROM r GROUP BY k")
def table_markdown(spark, sf_dir):
    return TB.parse_tables(R.rendered_orders(spark, sf_dir)).select("document_id", TB.to_markdown().alias("md"))


# --- text --------------------------------------------------------------------------------------------------------


@query("token_counts", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", X.count_tokens("text").alias("n_tokens"))


@query("sentence_split", r"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?;]\s+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS s FROM documents) SELECT doc_id, (unnest(range(1, len(s) + 1)) - 1)::INT AS pos, unnest(s) AS sentence FROM s")
def sentence_split(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "sentence"))


@query("word_stats", r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^#{1,6}\s+')))::INT AS headings,
  len(list_filter(l, lambda x: regexp_matches(x, '^\|.*\|$')))::INT AS table_lines, len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*+]\s+')))::INT AS list_items, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS words FROM l""")
def word_stats(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", X.document_stats("text").alias("s")).select("doc_id", "s.headings", "s.table_lines", "s.list_items", "s.words")


@query("clean_markdown", I + " SELECT 'doc_' || k AS document_id, '### I. ' || status || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || 'y ' || priority || chr(10) || '# H' || chr(10) || chr(10) || 'z' AS md FROM o")
def clean_markdown(spark, sf_dir):
    t = R.order_tables(spark, sf_dir)
    raw = F.concat(F.lit("\n\n### I. "), "status", F.lit("\nx\t \n\n\n\n\ny "), "priority", F.lit(" \n# H\nz  \n"))
    return t.select(F.concat(F.lit("doc_"), F.col("k").cast("string")).alias("document_id"), X.clean_markdown(raw).alias("md"))


@query("clean_documents", "SELECT doc_id, md5(trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, chr(32) || chr(9) || chr(13))), chr(10)), chr(32) || chr(9) || chr(10) || chr(13))) AS h FROM documents")
def clean_documents(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_markdown("text").cast("binary")).alias("h"))


@query("heading_path", "SELECT o_orderkey, o_orderstatus || ' > ' || o_orderpriority || ' > Bảng ' || o_orderkey AS path FROM orders")
def heading_path(spark, sf_dir):
    text = F.concat(F.lit("# X\nchữ\n# "), "o_orderstatus", F.lit("\n## A\n## "), "o_orderpriority", F.lit("\n### Bảng "), F.col("o_orderkey").cast("string"))
    return R.table(spark, sf_dir, "orders").select("o_orderkey", X.heading_path(text).alias("path"))


@query("extract_dates_fmt", "SELECT o_orderkey, o_orderdate::DATE AS effective, day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) || '|ngày ' || day(o_orderdate) || ' tháng ' || month(o_orderdate) || ' năm ' || year(o_orderdate) AS found FROM orders")
def extract_dates_fmt(spark, sf_dir):
    d, m, y = (F.date_format("o_orderdate", f) for f in ("d", "M", "yyyy"))
    text = F.concat(F.lit("Ký ngày "), d, F.lit(" tháng "), m, F.lit(" năm "), y, F.lit(", áp dụng từ "), d, F.lit("/"), m, F.lit("/"), y, F.lit("."))
    return R.table(spark, sf_dir, "orders").select("o_orderkey", X.effective_date(text).alias("effective"), J(F.transform(X.dates(text), lambda s: s["text"])).alias("found"))


@query("extract_amounts", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice)::BIGINT::VARCHAR AS value, CASE WHEN l_returnflag = 'R' THEN 'USD' ELSE 'VND' END AS currency, 'tấn' AS unit, 'nếu' AS cond, CASE WHEN l_returnflag = 'R' THEN 'USD/tấn' ELSE 'VND/tấn' END AS unit_text FROM lineitem")
def extract_amounts(spark, sf_dir):
    text = F.concat(F.lit("Giá "), F.floor("l_extendedprice").cast("string"), F.lit(" "), F.when(F.col("l_returnflag") == "R", "USD").otherwise("VND"), F.lit("/tấn Nếu đủ."))
    li = R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.pricing_info(text).alias("p"), X.unit(text).alias("unit_text"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.get("p.amounts", F.lit(0))["value"].alias("value"), F.get("p.amounts", F.lit(0))["currency"].alias("currency"), F.get("p.units", F.lit(0)).alias("unit"), J(F.col("p.conditions")).alias("cond"), "unit_text")


@query("extract_references", "SELECT p_partkey, 'Bảng ' || p_size || '|Khoản ' || p_size || ' Điều ' || p_partkey || '|Thông tư ' || p_size || '/2024|Điều ' || p_partkey AS refs, p_partkey::VARCHAR AS article FROM part")
def extract_references(spark, sf_dir):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("Theo Khoản "), size, F.lit(" Điều "), k, F.lit(" và Bảng "), size, F.lit(" của Thông tư "), size, F.lit("/2024, Điều "), k)
    return R.table(spark, sf_dir, "part").select("p_partkey", J(X.references(text)).alias("refs"), X.article_number(text).alias("article"))


@query("extract_conditions", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'conditional' WHEN 1 THEN 'exception' ELSE 'prerequisite' END AS type, CASE p_size % 3 WHEN 0 THEN 'Nếu có ' WHEN 1 THEN 'Ngoài trừ ' ELSE 'Với điều kiện ' END || p_brand AS snippet, 3 AS position FROM part")
def extract_conditions(spark, sf_dir):
    lead = F.element_at(F.array(*map(F.lit, ("Nếu có ", "Ngoài trừ ", "Với điều kiện "))), (F.col("p_size") % 3 + 1).cast("int"))
    text = F.concat(F.lit("A. "), lead, "p_brand", F.lit(". Hết"))
    return R.table(spark, sf_dir, "part").select("p_partkey", F.explode(X.conditions(text)).alias("c")).select("p_partkey", "c.type", F.col("c.text").alias("snippet"), "c.position")


@query("normalize_abbrev", "SELECT p_partkey, 'General Purpose ' || p_size || ' Dry Container, GPX' AS t FROM part")
def normalize_abbrev(spark, sf_dir):
    return R.table(spark, sf_dir, "part").select("p_partkey", X.expand_abbreviations(F.concat(F.lit("GP "), F.col("p_size").cast("string"), F.lit(" DC, GPX"))).alias("t"))


@query("ordinals_thresholds", "SELECT p_partkey, 'ngày thứ ' || p_size || '|từ ngày thứ ' || p_size AS timing, 'phụ thu ' || p_size AS surcharges, 'giảm 5%' AS discounts, 'tối đa ' || p_size AS thresholds FROM part")
def ordinals_thresholds(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("Từ ngày thứ "), size, F.lit(". phụ thu "), size, F.lit(". giảm 5%. tối đa "), size, F.lit("."))
    p = R.table(spark, sf_dir, "part").select("p_partkey", X.pricing_conditions(F.replace(text, F.lit("Từ"), F.lit("từ"))).alias("c"))
    return p.select("p_partkey", *(F.regexp_replace(J(F.col(f"c.{n}")), r"\.$", "").alias(n) for n in ("timing", "surcharges", "discounts", "thresholds")))


@query("calculations", "SELECT p_partkey, 'tính theo cỡ ' || p_size || '|%' AS found FROM part")
def calculations(spark, sf_dir):
    text = F.concat(F.lit("Phí tính theo cỡ "), F.col("p_size").cast("string"), F.lit(". Tăng 5%."))
    return R.table(spark, sf_dir, "part").select("p_partkey", J(F.transform(X.calculations(text), lambda s: s["text"])).alias("found"))


@query("container_types", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '20'' DC|40'' HC|45''' ELSE '20''|45'' OT' END AS found FROM part")
def container_types(spark, sf_dir):
    text = F.when(F.col("p_size") % 2 == 0, "20' DC, 40'HC và 45'").otherwise("20', rồi 45'  OT")
    return R.table(spark, sf_dir, "part").select("p_partkey", J(X.container_types(text)).alias("found"))


@query("headings_heuristic", "SELECT p_partkey, p_size % 4 <> 3 AS is_heading FROM part")
def headings_heuristic(spark, sf_dir):
    line = F.element_at(F.array(*map(F.lit, ("## Giá", "Điều 5", "TỔNG CỘNG", "hàng thường"))), (F.col("p_size") % 4 + 1).cast("int"))
    return R.table(spark, sf_dir, "part").select("p_partkey", X.is_heading(line).alias("is_heading"))


@query("schema_metadata", "SELECT o_orderkey, day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) AS effective_date, '20''|40''' AS container_types, 'Lưu bãi' AS service_type, 'container' AS unit, 'container_rỗng' AS applies_to, o_orderkey || '-9' AS page_range FROM orders")
def schema_metadata(spark, sf_dir):
    date = F.date_format("o_orderdate", "d/M/yyyy")
    docs = R.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Lưu bãi và nâng hạ 20' DC, 40'. VND/container, có hiệu lực từ ngày "), date, F.lit(" cho container rỗng, trang "), F.col("o_orderkey").cast("string"), F.lit("-9")).alias("text"))
    m = docs.select("o_orderkey", X.metadata("text", schema("pricing")).alias("m"))
    return m.select("o_orderkey", "m.effective_date", J(F.col("m.container_types")).alias("container_types"), "m.service_type", "m.unit", J(F.col("m.applies_to")).alias("applies_to"), "m.page_range")


# --- chunks ------------------------------------------------------------------------------------------------------

DOC = "'doc_' || replace(p_brand, '#', '')"


@query("sections_level1", f"SELECT {DOC} AS document_id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS section_idx, 'Điều ' || p_partkey AS heading, 'Hàng cỡ ' || p_size || chr(10) || 'Xem Bảng ' || p_size AS content FROM part")
def sections_level1(spark, sf_dir):
    found = C.sections(TB.table_lines(doc_lines(R.rendered_articles(spark, sf_dir))), schema("regulation"))
    return found.select("document_id", F.col("section_idx").cast("int").alias("section_idx"), F.col("heading.text").alias("heading"), F.array_join("content_lines", "\n").alias("content"))


@query("preamble_section", f"SELECT {DOC} AS document_id, 'Section 0' AS title, 'section' AS type, 'Lời mở đầu' AS content FROM part GROUP BY p_brand")
def preamble_section(spark, sf_dir):
    return C.level_one(R.rendered_articles(spark, sf_dir, preamble=True), schema("regulation")).where("chunk_ord = 0").select("document_id", "title", "type", "content")


@query("chunks_level1", f"""WITH a AS (SELECT {DOC} AS document_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n, 'Điều ' || p_partkey AS h FROM part)
SELECT a.document_id, (a.i // 2)::INT AS chunk_ord, a.document_id || '_section_' || a.i || CASE WHEN b.h IS NULL THEN '' ELSE '_merged' END AS chunk_id, a.h || coalesce(' & ' || b.h, '') AS title, CASE WHEN b.h IS NULL THEN 6 ELSE 12 END AS token_count
FROM a LEFT JOIN a b ON b.document_id = a.document_id AND b.i = a.i + 1 WHERE a.i % 2 = 0""")
def chunks_level1(spark, sf_dir):
    return C.level_one(R.rendered_articles(spark, sf_dir), schema("regulation")).select("document_id", F.col("chunk_ord").cast("int").alias("chunk_ord"), "chunk_id", "title", "token_count")


LEAST, MOST, BUDGET = 250, 900, 120


@query("chunk_merge_pairs", rf"""WITH RECURSIVE d AS (SELECT source, doc_id, lang AS type, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
m AS (SELECT d.source, d.i, coalesce(d.tokens < {LEAST} AND d.tokens + n.tokens <= {MOST} AND d.type = n.type, false) AS can FROM d LEFT JOIN d n ON n.source = d.source AND n.i = d.i + 1),
w AS (SELECT source, i, can AS starts, false AS taken FROM m WHERE i = 1 UNION ALL SELECT m.source, m.i, m.can AND NOT w.starts, w.starts FROM w JOIN m ON m.source = w.source AND m.i = w.i + 1)
SELECT doc_id, starts, taken FROM w JOIN d USING (source, i)""")
def chunk_merge_pairs(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("type"), X.count_tokens("text").alias("token_count"))
    return C.merge_small(docs, LEAST, MOST, keys=("source",), order="doc_id").select("doc_id", "starts", "taken")


@query("chunk_split_budget", rf"""WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
q AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM p), t AS (SELECT doc_id, i, len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')) AS t FROM q),
big AS (SELECT doc_id FROM t GROUP BY 1 HAVING sum(t) > {BUDGET}),
w AS (SELECT doc_id, i, 0 AS g, t AS total FROM t WHERE i = 1 AND doc_id IN (SELECT doc_id FROM big) UNION ALL
  SELECT t.doc_id, t.i, CASE WHEN w.total + t.t > {BUDGET} THEN w.g + 1 ELSE w.g END, CASE WHEN w.total + t.t > {BUDGET} THEN t.t ELSE w.total + t.t END FROM w JOIN t ON t.doc_id = w.doc_id AND t.i = w.i + 1)
SELECT doc_id, g::INT AS piece_no, max(total)::BIGINT AS piece_tokens, count(*)::INT AS n_lines FROM w GROUP BY doc_id, g""")
def chunk_split_budget(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), X.count_tokens("text").alias("token_count"))
    cut = C.split_large(docs, BUDGET, separator="\n").where("piece is not null")
    return cut.select("doc_id", F.col("piece.no").alias("piece_no"), F.col("piece.tokens").alias("piece_tokens"), F.size(F.split("piece.text", "\n", -1)).alias("n_lines"))


@query("clauses_level2", """SELECT 'doc_' || p_partkey || '_section_0_sub_clause_' || n AS chunk_id, 'clause' AS type, 'Khoản ' || n AS title, CASE n WHEN '1' THEN '1. Mức ' || p_size ELSE '2. Xem Bảng ' || p_size || chr(10) || 'Ngoài trừ hàng ' || p_partkey END AS content FROM part, (VALUES ('1'), ('2')) AS v(n)
UNION ALL SELECT 'doc_' || p_partkey || '_section_0_sub_cond_0', 'condition', 'Condition: exception', 'Ngoài trừ hàng ' || p_partkey FROM part""")
def clauses_level2(spark, sf_dir):
    s = schema("regulation")
    return C.level_two(C.level_one(R.rendered_clauses(spark, sf_dir), s), s).select("chunk_id", "type", "title", "content")


@query("definitions_level2", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?;]\s+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '' AND regexp_matches(x, '(?i)the')) AS s FROM documents),
e AS (SELECT doc_id, (unnest(range(1, len(s) + 1)) - 1)::INT AS pos, list_filter(regexp_split_to_array(regexp_split_to_array(unnest(s), '(?i)the')[1], '\s+'), lambda x: x <> '') AS w FROM s)
SELECT doc_id, pos, array_to_string(w[greatest(len(w) - 2, 1):], ' ') AS term FROM e""")
def definitions_level2(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.definitions("text", "the")).alias("pos", "d")).select("doc_id", "pos", F.col("d.term").alias("term"))


def pricing_chunks(spark, sf_dir):
    s = schema("pricing")
    one = staged(C.level_one(R.rendered_orders(spark, sf_dir), s), "level-one")
    return one, C.level_two(one, s)


ROW = """'TT: ' || tt || ' | Hàng: ' || item || ' | 20'': ' || q || ' | 40'' HC: ' || (q + 1) || ' | Giá VND: ' || price"""


@query("row_group_level2", I + f""" SELECT 'doc_' || k || '_bảng_' || k || '_sub_row_' || c.id AS chunk_id, 'Bảng ' || k || ' - ' || c.name AS title, 'Container type: ' || c.name || chr(10) || chr(10) || string_agg({ROW}, chr(10) ORDER BY tt) AS content
FROM i, (VALUES ('20''', '20'), ('40'' HC', '40_HC')) AS c(name, id) GROUP BY k, c.name, c.id""")
def row_group_level2(spark, sf_dir):
    return pricing_chunks(spark, sf_dir)[1].where("type = 'row_group'").select("chunk_id", "title", "content")


@query("rule_level2", I + f""" SELECT 'doc_' || k || '_bảng_' || k || '_sub_surcharges_' || count(*) AS chunk_id, 'surcharges' AS rule_type, 'Rule type: surcharges' || chr(10) || chr(10) || string_agg({ROW}, chr(10) ORDER BY tt) AS content FROM i WHERE flag = 'R' GROUP BY k""")
def rule_level2(spark, sf_dir):
    return pricing_chunks(spark, sf_dir)[1].where("type = 'rule'").select("chunk_id", "metadata.rule_type", "content")


# --- edges -------------------------------------------------------------------------------------------------------

L2 = """, n AS (SELECT k, count(*) FILTER (flag = 'R') AS n FROM i GROUP BY k),
t AS (SELECT k, 'doc_' || k AS d, 'doc_' || k || '_section_0_merged' AS s, 'doc_' || k || '_bảng_' || k AS t, n FROM n),
l2 AS (SELECT k, d, s, t, n, t || '_sub_row_20' AS c, 'row_group' AS type FROM t UNION ALL SELECT k, d, s, t, n, t || '_sub_row_40_HC', 'row_group' FROM t UNION ALL SELECT k, d, s, t, n, t || '_sub_surcharges_' || n, 'rule' FROM t WHERE n > 0),
h AS (SELECT d AS document_id, c AS source_chunk_id, 'parent' AS type, t AS target_chunk_id FROM l2 UNION ALL SELECT d, t, 'child', c FROM l2),
x AS (SELECT d AS document_id, s AS source_chunk_id, 'reference' AS type, s AS target_chunk_id FROM t UNION ALL SELECT d, s, 'surcharge', t FROM t UNION ALL SELECT d, t, 'reference', s FROM t),
dm AS (SELECT d AS document_id, unnest([s, t, c]) AS source_chunk_id, 'surcharge' AS type, c AS target_chunk_id FROM l2 WHERE type = 'rule' UNION ALL SELECT a.d, a.c, 'surcharge', b.c FROM l2 a JOIN l2 b ON a.k = b.k AND b.type = 'rule' AND a.type = 'row_group')"""
EDGE = "document_id, source_chunk_id, type, target_chunk_id"


def all_chunks(spark, sf_dir):
    one, two = pricing_chunks(spark, sf_dir)
    return staged(one.unionByName(two), "chunks")


def edge_chunks(spark, sf_dir):
    """All chunks with what the edges need of them: texts and rows aren't written."""
    s = schema("pricing")
    rows = C.both_levels(C.level_one(R.rendered_orders(spark, sf_dir), s), s, E.FIELDS)
    return C.numbered(staged(E.traits(rows, s, "from", "no"), "traits"))


def edge(df):
    return df.select("document_id", "source_chunk_id", "type", "target_chunk_id")


@query("edges_hierarchical", I + L2 + f" SELECT {EDGE} FROM h")
def edges_hierarchical(spark, sf_dir):
    return edge(E.hierarchical(all_chunks(spark, sf_dir)))


@query("edges_crossref", I + L2 + f" SELECT {EDGE} FROM x")
def edges_crossref(spark, sf_dir):
    return edge(E.deduplicated(E.cross_references(edge_chunks(spark, sf_dir), schema("pricing"))))


@query("edges_domain", I + L2 + f" SELECT {EDGE} FROM dm")
def edges_domain(spark, sf_dir):
    return edge(E.domain(all_chunks(spark, sf_dir)))


@query("edges_dedup", I + L2 + " SELECT document_id, type, count(*) AS n FROM (SELECT * FROM h UNION SELECT * FROM x UNION SELECT * FROM dm) GROUP BY ALL")
def edges_dedup(spark, sf_dir):
    return DE.edge_counts(R.rendered_orders(spark, sf_dir), schema("pricing"))


@query("validate_links", I + L2 + " SELECT document_id, type, count(*) AS n, count(*) FILTER (type = 'child') AS broken FROM h GROUP BY document_id, type")
def validate_links(spark, sf_dir):
    chunks = all_chunks(spark, sf_dir)
    edges = E.hierarchical(chunks)
    wrong = edges.withColumn("target_chunk_id", F.when(F.col("type") == "child", F.concat("target_chunk_id", F.lit("_gone"))).otherwise(F.col("target_chunk_id")))
    return E.validate(wrong, chunks)


@query("related_chunks", I + L2 + " SELECT document_id, source_chunk_id, target_chunk_id, CASE WHEN contains(target_chunk_id, '_sub_row_') THEN 'row_group' ELSE 'rule' END AS target_type FROM h WHERE type = 'child'")
def related_chunks(spark, sf_dir):
    chunks = all_chunks(spark, sf_dir)
    return store.related(chunks, E.hierarchical(chunks), "child").select("document_id", "source_chunk_id", "target_chunk_id", "target_type")


# --- store -------------------------------------------------------------------------------------------------------


@query("search_chunks", I + L2 + " SELECT d AS document_id, c AS chunk_id, type FROM l2 WHERE type = 'rule' ORDER BY d, c LIMIT 20 OFFSET 5")
def search_chunks(spark, sf_dir):
    return store.search(all_chunks(spark, sf_dir), level=2, chunk_type="rule", limit=20, offset=5).select("document_id", "chunk_id", "type")


@query("search_metadata_any", I + L2 + " SELECT d AS document_id, t AS chunk_id FROM t ORDER BY d LIMIT 1000")
def search_metadata_any(spark, sf_dir):
    return store.search(all_chunks(spark, sf_dir), metadata={"container_types": ["40'", "45'"], "table_type": "pricing"}, limit=1000).select("document_id", "chunk_id")


@query("chunk_by_id", I + L2 + " SELECT d AS document_id, c AS chunk_id, type FROM l2 WHERE c = 'doc_7_bảng_7_sub_row_20'")
def chunk_by_id(spark, sf_dir):
    return store.chunk_by_id(all_chunks(spark, sf_dir), "doc_7_bảng_7_sub_row_20").select("document_id", "chunk_id", "type")


@query("list_documents", I + L2 + " SELECT d AS document_id, 'pricing' AS document_type, 2::BIGINT AS level1, (2 + (n > 0)::INT)::BIGINT AS level2, (4 + (n > 0)::INT)::BIGINT AS total FROM t")
def list_documents(spark, sf_dir):
    docs = R.rendered_orders(spark, sf_dir).select("document_id", F.lit("pricing").alias("document_type"))
    return store.list_documents(docs, all_chunks(spark, sf_dir))


def queries() -> dict:
    from lathe.plans import queries_render  # noqa: F401  (adds its queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from lathe.plans import queries_render  # noqa: F401

    return dict(SQL)
