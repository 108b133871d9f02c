"""More queries: HTML, bullets, PDF geometry and content streams. Added to those of lathe.plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import text as X
from lathe.operators import bullets as B
from lathe.operators import chunks as C
from lathe.operators import html as H
from lathe.operators import pdf as P
from lathe.operators import split as S
from lathe.operators import text_tables as TT
from lathe.operators.lines import doc_lines, started
from lathe.plans import rendered as R
from lathe.plans.queries import I, J, query

ESC = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
Q = lambda s: "'" + s.replace("'", "''") + "'"


@query("html_escape_pages", f"SELECT page_id, {ESC('url')} AS url, md5({ESC('html')}) AS h FROM pages")
def html_escape_pages(spark, sf_dir):
    return R.table(spark, sf_dir, "pages").select("page_id", X.escape_html("url").alias("url"), F.md5(X.escape_html("html").cast("binary")).alias("h"))


N = "chr(10)"
CSV_SQL = f"""SELECT user_id, '<table class="csv-table">' || {N} || '<thead>' || {N} || '<tr>' || {N} || '  <th>id</th>' || {N} || '  <th>type</th>' || {N} || '  <th>props</th>' || {N} || '</tr>' || {N} || '</thead>' || {N} || '<tbody>' || {N} ||
string_agg('<tr>' || {N} || '  <td>' || event_id || '</td>' || {N} || '  <td>' || event_type || {N} || '&lt;&amp;</td>' || {N} || '  <td>' || {ESC('props')} || '</td>' || {N} || '</tr>' || {N}, '' ORDER BY event_id) || '</tbody>' || {N} || '</table>' AS html FROM events GROUP BY user_id"""


@query("csv_to_html", CSV_SQL)
def csv_to_html(spark, sf_dir):
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("event_id").cast("string"), quoted(F.concat(F.lit(" "), "event_type", F.lit("\n<& "))), quoted(F.col("props")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda s: s["line"])
    files = R.table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat_ws("\n", F.lit("id,type,props"), rows).alias("text"))
    return files.select("user_id", H.csv_to_html("text").alias("html"))


@query("html_documents", I + " SELECT 'doc_' || k AS document_id, '<h1>A &amp; ' || status || '</h1>' || chr(10) || '<p>x<br />' || chr(10) || '<strong>' || priority || '</strong></p>' || chr(10) || '<ul><li>a</li><li>' || k || '</li></ul>' || chr(10) || '<table><thead><tr><th>p</th></tr></thead><tbody><tr><td>' || k || '</td></tr></tbody></table>' AS html FROM o")
def html_documents(spark, sf_dir):
    k = F.col("k").cast("string")
    text = F.concat(F.lit("# A & "), "status", F.lit("\n\nx\n**"), "priority", F.lit("**\n\n- a\n- "), k, F.lit("\n\n| p |\n|---|\n| "), k, F.lit(" |\n"))
    return H.markdown_to_html(R.order_tables(spark, sf_dir).select(F.concat(F.lit("doc_"), k).alias("document_id"), text.alias("text")))


@query("html_shell", "SELECT page_id, contains(url, '<') AS odd, true AS titled, true AS framed FROM pages")
def html_shell(spark, sf_dir):
    page = H.document_shell(F.lit("<p>x</p>"), F.col("url"), author=F.lit("a&b"))
    return R.table(spark, sf_dir, "pages").select("page_id", F.contains("url", F.lit("<")).alias("odd"), F.contains(page, F.concat(F.lit("<title>"), X.escape_html("url"), F.lit("</title>"), F.lit('<meta name="author" content="a&amp;b">'))).alias("titled"), F.contains(page, F.lit("<main><p>x</p></main>")).alias("framed"))


@query("bullet_headings", I + " SELECT 'doc_' || k AS document_id, chr(10) || 'I ' || status || chr(10) || repeat('━', length(status) + 4) || chr(10) || chr(10) || '1 ' || priority || chr(10) || repeat('━', length(priority) + 2) || chr(10) || '  • Xe xuống bãi' || chr(10) || '• mục' || chr(10) || '• ' || k AS text FROM o")
def bullet_headings(spark, sf_dir):
    text = F.concat(F.lit("## I "), "status", F.lit("\n### 1 "), "priority", F.lit("\n#### Xe → Bãi\n* mục\n"), F.col("k").cast("string"), F.lit("\nEmail: x"))
    return B.render_markdown(R.order_tables(spark, sf_dir).select(F.concat(F.lit("doc_"), F.col("k").cast("string")).alias("document_id"), text.alias("text")))


@query("bullet_boxes", I + """, s AS (SELECT *, max(CASE WHEN tt = 1 THEN item END) OVER (PARTITION BY k) AS i1, max(CASE WHEN tt = 1 THEN q END) OVER (PARTITION BY k) AS q1, max(CASE WHEN tt = 1 THEN price END) OVER (PARTITION BY k) AS p1 FROM i)
SELECT 'doc_' || k AS document_id, string_agg('┃ PHƯƠNG ÁN ' || tt || chr(10) || '┣' || repeat('━', 70) || chr(10) || """ + " || chr(10) || ".join(
    f"'┃ • ' || {h} || repeat(' ', greatest(25 - length({h}), 0)::INT) || ' → ' || {v}" for h, v in (("'Hàng ' || i1", "item"), ("'20'' ' || q1", "q"), ("'40'' HC ' || (q1 + 1)", "(q + 1)"), ("'Giá VND ' || p1", "price"))
) + " || chr(10), chr(10) ORDER BY tt) AS text FROM s WHERE tt > 1 GROUP BY k")
def bullet_boxes(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("tt", "line")))
    raw = R.items(spark, sf_dir).groupBy("k").agg(F.concat(F.array(F.lit(R.HEADER), F.lit(R.DASHES)), F.transform(rows, lambda s: s["line"])).alias("rows"))
    return raw.select(F.concat(F.lit("doc_"), F.col("k").cast("string")).alias("document_id"), F.array_join(B.boxes("rows"), "\n").alias("text")).where("text <> ''")


@query("bullet_arrows", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Xe xuống bãi hoặc từ bãi lên xe' WHEN 1 THEN 'Tàu hoặc sà lan đến bãi' WHEN 2 THEN 'Từ bãi lên xe' WHEN 3 THEN 'Tàu hoặc sà lan đến bãi hoặc từ bãi lên tàu hoặc sà lan' WHEN 4 THEN 'Từ bãi lên tàu hoặc sà lan' ELSE event_type END AS phrase FROM events")
def bullet_arrows(spark, sf_dir):
    cases = F.when(F.col("event_id") % 6 == 0, "Xe ↔ Bãi").when(F.col("event_id") % 6 == 1, "Tàu/Sà lan → Bãi").when(F.col("event_id") % 6 == 2, "Bãi ← Xe").when(F.col("event_id") % 6 == 3, "Sà lan <-> Bãi").when(F.col("event_id") % 6 == 4, "Bãi <- Tàu").otherwise(F.col("event_type"))
    return R.table(spark, sf_dir, "events").select("event_id", B.arrow(cases).alias("phrase"))


@query("bullet_prices", "SELECT p_partkey, 'Tầng' AS text, (p_partkey + 1000) || '.000|1.5' AS prices FROM part")
def bullet_prices(spark, sf_dir):
    line = F.concat(F.lit("Tầng 2 giá "), (F.col("p_partkey") + 1000).cast("string"), F.lit(".000 12 1.5"))
    p = R.table(spark, sf_dir, "part").select("p_partkey", B.text_and_prices(line).alias("s"))
    return p.select("p_partkey", "s.text", J(F.col("s.prices")).alias("prices"))


#: Blocks of three shapes of rows by number (one line, a number alone, agreed prices) after heads and a row without a number.
TABLE_HEADS = "Bảng 1 Đơn vị tính: đồng\nContainer khô Container lạnh\nTT Phương án làm hàng\n20' 40' 45' 20'\n"


def text_table_blocks(spark, sf_dir):
    p, tt = F.col("price"), F.col("tt").cast("string")
    four = F.concat_ws(" ", *(F.concat((p + n).cast("string"), F.lit(".000")) for n in (1000, 2000, 3000, 4000)))
    line = F.when(F.col("tt") % 3 == 0, F.concat(tt, F.lit(" Hàng lạnh "), four)).when(F.col("tt") % 3 == 1, F.concat(tt, F.lit("\nHạ\n\ntheo quy định\nxuống đất\n"), four)).otherwise(F.concat(tt, F.lit(" OOG (**) Thỏa thuận Thỏa thuận")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("tt", line.alias("line")))), lambda s: s["line"])
    first = F.concat(F.lit(TABLE_HEADS + "Giao\nnhận\n"), F.col("k").cast("string"), F.lit(".1 2.2 3.3 4.4\n"))
    blocks = R.items(spark, sf_dir).groupBy("k").agg(F.array_join(rows, "\n").alias("rows"))
    return blocks.select("k", F.concat(first, "rows", F.lit("\nGhi chú: hết\n9 A 9.000")).alias("text"))


ROWS_SQL = """, b AS (SELECT k, tt::INT AS row_no, tt::VARCHAR AS num, CASE tt % 3 WHEN 0 THEN 'Hàng lạnh' WHEN 1 THEN 'Hạ xuống đất' ELSE 'OOG (**)' END AS description,
CASE WHEN tt % 3 = 2 THEN ['Thỏa thuận', 'Thỏa thuận'] ELSE [(price + 1000) || '.000', (price + 2000) || '.000', (price + 3000) || '.000', (price + 4000) || '.000'] END AS prices, tt % 3 = 2 AS worded FROM i
UNION ALL SELECT DISTINCT k, 0, '1', 'Giao nhận', [k || '.1', '2.2', '3.3', '4.4'], false FROM i)"""


@query("text_table_rows", I + ROWS_SQL + " SELECT 'doc_' || k AS document_id, row_no, num, description, array_to_string(prices, '|') AS prices FROM b")
def text_table_rows(spark, sf_dir):
    got = TT.parse_text_tables(text_table_blocks(spark, sf_dir).select(F.concat(F.lit("doc_"), F.col("k").cast("string")).alias("document_id"), "text"))
    return got.select("document_id", "row_no", "num", "description", J(F.col("prices")).alias("prices"))


NAMES_SQL = "['Container khô 20' || chr(39), 'Container khô 40' || chr(39), 'Container khô 45' || chr(39), 'Container lạnh 20' || chr(39)]"


@query("bullet_text_tables", I + ROWS_SQL + f""", x AS (SELECT k, string_agg(CASE WHEN worded THEN '┃ PHƯƠNG ÁN ' ELSE '┃ TT ' END || num || ': ' || description || chr(10) || '┣' || repeat('━', 70) || chr(10)
|| array_to_string(list_transform(range(1, len(prices) + 1), lambda j: '┃ • ' || {NAMES_SQL}[j] || repeat(' ', (CASE WHEN worded THEN 30 ELSE 25 END - length({NAMES_SQL}[j]))::INT) || ' → ' || prices[j]), chr(10)) || chr(10), chr(10) ORDER BY row_no) AS t FROM b GROUP BY k)
SELECT 'doc_' || k AS document_id, chr(10) || '1. Mục ' || k || chr(10) || repeat('━', 80) || chr(10) || '• chữ' || chr(10) || chr(10) || '- gạch' || chr(10) || chr(10) || 'Bảng 1' || chr(10) || repeat('━', 80) || chr(10) || chr(10) || t || chr(10) || 'Ghi chú: hết' || chr(10) || repeat('━', 80) || chr(10) || chr(10) || '1.1.4. Phụ' || chr(10) || repeat('━', 80) || chr(10) || '• a. Một' || chr(10) || 'hai' AS text FROM x""")
def bullet_text_tables(spark, sf_dir):
    text = F.concat(F.lit("1. Mục "), F.col("k").cast("string"), F.lit("\nchữ\nNgày in: 1\n\n\n- gạch\nFax: 1\n\n"), "text", F.lit("\n1.1.4. Phụ\na. Một\n5\nhai"))
    return B.convert(text_table_blocks(spark, sf_dir).select(F.concat(F.lit("doc_"), F.col("k").cast("string")).alias("document_id"), text.alias("text")))


@query("bullet_preprocess", """SELECT 'doc_' || p_partkey AS document_id, CASE WHEN p_size % 2 = 0 THEN array_to_string(['5', '1.1.4. P' || p_size, 'Phương án làm hàng', 'TT Loại container', 'x', 'Từ tàu hoặc sà lan đến bãi hoặc từ bãi xuống tàu hoặc sà lan', 'Từ xe xuống bãi hoặc từ bãi lên xe', 'y', '1.2. Sau', '5'], chr(10))
ELSE array_to_string(['5', '1.1.5. P' || p_size, 'Phương án làm hàng', 'TT Loại container', 'x', 'Phương án làm hàng', 'TT Loại container', 'Tàu/ Sà lan', 'Tàu/ Sà lan Bãi', '5', 'y', '1.2. Sau', '5'], chr(10)) END AS text FROM part""")
def bullet_preprocess(spark, sf_dir):
    p = R.table(spark, sf_dir, "part")
    text = F.concat(F.lit("5\n1.1."), F.when(F.col("p_size") % 2 == 0, "4").otherwise("5"), F.lit(". P"), F.col("p_size").cast("string"), F.lit("\nPhương án làm hàng\nTT Loại container\nx\nPhương án làm hàng\nTT Loại container\nTàu/ Sà lan\nTàu/ Sà lan Bãi\n5\ny\n1.2. Sau\n5"))
    return B.cleaned_special_section(p.select(F.concat(F.lit("doc_"), F.col("p_partkey").cast("string")).alias("document_id"), text.alias("text")))


@query("bullet_rejoin", "SELECT 'doc_' || p_partkey AS document_id, CASE WHEN p_size % 2 = 0 THEN '| 1 | ' || p_size || ' x |' || chr(10) || '| 2 | y' ELSE '| 1 | ' || p_size || chr(10) || 'x' || chr(10) || chr(10) || 'z' END || chr(10) || 'end' AS text FROM part")
def bullet_rejoin(spark, sf_dir):
    p = R.table(spark, sf_dir, "part")
    text = F.concat(F.lit("| 1 | "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "\nx |\n| 2 | y").otherwise("\nx\n\nz"), F.lit("\nend"))
    return B.rejoined_rows(p.select(F.concat(F.lit("doc_"), F.col("p_partkey").cast("string")).alias("document_id"), text.alias("text")))


@query("bullet_watermark", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a' || chr(10) || chr(10) || chr(10) || 'b' WHEN 1 THEN 'a' || chr(10) || chr(10) || 'B' WHEN 2 THEN 'a' || chr(10) ELSE 'a' || chr(10) || 'Người in/ký: ' || c_custkey END AS text FROM customer")
def bullet_watermark(spark, sf_dir):
    n, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    text = F.concat(F.lit("a\n"), F.when(k == 0, F.concat(F.lit("Người in: "), n, F.lit("\n\nb"))).when(k == 1, F.concat(F.lit("Người  ký : "), n, F.lit("\nđ\nB"))).when(k == 2, F.concat(F.lit("Ngày in: "), n)).otherwise(F.concat(F.lit("Người in/ký: "), n)))
    return R.table(spark, sf_dir, "customer").select("c_custkey", B.remove_watermark(text).alias("text"))


#: Lines with and without the words that make a line metadata, one of each; the SQL says which is which.
LINES = ("người in: a", "Người ký: b", "THỜI GIAN ký", "Thủ trưởng", "Ban chỉ huy", "CT/TGĐ", "Email a", "www.a.vn", "Điện thoại 1", "Ngày in: 1", "Fax: 2", "Địa chỉ: 3", "Tổng công ty A", "Biểu giá dịch vụ tại cảng B", "trang 3", "Giám đốc", "Fax 2", "người in", "nơi nhận", "chữ")


@query("skip_lines", "SELECT n_nationkey, u.i::INT AS i, u.i < 14 AS text_path, u.i < 13 AS markdown_path FROM nation, (SELECT unnest(range(0, 20)) AS i) u")
def skip_lines(spark, sf_dir):
    lines = R.table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.array(*map(F.lit, LINES))).alias("i", "line"))
    return lines.select("n_nationkey", "i", B.is_skipped("line").alias("text_path"), B.is_skipped("line", markdown=True).alias("markdown_path"))


# --- PDF ---------------------------------------------------------------------------------------------------------


def line_boxes(spark, sf_dir):
    li = R.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("d"), (F.col("l_orderkey") % 50).cast("string")).alias("document_id"), (F.col("l_partkey") % 20).cast("int").alias("page"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    y = (F.col("k") % 800).cast("double")
    return li.select("document_id", "page", "k", "n", "p", "s", (F.col("s") % 400).cast("double").alias("x0"), y.alias("y0"), (F.col("s") % 400 + 60).cast("double").alias("x1"), (y + 10).alias("y1"))


def table_boxes(spark, sf_dir):
    p = R.table(spark, sf_dir, "part")
    x, y = (F.col("p_size") * 7).cast("double"), (F.col("p_partkey") % 700).cast("double")
    return p.select(F.concat(F.lit("d"), (F.col("p_partkey") % 50).cast("string")).alias("document_id"), (F.col("p_partkey") % 20).cast("int").alias("page"), x.alias("x0"), y.alias("y0"), (x + 200).alias("x1"), (y + 120).alias("y1"))


BOXES = """WITH l AS (SELECT 'd' || (l_orderkey % 50) AS document_id, (l_partkey % 20)::INT AS page, l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, (l_suppkey % 400)::DOUBLE AS x0, (l_orderkey % 800)::DOUBLE AS y0, (l_suppkey % 400 + 60)::DOUBLE AS x1, (l_orderkey % 800 + 10)::DOUBLE AS y1 FROM lineitem),
b AS (SELECT 'd' || (p_partkey % 50) AS document_id, (p_partkey % 20)::INT AS page, (p_size * 7)::DOUBLE AS x0, (p_partkey % 700)::DOUBLE AS y0, (p_size * 7 + 200)::DOUBLE AS x1, (p_partkey % 700 + 120)::DOUBLE AS y1 FROM part) """


@query("bbox_anti", BOXES + "SELECT document_id, page, k, n, p, s FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.document_id = l.document_id AND b.page = l.page AND l.x0 >= b.x0 - 5 AND l.y0 >= b.y0 - 5 AND l.x1 <= b.x1 + 5 AND l.y1 <= b.y1 + 5)")
def bbox_anti(spark, sf_dir):
    return P.outside_boxes(line_boxes(spark, sf_dir), table_boxes(spark, sf_dir)).select("document_id", "page", "k", "n", "p", "s")


def headings_and_tables(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), (F.col("o_custkey") % 40).cast("string")).alias("document_id"), (F.col("o_orderkey") % 60).cast("int").alias("page"), F.col("o_orderkey").alias("heading_id"), (F.col("o_orderkey") * 37 % 800).cast("double").alias("y"))
    p = R.table(spark, sf_dir, "part").select(F.concat(F.lit("d"), (F.col("p_partkey") % 40).cast("string")).alias("document_id"), (F.col("p_size") % 60).cast("int").alias("page"), F.col("p_partkey").alias("table_id"), (F.col("p_partkey") * 53 % 800).cast("double").alias("y"))
    return o, p


@query("nearest_table_match", """WITH h AS (SELECT 'd' || (o_custkey % 40) AS document_id, (o_orderkey % 60)::INT AS page, o_orderkey AS heading_id, (o_orderkey * 37 % 800)::DOUBLE AS y FROM orders),
t AS (SELECT 'd' || (p_partkey % 40) AS document_id, (p_size % 60)::INT AS page, p_partkey AS table_id, (p_partkey * 53 % 800)::DOUBLE AS y FROM part),
c AS (SELECT h.document_id, heading_id, table_id, abs(h.page - t.page) * 10000 + abs(h.y - t.y) AS distance FROM h JOIN t ON h.document_id = t.document_id AND abs(h.page - t.page) <= 1)
SELECT document_id, heading_id, table_id, distance FROM c QUALIFY row_number() OVER (PARTITION BY document_id, heading_id ORDER BY distance, table_id) = 1""")
def nearest_table_match(spark, sf_dir):
    return P.nearest_tables(*headings_and_tables(spark, sf_dir))


@query("greedy_table_match", """WITH RECURSIVE h AS (SELECT 'd' || (o_custkey % 40) AS document_id, (o_orderkey % 60)::INT AS page, o_orderkey AS heading_id, (o_orderkey * 37 % 800)::DOUBLE AS y, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS n FROM orders),
t AS (SELECT 'd' || (p_partkey % 40) AS document_id, (p_size % 60)::INT AS page, p_partkey AS table_id, (p_partkey * 53 % 800)::DOUBLE AS y FROM part),
r AS (SELECT DISTINCT document_id, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS heading_id, NULL::STRUCT(distance DOUBLE, table_id BIGINT) AS m FROM h
UNION ALL SELECT document_id, n, CASE WHEN m IS NULL THEN used ELSE list_append(used, m.table_id) END, heading_id, m FROM (
SELECT r.document_id, h.n, r.used, h.heading_id, min({'distance': abs(h.page - t.page) * 10000 + abs(h.y - t.y), 'table_id': t.table_id}) FILTER (t.table_id IS NOT NULL) AS m
FROM r JOIN h ON h.document_id = r.document_id AND h.n = r.n + 1 LEFT JOIN t ON t.document_id = h.document_id AND abs(h.page - t.page) <= 1 AND NOT list_contains(r.used, t.table_id) GROUP BY ALL))
SELECT document_id, heading_id, m.table_id AS table_id, m.distance AS distance FROM r WHERE m IS NOT NULL""")
def greedy_table_match(spark, sf_dir):
    return P.match_tables(*headings_and_tables(spark, sf_dir))


SPAN_MARKS = ("DRAFT v2", "Hợp đồng_Approved", "internal use only", "copy", "mật", "  ")


@query("spans_to_lines", """WITH s AS (SELECT l_orderkey AS page, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'A' THEN CASE l_partkey % 6 WHEN 3 THEN 'copy' WHEN 4 THEN 'mật' END ELSE 'P' || l_partkey END AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS span, trunc(l_quantity)::INT % 20 AS size FROM lineitem),
g AS (SELECT page, string_agg(text, ' ' ORDER BY span) AS text, avg(size) AS size FROM s WHERE text IS NOT NULL GROUP BY page) SELECT page, CASE WHEN size > 16 THEN '# ' WHEN size > 14 THEN '## ' WHEN size > 12 THEN '### ' ELSE '' END || text AS markdown FROM g""")
def spans_to_lines(spark, sf_dir):
    i = R.items(spark, sf_dir)
    part = F.regexp_extract("item", r"(\d+)", 1).cast("int")
    text = F.when(F.col("flag") == "R", " Draft ").when(F.col("flag") == "A", F.get(F.array(*map(F.lit, SPAN_MARKS)), part % 6)).otherwise(F.concat(F.lit(" P"), part.cast("string"), F.lit(" ")))
    spans = i.select(F.lit("d").alias("document_id"), F.col("k").alias("page"), F.lit(0).alias("block"), F.lit(0).alias("line"), F.col("tt").alias("span"), text.alias("text"), (F.col("q") % 20).alias("size"))
    return P.spans_to_lines(spans).select("page", "markdown")


@query("pricing_part", """WITH l AS (SELECT 'd' || (l_orderkey % 97) AS document_id, (l_linenumber - 1) % 6 AS page, l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_partkey % 50 = 0 AS charges FROM lineitem),
f AS (SELECT document_id, min((page, k, n, p, s)) AS first FROM l WHERE page >= 4 OR charges GROUP BY document_id) SELECT l.document_id, l.page::INT AS page, l.k, l.n, l.p, l.s FROM l JOIN f ON l.document_id = f.document_id AND (l.page, l.k, l.n, l.p, l.s) >= f.first""")
def pricing_part(spark, sf_dir):
    li = R.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("d"), (F.col("l_orderkey") % 97).cast("string")).alias("document_id"), ((F.col("l_linenumber") - 1) % 6).cast("int").alias("page"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    lines = li.select("*", F.struct("k", "n").alias("block"), F.struct("p", "s").alias("line"), F.when(F.col("p") % 50 == 0, "II. GIÁ CƯỚC").when(F.col("p") % 50 == 1, "II. GIÁ").otherwise("CƯỚC").alias("text"))
    return P.pricing_part(lines).select("document_id", "page", "k", "n", "p", "s")


@query("pdf_table_markdown", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE chr(10) || '| TT | Xeáp |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_size || ' | ab c |' || chr(10) END AS markdown FROM part""")
def pdf_table_markdown(spark, sf_dir):
    p = R.table(spark, sf_dir, "part")
    row = lambda *cells: F.array(*(F.lit(c) if isinstance(c, str) or c is None else c for c in cells))
    data = F.when(F.col("p_size") % 3 == 0, row(" ", "")).otherwise(row(F.col("p_size").cast("string"), "a b  c"))
    return p.select("p_partkey", P.table_markdown(F.array(row("TT", " Xe\n áp"), row("", None), data)).alias("markdown"))


@query("pdf_assembled", """WITH m AS (SELECT p_partkey AS k, p_size % 3 AS form FROM part) SELECT 'd' || k AS document_id, chr(10) || '### Bảng 1' || chr(10) || chr(10) || CASE WHEN form < 2 THEN '| ' || k || ' |' || chr(10) ELSE '' END || 'chữ' || chr(10) || chr(10) || '<!-- Page 4 -->' || chr(10) || CASE WHEN form = 1 THEN chr(10) || '| rest |' ELSE '' END AS text FROM m""")
def pdf_assembled(spark, sf_dir):
    p = R.table(spark, sf_dir, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("document_id"), F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" |")).alias("own"), (F.col("p_size") % 3).alias("form"))
    line = lambda n, markdown, heading: F.struct(F.lit(n).alias("line"), F.lit(markdown).alias("markdown"), F.lit(heading).cast("long").alias("heading_id"), F.lit(10.0 * n).alias("y"))
    lines = p.select("document_id", F.lit(4).alias("page"), F.lit(0).alias("block"), F.explode(F.array(line(1, "### Bảng 1", 1), line(2, "chữ", None))).alias("l")).select("document_id", "page", "block", "l.*")
    box = lambda n, y, markdown: F.struct(F.lit(n).cast("long").alias("table_id"), F.lit(4).alias("page"), F.lit(y).alias("y"), markdown.alias("markdown"))
    tables = p.select("document_id", F.explode(F.when(F.col("form") == 0, F.array(box(1, 12.0, F.col("own")))).when(F.col("form") == 1, F.array(box(2, 90.0, F.lit("| rest |")), box(1, 12.0, F.col("own"))))).alias("t")).select("document_id", "t.*")
    return P.assembled(lines, tables, P.match_tables(lines.where("heading_id is not null"), tables))


@query("started_latch", I + ", f AS (SELECT k, min(CASE WHEN item LIKE 'Phụ thu%' THEN tt END) AS s FROM i GROUP BY k) SELECT 'doc_' || i.k AS document_id, (i.tt + 5)::INT AS line_no FROM i JOIN f ON i.k = f.k AND i.tt >= f.s UNION ALL SELECT 'doc_' || f.k, (6 + (SELECT count(*) FROM i WHERE i.k = f.k))::INT FROM f")
def started_latch(spark, sf_dir):
    return started(doc_lines(R.rendered_orders(spark, sf_dir)), F.col("line").rlike("(?i)phụ thu"), ["line_no"]).select("document_id", "line_no")


@query("stream_heuristics", """WITH s AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS stream_no, (l_partkey % 1000 + 1)::BIGINT AS size, trunc(l_quantity)::INT % 20 AS ops, l_returnflag = 'R' AS rotated FROM lineitem), t AS (SELECT *, size / sum(size) OVER (PARTITION BY page) AS share FROM s)
SELECT page, stream_no::INT AS stream_no, (share < 0.05 AND ops = 0) OR (rotated AND share < 0.03 AND ops < 10) OR (ops BETWEEN 1 AND 14 AND share < 0.2 AND size > 100) AS removed FROM t""")
def stream_heuristics(spark, sf_dir):
    i = R.items(spark, sf_dir)
    size = F.regexp_extract("item", r"(\d+)", 1).cast("long") % 1000 + 1
    s = i.select(F.lit("d").alias("document_id"), F.col("k").alias("page"), F.col("tt").alias("stream_no"), size.alias("size"), (F.col("q") % 20).alias("text_ops"), (F.col("flag") == "R").alias("rotated"))
    return P.removed_streams(s).select("page", "stream_no", "removed")


@query("stream_operators", """SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN length('-1 0 0 1 ' || p_size || '0 20 Tm' || chr(10) || '(a) Tj' || chr(10) || ' [(b)] TJ ' || chr(10) || 'q') ELSE length('1 0 0 1 ' || p_size || '0 20 Tm' || chr(10) || '(a) Tj x') END)::BIGINT AS size, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END AS text_ops, p_size % 2 = 0 AS rotated, p_size * 10 > 350 AS right_edge FROM part""")
def stream_operators(spark, sf_dir):
    size = F.col("p_size").cast("string")
    content = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("-1 0 0 1 "), size, F.lit("0 20 Tm\n(a) Tj\n [(b)] TJ \nq"))).otherwise(F.concat(F.lit("1 0 0 1 "), size, F.lit("0 20 Tm\n(a) Tj x")))
    return P.described_streams(R.table(spark, sf_dir, "part").select("p_partkey", content.cast("binary").alias("content"))).drop("content")


@query("reordered_tables", """SELECT 'd' || p_partkey AS document_id, CASE WHEN p_size % 2 = 0 THEN array_to_string(['### II. Giá', '### Bảng 1', '', '| ' || p_size || ' |', '', '| x |', 'chữ', '### Bảng 2', '', '| hai |', 'cuối', '', '| ba |'], chr(10)) ELSE array_to_string(['đầu', '### III. Giá', '### Bảng 1', '### Bảng 2'], chr(10)) END AS text FROM part""")
def reordered_tables(spark, sf_dir):
    p = R.table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("đầu\n| cũ |\n### II. Giá\n| "), F.col("p_size").cast("string"), F.lit(" |\n\n| x |\n### Bảng 1\nchữ\n### Bảng 2\n| hai |\ncuối\n| ba |"))).otherwise("đầu\n### III. Giá\n### Bảng 1\n### Bảng 2")
    return S.reordered_tables(p.select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("document_id"), text.alias("text")))


@query("orphan_lines", """SELECT 'd' || p_partkey AS document_id, '### Đơn vị tính: đồng' || chr(10) || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'khác' || chr(10) || '5' ELSE 'TT' || chr(10) || 'Container khô' || chr(10) || p_size || '.000' || chr(10) || '20''' || chr(10) || 'khác' || chr(10) || '5' END AS text FROM part""")
def orphan_lines(spark, sf_dir):
    p = R.table(spark, sf_dir, "part")
    more = F.when(F.col("p_size") % 2 == 0, "\n40’\n\nkhác\n5").otherwise("\nkhác\n5")
    text = F.concat(F.lit("### Đơn vị tính: đồng\nTT\nContainer khô\n"), F.col("p_size").cast("string"), F.lit(".000\n20'"), more)
    return S.without_orphans(p.select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("document_id"), text.alias("text")))


@query("document_metadata", "SELECT 'd' || c_custkey AS document_id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'tựa ' || c_custkey END, 'Untitled') AS document_name, c_mktsegment AS document_type, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE '/f/' || c_custkey END AS source_file FROM customer")
def document_metadata(spark, sf_dir):
    k = F.col("c_custkey")
    c = R.table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), k.cast("string")).alias("document_id"), F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, "").alias("document_name"), F.col("c_mktsegment").alias("document_type"), F.when(k % 3 == 1, F.concat(F.lit("tựa "), k.cast("string"))).otherwise("").alias("title"), F.when(k % 3 != 2, F.concat(F.lit("/f/"), k.cast("string"))).alias("path"))
    return C.document_metadata(c.select("document_id", "document_name", "document_type"), c.select("document_id", "title", F.col("path").alias("source_file")))


@query("operator_filter", """SELECT p_partkey, v.op_no FROM part, (VALUES (0), (1), (2), (3)) AS v(op_no) WHERE NOT (p_size % 2 = 0 AND v.op_no IN (1, 2))""")
def operator_filter(spark, sf_dir):
    p = R.table(spark, sf_dir, "part")
    y = F.when(F.col("p_size") % 2 == 0, "20").otherwise("400")
    ops = F.array(F.concat(F.lit("1 0 0 1 50 "), y, F.lit(" Tm")), F.concat(F.lit("[("), F.col("p_size").cast("string"), F.lit(")] TJ")), F.lit("[(-- __)] TJ"), F.lit("[(12a)] TJ"))
    each = p.select("p_partkey", F.lit("d").alias("document_id"), F.col("p_partkey").alias("page"), F.lit(842.0).alias("height"), F.posexplode(ops).alias("op_no", "op"))
    return P.filtered_operators(each).select("p_partkey", "op_no")
