"""Small hand-derived cases of the document operators."""

import dataclasses
import random
import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lathe.functions import text as X
from lathe.operators import bullets as B
from lathe.operators import chunks as C
from lathe.operators import document_edges as DE
from lathe.operators import edges as E
from lathe.operators import html as H
from lathe.operators import pdf as P
from lathe.operators import split as S
from lathe.operators import tables as TB
from lathe.operators import text_tables as TT
from lathe.plans.rules import schema, schemas
from lathe.sources import store


def docs(spark, *texts):
    return spark.createDataFrame([(f"doc_{i}", t) for i, t in enumerate(texts)], "document_id string, text string")


def one(spark, column, text):
    return docs(spark, text).select(column.alias("c")).first()["c"]


def parts(spark, text, **options):
    return [r.asDict(recursive=True) for r in S.split_tables(docs(spark, text), **options).orderBy("line_no", "part").collect()]


def table(n, extra=()):
    return "\n".join(["### Bảng 1", "| TT | b | c |", "|---|---|---|", *(f"| {i} | x | y |" for i in range(n)), *extra])


@pytest.mark.parametrize(("rows", "want"), [(4, [("1/1", 4)]), (5, [("1/1", 5)]), (6, [("1/2", 3), ("2/2", 3)])])
def test_split_sizes(spark, rows, want):
    assert [(p["phan_so"], p["so_hang_du_lieu"]) for p in parts(spark, table(rows))] == want


def test_split_uncounted_row(spark):
    got = parts(spark, table(11, ["|  | z | z |"]))
    assert [(p["phan_so"], p["so_hang_du_lieu"]) for p in got] == [("1/3", 4), ("2/3", 4), ("3/3", 3)]
    assert S.SEPARATOR in got[0]["noi_dung_bang"]


def test_heading_without_table_takes_the_next(spark):
    got = parts(spark, "### Bảng 1\n### Bảng 2\n| a |\n| --- |\n| x |\n### Bảng 3")
    assert [p["ten_bang"] for p in got] == ["Bảng 1"]


def test_hierarchy(spark):
    got = parts(spark, "### II. A\n### 1. B\n### 1.1. C\n### Bảng 1\n| a |\n| - |\n### III. D\n### Bảng 2\n| a |\n| - |")
    assert got[0]["tieu_de_muc"] == {"muc_chinh": "II. A", "muc_cap_1": "1. B", "muc_cap_2": "1.1. C", "muc_cap_3": None}
    assert got[1]["tieu_de_muc"] == {"muc_chinh": "III. D", "muc_cap_1": None, "muc_cap_2": None, "muc_cap_3": None}


def test_tables(spark):
    got = TB.parse_tables(docs(spark, "chữ\n| một |\nchữ\n| a | b |\n| 1.000 | x |\n| 2,5 |")).collect()
    assert [(r.headers, r.rows) for r in got] == [(["a", "b"], [["1.000", "x"], ["2,5"]])]
    frame = TB.parse_tables(docs(spark, "| a | b |\n|---|:-:|\n| 1.000 | 1 2 |\n| 2,5 | x |"))
    assert sorted(r.value for r in TB.numeric_cells(frame).collect()) == [12.0, 25.0, 1000.0]
    assert frame.select(TB.row_maps().alias("m")).first().m == [{"a": "1.000", "b": "1 2"}, {"a": "2,5", "b": "x"}]


def test_text(spark):
    assert one(spark, X.container_types("text"), "20' DC, 40'HC và 45'") == ["20' DC", "40' HC", "45'"]
    assert [r.identifier for r in one(spark, X.table_references("text"), "Bảng 23-TT.9, Bảng IV")] == ["23", "IV"]
    assert [r.type for r in one(spark, X.article_references("text"), "Điểm a Khoản 3 Điều 10")] == ["article", "clause", "point"]
    assert one(spark, X.sentences("text"), "A. B! C;D") == ["A", "B", "C;D"]
    assert [(r.type, r.text) for r in one(spark, X.conditions("text"), "trừ khi có lệnh. X")] == [("conditional", "khi có lệnh"), ("conditional", "trừ khi có lệnh")]
    assert one(spark, X.heading_path("text"), "# A\n## B\n## C\n# D") == "A > D"
    assert one(spark, X.effective_date("text"), "ngày 5 tháng 3 năm 2025") is None
    assert one(spark, X.clean_markdown("text"), "x\n# H\ny") == "x\n# H\n\ny"
    assert one(spark, X.escape_html("text"), "<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"
    assert one(spark, X.count_tokens("text"), None) in (None, -1)


@pytest.mark.parametrize(("given", "want"), [("Xe ↔ Bãi", "Xe xuống bãi hoặc từ bãi lên xe"), ("Tàu/Sà lan → Bãi", "Tàu hoặc sà lan đến bãi"), ("Bãi ← Xe", "Từ bãi lên xe"), ("A → B", "A -> B"), ("chữ", "chữ")])
def test_arrows(spark, given, want):
    assert one(spark, B.arrow("text"), given) == want


def test_prices(spark):
    assert one(spark, B.prices("text"), "12 497.000 1.5 2025") == ["497.000", "1.5", "2025"]
    got = one(spark, B.text_and_prices("text"), "Tầng 2 giá 497.000")
    assert (got.text, got.prices) == ("Tầng", ["497.000"])


def table_rows(spark, text):
    got = TT.parse_text_tables(docs(spark, text)).orderBy("row_no").collect()
    return [(r.num, r.description, r.prices) for r in got]


def test_text_table_rows(spark):
    """Each rule of the row grammar once: headers skipped, rows without a number, prices before their row, agreed and worded prices, five at most."""
    heads = "Bảng 02 Đơn vị tính: đồng/container\nContainer khô Container lạnh\nTT Phương án làm hàng\n20' 40' 45' 20' 40' & 45'\n"
    five = "1.000 2.000 3.000 4.000 5.000"
    assert table_rows(spark, heads + f"1 Xe Bãi {five} 6.000\n2\nHạ container\nxuống đất\ntheo quy định chung\n{five}") == [("1", "Xe Bãi", five.split()), ("2", "Hạ container xuống đất", five.split())]
    assert table_rows(spark, heads + f"Giao hàng\nquá cảnh\n{five}\nNhận hàng\nMiễn phụ thu") == [("1", "Giao hàng quá cảnh", five.split()), ("2", "Nhận hàng", ["Miễn phụ thu"])]
    assert table_rows(spark, f"T\n1 A {five}\n7.000 7.001 7.002 7.003\n2 B\n3 C\n") == [("1", "A", five.split()), ("2", "B", ["7.000", "7.001", "7.002", "7.003"]), ("3", "C", [])]
    assert table_rows(spark, "T\n1 OOG nhóm 2 (**) Thỏa thuận Thỏa thuận\n2 IMDG\nTăng 50% đơn giá\nhàng thông thường\nTăng 100%\n3 D Thỏa thuận") == [("1", "OOG nhóm 2 (**)", ["Thỏa thuận"] * 2), ("2", "IMDG", ["Tăng 50% đơn giá hàng thông thường", "Tăng 100%"]), ("3", "D Thỏa thuận", [])]
    assert table_rows(spark, "T\n1 A 1.000 2.000\n3.000 4.000 5.000\n2\nB\nBằng 10% giá\n- x\n9 E 1.000") == [("1", "A", ["1.000", "2.000", "3.000", "4.000", "5.000"]), ("2", "B - x 9 E 1.000", ["Bằng 10% giá"])]
    assert table_rows(spark, "T\n1 A 1.000\nGhi chú: hết\n2 B 2.000") == [("1", "A", ["1.000"])]
    assert table_rows(spark, "T\n1 A 1.000\n1.2. Mục\n2 B 2.000") == [("1", "A", ["1.000"])]


def test_column_names():
    assert TT.column_names("Container khô Container lạnh", "20' 40' 45' 20' 40' & 45'") == ["Container khô 20'", "Container khô 40'", "Container khô 45'", "Container lạnh 20'", "Container lạnh 40' & 45'"]
    assert TT.column_names("Container khô", "20\u2019 40'") == ["Container khô 20\u2019", "Container khô 40'"]
    assert TT.column_names("", "") == [f"Price {i}" for i in range(1, 6)]
    assert TT.column_names("", "Tàu/ Sà lan \uf0f3 Bãi  Xe \uf0f3 Bãi") == ["Tàu/ Sà lan Bãi", "Xe Bãi"]
    assert TT.column_names("", "Xe") == ["Xe", "Bãi"]


@pytest.mark.parametrize(("line", "want"), [("Từ xe xuống bãi", True), ("Xe ↔ Bãi", True), ("Container khô và Container lạnh", True), ("Loại hàng", True), ("Đơn vị tính: đồng", True), ("20' 40' 45'", True), ("40' &", True), ("1 Xe ↔ Bãi", False), ("Xe Bãi 1.000", False), ("Container khô", False), ("Giá loại hàng", False)])
def test_header_lines(spark, line, want):
    assert one(spark, TT.is_header_line("text"), line) is want


@pytest.mark.parametrize(("line", "path", "want"), [("Tổng công ty A", "text", True), ("Địa chỉ: 1", "text", True), ("www.abc.vn", "text", True), ("Người in: x", "text", True), ("trang 3", "text", False), ("Giám đốc", "text", False), ("Biểu giá dịch vụ tại cảng X", "text", True), ("Biểu giá dịch vụ tại cảng X", "markdown", False), ("EMAIL a@b", "markdown", True)])
def test_skipped_lines(spark, line, path, want):
    assert one(spark, B.is_skipped("text", path == "markdown"), line) is want


def test_markers_and_watermarks(spark):
    marks = [("[Image on page 3]", True), ("<!-- Page 2 -->", True), ("<!-- Image -->", False), ("Biểu giá dịch vụ tại cảng Tân Cảng từ ngày 1", True), ("từ ngày 1", False)]
    assert all(one(spark, B.is_marker("text"), t) is w for t, w in marks)
    for text, want in [("a\nNgười in: x\ny\nB", "a\n\nB"), ("Người ký: z", ""), ("Ngày in: 1/2\n\nc", "\n\nc"), ("Người in/ký: a\nB", "Người in/ký: a\nB")]:
        assert one(spark, B.remove_watermark("text"), text) == want
    spans = [("DRAFT v2", True), ("internal use only", True), ("Do Not Copy", True), ("Hợp đồng_Approved", True), ("copy", False), ("mật", False), ("bản nháp", False)]
    assert all(one(spark, P.is_watermark("text"), t) is w for t, w in spans)


def test_rejoined_rows(spark):
    text = "a\n| 1 | x\ny |\n| 2 |\nz\n\n| 3 |\nlast\nend"
    assert B.rejoined_rows(docs(spark, text)).first().text == "a\n| 1 | x y |\n| 2 | z\n\n| 3 |\nlast\nend"


def test_special_section(spark):
    head = "Phương án làm hàng\nTT Loại container\nTàu/ Sà lan  Bãi"
    text = f"{head}\n5\n1.1.4. Phụ thu\n5\n{head}\nx\n{head}\nBiểu giá dịch vụ tại cảng từ ngày 1\n1.2. Khác\n5"
    routes = "Từ tàu hoặc sà lan đến bãi hoặc từ bãi xuống tàu hoặc sà lan\nTừ xe xuống bãi hoặc từ bãi lên xe"
    want = f"{head}\n5\n1.1.4. Phụ thu\nPhương án làm hàng\nTT Loại container\n{routes}\nx\n1.2. Khác\n5"
    assert B.cleaned_special_section(docs(spark, text)).first().text == want


def test_text_bullets(spark):
    bar, line = "━" * 80, "┣" + "━" * 70
    text = "Mở đầu\n\n1. Đối tượng\n- một\nEmail: a\nBảng 02 Đơn vị tính: đồng\nContainer khô Container lạnh\n20' 40'\n1 Xe 1.000 2.000\n2\nHạ\nTăng 5%\nGhi chú: hết\n1.1.4. Phụ thu\na. Một\nhai"
    want = ["• Mở đầu", "", "", "1. Đối tượng", bar, "- một", "Bảng 02", bar, "", "┃ TT 1: Xe", line, f"┃ • {'Container khô 20' + chr(39):25} → 1.000", f"┃ • {'Container khô 40' + chr(39):25} → 2.000", "", "┃ PHƯƠNG ÁN 2: Hạ", line, f"┃ • {'Container khô 20' + chr(39):30} → Tăng 5%", "", "Ghi chú: hết", bar, "", "1.1.4. Phụ thu", bar, "• a. Một", "hai"]
    assert B.convert(docs(spark, text)).first().text.split("\n") == want
    untitled = "Phương án làm hàng\nTT Loại\n1 A 1.000\nb. Sau"
    assert TT.text_bullets(docs(spark, untitled)).first().text.split("\n") == ["Phương án làm hàng", bar, "", "┃ TT 1: A", line, f"┃ • {'Price 1':25} → 1.000", "", "• b. Sau"]


def test_lines_in_python_as_in_java(spark):
    """Random lines and texts: the walk's answers are those of the Column forms."""
    rng = random.Random(3)
    bits = ["Tàu", "Tàu/", "Sà lan", "Sà  lan", "Xe", "Bãi", "Từ ", "↔", "→", "container ", "Container\u00a0", "khô", "LẠNH", "tt ", "Loại ", "phương\u2003án ", "Đơn vị tính", "20'", "40\u2019", "&", ",", "\r", "\u2028", "\u0085", "1", "12 ", "\u0665", "1.000", "1.2. ", "1.1.4", "a. ", "Bảng 1", "Bảng\n2", "|", " ", "\t", "\x1c", "Ghi chú:", "ghi\u2009chú :", "-", "• ", "½", "é", "Thỏa thuận", "Tăng", "fax:", "FAX:", "5"]
    lines = ["".join(rng.choices(bits, k=rng.randint(0, 5))) for _ in range(1500)]
    got = docs(spark, *lines).select("text", TT.is_header_line("text").alias("header"), TT.is_route_line("text").alias("route"), B.is_skipped("text").alias("skipped"), B.prices(X.strip("text")).alias("prices"), X.strip("text").rlike(TT.SECTION).alias("section"), X.strip("text").rlike(X.any_case(TT.NOTE)).alias("note"), X.strip("text").rlike(r"\p{L}").alias("letters")).collect()
    assert [r for r in got if any(bool(getattr(TT.Line(r.text), k)) != r[k] for k in ("header", "route", "skipped", "section", "note", "letters")) or TT.Line(r.text).prices != r.prices] == []
    parts = [*lines[:60], *["Phương án làm hàng\nTT Loại container", "Tàu/ Sà lan Bãi", "5", "1.1.4. x", "1.2. y", "Biểu giá dịch vụ tại cảng từ ngày", "Bảng 1", "| a |", "Người ký: a", "Ngày in: b", "Abc", ""] * 8]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(600)]
    frame = docs(spark, *texts)
    want = B.cleaned_special_section(frame).select("document_id", "text", B.is_text_table("text").alias("tables"), B.remove_watermark("text").alias("plain")).collect()
    assert sorted(want) == sorted((*r, TT.without_watermark(r.text)) for r in TT.prepared(frame).collect())
    assert TT.prepared(docs(spark, None)).count() == 0


def test_text_tables_need_no_exchange(spark, monkeypatch):
    """A document is read where it lies, and equal lines are described once a task."""
    frame = docs(spark, *["1. Mục\nBảng 1\n1 Xe 1.000 2.000\n1.1.4. Phụ\n5"] * 40).coalesce(1)
    plans = [TT.prepared(frame), TT.text_bullets(frame), TT.parse_text_tables(frame)]
    assert not any("Exchange" in p or "transform(" in p for p in (x._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "") for x in plans))
    made = []
    monkeypatch.setattr(TT, "Line", lambda raw, line=TT.Line: made.append(raw) or line(raw))
    described = TT.Described()
    for _ in range(40):
        TT.walked(described.lines("1. Mục\nBảng 1\n1 Xe 1.000 2.000"))
    assert len(made) == 3


def test_render_markdown(spark):
    bar = "━" * 80
    text = "# T\n\n\nchữ\nGhi chú: a\nxem lưu ý\nEmail: x\n* m\n## Bảng 1\n| Phương án | Giá |\n|---|---|\n| | 20' |\n| A | 5 |\n\nbỏ\nsau\n<!-- Page 1 -->"
    want = ["T", bar, "", "• chữ", "┃ ⓘ Ghi chú: a", "ⓘ xem lưu ý", "•  m".replace("  ", " "), "Bảng 1", "━" * 8, "", "┃ PHƯƠNG ÁN A", "┣" + "━" * 70, f"┃ • {'Giá 20' + chr(39):25} → 5", "", "• sau"]
    assert B.render_markdown(docs(spark, text)).first().text.split("\n") == want
    assert B.render_markdown(docs(spark, "")).first().text == ""


def test_merge_and_budget(spark):
    rows = spark.createDataFrame([("d", i, 10, "a") for i in range(3)], "document_id string, ord int, token_count int, type string")
    got = C.merge_small(rows, 20, 100).orderBy("ord").collect()
    assert [(r.starts, r.taken) for r in got] == [(True, False), (False, True), (False, False)]
    groups = spark.range(1).select(C.budget_starts(F.array(*map(F.lit, (2, 2, 2, 5, 1, 7, 1))), 5).alias("g")).first().g
    assert groups == [1, 3, 4, 5, 6, 7]


def test_preamble_and_clauses(spark):
    s = schema("regulation")
    chunks = C.level_one(docs(spark, "Mở đầu\nĐiều 5\n5. a\n7. b"), s)
    assert [(r.title, r.type) for r in chunks.orderBy("chunk_ord").collect()] == [("Section 0", "section"), ("Điều 5", "article")]
    assert [r.metadata.clause_number for r in C.level_two(chunks, s).where("type = 'clause'").orderBy("chunk_ord").collect()] == ["1", "2"]


def test_cross_references_lose_nothing(spark):
    """Meeting by equal keys finds what comparing each reference with each chunk finds: parts of ids, beginnings of title words, first chunk first."""
    rng = random.Random(4)
    word = lambda: rng.choice(["Bảng", "bảng", "Điều", "Khoản", "Khoản 2 Điều", "x"]) + rng.choice([" ", "  ", "-"]) + rng.choice(["1", "12", "2", "23-TT.9", "IV", "a1"])
    rows = []
    for i in range(160):
        kind = rng.choice(["table", "article", "clause", "section"])
        number = rng.choice([None, "1", "12", "2", "Bảng 12", "23-TT", "IV"])
        rows.append((f"d{i % 8}", i // 8, f"c{i}", kind, rng.choice([word(), f"{word()} và {word()}", "không", ""]), " ".join(word() + rng.choice([" ", ", ", ". "]) for _ in range(rng.randint(0, 5))), number))
    df = spark.createDataFrame(rows, "document_id string, chunk_ord int, chunk_id string, type string, title string, content string, number string")
    df = df.withColumn("metadata", C.closed({"table_id": F.col("number"), "article_number": F.col("number"), "clause_number": F.col("number")}))
    links = schema("pricing").links + schema("regulation").links
    got = sorted((r.document_id, r.source_chunk_id, r.ord, r.type, r.target_chunk_id) for r in E.cross_references(df, SimpleNamespace(links=links)).collect())

    def ref_id(ref):
        for key, pattern, flags in (("Bảng", r"Bảng\s+([\d\w-]+)", re.I), ("Điều", r"Điều\s+(\d+)", 0), ("Khoản", r"Khoản\s+(\d+)", 0)):
            if key in ref:
                return m.group(1) if (m := re.search(pattern, ref, flags)) else None
        return None

    def answers(c, ref, n):
        id_ = c[6] or ""
        return (c[3] == "table" and n in id_) or (c[3] in ("article", "clause") and id_ == n) or ref.lower() in c[4].lower()

    want = []
    for d, _, c, _, _, text, _ in rows:
        at = 0
        for link in links:
            for m in re.finditer(link["pattern"], text, re.I):
                n = ref_id(m.group())
                hits = [x for x in rows if n and x[0] == d and answers(x, m.group(), n)]
                if hits:
                    want.append((d, c, at, link["type"], min(hits, key=lambda x: x[1])[2]))
                at += 1
    assert got == sorted(want) and len(want) > 100


def test_exception_edges(spark):
    sch = schema("regulation")
    one = C.level_one(docs(spark, "Điều 1\nXem Điều 2\nĐiều 2\nKhông áp dụng cho hàng B."), sch)
    edges = E.domain(one.unionByName(C.level_two(one, sch))).collect()
    assert edges and {r.type for r in edges} == {"exception"} and all("_sub_cond_" in r.target_chunk_id for r in edges)


def test_html():
    assert H.markdown_html("# A\n\nb\nc\n\n- x") == "<h1>A</h1>\n<p>b<br />\nc</p>\n<ul><li>x</li></ul>"


def test_schemas():
    assert set(schemas()) == {"document", "pricing", "regulation"}
    with pytest.raises(ValueError, match="contract"):
        schema("contract")


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    sch = schema("regulation")
    s.save_chunks(C.level_one(docs(spark, "Điều 1\na", "Điều 2\nb"), sch))
    s.save_chunks(C.level_one(docs(spark, "Điều 1\nneu"), sch))
    got = {r.document_id: r.content for r in s.chunks().collect()}
    assert got == {"doc_0": "neu", "doc_1": "b"}
    assert s.delete_document("doc_0") and not s.delete_document("doc_0")
    assert [r.document_id for r in s.chunks().collect()] == ["doc_1"]
    assert store.search(s.chunks(), chunk_type="article", metadata={"heading": "Điều 2"}).count() == 1
    s.compact()
    assert [(r.document_id, r.content) for r in s.chunks().collect()] == [("doc_1", "b")] and s.chunks("doc_1", 1).count() == 1


def test_store_leaves_no_stale_chunks(spark, tmp_path):
    """A document saved again has the new chunks only, whatever levels it had; one without chunks has none; a save without its note doesn't count."""
    s, schema_ = store.Store(spark, str(tmp_path / "store")), "document_id string, chunk_id string, level int"
    s.save_chunks(spark.createDataFrame([("d1", "a", 1), ("d1", "b", 2), ("d2", "c", 2), ("d3", "e", 1)], schema_))
    s.save_chunks(spark.createDataFrame([("d1", "n", 1)], schema_))
    s.save_chunks(spark.createDataFrame([], schema_), spark.createDataFrame([("d3",)], "document_id string"))
    assert sorted(r.chunk_id for r in s.chunks().collect()) == ["c", "n"]
    spark.createDataFrame([("d2", "torn", 1)], schema_).withColumn("prefix", store.prefix("document_id")).write.partitionBy("prefix", "level").parquet(str(tmp_path / "store/chunks/save=9223372036854775807"))
    assert sorted(r.chunk_id for r in s.chunks().collect()) == ["c", "n"] and s.chunks("d2").count() == 1
    s.compact()
    assert sorted(r.chunk_id for r in s.chunks().collect()) == ["c", "n"] and s.chunks("d1", 2).count() == 0


def test_nearest_tables_by_order(spark):
    """Against each-with-each, on crowded pages with equal places; headings and tables aren't paired."""
    rng = random.Random(4)
    heads = [(f"d{i % 2}", rng.randint(0, 4), i, rng.randint(0, 60) / 2) for i in range(300)] + [("d9", 1, 999, 1.0), ("d0", 40, 998, 1.0)]
    tables = [(f"d{i % 2}", rng.randint(0, 4), i, rng.randint(0, 60) / 2) for i in range(60)]
    h = spark.createDataFrame(heads, "document_id string, page int, heading_id long, y double")
    t = spark.createDataFrame(tables, "document_id string, page int, table_id long, y double")
    found = P.nearest_tables(h, t)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for d, page, heading, y in heads:
        near = [(abs(page - p) * 10_000 + abs(y - z), i) for e, p, i, z in tables if e == d and abs(page - p) <= 1]
        if near:
            want[d, heading] = min(near)
    assert {(r.document_id, r.heading_id): (r.distance, r.table_id) for r in found.collect()} == want and len(want) == 300


def test_match_tables_against_a_scan(spark):
    """Each heading takes the best free table of all; documents go in batches, not each to a call of its own."""
    rng = random.Random(5)
    heads = [(f"d{i % 3}", rng.randint(0, 3), i, rng.randint(0, 20) / 2) for i in range(150)] + [("d9", 1, 999, 1.0)]
    tables = [(f"d{i % 3}", rng.randint(0, 3), i, rng.randint(0, 20) / 2) for i in range(120)]
    h = spark.createDataFrame(heads, "document_id string, page int, heading_id long, y double")
    t = spark.createDataFrame(tables, "document_id string, page int, table_id long, y double")
    found = P.match_tables(h, t)
    assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()
    want, used = {}, set()
    for d, page, heading, y in heads:
        near = [(abs(page - p) * 10_000 + abs(y - z), i) for e, p, i, z in tables if e == d and abs(page - p) <= 1 and i not in used]
        if near:
            want[d, heading] = min(near)
            used.add(min(near)[1])
    assert {(r.document_id, r.heading_id): (r.distance, r.table_id) for r in found.collect()} == want


def test_edges_from_traits_in_one_pass(spark, monkeypatch):
    """Both levels in one pass have the ids, order and texts of the two steps; edges of traits, with asked keys in short lists, are those of whole chunks."""
    s = schema("pricing")
    text = "### I. A\nĐơn vị: VND\n### Bảng 7\n| TT | Hàng | 20' | 40' HC | Giá VND |\n| --- | --- | --- | --- | --- |\n| 1 | Phụ thu P1 | 2 | 3 | 5 |\n| 2 | P2 | 4 | 5 | 6 |\nGhi chú: phụ thu theo Bảng 7, xem Bảng 8"
    one = C.level_one(docs(spark, text, "### X\ntheo Bảng 9"), s).localCheckpoint()
    both = one.unionByName(C.level_two(one, s)).localCheckpoint()
    columns = ["document_id", "chunk_ord", "chunk_id", "type", "title", "content", "relationships"]
    rows = C.both_levels(one, s, E.FIELDS)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(C.numbered(rows).select(columns)) == key(both.select(columns))
    want = key(E.map_relationships(both, s))
    assert len(want) > 5
    monkeypatch.setattr(E, "MOST_KEYS", 1)
    narrow = C.numbered(E.traits(rows, s, "from", "no"))
    assert "content" not in narrow.columns
    assert key(E.map_relationships(narrow, s)) == want


@pytest.mark.parametrize(("kind", "limits"), [("pricing", {}), ("pricing", {"first_min": 12, "first_max": 20}), ("regulation", {}), ("regulation", {"first_min": 3, "first_max": 9}), ("document", {})])
def test_edges_of_whole_documents(spark, monkeypatch, kind, limits):
    """Random documents: one pass over each finds the edges that the Column forms find in steps, in every column; also where references meet chunks by an index."""
    rng = random.Random(5)
    bits = ["Bảng 1", "BẢNG 2", "bảng\u00a012", "Bảng IV", "Bảng 23-TT", "Bảng: 4", "Table 3: Giá", "Bảng 1: Đơn giá", "phụ thu", "Phụ Thu theo", "cộng thêm", "Điều chỉnh", "ngoài trừ", "NGOÀI TRỪ", "không áp dụng", "tại khoản 3", "Điều 1", "Điều 2", "Khoản 2 Điều 1", "Khoản\u20032", "điểm a", "Nghị định 12/2020", "tính theo", "nếu", "Khi", "với điều kiện", "là", "bao gồm", "x", "Y.", ". ", "; ", "20'", "40' HC", "\x1c", "\u2028", "\r", "\u0301", "²", "İ", "ı", "ſ", "Κ", "Σ", "1", "7", "-", "sửa đổi theo Điều 2", "thực hiện theo Mục 1"]
    said = lambda n: " ".join(rng.choices(bits, k=rng.randint(0, n)))
    line = lambda: rng.choice(["", "### ", "# ", "I. ", "1. ", "2. ", "Điều 1 ", "Điều 2 ", "Điều 3\n", "Chương I ", "Mục 1 ", "Khoản 1 ", "### Bảng 1", "### Bảng 12\n", "", "", ""]) + said(4)
    row = lambda: "| " + " | ".join(said(2).replace("\n", " ") for _ in range(rng.randint(1, 4))) + rng.choice([" |", " |", " |\u2028", "|\t", ""])
    table_ = lambda: "\n".join([rng.choice(["| TT | 20' | 40' HC | 20' |", "| a | Giá 45'DC |", row()]), rng.choice(["| --- | :-: | --- |", row()]), *(row() for _ in range(rng.randint(0, 4)))])
    texts = ["\n".join(rng.choice([line, line, line, table_, lambda: ""])() for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None]
    rules = dataclasses.replace(schema(kind), limits=limits or schema(kind).limits)
    frame = docs(spark, *texts)
    steps = C.numbered(E.traits(C.both_levels(C.level_one(frame, rules), rules, E.FIELDS), rules, "from", "no").localCheckpoint())
    want = sorted(map(str, E.map_relationships(steps, rules).select(*E.EDGE).collect()))
    assert len(want) > (300 if kind != "document" else 0)
    assert sorted(map(str, DE.document_edges(frame, rules).collect())) == want
    monkeypatch.setattr(DE, "MOST_COMPARED", 0)
    compiled = DE.Rules(rules)
    got = [(f"doc_{i}", n, c, *e) for i, t in enumerate(texts[:-1]) for n, c, edges in DE.edges_of(f"doc_{i}", t, compiled) for e in edges]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in DE.document_edges(frame, rules).collect())
    counts = DE.edge_counts(frame, rules)
    assert sorted(map(tuple, counts.collect())) == sorted((d, t, n) for (d, t), n in Counter((r[0], r[5]) for r in got).items())
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "transform(" not in plan
