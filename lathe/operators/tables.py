"""Markdown tables in lines of text: runs, cells, captions, kinds, and what can be asked of a parsed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lathe.functions.text import CONTAINER, any_case, col, first_match, strip
from lathe.operators.lines import by_line, doc_lines, is_separator_row, is_table_row, islands, ordered

# Captions and ids of tables, and header words of each kind, in order of precedence.
CAPTIONS = (r"Bảng\s+(?:\d+|[IVX]+|[\d-]+):\s*(.+)", r"Bảng\s+(?:\d+|[IVX]+|[\d-]+)\s*[:\-]\s*(.+)", r"Table\s+\d+:\s*(.+)")
TABLE_ID = r"(Bảng\s+(?:\d+|[IVX]+|[\d-]+(?:-[A-Z]+)?))"
TABLE_KINDS = {
    "pricing": ("giá", "cước", "phí", "vnd", "usd", "eur", "cost", "price"),
    "schedule": ("ngày", "tháng", "thời gian", "date", "time"),
    "comparison": ("so sánh", "trước", "sau", "before", "after"),
    "data": ("số liệu", "thống kê", "tỷ lệ", "data", "statistics"),
}


def cells(line: Column | str) -> Column:
    """TBL3: stripped, outer bars dropped, split, each cell stripped."""
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\||\|$", ""), r"\|", -1), strip)


def table_lines(lines: DataFrame) -> DataFrame:
    """lines with table: the first line_no of the table run (two rows or more) that a line is in, else null. TBL1, PRD5."""
    runs = islands(lines, is_table_row("line"), "run")
    of = W.partitionBy("document_id", "run")
    start = F.when(F.col("run").isNotNull() & (F.count(F.lit(1)).over(of) >= 2), F.min("line_no").over(of))
    return runs.withColumn("table", start).drop("run")


def parse_tables(docs: DataFrame, before: int = 3, after: int = 1) -> DataFrame:
    """TBL1-7: a row a table: document_id, table_idx, start_line, end_line, context_before, context_after, headers, rows, row_count, column_count, caption, table_id, table_type, container_columns."""
    return tables_of(table_lines(doc_lines(docs)), before, after)


def tables_of(lines: DataFrame, before: int = 3, after: int = 1) -> DataFrame:
    # the lines around a table are wanted at its first and last line only
    first, last = F.col("line_no") == F.col("table"), ~F.lead("table").over(by_line()).eqNullSafe(F.col("table"))
    near = lambda step, ns: F.array_compact(F.array(*(step("line", n).over(by_line()) for n in ns)))
    near_by = lines.withColumn("above", F.when(first, near(F.lag, range(before, 0, -1)))).withColumn("below", F.when(last, near(F.lead, range(1, after + 1))))
    rows = near_by.where("table is not null").groupBy("document_id", F.col("table").alias("start_line")).agg(
        F.max("line_no").alias("end_line"), ordered("line").alias("raw"), F.any_value("above", True).alias("above"), F.any_value("below", True).alias("below")
    )
    head = F.element_at("raw", 1)
    body = F.when(is_separator_row(F.element_at("raw", 2)), F.slice("raw", 3, F.size("raw"))).otherwise(F.slice("raw", 2, F.size("raw")))
    out = rows.select(
        "document_id", (F.row_number().over(W.partitionBy("document_id").orderBy("start_line")) - 1).alias("table_idx"), "start_line", "end_line",
        F.array_join("above", "\n").alias("context_before"), F.array_join("below", "\n").alias("context_after"), cells(head).alias("headers"), F.transform(body, cells).alias("rows"),
    )
    return out.withColumns({
        "row_count": F.size("rows"), "column_count": F.size("headers"), "caption": caption("context_before"), "table_id": table_id("context_before"),
        "table_type": table_type("headers"), "container_columns": container_columns("headers"),
    })


def caption(context: Column | str) -> Column:
    """TBL5: of the last three lines, the nearest first; in each the patterns in order."""
    lines = F.reverse(F.slice(F.reverse(F.split(strip(context), "\n")), 1, 3))
    found = F.transform(F.reverse(lines), lambda x: F.coalesce(*(strip(first_match(x, any_case(p), 1)) for p in CAPTIONS)))
    return F.get(F.filter(found, lambda c: c.isNotNull()), F.lit(0))


def table_id(context: Column | str) -> Column:
    """TBL6."""
    return first_match(context, any_case(TABLE_ID), 1)


def table_type(headers: Column | str) -> Column:
    """TBL7."""
    joined = F.array_join(F.transform(col(headers), F.lower), " ")
    out = None
    for kind, words in TABLE_KINDS.items():
        hit = joined.rlike("|".join(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def container_columns(headers: Column | str) -> Column:
    """TBL8: map of container type to the last column (from 0) whose header has it."""
    found = F.filter(F.transform(col(headers), lambda h, i: F.struct(first_match(h, CONTAINER).alias("k"), i.alias("v"))), lambda s: s["k"].isNotNull())
    last = F.filter(found, lambda s: ~F.exists(found, lambda o: (o["k"] == s["k"]) & (o["v"] > s["v"])))
    return F.map_from_arrays(F.transform(last, lambda s: s["k"]), F.transform(last, lambda s: s["v"]))


def group_rows(tables: DataFrame, column: int) -> DataFrame:
    """TBL9: document_id, table_idx, key (stripped cell), rows; shorter rows are left out."""
    each = tables.select("document_id", "table_idx", F.posexplode("rows").alias("row_no", "row")).where(F.size("row") > column)
    return each.groupBy("document_id", "table_idx", strip(F.get("row", F.lit(column))).alias("key")).agg(ordered("row", "row_no").alias("rows"))


def numeric_cells(tables: DataFrame) -> DataFrame:
    """TBL10: document_id, table_idx, row_no, col_no, value of cells that are numbers without separators."""
    rows = tables.select("document_id", "table_idx", F.posexplode("rows").alias("row_no", "row"))
    each = rows.select("document_id", "table_idx", "row_no", F.posexplode("row").alias("col_no", "cell"))
    value = F.regexp_replace("cell", "[,. ]", "").try_cast("double")
    return each.withColumn("value", value).where("value is not null").drop("cell")


def row_maps(headers: Column | str = "headers", rows: Column | str = "rows") -> Column:
    """TBL11: a map a row; short rows are padded with '', of equal headers the last counts."""
    heads = col(headers)

    def one(row):
        pairs = F.transform(heads, lambda h, i: F.struct(h.alias("k"), F.coalesce(F.get(row, i), F.lit("")).alias("v"), i.alias("i")))
        last = F.filter(pairs, lambda s: ~F.exists(pairs, lambda o: (o["k"] == s["k"]) & (o["i"] > s["i"])))
        return F.map_from_arrays(F.transform(last, lambda s: s["k"]), F.transform(last, lambda s: s["v"]))

    return F.transform(col(rows), one)


def to_markdown(headers: Column | str = "headers", rows: Column | str = "rows") -> Column:
    """TBL12."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    dashes = F.transform(col(headers), lambda h: F.lit("---"))
    return F.concat_ws("\n", F.concat(F.array(line(col(headers)), line(dashes)), F.transform(col(rows), line)))


def find_table(tables: DataFrame, wanted: str) -> DataFrame:
    """JOIN14: in each document the first table whose context has the id, in any case."""
    hit = tables.where(F.contains(F.lower("context_before"), F.lit(wanted.lower())))
    return hit.withColumn("__n", F.row_number().over(W.partitionBy("document_id").orderBy("table_idx"))).where("__n = 1").drop("__n")


def matching_rows(rows: Column | str, pattern: str) -> Column:
    """PRD15: rows whose cells, joined by spaces, match in any case."""
    return F.filter(col(rows), lambda r: F.array_join(r, " ").rlike(any_case(pattern)))
