"""Documents into table parts: each `### Bảng n` heading takes the next table, tables are cut into parts, and every part
carries the section headings above it. Set-based: as-of look-ups, islands and forward fills; no loop over lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lathe.functions.text import strip
from lathe.operators.lines import by_line, doc_lines, next_where, ordered

# Heading patterns, the size from which tables are cut, rows a part, and the separator line.
TABLE_HEADING = r"(?iuU)###\s+Bảng\s+(\d+[a-z]*)"
#: Words of table cells that a broken table leaves as lines, in lower case.
ORPHANS = ("container khô", "container lạnh", "tàu/sà lan", "phương án", "20'", "40'", "45'", "20\u2019", "40\u2019", "45\u2019", "tt", "tàu/", "bãi", "xe  bãi", "giao/nhận", "loại container", "imdg", "oog")
LEVELS = {"muc_chinh": r"(?U)^([IVX]+\.|[A-Z]\.)\s+(.+)$", "muc_cap_1": r"(?U)^(1\.)\s+(.+)$", "muc_cap_2": r"(?U)^(1\.1\.)\s+(.+)$", "muc_cap_3": r"(?U)^(1\.1\.1\.)\s+(.+)$"}
ANY_NUMBER = {"muc_chinh": LEVELS["muc_chinh"], "muc_cap_1": r"(?U)^(\d+\.)\s+(.+)$", "muc_cap_2": r"(?U)^(\d+\.\d+\.)\s+(.+)$", "muc_cap_3": r"(?U)^(\d+\.\d+\.\d+\.)\s+(.+)$"}
CUT_FROM, ROWS_A_PART = 5, 5
SEPARATOR = "| --- | --- | --- | --- | --- | --- | --- |"


def counted(rows: Column) -> Column:
    """TBL15: rows with a non-empty first cell and no separator in them."""
    return F.size(F.filter(rows, lambda r: ~F.contains(r, F.lit("---")) & (F.size(F.split(r, r"\|", -1)) > 2) & (strip(F.get(F.split(r, r"\|", -1), F.lit(1))) != "")))


def formatted(header: Column, rows: Column) -> Column:
    """TBL17."""
    return F.when(F.size(rows) == 0, header).otherwise(F.concat_ws("\n", F.concat(F.array(header, F.lit(SEPARATOR)), rows)))


def headed_tables(docs: DataFrame, any_number: bool = False) -> DataFrame:
    """A row a kept heading: document_id, line_no, ten_bang, header, rows, tieu_de_muc."""
    lines = doc_lines(docs)
    pipe = F.startswith(strip("line"), F.lit("|"))
    lines = lines.withColumn("pipe", pipe).withColumn("number", F.regexp_extract("line", TABLE_HEADING, 1)).withColumn("nxt", next_where(F.col("pipe")))
    head = (F.col("number") != "") & F.col("nxt").isNotNull()
    lines = lines.withColumn("kept", head & (F.row_number().over(W.partitionBy("document_id", "nxt", head).orderBy("line_no")) == 1))
    # what a kept heading consumes: from itself to the end of the run of pipe lines after the header and its separator
    lines = lines.withColumn("follows", F.lead("line").over(by_line()))
    lines = lines.withColumn("stop", F.first(F.when(~F.col("pipe"), F.col("line_no")), ignorenulls=True).over(by_line().rowsBetween(0, W.unboundedFollowing)))
    opened = F.last(F.when(F.col("kept"), F.struct(F.col("line_no").alias("at"), F.col("nxt").alias("nxt"))), ignorenulls=True)
    lines = lines.withColumn("open", opened.over(by_line().rowsBetween(W.unboundedPreceding, 0)))
    header_follows = F.max(F.when(F.col("line_no") == F.col("open.nxt"), F.col("follows"))).over(W.partitionBy("document_id", "open.at"))
    lines = lines.withColumn("first_row", F.col("open.nxt") + F.when(F.contains(F.coalesce(header_follows, F.lit("")), F.lit("---")), 2).otherwise(1))
    # rows: pipe lines from first_row on without a break
    run = F.max(F.when((F.col("line_no") >= F.col("first_row")) & ~F.col("pipe"), 1).otherwise(0)).over(W.partitionBy("document_id", "open.at").orderBy("line_no"))
    lines = lines.withColumn("row", (F.col("line_no") >= F.col("first_row")) & F.col("pipe") & (run == 0))
    end = F.max(F.when(F.col("row"), F.col("line_no"))).over(W.partitionBy("document_id", "open.at"))
    inside = F.col("open").isNotNull() & (F.col("line_no") > F.col("open.at")) & (F.col("line_no") <= F.coalesce(end, F.col("first_row") - 1))
    lines = lines.withColumn("inside", inside)

    text = strip(F.replace("line", F.lit("###"), F.lit("")))
    usable = F.startswith("line", F.lit("###")) & ~F.col("inside") & (F.length(text) <= 250) & (text != "")
    levels, level = ANY_NUMBER if any_number else LEVELS, None
    for k, p in enumerate(levels.values()):
        level = F.when(text.rlike(p), k) if level is None else level.when(text.rlike(p), k)
    lines = lines.withColumn("level", F.when(usable, level)).withColumn("title", text)
    for k, name in enumerate(levels):
        at = F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(by_line().rowsBetween(W.unboundedPreceding, 0))
        lines = lines.withColumn(name, at)
    above, names = F.lit(-1), []
    for name in levels:
        names.append(F.when(F.col(f"{name}.line_no") > above, F.col(f"{name}.title")).alias(name))
        above = F.greatest(above, F.coalesce(F.col(f"{name}.line_no"), F.lit(-1)))
    lines = lines.withColumn("tieu_de_muc", F.struct(*names))

    of = lines.where("open is not null").groupBy("document_id", F.col("open.at").alias("line_no"))
    return of.agg(
        F.concat(F.lit("Bảng "), F.min_by("number", "line_no")).alias("ten_bang"), F.max(F.when(F.col("line_no") == F.col("open.nxt"), F.col("line"))).alias("header"),
        ordered(F.when(F.col("row"), F.col("line"))).alias("rows"), F.min_by("tieu_de_muc", "line_no").alias("tieu_de_muc"),
    ).withColumn("rows", F.filter("rows", lambda r: r.isNotNull()))


def split_tables(docs: DataFrame, any_number: bool = False) -> DataFrame:
    """TBL13-17: document_id, line_no (of the heading), part, ten_bang, phan_so, tieu_de_muc, so_hang_du_lieu, noi_dung_bang."""
    tables = headed_tables(docs, any_number).withColumn("n", counted(F.col("rows")))
    parts = F.when(F.col("n") < CUT_FROM, 1).otherwise(F.floor((F.col("n") + ROWS_A_PART - 1) / ROWS_A_PART)).cast("int")
    tables = tables.withColumn("parts", parts).withColumn("k", F.floor(F.size("rows") / F.col("parts")).cast("int"))
    each = tables.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    last = F.col("part") == F.col("parts") - 1
    rows = F.slice("rows", F.col("part") * F.col("k") + 1, F.when(last, F.size("rows") - F.col("part") * F.col("k")).otherwise(F.col("k")))
    each = each.withColumn("own", rows)
    return each.select("document_id", "line_no", "part", "ten_bang", F.concat_ws("/", (F.col("part") + 1).cast("string"), F.col("parts").cast("string")).alias("phan_so"), "tieu_de_muc", counted(F.col("own")).alias("so_hang_du_lieu"), formatted(F.col("header"), F.col("own")).alias("noi_dung_bang"))


def reordered_tables(docs: DataFrame) -> DataFrame:
    """MD3: document_id, text from the heading of section II on (if there is one), with the k-th table after the k-th table heading; tables that are left come last.

    A table is a pipe line with the pipe and blank lines after it."""
    line = F.col("line")
    lines = doc_lines(docs).withColumn("second", F.contains("line", F.lit("### II.")) | (F.contains("line", F.lit("### II")) & F.contains("line", F.lit("CƯỚC"))))
    whole = W.partitionBy("document_id")
    lines = lines.withColumn("start", F.min(F.when(F.col("second"), F.col("line_no"))).over(whole))
    kept = lines.where("start is null or line_no >= start").withColumn("pipe", F.startswith("line", F.lit("|")))
    so_far = by_line().rowsBetween(W.unboundedPreceding, 0)
    inside = F.last(F.when(F.col("pipe") | (strip("line") != ""), F.col("pipe")), ignorenulls=True).over(so_far)
    kept = kept.withColumn("table", F.col("start").isNotNull() & F.coalesce(inside, F.lit(False)))
    kept = kept.withColumn("run", F.col("line_no") - F.row_number().over(by_line("table")))
    tables = kept.where("table").groupBy("document_id", "run").agg(F.min("line_no").alias("first"), F.array_join(F.concat(F.array(F.lit("")), ordered("line")), "\n").alias("block"))
    tables = tables.select("document_id", F.row_number().over(W.partitionBy("document_id").orderBy("first")).alias("k"), "block")
    others = kept.where(~F.col("table"))
    heading = F.col("start").isNotNull() & F.startswith("line", F.lit("###")) & F.contains("line", F.lit("### Bảng"))
    others = others.withColumn("k", F.when(heading, F.sum(heading.cast("int")).over(so_far)))
    placed = others.join(tables, ["document_id", "k"], "left").select("document_id", "line_no", F.concat_ws("\n", line, "block").alias("text"))
    rest = tables.join(others.where("k is not null").select("document_id", "k"), ["document_id", "k"], "left_anti")
    rest = rest.select("document_id", (F.col("k") + F.lit(1 << 30)).cast("int").alias("line_no"), F.col("block").alias("text"))
    return placed.unionByName(rest).groupBy("document_id").agg(F.array_join(ordered("text"), "\n").alias("text"))


def without_orphans(docs: DataFrame, least: int = 5, reach: int = 5, short: int = 50) -> DataFrame:
    """MD4: document_id, text without what a broken table left: after a unit heading (within `reach` lines) a short line of table words or numbers
    that begins `least` such lines before the next other one, and those that follow it without a gap."""
    text = strip("line")
    lower = F.lower(text)
    plain = F.regexp_replace(lower, r"(?U)\s+", " ")
    digits = F.replace(F.regexp_replace(lower, "[., ]", ""), F.lit("000"), F.lit(""))
    lines = doc_lines(docs).withColumn("filled", text != "").withColumn("mark", text.rlike("^[#|]"))
    lines = lines.withColumn("like", F.col("filled") & ~F.col("mark") & (plain.rlike("|".join(map(re.escape, ORPHANS))) | digits.rlike(r"^\d+$")))
    unit = F.contains(F.lower("line"), F.lit("đơn vị tính")) & F.startswith(text, F.lit("###"))
    near = F.coalesce(F.max(unit.cast("int")).over(by_line().rowsBetween(-reach, -1)), F.lit(0)) == 1
    lines = lines.withColumn("near", near).withColumn("other", (F.col("filled") & ~F.col("like")).cast("int"))
    lines = lines.withColumn("part", F.sum("other").over(by_line().rowsBetween(W.unboundedPreceding, 0)))
    ahead = F.sum(F.col("like").cast("int")).over(by_line("part").rowsBetween(0, W.unboundedFollowing))
    lines = lines.withColumn("begins", F.col("like") & F.col("near") & (F.length(lower) < short) & (ahead >= least))
    lines = lines.withColumn("run", F.col("line_no") - F.row_number().over(by_line("like")))
    gone = F.col("like") & (F.max(F.col("begins").cast("int")).over(by_line("like", "run").rowsBetween(W.unboundedPreceding, 0)) == 1)
    return lines.withColumn("gone", gone).where(~F.col("gone")).groupBy("document_id").agg(F.array_join(ordered("line"), "\n").alias("text"))
