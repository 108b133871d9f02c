"""Boxed bullet renderings of markdown, as Column expressions and windows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lathe.functions.text import any_case, col, strip
from lathe.operators.lines import by_line, doc_lines, ordered

BAR = "━"
# Words of lines that are left out (the last one only in text without pipe tables), running marks and
# footers, words of note rows, and artefact patterns of cells.
SKIPPED = (
    "người in:", "người ký:", "thời gian", "thủ trưởng", "ban chỉ huy", "ct/tgđ", "email", ".vn", "điện thoại",
    "ngày in:", "fax:", "địa chỉ:", "tổng công ty", "biểu giá dịch vụ tại cảng",
)
PAGE_MARKS, FOOTER = ("[Image on page", "<!-- Page"), ("Biểu giá dịch vụ tại cảng Tân Cảng", "từ ngày")
# Of section 1.1.4: the repeated column heads, the running footer, and what stands for a line of routes. Begins of watermarks.
REPEATED_HEAD, FOOTER_OF_PAGE = ("Phương án làm hàng", "TT Loại container"), ("Biểu giá dịch vụ tại cảng", "từ ngày")
ROUTES = ("Từ tàu hoặc sà lan đến bãi hoặc từ bãi xuống tàu hoặc sà lan", "Từ xe xuống bãi hoặc từ bãi lên xe")
WATERMARKS = (r"Người\s+(?:in|ký)", r"Ngày\s+in")
REMARKS = ("ghi chú", "chú ý", "lưu ý", "cụ thể")
NOTES = ("cước", "ghi chú", "chú ý", "lưu ý", "quy định", "được")
ARTEFACTS = (r"in\s*:\s*$", r"ờ\s*i\s*$", r"ừ.*ng\s*$", r"ịn\s*r\s*T\s*$", r"@\s*k\s*")


def let(value: Column, then) -> Column:
    """then(value) with value computed once; nested conditions on a long expression would repeat it at every mention."""
    return F.element_at(F.transform(F.array(value), then), 1)


def arrow(text: Column | str) -> Column:
    """BUL7: arrows between places as phrases; two-way, then down, then up; else the text with ASCII arrows of the last tried kind."""
    boat = "Tàu|Sà lan"
    has = lambda t, x: F.contains(t, F.lit(x))

    def sides(t, sign, then, other):
        """then(left, right) if the text has the sign once and then isn't null, else other."""
        return let(F.split(t, sign), lambda p: F.coalesce(F.when(has(t, sign) & (F.size(p) == 2), then(F.get(p, F.lit(0)), F.get(p, F.lit(1)))), other))

    up = lambda t: sides(t, "<-", lambda a, b: F.when(has(a, "Bãi"), F.when(has(b, "Xe"), "Từ bãi lên xe").when(b.rlike(boat), "Từ bãi lên tàu hoặc sà lan")), t)
    down = lambda t: sides(t, "->", lambda a, b: F.when(has(b, "Bãi"), F.when(has(a, "Xe"), "Xe xuống bãi").when(a.rlike(boat), "Tàu hoặc sà lan đến bãi")), let(F.replace(t, F.lit("←"), F.lit("<-")), up))
    two = lambda t: sides(t, "<->", lambda a, b: F.when(has(a, "Xe"), "Xe xuống bãi hoặc từ bãi lên xe").when(a.rlike(boat), "Tàu hoặc sà lan đến bãi hoặc từ bãi lên tàu hoặc sà lan"), let(F.replace(t, F.lit("→"), F.lit("->")), down))
    return let(F.replace(col(text), F.lit("↔"), F.lit("<->")), two)


def heading_lines(line: Column | str) -> Column:
    """BUL5: the lines that a heading becomes, by its level."""

    def shown(s):
        level, title = s["level"], s["title"]
        n = F.length(title)
        return (
            F.when(level == 1, F.array(title, F.lit(BAR * 80), F.lit("")))
            .when(level == 2, F.array(F.lit(""), title, F.repeat(F.lit(BAR), F.least(n + 2, F.lit(80))), F.lit("")))
            .when(level == 3, F.array(title, F.repeat(F.lit(BAR), F.least(n, F.lit(80)))))
            .otherwise(F.array(F.concat(F.repeat(F.lit("  "), level - 3), F.lit("• "), title)))
        )

    parsed = lambda x: F.struct(F.length(F.regexp_extract(x, "^(#*)", 1)).alias("level"), arrow(strip(F.regexp_replace(x, "^#+", ""))).alias("title"))
    return let(strip(line), lambda x: let(parsed(x), shown))


def bullet_line(line: Column | str) -> Column:
    """BUL6."""
    line = col(line)
    return F.when(strip(line).rlike(r"^[*+]"), F.concat(F.lit("•"), F.substring(strip(line), 2, F.length(line)))).otherwise(line)


def spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_header(text: Column) -> Column:
    """BUL9."""
    return spaces(F.regexp_replace(text, r"[a-z]\n[a-z]|[A-Z]\s+[a-z]", ""))


def clean_cell(text: Column) -> Column:
    """BUL9."""
    out = spaces(F.regexp_replace(F.regexp_replace(text, r"[a-z]\n[a-z]", ""), r"[A-Z]\s+[a-z]\s+[A-Z]", ""))
    for p in ARTEFACTS:
        out = F.regexp_replace(out, any_case(p), "")
    return strip(out)


def prices(line: Column | str) -> Column:
    """BUL18: numbers of four characters or more, or with a dot."""
    return F.filter(F.regexp_extract_all(col(line), F.lit(r"\d[\d.]*"), F.lit(0)), lambda p: (F.length(F.replace(p, F.lit("."), F.lit(""))) >= 4) | F.contains(p, F.lit(".")))


def text_and_prices(line: Column | str) -> Column:
    """BUL19: what comes before the first digit, and the prices."""
    line = col(line)
    return F.struct(strip(F.when(F.size(prices(line)) > 0, F.regexp_extract(line, r"^([^\d]*)", 1)).otherwise(line)).alias("text"), prices(line).alias("prices"))


def raw_cells(row: Column) -> Column:
    p = F.split(row, r"\|", -1)
    return F.transform(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), strip)


def boxes(rows: Column | str) -> Column:
    """BUL8: lines of boxed options of a table's raw rows (array of strings)."""
    nothing = F.array().cast("array<string>")

    def layout(rows):
        where = F.array_position(F.transform(F.slice(rows, 2, 3), lambda r: F.contains(r, F.lit("---"))), F.lit(True)).cast("int")
        sep = F.when(where > 0, where)  # the row's index from 0
        return F.struct(rows.alias("rows"), sep.alias("sep"), F.get(rows, sep + 1).alias("below"), F.transform(raw_cells(F.get(rows, F.lit(0))), clean_header).alias("main"))

    def headed(t):
        below = t["below"]
        filled = F.exists(raw_cells(below), lambda c: c != "")
        multi = F.coalesce(below.isNotNull() & (below.rlike("\\d+['ʼ\u2019]") | below.rlike("[Tt]àu|[Ss]à lan|[Bb]ãi|[Xx]e") | (filled & (t["sep"] == 1))), F.lit(False))
        sub = F.when(multi, F.transform(raw_cells(below), clean_header)).otherwise(nothing)
        return F.struct(t["rows"].alias("rows"), t["main"].alias("main"), sub.alias("sub"), F.when(multi, t["sep"] + 2).otherwise(2).alias("first"), multi.alias("multi"))

    def combined(t):
        def one(h, i):
            s = F.coalesce(F.get(t["sub"], i), F.lit(""))
            over = F.coalesce(F.try_element_at(F.filter(F.slice(t["main"], 1, i + 1), lambda x: x != ""), F.lit(-1)), F.lit(""))
            return let(F.struct(s.alias("s"), over.alias("o")), lambda z: F.when(z["s"] != "", F.when(z["o"] != "", F.concat_ws(" ", z["o"], z["s"])).otherwise(z["s"])).otherwise(h))

        main = t["main"]
        tt = F.contains(F.coalesce(F.get(main, F.lit(0)), F.lit("")), F.lit("TT"))
        kind = F.lower(F.coalesce(F.get(main, F.lit(1)), F.lit(""))).rlike("loại|container")
        plan = F.exists(main, lambda h: F.contains(F.lower(h), F.lit("phương")))
        return F.struct(
            t["rows"].alias("rows"), t["first"].alias("first"), F.when(t["multi"], F.transform(main, one)).otherwise(main).alias("heads"),
            F.when(tt & kind & plan, 2).when((tt | kind) & plan, 1).otherwise(0).alias("action"), F.when(tt & kind & plan, 1).when(~tt & kind & plan, 0).alias("kind"), F.when(tt & plan, 0).alias("number"),
        )

    def listing(t):
        def option(row):
            return let(raw_cells(row), lambda cells: let(parts(row, cells), lambda p: shown(cells, p)))

        def parts(row, cells):
            at = lambda i: F.coalesce(F.get(cells, i), F.lit(""))
            usable = ~F.contains(row, F.lit("---")) & (F.size(cells) >= 2) & F.exists(cells, lambda c: c != "")
            rest = F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0)))
            note = (at(F.lit(0)) == "") & (at(F.lit(1)) == "") & F.exists(rest, lambda c: c != "") & F.lower(F.array_join(cells, "")).rlike("|".join(NOTES))
            box = F.when(t["kind"].isNotNull(), at(t["kind"])).otherwise("")
            number = F.when(t["number"].isNotNull(), at(t["number"])).otherwise("")
            return F.struct(usable.alias("usable"), note.alias("note"), arrow(clean_cell(at(t["action"]))).alias("action"), arrow(clean_cell(box)).alias("box"), number.alias("number"))

        def shown(cells, p):
            action, box, number = p["action"], p["box"], p["number"]
            title = F.when(box != "", F.when(number != "", F.concat(number, F.lit(": "), box)).otherwise(box)).otherwise(F.when(action != "", action).otherwise("Phương án"))
            top = F.concat(F.when(F.startswith(title, F.lit("PHƯƠNG ÁN")), F.lit("┃ ")).otherwise(F.lit("┃ PHƯƠNG ÁN ")), title)
            extra = F.when((box != "") & (action != ""), F.array(F.concat(F.lit("┃ • Phương án làm hàng    → "), action))).otherwise(nothing)
            priced = lambda c, i: F.when((i > t["action"]) & (i < F.size(t["heads"])) & (c != ""), F.concat(F.lit("┃ • "), padded(F.get(t["heads"], i), 25), F.lit(" → "), clean_cell(c)))
            listed = F.filter(F.transform(cells, priced), lambda x: x.isNotNull())
            gap = lambda xs: F.when((F.size(xs) > 0) | (box != ""), F.concat(xs, F.array(F.lit("")))).otherwise(xs)
            body = F.when((action != "") | (box != ""), F.concat(F.array(top, F.lit("┣" + BAR * 70)), extra, let(listed, gap))).otherwise(nothing)
            noted = F.array(F.concat(F.lit("ⓘ "), F.array_join(F.filter(cells, lambda c: c != ""), " ")), F.lit(""))
            return F.when(~p["usable"], nothing).when(p["note"], noted).otherwise(body)

        data = F.slice(t["rows"], t["first"] + 1, F.greatest(F.size(t["rows"]) - t["first"], F.lit(0)))
        return F.flatten(F.transform(data, option))

    rows = col(rows)
    return F.when(F.size(rows) >= 2, let(layout(rows), lambda a: let(headed(a), lambda b: let(combined(b), listing)))).otherwise(nothing)


def padded(text: Column, n: int) -> Column:
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(n) - F.length(text), F.lit(0))))


def mentions(text: Column, words) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def is_skipped(line: Column | str, markdown: bool = False) -> Column:
    """PRD11; PRD12 for lines of markdown."""
    return mentions(F.lower(col(line)), SKIPPED[:-1] if markdown else SKIPPED)


def is_marker(line: Column | str) -> Column:
    """PRD13: page and image markers, and the running footer."""
    return mentions(col(line), PAGE_MARKS) | (F.contains(col(line), F.lit(FOOTER[0])) & F.contains(col(line), F.lit(FOOTER[1])))


def is_text_table(text: Column | str) -> Column:
    """PRD14: table titles but no pipe lines."""
    return col(text).rlike(r"(?m)^\s*Bảng\s+\d+") & ~col(text).rlike(r"(?m)^\s*\|")


def remove_watermark(text: Column | str) -> Column:
    """BUL11: who printed or signed, and when, up to a blank line or a line that begins with a capital (A-Z)."""
    out = col(text)
    for begin in WATERMARKS:
        out = F.regexp_replace(out, rf"(?s){begin}\s*:.*?(?=\n[A-Z]|\n\n|$)", "")
    return out


def in_special_section(line: Column) -> Column:
    """BUL2: whether a line lies in section 1.1.4, from its heading to the next main section."""
    mark = F.when(F.contains(line, F.lit("1.1.4")), True).when(line.rlike(r"^\d+\.\d+\.\s+"), False)
    return F.coalesce(F.last(mark, ignorenulls=True).over(by_line().rowsBetween(W.unboundedPreceding, 0)), F.lit(False))


def cleaned_special_section(docs: DataFrame) -> DataFrame:
    """BUL2: document_id, text without what page breaks left in section 1.1.4: lone row numbers, page heads, repeated column heads; routes in words."""
    line, text = F.col("line"), strip("line")
    has = lambda *words: reduce(lambda a, b: a & b, (F.contains(line, F.lit(w)) for w in words))
    lines = doc_lines(docs).withColumn("special", in_special_section(line))
    head = F.col("special") & (text == REPEATED_HEAD[0]) & (F.lead(text).over(by_line()) == REPEATED_HEAD[1])
    lines = lines.withColumn("head", F.coalesce(head, F.lit(False)))
    lines = lines.withColumn("again", F.col("head") & (F.sum(F.col("head").cast("int")).over(by_line().rowsBetween(W.unboundedPreceding, 0)) > 1))
    before = lambda n: F.coalesce(F.lag("again", n).over(by_line()), F.lit(False))
    repeated = F.col("again") | before(1) | (before(2) & has("Tàu/", "Sà lan"))
    dropped = repeated | (F.col("special") & ((text == "5") | has(*FOOTER_OF_PAGE)))
    routes = F.array(*map(F.lit, ROUTES))
    kept = F.when(F.col("special") & has("Tàu/", "Sà lan", "Bãi"), routes).otherwise(F.array(line))
    lines = lines.withColumn("out", F.when(dropped, F.array().cast("array<string>")).otherwise(kept))
    return lines.groupBy("document_id").agg(F.array_join(F.flatten(ordered("out")), "\n").alias("text"))


def rejoined_rows(docs: DataFrame) -> DataFrame:
    """BUL3: document_id, text with table rows that were wrapped over lines in one line each.

    A line goes to the row above if it has a bar or the next line that isn't blank has one, and nothing in between ended the row."""
    filled = strip("line") != ""
    lines = doc_lines(docs).withColumn("starts", F.startswith(strip("line"), F.lit("|")))
    after = F.first(F.when(filled, F.contains("line", F.lit("|"))), ignorenulls=True).over(by_line().rowsBetween(1, W.unboundedFollowing))
    ends = ~F.col("starts") & ~(filled & (F.contains("line", F.lit("|")) | F.coalesce(after, F.lit(False))))
    running = by_line().rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("row", F.sum(F.col("starts").cast("int")).over(running)).withColumn("ends", ends.cast("int"))
    ended = F.sum("ends").over(by_line("row").rowsBetween(W.unboundedPreceding, 0)) > 0
    lines = lines.withColumn("part", (F.col("row") > 0) & ~ended)
    # a row's parts share its first line's number; every other line is alone
    first = F.when(F.col("part"), F.min("line_no").over(W.partitionBy("document_id", "row"))).otherwise(F.col("line_no"))
    text = F.when(F.col("starts") | ~F.col("part"), F.col("line")).otherwise(strip("line"))
    joined = lines.withColumn("first", first).withColumn("text", text).groupBy("document_id", "first").agg(F.array_join(ordered("text"), " ").alias("text"))
    return joined.groupBy("document_id").agg(F.array_join(ordered("text", "first"), "\n").alias("text"))


def convert(docs: DataFrame) -> DataFrame:
    """BUL1: document_id, text: every document by the path that its form asks for."""
    from lathe.operators.text_tables import prepared, text_bullets
    from lathe.sources.scratch import staged

    clean = staged(prepared(docs), "bullets")
    return render_markdown(clean.where("not tables").drop("tables")).unionByName(text_bullets(clean.where("tables")))


def plain_line(line: Column | str) -> Column:
    """BUL4: what a line that is neither heading nor table becomes; null: nothing."""
    text = strip(line)
    return (
        F.when(F.startswith(F.lower(text), F.lit(REMARKS[0])), F.concat(F.lit("┃ ⓘ "), text))
        .when(text.rlike("^[-*+]"), bullet_line(line))
        .when(F.startswith(text, F.lit("•")), text)
        .when(is_skipped(text, markdown=True), F.lit(None))
        .when(mentions(F.lower(text), REMARKS), F.concat(F.lit("ⓘ "), text))
        .otherwise(F.concat(F.lit("• "), text))
    )


def title_lines(line: Column | str) -> Column:
    """BUL4: headings; a table's title is plain text with a bar."""
    title = strip(F.regexp_replace(strip(line), "^#+", ""))
    table = F.array(title, F.repeat(F.lit(BAR), F.least(F.length(title) + 2, F.lit(80))), F.lit(""))
    return F.when(F.startswith(title, F.lit("Bảng")), table).otherwise(heading_lines(line))


def render_markdown(docs: DataFrame) -> DataFrame:
    """BUL4: document_id, text: headings, tables, notes and bullets rendered.

    Blank lines don't end a table, and the first line after one is left out. A table comes out when it ends, so after the
    blank lines that follow it; a blank line is kept where the last line that came out isn't blank."""
    lines = doc_lines(rejoined_rows(docs)).where(~is_marker("line"))
    text, bar = strip("line"), F.contains("line", F.lit("|"))
    lines = lines.withColumn("blank", text == "").withColumn("pipe", F.startswith(text, F.lit("|")))
    so_far = by_line().rowsBetween(W.unboundedPreceding, 0)
    # a line with a bar inside a table goes to the row above; so lines with bars after a pipe line are of its table
    inside = F.last(F.when(~F.col("blank") & (F.col("pipe") | ~bar), F.col("pipe")), ignorenulls=True).over(so_far)
    lines = lines.withColumn("table", F.coalesce(inside, F.lit(False)) & ~F.col("blank"))
    filled = lines.where(~F.col("blank"))
    after = F.coalesce(F.lag("table").over(by_line()), F.lit(False)) & ~F.col("table")
    filled = filled.withColumn("after", after).withColumn("run", F.sum((~F.col("table")).cast("int")).over(so_far))
    next_line = F.first(F.when(~F.col("table"), F.col("line_no")), ignorenulls=True).over(by_line().rowsBetween(1, W.unboundedFollowing))
    filled = filled.withColumn("until", next_line).withColumn("row", F.sum(F.col("pipe").cast("int")).over(so_far))
    rows = filled.where("table").groupBy("document_id", "run", "row").agg(F.min("until").alias("until"), F.array_join(ordered(F.when(F.col("pipe"), F.col("line")).otherwise(text)), " ").alias("line"))
    tables = rows.groupBy("document_id", "run").agg(F.min("until").alias("until"), ordered("line", "row").alias("rows"))
    never = F.lit(2**31 - 1)
    parts = [
        tables.select("document_id", F.coalesce("until", never).alias("at"), F.lit(0).alias("late"), boxes("rows").alias("out")),
        filled.where(~F.col("table") & ~F.col("after")).select("document_id", F.col("line_no").alias("at"), F.lit(1).alias("late"), F.when(F.startswith(text, F.lit("#")), title_lines("line")).otherwise(F.filter(F.array(plain_line("line")), lambda x: x.isNotNull())).alias("out")),
        lines.where("blank").select("document_id", F.col("line_no").alias("at"), F.lit(1).alias("late"), F.lit(None).cast("array<string>").alias("out")),
    ]
    both = reduce(DataFrame.unionByName, parts)
    # a blank line comes out, or none does because the last one is blank already
    last = F.when(F.col("out").isNull(), F.lit("")).when(F.size("out") > 0, F.element_at("out", -1))
    before = F.last(last, ignorenulls=True).over(W.partitionBy("document_id").orderBy("at", "late").rowsBetween(W.unboundedPreceding, -1))
    out = F.coalesce("out", F.when(before != "", F.array(F.lit(""))), F.array().cast("array<string>"))
    return both.withColumn("out", out).groupBy("document_id").agg(F.array_join(F.flatten(ordered("out", F.struct("at", "late"))), "\n").alias("text"))
