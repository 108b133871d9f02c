"""Text functions as Column expressions: extraction, metadata, clean-up. All run in the JVM; nothing here is a UDF.

Patterns follow the dialect rules of Java: (?iu) for case-insensitive Vietnamese, (?U) where white space is any white
space, (?md) for line anchors. Python's strip() is btrim with WS.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

# Vocabularies and patterns of the document language.
ABBREVIATIONS = {
    "TT": "Thông tư", "NĐ": "Nghị định", "QĐ": "Quyết định", "LĐ": "Luật định", "CP": "Chính phủ", "TTg": "Thủ tướng",
    "GP": "General Purpose", "DC": "Dry Container", "HC": "High Cube", "OT": "Open Top", "FR": "Flat Rack",
}
ORDINALS = (r"ngày\s+thứ\s+\d+", r"từ\s+ngày\s+thứ\s+\d+", r"tuần\s+thứ\s+\d+", r"tháng\s+thứ\s+\d+")
CONDITION_MARKERS = ("trong trường hợp", "nếu", "khi", "trừ khi", "với điều kiện", "ngoài trừ", "không áp dụng", "riêng đối với")
CALCULATION_TERMS = ("tính lũy tiến", "tính từ", "tính bằng", "tính theo", "không vượt quá", "cộng thêm", "trừ đi", "nhân với", "chia cho", "phần trăm", "%")
SERVICES = ("Xếp dỡ", "Lưu bãi", "Nâng hạ", "Vận chuyển", "Niêm phong", "Đóng mở cửa", "Làm hàng", "Cân container", "Kiểm định")
CONTAINER = r"(20'|40'|45')(?:\s*(DC|GP|HC|OT|FR))?"
TABLE_REFERENCE = r"Bảng\s+((?:\d+)|(?:[IVX]+)|(?:\d+-[A-Z]+)|(?:\d+-TT\.\d+))"
ARTICLE, CLAUSE, POINT = r"Điều\s+(\d+)", r"Khoản\s+(\d+)\s+Điều\s+(\d+)", r"Điểm\s+([a-z])\s+Khoản\s+(\d+)\s+Điều\s+(\d+)"
LEGAL_DOCUMENT = r"(Luật|Nghị định|Thông tư|Quyết định)\s+(?:số\s+)?(\d+[/-]\d+(?:[/-][A-Z]+)?)"
NUMERIC_DATE, VERBAL_DATE = r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})", r"ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
AMOUNT, UNIT = r"([\d,\.]+)\s*(VND|USD|EUR)", r"/(container|tấn|cbm|chuyến|lượt|ngày)"
UNITS = (r"(VND|USD|EUR)/(container|tấn|cbm|chuyến|lượt|ngày|giờ)", r"đồng/(container|tấn|cbm)")
HEADINGS = (r"#{1,6}\s+", r"[IVX]+\.\s+", r"\d+\.\s+", r"Chương\s+[IVX\d]+", r"Mục\s+\d+", r"Điều\s+\d+")
SURCHARGE, DISCOUNT = r"phụ thu[^.]{0,100}", r"(?:giảm|chiết khấu)[^.]{0,100}"
THRESHOLD = r"(?:không vượt quá|tối thiểu|tối đa|từ|đến)\s+[\d,\.]+"
PAGES = (r"(?:Trang|trang|p\.|page)\s*(\d+)\s*[-–]\s*(\d+)", r"(?:Trang|trang|p\.|page)\s*(\d+)")
APPLIES = {"container_hàng": ("container hàng", "cont hàng"), "container_rỗng": ("container rỗng", "cont rỗng"), "hàng_nguy_hiểm": ("hàng nguy hiểm",), "hàng_quá_khổ": ("hàng quá khổ",)}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WS))


def any_case(pattern: str) -> str:
    return "(?iuU)" + pattern


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def words(text: Column | str, tokenizer=None) -> Column:
    """TXT1: tokens; a tokenizer is a function Column -> array Column, white space by default."""
    return tokenizer(col(text)) if tokenizer else F.filter(F.split(col(text), r"(?U)\s+"), lambda w: w != "")


def count_tokens(text: Column | str, tokenizer=None) -> Column:
    """TXT2."""
    return F.size(words(text, tokenizer))


def find_all(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def first_match(text: Column | str, pattern: str, group: int = 0) -> Column:
    return empty_to_null(F.regexp_extract(col(text), pattern, group))


def positions(text: Column | str, literal_pattern: str) -> Column:
    """Where matches of a pattern begin (0-based), from the lengths of the pieces between them."""
    pairs = F.arrays_zip(F.split(col(text), literal_pattern, -1).alias("a"), F.regexp_extract_all(col(text), F.lit(literal_pattern), F.lit(0)).alias("b"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, p):
        start = acc["at"] + F.length(p["a"])
        return F.when(p["b"].isNull(), acc).otherwise(F.struct((start + F.length(p["b"])).alias("at"), F.concat(acc["out"], F.array(start)).alias("out")))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def ordinals(text: Column | str) -> Column:
    """TXT3, pattern by pattern."""
    return F.concat(*(find_all(text, any_case(p)) for p in ORDINALS))


def snippets(text: Column | str, markers, most: int) -> Column:
    """TXT4, TXT5: from each marker to the next full stop, at most `most` characters; array of (marker, position, text)."""
    text = col(text)

    def one(p):
        stop = F.instr(F.substring(text, p + 1, F.length(text)), ".")
        n = F.when((stop == 0) | (stop - 1 > most), F.least(F.lit(most), F.length(text) - p)).otherwise(stop - 1)
        return F.struct(p.alias("position"), strip(F.substring(text, p + 1, n)).alias("text"))

    return F.concat(*(F.transform(positions(text, any_case(re.escape(m))), one) for m in markers))


def conditionals(text: Column | str) -> Column:
    return snippets(text, CONDITION_MARKERS, 200)


def calculations(text: Column | str) -> Column:
    return snippets(text, CALCULATION_TERMS, 150)


def container_types(text: Column | str) -> Column:
    """TXT6: sizes with their type after one space."""
    return F.transform(find_all(text, CONTAINER), lambda m: F.regexp_replace(m, r"^(\d\d')\s*([A-Z]{2})$", "$1 $2"))


def table_references(text: Column | str) -> Column:
    """TXT7: array of (text, identifier)."""
    p = any_case(TABLE_REFERENCE)
    return F.transform(F.arrays_zip(find_all(text, p).alias("text"), find_all(text, p, 1).alias("identifier")), lambda s: F.struct(s["text"].alias("text"), s["identifier"].alias("identifier")))


def article_references(text: Column | str) -> Column:
    """TXT8: array of (type, text) in three passes."""
    parts = [F.transform(find_all(text, p), _typed(kind)) for kind, p in (("article", ARTICLE), ("clause", CLAUSE), ("point", POINT))]
    return F.concat(*parts)


def _typed(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("type"), m.alias("text"))


def legal_references(text: Column | str) -> Column:
    """TXT9."""
    return find_all(text, any_case(LEGAL_DOCUMENT))


def dates(text: Column | str) -> Column:
    """TXT10: numeric dates, then verbal ones; array of (format, position, text)."""
    text = col(text)
    out = []
    for kind, p in (("numeric", NUMERIC_DATE), ("verbal", any_case(VERBAL_DATE))):
        both = F.arrays_zip(positions(text, p).alias("position"), find_all(text, p).alias("text"))
        out.append(F.transform(both, _dated(kind)))
    return F.concat(*out)


def _dated(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("format"), s["position"].alias("position"), s["text"].alias("text"))


def expand_abbreviations(text: Column | str) -> Column:
    """TXT11: one after another, in order."""
    out = col(text)
    for short, long in ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"(?U)\b{re.escape(short)}\b", long)
    return out


def sentences(text: Column | str) -> Column:
    """TXT12."""
    return F.filter(F.transform(F.split(col(text), r"(?U)[.!?;]\s+"), strip), lambda s: s != "")


def pricing_info(text: Column | str) -> Column:
    """TXT13: amounts, units, conditions."""
    text = col(text)
    amounts = F.arrays_zip(find_all(text, AMOUNT, 1).alias("value"), find_all(text, AMOUNT, 2).alias("currency"))
    has = F.filter(F.array(*map(F.lit, CONDITION_MARKERS)), lambda m: F.contains(F.lower(text), m))
    return F.struct(amounts.alias("amounts"), find_all(text, any_case(UNIT), 1).alias("units"), has.alias("conditions"))


def is_heading(text: Column | str) -> Column:
    """PRD3."""
    text = col(text)
    upper = (F.length(text) < 100) & (text == F.upper(text)) & (text != F.lower(text))
    return strip(text).rlike("(?U)^(?:" + "|".join(HEADINGS) + ")") | upper


def first_keyword(text: Column | str, keywords) -> Column:
    """The first of keywords (in their order) that the text has, in any case."""
    low = F.lower(col(text))
    return F.coalesce(*(F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in keywords))


def all_keywords(text: Column | str, keywords) -> Column:
    low = F.lower(col(text))
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, F.lower(k)))


def service_type(text: Column | str) -> Column:
    """MET7."""
    return first_keyword(text, SERVICES)


def unit(text: Column | str) -> Column:
    """MET8."""
    return F.coalesce(*(first_match(text, any_case(p)) for p in UNITS))


def applies_to(text: Column | str) -> Column:
    """MET9: always an array."""
    low = F.lower(col(text))
    flags = [F.when(F.contains(low, F.lit(ws[0])) | (F.contains(low, F.lit(ws[-1]))), F.lit(name)) for name, ws in APPLIES.items()]
    return F.array_compact(F.array(*flags))


def references(text: Column | str) -> Column:
    """MET10: distinct references, sorted."""
    tables = F.transform(table_references(text), lambda s: s["text"])
    articles = F.transform(article_references(text), lambda s: s["text"])
    return F.array_sort(F.array_distinct(F.concat(tables, articles, legal_references(text))))


def heading_path(text: Column | str) -> Column:
    """MET4: of the first 20 lines' headings, deeper ones are appended, others replace the last."""
    heads = F.filter(F.slice(F.split(col(text), "\n"), 1, 20), lambda line: line.rlike(r"^#{1,6}\s+.+"))
    parsed = F.transform(heads, lambda h: F.struct(F.length(F.regexp_extract(h, "^(#{1,6})", 1)).alias("level"), strip(F.regexp_extract(h, r"^#{1,6}\s+(.+)", 1)).alias("title")))
    zero = F.struct(F.lit(0).alias("last"), F.array().cast("array<string>").alias("path"))

    def step(acc, h):
        deeper = h["level"] > acc["last"]
        return F.struct(F.when(deeper, h["level"]).otherwise(acc["last"]).alias("last"), F.when(deeper, F.concat(acc["path"], F.array(h["title"]))).otherwise(F.concat(F.slice(acc["path"], 1, F.greatest(F.size(acc["path"]) - 1, F.lit(0))), F.array(h["title"]))).alias("path"))

    return empty_to_null(F.aggregate(parsed, zero, step, lambda acc: F.array_join(acc["path"], " > ")))


def page_range(text: Column | str) -> Column:
    """MET5."""
    two = first_match(text, PAGES[0])
    return F.coalesce(F.when(two.isNotNull(), F.concat(F.regexp_extract(col(text), PAGES[0], 1), F.lit("-"), F.regexp_extract(col(text), PAGES[0], 2))), first_match(text, PAGES[1], 1))


def parse_date(text: Column | str) -> Column:
    """Four formats; an impossible date is null."""
    text = col(text)
    return F.coalesce(*(F.try_to_timestamp(F.when(text.rlike(shape), text), F.lit(fmt)) for shape, fmt in ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy")))).cast("date")


def effective_date(text: Column | str) -> Column:
    """MET6: the first date with a word of effect within 50 characters, else the first."""
    text = col(text)
    found = dates(text)

    def near(s):
        start = F.greatest(s["position"] - 50, F.lit(0))
        return F.lower(F.substring(text, start + 1, s["position"] + 50 - start)).rlike("hiệu lực|áp dụng")

    best = F.coalesce(F.get(F.filter(found, near), F.lit(0)), F.get(found, F.lit(0)))
    return parse_date(best["text"])


def article_number(text: Column | str) -> Column:
    """MET11."""
    return first_match(text, ARTICLE, 1)


def chapter_number(text: Column | str) -> Column:
    return first_match(text, r"Chương\s+([IVX]+|\d+)", 1)


def section_number(text: Column | str) -> Column:
    return first_match(text, r"Mục\s+(\d+)", 1)


def condition_type(snippet: Column) -> Column:
    """MET12: conditional > exception > prerequisite > general."""
    low = F.lower(snippet)
    return F.when(low.rlike("nếu|khi"), "conditional").when(low.rlike("ngoài trừ|không áp dụng"), "exception").when(F.contains(low, F.lit("với điều kiện")), "prerequisite").otherwise("general")


def conditions(text: Column | str) -> Column:
    """MET12: array of (type, text, position)."""
    return F.transform(conditionals(text), lambda s: F.struct(condition_type(s["text"]).alias("type"), s["text"].alias("text"), s["position"].alias("position")))


def pricing_conditions(text: Column | str) -> Column:
    """MET13."""
    return F.struct(ordinals(text).alias("timing"), find_all(text, any_case(SURCHARGE)).alias("surcharges"), find_all(text, any_case(DISCOUNT)).alias("discounts"), find_all(text, any_case(THRESHOLD)).alias("thresholds"))


COMMON_FIELDS = {
    "heading_path": heading_path, "page_range": page_range, "effective_date": lambda t: effective_date(t).cast("string"), "container_types": container_types, "service_type": service_type,
    "unit": unit, "applies_to": applies_to, "references": references, "article_number": article_number, "chapter_number": chapter_number, "section_number": section_number,
}


def configured(text: Column | str, config: dict) -> Column | None:
    """MET2: by patterns (the first that matches) or by keywords."""
    every = config.get("extract_all", False)
    if "patterns" in config:
        patterns = [config["patterns"]] if isinstance(config["patterns"], str) else config["patterns"]
        cols = []
        for p in patterns:
            group = 1 if re.compile(re.sub(r"\\p\{\w+\}", "x", p)).groups else 0
            cols.append(F.when(F.size(find_all(text, any_case(p), group)) > 0, find_all(text, any_case(p), group)) if every else F.when(col(text).rlike(any_case(p)), F.regexp_extract(col(text), any_case(p), group)))
        return F.coalesce(*cols)
    keywords = config.get("keywords", config.get("vocabulary"))
    if keywords:
        keywords = list(keywords)
        found = all_keywords(text, keywords)
        return F.when(F.size(found) > 0, found) if every else first_keyword(text, keywords)
    return None


def metadata(text: Column | str, schema, context: Column | None = None, strict: bool = True) -> Column:
    """MET1: one struct a document type, compiled from its schema. strict: an extractor that says `pattern` finds nothing."""
    whole = col(text) if context is None else F.concat(context, F.lit("\n"), col(text))
    fields = []
    for name in schema.fields:
        config = dict(schema.extractors.get(name, {}))
        if not strict and "pattern" in config:
            config["patterns"] = config.pop("pattern")
        if name in schema.extractors:
            got = configured(whole, config)
        else:
            got = COMMON_FIELDS[name](whole) if name in COMMON_FIELDS else None
        fields.append((F.lit(None).cast("string") if got is None else got).alias(name))
    return F.struct(*fields)


def clean_markdown(text: Column | str) -> Column:
    """MD1: at most two newlines, right-stripped lines, a blank line after headings, stripped."""
    out = F.regexp_replace(col(text), r"\n{3,}", "\n\n")
    out = F.array_join(F.transform(F.split(out, "\n"), lambda line: F.rtrim(line, F.lit(WS))), "\n")
    return strip(F.regexp_replace(out, r"(?md)^(#{1,6} .+)$", "$1\n"))


def document_stats(text: Column | str) -> Column:
    """MD2: title, headings, table lines, list items, words."""
    text = col(text)
    lines = F.split(text, "\n")
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    title = F.get(F.filter(lines, lambda x: x.rlike(r"^#\s+.+")), F.lit(0))
    return F.struct(strip(F.regexp_replace(title, r"^#\s+", "")).alias("title"), count(r"^#{1,6}\s+").alias("headings"), count(r"^\|.*\|$").alias("table_lines"), count(r"^\s*[-*+]\s+").alias("list_items"), count_tokens(text).alias("words"))


def escape_html(text: Column | str) -> Column:
    """HTM1: & first."""
    out = col(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
