"""

A walk in Python, one document at a time in Arrow batches: rows go over several lines, and where one ends depends on those
before. What a line is (heading, header, note, prices, ...) is found when the walk first asks; equal lines of a task share
the answers. Patterns mean what the Column forms here and in bullets.py mean in Java, and tests compare both.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.text import WS, any_case, col, strip
from lathe.operators.bullets import BAR, FOOTER_OF_PAGE, REPEATED_HEAD, ROUTES, SKIPPED, WATERMARKS

# What a line must look like to be of a kind, words that are left out of descriptions, and box forms.
SECTION, TITLE, LETTERED = r"^\d+(?:\.\d+)*\.\s+", r"^\s*Bảng\s+\d+", r"^[a-z]+\.\s+"
NOTE, BULLET = r"^(?:ghi\s*chú|lưu\s*ý|chú\s*ý)\s*:", "^[-*\u2022\uf0b7\u2023\u2043]\\s+"
SIZE, SIZES = "\\d+['\u02bc\u2019]", "\\d+['\u02bc\u2019](?:\\s*&\\s*\\d+['\u02bc\u2019])?"
ARROWS, DECORATION = "↔→←\uf0f3", "\uf0f3\uf02d•-"
PRICE_WORDS = "tăng|thỏa thuận|miễn|%|bằng"
EXEMPT, AGREED = "Miễn phụ thu", "Thỏa thuận"
OUT_OF_NUMBERED = ("cước đảo chuyển", "ghi chú", "lưu ý", "chú ý", "dưới đây tại", "tại bảng", "bảng", "quay lại", "theo quy định")
OUT_OF_UNNUMBERED = ("cước đảo chuyển", "lưu ý", "chú ý", "dưới đây tại", "tại bảng", "theo quy định")
MOST_PRICES, FULL_LINE, SHORT_LINE, MOST_LINES, MEMORY = 5, 4, 3, 50, 200
SPECIAL = "1.1.4"
#: Described lines that a task keeps at most, and the length of the longest one that is kept.
MOST_KEPT, LONGEST_KEPT = 20_000, 500


def is_section_heading(line: Column | str) -> Column:
    """PRD7."""
    return strip(line).rlike(SECTION)


def is_subsection_heading(line: Column | str) -> Column:
    """PRD8."""
    return col(line).rlike(r"^\s*\d+(?:\.\d+)?\.\s+[A-ZÀ-Ỿ]") & ~col(line).rlike(r"^\s*\d+\s+[A-ZÀ-Ỿ]")


def is_data_line(line: Column | str) -> Column:
    """PRD10."""
    return col(line).rlike(r"^\d+\s+")


def is_header_line(line: Column | str) -> Column:
    """PRD9: not a data row, and of one of six families."""
    line = strip(line)
    families = (
        line.rlike("^Từ ") & F.lower(line).rlike("bãi|xe|tàu"),
        line.rlike("Tàu|Sà lan|Xe") & line.rlike(f"[{ARROWS}]"),
        line.rlike(any_case(r"container\s+(?:khô|lạnh|rỗng).*container\s+(?:khô|lạnh|rỗng)")),
        line.rlike(any_case(r"^(?:tt|tên|loại|phương\s+án)\s+|đơn\s+vị\s+(?:tính|trọng|thời)")),
        F.regexp_count(line, F.lit(SIZE)) >= 3,
        line.rlike(rf"^\s*{SIZE}\s*(?:&|,|\s|$)"),
    )
    return ~is_data_line(line) & reduce(or_, families)


def is_route_line(line: Column | str) -> Column:
    """The sub-header of a table without a title."""
    has = lambda *words: reduce(lambda a, b: a & b, (F.contains(col(line), F.lit(w)) for w in words))
    return has("Tàu", "/", "Sà lan") | has("Xe", "Bãi")


#: Java's line terminators, its $ (without (?m)), and its white space and dot under (?U).
TERMINATORS = "\n\r\x85\u2028\u2029"
END = rf"(?=(?:\r\n|[{TERMINATORS}])?\Z)"
SPACE, DOT = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", f"[^{TERMINATORS}]"


def ascii_match(pattern: str) -> Callable[[str], bool]:
    found = re.compile(pattern.removeprefix("^"), re.ASCII).match
    return lambda text: found(text) is not None


def ascii_search(pattern: str) -> Callable[[str], bool]:
    found = re.compile(pattern, re.ASCII).search
    return lambda text: found(text) is not None


def any_case_search(pattern: str) -> Callable[[str], bool]:
    found = re.compile(pattern.replace(r"\s", SPACE).replace(".*", DOT + "*"), re.IGNORECASE).search
    return lambda text: found(text) is not None


_data, _section, _title, _lettered, _row = (ascii_match(p) for p in (r"\d+\s+", SECTION, TITLE, LETTERED, r"\s*\d+\s+"))
_bare, _numbered, _bullet, _leaves, _item = (ascii_match(p) for p in (r"\d+" + END, rf"\d+(?:\s|{END})", BULLET, r"\d+\.\d+\.\s+", r"[a-d]\.\s+"))
_priced, _sized, _sub, _size_first = ascii_search(r"\d+\.\d{3}"), ascii_search(SIZE), ascii_search(r"Tàu|Sà\s*lan|Xe|Bãi"), ascii_match(rf"\s*{SIZE}\s*(?:&|,|\s|{END})")
_note, _two_kinds, _column_head = (any_case_search(p) for p in (NOTE, r"container\s+(?:khô|lạnh|rỗng).*container\s+(?:khô|lạnh|rỗng)", r"^(?:tt|tên|loại|phương\s+án)\s+|đơn\s+vị\s+(?:tính|trọng|thời)"))
_sizes, _digits = re.compile(SIZE, re.ASCII), re.compile(r"\d[\d.]*", re.ASCII)


def one_of(text: str, words: Sequence[str]) -> bool:
    for w in words:
        if w in text:
            return True
    return False


def is_header(line: Line) -> bool:
    """PRD9, as is_header_line()."""
    text = line.text
    return not _data(text) and (
        (text.startswith("Từ ") and one_of(line.lower, ("bãi", "xe", "tàu"))) or (one_of(text, ("Tàu", "Sà lan", "Xe")) and one_of(text, ARROWS))
        or _two_kinds(text) or _column_head(text) or len(_sizes.findall(text)) >= 3 or _size_first(text)
    )


#: What the walk asks of a line, besides its text.
ASKED: dict[str, Callable[[Line], object]] = {
    "lower": lambda x: x.text.lower(), "prices": lambda x: [p for p in _digits.findall(x.text) if "." in p or len(p) >= 4],
    "section": lambda x: _section(x.text), "title": lambda x: _title(x.raw), "lettered": lambda x: _lettered(x.raw), "header": is_header, "bare": lambda x: _bare(x.text),
    "numbered": lambda x: _numbered(x.text), "row": lambda x: _row(x.raw), "note": lambda x: _note(x.text), "bullet": lambda x: _bullet(x.text), "letters": lambda x: any(map(str.isalpha, x.text)),
    "worded": lambda x: one_of(x.lower, PRICE_WORDS.split("|")), "exempt": lambda x: x.lower == EXEMPT.lower(), "plan": lambda x: "Phương án" in x.raw, "kinds": lambda x: "TT" in x.raw and "Loại" in x.raw,
    "route": lambda x: ("Tàu" in x.raw and "/" in x.raw and "Sà lan" in x.raw) or ("Xe" in x.raw and "Bãi" in x.raw),
    "skipped": lambda x: one_of(x.raw.lower(), SKIPPED), "raised": lambda x: AGREED in x.raw or "Tăng" in x.raw, "priced": lambda x: _priced(x.raw) or AGREED in x.raw, "enters": lambda x: SPECIAL in x.raw,
    "leaves": lambda x: _leaves(x.raw) and SPECIAL not in x.raw, "item": lambda x: _item(x.text), "sized": lambda x: _sized(x.text), "typed": lambda x: one_of(x.lower, ("khô", "lạnh")),
    "sub": lambda x: _sub(x.text) and "phương án" not in x.lower, "out_of_numbered": lambda x: one_of(x.lower, OUT_OF_NUMBERED), "out_of_unnumbered": lambda x: one_of(x.lower, OUT_OF_UNNUMBERED),
}


class Line:
    """A line as it stands, stripped, and what has been asked of it."""

    __slots__ = ("raw", "text", *ASKED)

    def __init__(self, raw: str):
        self.raw, self.text = raw, raw.strip(WS)

    def __getattr__(self, name: str):
        value = ASKED[name](self)
        setattr(self, name, value)
        return value


class Described(dict):
    """Lines by their text. One a task; when it is full it begins anew."""

    def __missing__(self, raw: str) -> Line:
        line = Line(raw)
        if len(raw) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[raw] = line
        return line

    def lines(self, text: str) -> list[Line]:
        return list(map(self.__getitem__, text.split("\n")))


@dataclass
class Row:
    num: str
    description: str
    prices: list[str]


_isdigit = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit())
_first_digit, _numbers, _price = re.compile(f"[{_isdigit}]").search, re.compile(f"[{_isdigit}][{_isdigit}.]*").findall, re.compile(r"\d[\d.]*").fullmatch


def before_number(text: str) -> str:
    """BUL19: what stands before the first digit."""
    found = _first_digit(text)
    return (text[: found.start()] if found else text).strip()


def gathered(lines: Sequence[Line], at: int, ends: Callable[[Line], bool]) -> tuple[list[Line], list[str], int]:
    """Lines from `at` up to the row's prices (a line without letters that has enough, or the word of exemption) or to a line that ends it; the prices; where to go on."""
    found: list[Line] = []
    while at < len(lines):
        line = lines[at]
        if line.text:
            if ends(line):
                break
            if line.exempt:
                return found, [EXEMPT], at + 1
            if not line.letters and len(line.prices) >= FULL_LINE:
                return found, list(line.prices), at + 1
            found.append(line)
        at += 1
    return found, [], at


def numbered_row(lines: Sequence[Line], at: int) -> tuple[Row, int]:
    """A10: a number alone in its line."""
    found, paid, after = gathered(lines, at + 1, lambda x: x.bare or x.header)
    if not paid:
        paid = [x.text for x in found if x.worded]
        found = [x for x in found if not x.worded]
    said = (x.text for x in found if not x.out_of_numbered)
    return Row(lines[at].text, " ".join(said).strip(), paid), after


def agreed_prices(text: str) -> tuple[str, list[str]]:
    """A word of agreement twice or more stands for prices; what comes before is the description (which may be the word itself)."""
    at = text.find(f" {AGREED}", 1)
    head, tail = (text[:at].strip(), text[at:]) if at > 0 else ("", text)
    n = tail.count(AGREED)
    return (head, [AGREED] * n) if n >= 2 else (text, [])


def same_line_row(lines: Sequence[Line], at: int) -> tuple[Row, int]:
    """A11: number, text and perhaps prices in one line; more prices below."""
    num = lines[at].text.split()[0]
    rest = lines[at].text[len(num) :].strip()
    paid = [p for p in numbers(rest)]
    text = before_number(rest) if paid else rest
    if not paid:
        text, paid = agreed_prices(text)
    phrases: list[list[str]] = []
    open_ = False
    at += 1
    while at < len(lines) and len(paid) < MOST_PRICES:
        line = lines[at]
        if line.text:
            if line.numbered or line.header or line.section:
                break
            if not line.letters:
                open_ = False
                if len(line.prices) < SHORT_LINE:
                    break
                paid = paid + line.prices
            elif line.worded:
                phrases.append([line.text])
                open_ = True
            elif open_ and len(line.text) < 40:
                phrases[-1].append(line.text)
            else:
                break
        at += 1
    return Row(num, text, paid or [" ".join(p) for p in phrases]), at


def numbers(text: str) -> list[str]:
    """BUL18."""
    return [p for p in _numbers(text) if "." in p or len(p) >= 4]


def unnumbered_row(lines: Sequence[Line], at: int) -> tuple[Row | None, int]:
    """A9."""
    found, paid, after = gathered(lines, at + 1, lambda x: x.numbered or x.header or x.section or x.note)
    said = []
    for line in (lines[at], *found):
        if not line.note and line.out_of_unnumbered:
            continue
        if len(line.prices) >= FULL_LINE:
            said.append(before_number(line.text))
            paid = paid or list(line.prices)
        else:
            said.append(line.text)
    text = " ".join(filter(None, said)).strip()
    return (Row("", text, paid), after) if text or paid else (None, at + 1)


def rows_of(lines: Sequence[Line]) -> list[Row]:
    """A6-A13: rows of a block; line 0 is its title."""
    out: list[Row] = []
    spare: list[str] = []
    unnumbered, at = 0, 1
    while at < len(lines):
        line = lines[at]
        if not line.text or (line.header and not line.bare):
            at += 1
        elif line.section or line.note or line.bullet:
            break
        elif line.numbered:
            row, at = (numbered_row if line.bare else same_line_row)(lines, at)
            if spare and not row.prices:
                row.prices, spare = spare, []
            out.append(row)
            after = lines[at] if at < len(lines) else None
            if after is not None and after.text and not after.letters:  # prices that came before their row
                spare = list(after.prices) if len(after.prices) >= FULL_LINE else []
                at += bool(spare)
        else:
            got, at = unnumbered_row(lines, at)
            if got:
                unnumbered += 1
                got.num = str(unnumbered)
                out.append(got)
    return [Row(r.num, r.description, r.prices[:MOST_PRICES]) for r in out]


def header_lines(lines: Sequence[Line]) -> tuple[str, str]:
    """BUL13: type line, and the size lines or sub-headers in one."""
    kind, sizes, subs = "", [], []
    for line in lines[1:6]:
        if not line.text or (line.numbered and not line.bare):
            continue
        if line.sub:
            subs.append(line.text)
        elif line.sized:
            sizes.append(line.text)
        elif line.typed:
            kind = line.text
    return kind, " ".join(subs or sizes)


@lru_cache(1000)
def column_names(kind: str, header: str) -> list[str]:
    """BUL14, A5."""
    if "Tàu" in header or "Xe" in header:
        return route_names(header)
    sizes = re.findall(SIZES, header)
    if not sizes:
        return [f"Price {i}" for i in range(1, 6)]
    dry, cold = "khô" in kind.lower(), "lạnh" in kind.lower()
    n_dry = (3 if cold else len(sizes)) if dry else 0
    return [f"Container {'khô' if i < n_dry else 'lạnh'} {s}" for i, s in enumerate(sizes)]


def route_names(header: str) -> list[str]:
    """Two routes, cut after a yard that a truck follows."""
    plain = " ".join(header.translate(str.maketrans(dict.fromkeys(DECORATION, " "))).split())
    *first, last = plain.replace("Bãi Xe", "Bãi\nXe").split("\n")
    parts = [p for p in first if p != "Bãi"] + [last if last.startswith(("Tàu", "Xe")) else f"{last} Bãi"]
    return [*parts, "Bãi"][:2]


def boxed(lines: Sequence[Line]) -> list[str]:
    """BUL12, A3, A14, A15."""
    title = lines[0].text
    named = re.match(r"Bảng\s+\d+", title)
    out = [named.group() if named else title, BAR * 80, ""]
    names = column_names(*header_lines(lines))
    routes = any("Tàu" in n or "Xe" in n for n in names)
    for row in rows_of(lines):
        if not row.description and not row.prices:
            continue
        worded = not all(map(_price, row.prices))
        out += [f"┃ {'PHƯƠNG ÁN' if worded and not routes else 'TT'} {row.num}: {row.description}", "┣" + BAR * 70]
        for i, price in enumerate(row.prices):
            name = names[i] if i < len(names) else None
            if worded:
                if name and ("Tàu" in name or "Xe" in name) and "→" not in name and "Bãi" not in name:
                    name += " → Bãi"
                out.append(f"┃ • {name:30} → {price}" if name else f"┃ •{'':30}→ {price}")
            else:
                out.append(f"┃ • {name:25} → {price}" if name else f"┃ • {price}")
        out.append("")
    for line in lines[1:]:
        if line.note:
            out += [line.text, BAR * 80]
    return out


def block_end(lines: Sequence[Line], at: int, room: int | None = None) -> int:
    """Where a block that goes on at `at` ends; blocks without a title also end at a lettered line or when they are full."""
    end = at
    while end < len(lines) and not lines[end].section and not lines[end].title and (room is None or (end - at < room and not lines[end].lettered)):
        end += 1
    return end


def untitled(lines: Sequence[Line], at: int) -> tuple[list[Line], int] | None:
    """A2: a block without a title that begins at line `at`, and where to go on."""
    if lines[at].route:
        head = list(lines[max(0, at - 3) : at + 1])
        end = block_end(lines, at + 1, MOST_LINES - len(head))
        more = lines[at + 1 : end]
        if any(x.row for x in more) and any(x.raised for x in more):
            return head + list(more), end - 1
    if lines[at].plan and at + 1 < len(lines) and lines[at + 1].kinds:
        end = block_end(lines, at + 1, MOST_LINES - 1)
        more = lines[at + 1 : end]
        if any(x.row for x in more) and any(x.priced for x in more):
            return [lines[at], *more], end
    return None


def walked(lines: Sequence[Line]) -> str:
    """BUL10: the text of a whole document."""
    out: list[str] = []
    first = next((i for i, line in enumerate(lines) if line.enters), len(lines))
    special, entered = [False] * first, -MEMORY - 1  # whether the lines before say that a line lies in the special section
    for i, line in enumerate(lines[first:], first):
        special.append(i - entered <= MEMORY)
        entered = i if line.enters else -MEMORY - 1 if line.leaves else entered
    at = 0
    while at < len(lines):
        line, here = lines[at], at
        at += 1
        if not line.text:
            if out and out[-1]:
                out.append("")
        elif line.section:
            out += ["", line.text, BAR * 80]
        elif line.title:
            at = block_end(lines, at)
            out += boxed(lines[here:at])
        elif found := untitled(lines, here):
            block, at = found
            out += boxed(block)
        elif not line.skipped:
            plain = line.text[0] in "-*•" or (special[here] and not line.item)
            out.append(line.text if plain else f"• {line.text}")
    return "\n".join(out)


def at_line_start(text: str, at: int) -> bool:
    """Whether only white space stands between `at` and the beginning of its line."""
    while at and text[at - 1] in " \t\x0b\f":
        at -= 1
    return not at or text[at - 1] in TERMINATORS


_named, _bar, _watermarks = re.compile(r"Bảng\s+\d+", re.ASCII), re.compile(r"\|"), [re.compile(rf"(?s){p}\s*:.*?(?=\n[A-Z]|\n\n|{END})", re.ASCII) for p in WATERMARKS]


def has_text_tables(text: str) -> bool:
    """PRD14, as is_text_table()."""
    return any(at_line_start(text, m.start()) for m in _named.finditer(text)) and not any(at_line_start(text, m.start()) for m in _bar.finditer(text))


def without_watermark(text: str) -> str:
    """BUL11, as remove_watermark()."""
    for p in _watermarks:
        text = p.sub("", text)
    return text


def without_page_breaks(text: str, described: Described) -> str:
    """BUL2, as cleaned_special_section() of one document."""
    if SPECIAL not in text:
        return text
    lines, out = described.lines(text), []
    special, heads, again, before = False, 0, False, False
    for i, line in enumerate(lines):
        special = True if line.enters else False if line.leaves else special
        head = special and line.text == REPEATED_HEAD[0] and i + 1 < len(lines) and lines[i + 1].text == REPEATED_HEAD[1]
        heads += head
        again, before, two_before = head and heads > 1, again, before
        route = "Tàu/" in line.raw and "Sà lan" in line.raw
        if again or before or (two_before and route) or (special and (line.text == "5" or all(w in line.raw for w in FOOTER_OF_PAGE))):
            continue
        out += ROUTES if special and route and "Bãi" in line.raw else (line.raw,)
    return "\n".join(out)


def prepared(docs: DataFrame) -> DataFrame:
    """document_id, text as cleaned_special_section() gives it, tables (whether it has tables as plain text). Documents without text (null) are left out."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        described = Described()
        for b in batches:
            texts = [without_page_breaks(t, described) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(list(map(has_text_tables, texts)), pa.bool_())], names=["document_id", "text", "tables"])

    return docs.select(F.col("document_id").cast("string").alias("document_id"), "text").where("text is not null").mapInArrow(run, "document_id string, text string, tables boolean")


def text_bullets(docs: DataFrame) -> DataFrame:
    """BUL10: document_id, text of documents with tables as plain text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        described = Described()
        for b in batches:
            texts = [walked(described.lines(without_watermark(t or ""))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["document_id", "text"])

    return docs.select("document_id", "text").mapInArrow(run, "document_id string, text string")


def parse_text_tables(blocks: DataFrame) -> DataFrame:
    """BUL15: blocks: document_id, text (a block, its title first). document_id, row_no, num, description, prices."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        described = Described()
        for b in batches:
            rows = [(d, i, r.num, r.description, r.prices) for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, r in enumerate(rows_of(described.lines(text or "")))]
            if rows:
                d, i, n, s, p = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(i, pa.int32()), pa.array(n), pa.array(s), pa.array(p, pa.list_(pa.string()))], names=["document_id", "row_no", "num", "description", "prices"])

    return blocks.select("document_id", "text").mapInArrow(run, "document_id string, row_no int, num string, description string, prices array<string>")
