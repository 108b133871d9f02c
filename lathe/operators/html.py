"""HTML renderings: CSV tables as expressions, markdown by document in Arrow batches, and the document shell."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.text import col, escape_html, strip
from lathe.operators.bullets import let


def csv_rows(text: Column | str) -> Column:
    """SRC9: rows of fields of CSV text; quoted fields may hold commas, doubled quotes and line breaks. Empty lines are left out."""
    fields = F.regexp_extract_all(F.concat(F.lit("\n"), F.regexp_replace(col(text), "\r\n?", "\n")), F.lit(r'([,\n](?:"(?:[^"]|"")*+"[^,\n]*|[^,\n]*))'), F.lit(1))
    value = lambda f: F.when(f.rlike('(?s)^"'), F.replace(F.regexp_replace(F.substring(f, 2, F.length(f)), r'(?s)"([^"]*)$', "$1"), F.lit('""'), F.lit('"'))).otherwise(f)
    place = lambda f: F.struct(F.startswith(f, F.lit("\n")).alias("first"), value(F.substring(f, 2, F.length(f))).alias("value"))
    return F.filter(let(F.transform(fields, place), rows_from), lambda r: (F.size(r) > 1) | (F.get(r, F.lit(0)) != ""))


def rows_from(fields: Column) -> Column:
    """Fields (first, value) cut into rows before those that are first: slices between their places."""
    starts = F.array_compact(F.transform(fields, lambda f, i: F.when(f["first"], i + 1)))
    cut = lambda z: F.transform(z["starts"], lambda s, k: F.slice(z["values"], s, F.coalesce(F.get(z["starts"], k + 1), F.size(z["values"]) + 1) - s))
    return let(F.struct(starts.alias("starts"), F.transform(fields, lambda f: f["value"]).alias("values")), cut)


def html_table(rows: Column | str) -> Column:
    """HTM2: an HTML table of rows of cells; the first is the header. No rows: null."""
    return let(col(rows), table_of_rows)


def table_of_rows(rows: Column) -> Column:
    cells = lambda r, tag: F.concat(F.lit("<tr>\n"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"  <{tag}>"), escape_html(strip(c)), F.lit(f"</{tag}>\n"))), ""), F.lit("</tr>\n"))
    head = F.concat(F.lit("<thead>\n"), cells(F.get(rows, F.lit(0)), "th"), F.lit("</thead>\n"))
    body = F.array_join(F.transform(F.slice(rows, 2, F.size(rows)), lambda r: cells(r, "td")), "")
    return F.when(F.size(rows) > 0, F.concat(F.lit('<table class="csv-table">\n'), head, F.lit("<tbody>\n"), body, F.lit("</tbody>\n</table>")))


def csv_to_html(text: Column | str) -> Column:
    """HTM2: of CSV text."""
    return html_table(csv_rows(text))


def document_shell(body: Column | str, title: Column | str = "Document", author: Column | None = None, description: Column | None = None, stamp: Column | None = None) -> Column:
    """HTM4. The time stamp is given, so a rerun gives the same page."""
    title = F.lit(title) if isinstance(title, str) else title
    meta = lambda name, c: F.lit("") if c is None else F.concat(F.lit(f'<meta name="{name}" content="'), escape_html(c), F.lit('">'))
    foot = F.lit("") if stamp is None else F.concat(F.lit("<footer>"), escape_html(stamp.cast("string")), F.lit("</footer>"))
    style = "<style>body{font-family:sans-serif;margin:2em auto;max-width:60em}table{border-collapse:collapse}th,td{border:1px solid #999;padding:.3em .6em}</style>"
    return F.concat(F.lit('<!DOCTYPE html><html lang="vi"><head><meta charset="utf-8"><title>'), escape_html(title), F.lit("</title>"), meta("author", author), meta("description", description), F.lit(style + "</head><body><header><h1>"), escape_html(title), F.lit("</h1></header><main>"), col(body), F.lit("</main>"), foot, F.lit("</body></html>"))


def inline(text: str) -> str:
    out = escape(text, quote=False)
    out = re.sub(r"`([^`]+)`", r"<code>\1</code>", out)
    out = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", out)
    out = re.sub(r"(?<!\*)\*([^*\s][^*]*)\*", r"<em>\1</em>", out)
    return re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', out)


def markdown_html(text: str, toc: bool = False) -> str:
    """HTM3: headings, paragraphs with line breaks, lists, tables, fenced code."""
    lines, out, heads, i = (text or "").split("\n"), [], [], 0
    listed = re.compile(r"^\s*(?:([-*+])|\d+\.)\s+(.*)$")
    while i < len(lines):
        line = lines[i]
        if line.startswith("```"):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith("```")), len(lines))
            out.append("<pre><code>" + escape("\n".join(lines[i + 1 : end]), quote=False) + "\n</code></pre>")
            i = end + 1
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line):
            n, slug = len(m[1]), re.sub(r"[^\w]+", "-", m[2].lower()).strip("-")
            heads.append((n, m[2], slug))
            out.append(f'<h{n} id="{slug}">{inline(m[2])}</h{n}>' if toc else f"<h{n}>{inline(m[2])}</h{n}>")
            i += 1
        elif line.strip().startswith("|") and i + 1 < len(lines) and re.match(r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$", lines[i + 1]):
            cells = lambda s: [c.strip() for c in s.strip().strip("|").split("|")]
            head, i = cells(line), i + 2
            body = []
            while i < len(lines) and lines[i].strip().startswith("|"):
                body.append("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in cells(lines[i])) + "</tr>")
                i += 1
            out.append("<table><thead><tr>" + "".join(f"<th>{inline(c)}</th>" for c in head) + "</tr></thead><tbody>" + "".join(body) + "</tbody></table>")
        elif m := listed.match(line):
            tag, items = "ul" if m[1] else "ol", []
            while i < len(lines) and (m := listed.match(lines[i])):
                items.append(f"<li>{inline(m[2])}</li>")
                i += 1
            out.append(f"<{tag}>" + "".join(items) + f"</{tag}>")
        elif line.strip():
            para = []
            while i < len(lines) and lines[i].strip() and not re.match(r"^(#{1,6}\s|```|\s*\|)", lines[i]) and not listed.match(lines[i]):
                para.append(inline(lines[i].strip()))
                i += 1
            if not para:
                para, i = [inline(line.strip())], i + 1
            out.append("<p>" + "<br />\n".join(para) + "</p>")
        else:
            i += 1
    if toc and heads:
        out.insert(0, '<div class="toc"><ul>' + "".join(f'<li class="l{n}"><a href="#{s}">{inline(t)}</a></li>' for n, t, s in heads) + "</ul></div>")
    return "\n".join(out)


def markdown_to_html(docs: DataFrame, toc: bool = False) -> DataFrame:
    """document_id, html. A sequential parser of nested states, so it runs by document."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([markdown_html(t, toc) for t in b.column(1).to_pylist()], pa.string())], names=["document_id", "html"])

    return docs.select("document_id", "text").mapInArrow(run, "document_id string, html string")
