"""Files into documents: routed by suffix, decoded whole; what can't be decoded goes to a quarantine frame with the reason."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.operators.chunks import document_id

TEXT, CSV, DOCX, PPTX = (".md", ".txt", ".markdown"), (".csv",), (".docx",), (".pptx",)
KNOWN = (*TEXT, *CSV, *DOCX, *PPTX)
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A, P = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
#: Heading marks of paragraph styles; other heading styles get four.
STYLES = {"Heading1": "# ", "Heading2": "## ", "Heading3": "### ", "Title": "# "}


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: path, suffix, length, modificationTime, content of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: newest first; contents aren't read."""
    return binary_files(spark, path).select("path", "length", "modificationTime").orderBy(F.desc("modificationTime"), "path")


def docx_markdown(raw: bytes) -> str:
    """SRC6, SRC7: paragraphs with heading marks, then all tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    out = []
    for p in body.findall(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        name = (style.get(f"{W}val") if style is not None else "") or ""
        if text(p).strip():
            mark = STYLES.get(name, "#### " if name.startswith("Heading") else "")
            out.append(mark + text(p).strip())
    for t in body.findall(f"{W}tbl"):
        out.append(table_text([[text(c).strip() for c in r.findall(f"{W}tc")] for r in t.findall(f"{W}tr")]))
    return "\n\n".join(filter(None, out))


def pptx_markdown(raw: bytes) -> str:
    """SRC8: slides in order, each with its number, its title as a heading, its paragraphs and its tables."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((int(m.group(1)), m.group()) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            out.append(f"<!-- Slide number: {number} -->")
            tree = ElementTree.fromstring(z.read(name))
            for shape in tree.iter(f"{P}sp"):
                kind = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                title = kind is not None and kind.get("type") in ("title", "ctrTitle")
                texts = ["".join(t.text or "" for t in p.iter(f"{A}t")).strip() for p in shape.iter(f"{A}p")]
                out += [f"# {t}" if title else t for t in texts if t]
            for t in tree.iter(f"{A}tbl"):
                out.append(table_text([["".join(x.text or "" for x in c.iter(f"{A}t")).strip() for c in r.findall(f"{A}tc")] for r in t.findall(f"{A}tr")]))
    return "\n\n".join(filter(None, out))


def table_text(rows: list[list[str]]) -> str:
    """Rows of cells as a markdown table; the first is the header."""
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]) if rows else ""


def csv_markdown(raw: bytes) -> str:
    """SRC8, SRC9."""
    import csv

    return table_text([[c.strip() for c in r] for r in csv.reader(io.StringIO(raw.decode("utf-8-sig"))) if r])


def decoded(suffix: str, raw: bytes) -> str:
    if suffix in TEXT:
        return raw.decode("utf-8")
    if suffix in CSV:
        return csv_markdown(raw)
    if suffix in DOCX:
        return docx_markdown(raw)
    if suffix in PPTX:
        return pptx_markdown(raw)
    raise ValueError(f"no reader for {suffix or 'files without suffix'}")


def read_documents(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """document_id, path, text, error: one of text and error is null. PRD16, PRD17: empty texts are errors too, and files above most_bytes, whose content isn't read. A bad file never stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for suffix, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    text, error = decoded(suffix, raw), None
                    if not text.strip():
                        text, error = None, "empty"
                except Exception as e:  # noqa: BLE001
                    text, error = None, f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    files = binary_files(spark, path)
    long = F.col("length") > (most_bytes if most_bytes is not None else 2**63 - 1)
    found = files.where(~long).select("path", "suffix", "content").mapInArrow(run, "path string, text string, error string")
    if most_bytes is not None:
        found = found.unionByName(files.where(long).select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("too long: "), F.col("length").cast("string"), F.lit(" bytes")).alias("error")))
    return found.select(document_id("path").alias("document_id"), "path", "text", "error")


def clean_docx(raw: bytes) -> bytes:
    """CLN5: the same file without text in its headers and footers."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.infolist():
            data = z.read(item.filename)
            if re.fullmatch(r"word/(?:header|footer)\d*\.xml", item.filename):
                tree = ElementTree.fromstring(data)
                for p in list(tree):
                    if p.tag in (f"{W}p", f"{W}tbl"):
                        tree.remove(p)
                tree.append(ElementTree.Element(f"{W}p"))
                data = ElementTree.tostring(tree, encoding="utf-8", xml_declaration=True)
            to.writestr(item, data)
    return out.getvalue()


def clean_files(files: DataFrame) -> DataFrame:
    """CLN1: path, ok, message, content of binary_files(); DOCX headers and footers go, text files stay as they are, PDF needs a plug-in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, suffix, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    if suffix not in (*DOCX, *TEXT, *CSV):
                        raise ValueError(f"{suffix} isn't supported")
                    rows.append((path, True, "cleaned" if suffix in DOCX else "unchanged", clean_docx(raw) if suffix in DOCX else raw))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, False, str(e), None))
            if rows:
                kinds = (pa.string(), pa.bool_(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "ok", "message", "content"])

    return files.select("path", "suffix", "content").mapInArrow(run, "path string, ok boolean, message string, content binary")
