"""Readers and the streaming ingest."""

import io
import zipfile

import pytest

from lathe.sources import readers, writers
from lathe.sources.store import Store
from lathe.streaming.ingest import SCHEMA, ingest, stream_documents

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
        z.writestr("word/document.xml", f'<w:document {NS}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Giá</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl></w:body></w:document>')
        z.writestr("word/header1.xml", f"<w:hdr {NS}><w:p><w:r><w:t>secret</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def test_readers(spark, tmp_path):
    for name, data in {"a.md": "# Tiêu đề".encode(), "b.CSV": b'x,"y, z"\n1,2', "c.docx": docx(), "d.xyz": b"?", "e.txt": b" ", "f.docx": b"no zip"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.md"].text == "# Tiêu đề" and got["b.CSV"].text == "| x | y, z |\n| --- | --- |\n| 1 | 2 |"
    assert got["c.docx"].text == "## Giá\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert all(got[n].text is None and got[n].error for n in ("d.xyz", "e.txt", "f.docx"))
    cleaned = {r.path.rsplit("/", 1)[1]: r for r in readers.clean_files(readers.binary_files(spark, str(tmp_path))).collect()}
    assert cleaned["c.docx"].ok and not cleaned["d.xyz"].ok
    with zipfile.ZipFile(io.BytesIO(cleaned["c.docx"].content)) as z:
        assert b"secret" not in z.read("word/header1.xml")
    assert readers.list_files(spark, str(tmp_path)).count() == 6
    bounded = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path), most_bytes=20).collect()}
    assert len(bounded) == 6 and bounded["c.docx"].error.startswith("too long") and bounded["a.md"].text


def pptx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        xml = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
        shape = lambda t, title: f'<p:sp><p:nvSpPr><p:nvPr>{"<p:ph type=" + chr(34) + "title" + chr(34) + "/>" if title else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
        cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
        for n, body in ((10, shape("hai", False)), (2, shape("Một", True) + shape("chữ", False) + f"<p:graphicFrame><a:tbl><a:tr>{cell('a')}{cell('b')}</a:tr><a:tr>{cell('1')}{cell('2')}</a:tr></a:tbl></p:graphicFrame>")):
            z.writestr(f"ppt/slides/slide{n}.xml", f"<p:sld {xml}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>")
    return out.getvalue()


def test_slides():
    assert readers.pptx_markdown(pptx()) == "<!-- Slide number: 2 -->\n\n# Một\n\nchữ\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n<!-- Slide number: 10 -->\n\nhai"


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "chữ"), ("x/b.html", "<p>"), ("e.md", None)], "name string, content string")
    for _ in range(2):
        got = {r.path: r.bytes for r in writers.write_each(rows, f"file://{tmp_path}/out").collect()}
    assert got == {f"{tmp_path}/out/a.md": 5, f"{tmp_path}/out/x/b.html": 3, f"{tmp_path}/out/e.md": 0}
    assert (tmp_path / "out/a.md").read_text() == "chữ" and sorted(p.name for p in (tmp_path / "out").rglob("*.*")) == ["a.md", "b.html", "e.md"]
    with pytest.raises(Exception, match="not a name"):
        writers.write_each(spark.createDataFrame([("../x", "y")], "name string, content string"), str(tmp_path)).collect()


def test_ingest(spark, tmp_path):
    """Documents of other types are quarantined, not lost; a later batch replaces a document; a second run finds nothing new."""
    def arrive(name, *rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(stream_documents(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ck"), "regulation").awaitTermination(120)

    arrive("one", ("doc_1", "regulation", "Điều 1\nnội dung"), ("doc_2", "pricing", "x"), ("doc_3", None, "y"))
    store = Store(spark, str(tmp_path / "store"))
    assert [(r.chunk_id, r.content) for r in store.chunks("doc_1", 1).collect()] == [("doc_1_section_0", "nội dung")]
    assert sorted((r.document_id, r.error) for r in spark.read.parquet(str(tmp_path / "store/quarantine")).collect()) == [("doc_2", "no schema here for pricing"), ("doc_3", "no schema here for null")]
    arrive("two", ("doc_1", "regulation", "Điều 1\nmới"))
    assert [r.content for r in store.chunks("doc_1", 1).collect()] == ["mới"] and [r.document_id for r in store.documents().collect()] == ["doc_1"]
    arrive("three", ("doc_4", "pricing", "z"))
    assert spark.read.parquet(str(tmp_path / "store/quarantine")).count() == 3
