"""WARC archives: whole-stream gzip made into a member a record, with a sidecar index of offsets.

1. Each task writes its pages as records of one gzip stream, a monolithic archive, straight from the scan.
2. Records with equal payloads (length and SHA-256) are grouped by short rows; the one with the largest page_id stays a
   response, the others become revisits of it. Payloads below `least` bytes all stay responses.
3. The normaliser inflates each monolithic archive once, front to back, rewrites every record as a gzip member of its
   own (a revisit without its payload, but with its digest and length) and writes an index: offset, length, type, id.
4. Archives are read back member by member through the index.

Nulls: a null html is an empty payload; a null page_id is written as an empty header, read back as null, and comes
before all others when the response is chosen; where all ids of a group are null, so is refers_to. Equal (page_id, html) rows: one of them is the response. An empty table
writes nothing and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm.common import AtomicFile, materialize, open_fs, scratch_path, slices, table

DATE = "1970-01-01T00:00:00Z"
GZIP = 31  # window bits of a gzip stream
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def page_headers(page_id: int | None, url: str | None, payload_digest: str) -> list[tuple[str, str]]:
    """url goes into one line: what can't stand in a header is escaped."""
    uri = "".join(c if c.isprintable() else f"%{b:02X}" if len(c.encode()) == 1 else "" for c in url or "" for b in c.encode("utf-8", "replace")[:1])
    name = "" if page_id is None else str(page_id)
    return [("WARC-Record-ID", f"<urn:lathe:page:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("X-Page-ID", name)]


class Records:
    """Records of a byte stream fed piece by piece: (headers, body)."""

    def __init__(self) -> None:
        self.held, self.head, self.need = bytearray(), None, 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += data
        while True:
            if self.head is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = bytes(self.held[:end]).decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                self.head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                del self.held[: end + 4]
                self.need = int(self.head["Content-Length"])
            if len(self.held) < self.need + 4:
                return
            body = bytes(self.held[: self.need])
            del self.held[: self.need + 4]
            head, self.head = self.head, None
            yield head, body

    def close(self) -> None:
        if self.held or self.head is not None:
            raise ValueError("the archive ends within a record")


def inflate(uri: str, piece: int = 1 << 20) -> Iterator[bytes]:
    """All bytes of a gzip file of one or more members, front to back, in bounded pieces."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as source:
        stream = zlib.decompressobj(GZIP)
        while data := source.read(piece):
            while data:
                out = stream.decompress(data, 4 * piece)
                if out:
                    yield out
                if stream.eof:
                    data, stream = stream.unused_data, zlib.decompressobj(GZIP)
                else:
                    data = stream.unconsumed_tail
        while out := stream.decompress(stream.unconsumed_tail, 4 * piece) if stream.unconsumed_tail else b"":
            yield out


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """One gzip stream a task; returns file, ord, page_id, payload_bytes, sha256 of each record."""
    schema = "file string, ord long, page_id long, payload_bytes long, sha256 binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/mono-{TaskContext.get().partitionId():06d}.warc.gz"
        out, deflate, ord_ = None, zlib.compressobj(1, zlib.DEFLATED, GZIP), 0
        with ExitStack() as open_file:
            for b in slices(batches, "html", 4 << 20):
                if out is None:
                    out = open_file.enter_context(AtomicFile(uri))
                    out.write(deflate.compress(record("warcinfo", [("WARC-Record-ID", "<urn:lathe:archive>"), ("WARC-Date", DATE)], b"software: lathe\r\n")))
                rows = []
                for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    out.write(deflate.compress(record("response", page_headers(page_id, url, digest32(payload)), payload)))
                    rows.append((uri, ord_, page_id, len(payload), hashlib.sha256(payload).digest()))
                    ord_ += 1
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "ord", "page_id", "payload_bytes", "sha256"])
            if out:
                out.write(deflate.flush())
                out.commit()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return materialize(rows.mapInArrow(run, schema), "warc-records")


def decide(records: DataFrame, least: int = 0) -> DataFrame:
    """file, ord, refers_to, revisit: which records repeat another's payload, and whose (the largest page_id's)."""
    place = F.struct("page_id", "file", "ord")  # nulls come first
    best = records.groupBy("payload_bytes", "sha256").agg(F.max(place).alias("best"))
    both = records.withColumn("place", place).join(best, ["payload_bytes", "sha256"])
    revisit = (F.col("payload_bytes") >= least) & ~F.col("place").eqNullSafe(F.col("best"))
    return both.select("file", "ord", F.when(revisit, F.col("best.page_id")).alias("refers_to"), revisit.alias("revisit"))


def normalise(decisions: DataFrame, folder: str) -> DataFrame:
    """Rewrites each monolithic archive once, a member a record; returns archive, index, n of each. Archives are dealt to tasks by file, whatever the size of their decisions' rows."""

    def rewrite(file: str, revisits: dict[int, int | None]) -> pa.RecordBatch:
        name = file.rsplit("/", 1)[1].replace("mono-", "part-")
        records, ord_ = Records(), -1
        with AtomicFile(f"{folder}/{name}") as out, AtomicFile(f"{folder}/{name}.idx") as index:
            for data in inflate(file):
                for head, body in records.feed(data):
                    kind = head.pop("WARC-Type")
                    head.pop("Content-Length")
                    if kind == "response":
                        ord_ += 1
                        head["X-Payload-Length"] = str(len(body))
                        if ord_ in revisits:
                            kind, body, of = "revisit", b"", revisits[ord_]
                            head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:lathe:page:{'' if of is None else of}>"}
                    deflate = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                    member = deflate.compress(record(kind, list(head.items()), body)) + deflate.flush()
                    index.write(struct.pack("<QIB", out.size, len(member), ("warcinfo", "response", "revisit").index(kind)))
                    out.write(member)
            records.close()
            out.commit()
            size = index.commit()
        return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "index": [f"{folder}/{name}.idx"], "n": [size // 13]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, revisits = None, {}
        for b in batches:
            for file, ord_, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != now:
                    if now is not None:
                        yield rewrite(now, revisits)
                    now, revisits = file, {}
                if revisit:
                    revisits[ord_] = refers_to
        if now is not None:
            yield rewrite(now, revisits)

    decisions = decisions.select("file", "ord", "refers_to", "revisit")
    files = decisions.select("file").distinct().count()
    dealt = decisions.repartition(max(1, 4 * files), "file").sortWithinPartitions("file")
    return materialize(dealt.mapInArrow(run, "archive string, index string, n long"), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit) of every record but warcinfo, through the index."""
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = open_fs(archive)
                with open_fs(index)[0].open_input_stream(open_fs(index)[1], compression=None) as f:
                    entries = list(struct.iter_unpack("<QIB", f.read()))
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for offset, size, kind in entries:
                        if not kind:
                            continue
                        f.seek(offset)
                        parser = Records()
                        ((head, body),) = parser.feed(zlib.decompress(f.read(size), GZIP))
                        parser.close()
                        said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == 1 and (digest32(body) != said or len(body) != int(head["X-Payload-Length"])):
                            raise ValueError(f"payload damaged at {offset} of {archive}")
                        page = head["X-Page-ID"]
                        refers = head.get("WARC-Refers-To", "")[len("<urn:lathe:page:") : -1]
                        rows.append((int(page) if page else None, int(head["X-Payload-Length"]), said, head["WARC-Type"], int(refers) if refers else None, body if kind == 1 else None))
                        held += len(body)
                        if held > 4 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return archives.select("archive", "index").repartition(max(1, archives.count())).mapInArrow(run, schema)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Archives of pages (page_id, url, html) and their indexes: archive, index, n."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    decisions = materialize(decide(write_monolithic(pages, f"{folder}/mono"), least), "warc-decisions")
    return normalise(decisions, folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("payload")
