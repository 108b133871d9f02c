"""Token-id files: canonical length-limited Huffman codes from global counts, in independent blocks with checkpoints.

1. Texts become ids (tokenizers) with an end id each; rows of (doc_id, ids) go to a scratch table.
2. Ids are counted over the whole table; the driver sees one count an id of the vocabulary (a fixed bound), finds the
   code lengths by package-merge and numbers the codes canonically, so lengths alone describe the code.
3. Rows are range-sorted by doc_id and each range is written to a file: code lengths, blocks of 65,536 ids (each with the
   bit offset of every 256th id, and decodable alone), and at the end the documents with their counts.
4. Files are read back by a table lookup of the next bits, for all checkpoints of many blocks in step.

Nulls: a null text is empty (its row is the end id only); a null doc_id is kept and sorts first. Equal doc_ids lie side
by side in no fixed order. No rows give no files and no result. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lathe.llm.common import AtomicFile, materialize, open_fs, scratch_path, slices, table

MAGIC = b"LHC1"
BLOCK, STEP = 1 << 16, 256


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal lengths of at most limit bits for symbols with counts > 0 (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        levels.append(at < n)
        merged = merged[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for is_leaf in reversed(levels):
        m = int(is_leaf[:take].sum())
        depth[:m] += 1
        take = 2 * (take - m)
    lengths[order] = depth
    return lengths


class Code:
    """Canonical code of an array of lengths (0: not used)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.symbols = np.flatnonzero(lengths)
        self.most = int(lengths.max()) if len(self.symbols) else 1
        order = self.symbols[np.lexsort((self.symbols, lengths[self.symbols]))]
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        size = np.left_shift(np.uint64(1), (self.most - lengths[order]).astype(np.uint64))
        ends = np.cumsum(size)
        self.codes[order] = (ends - size) >> (self.most - lengths[order]).astype(np.uint64)
        self._order, self._sizes = order, size

    def table(self) -> np.ndarray:
        """Symbol << 5 | length for each value of the next self.most bits."""
        out = np.zeros(1 << self.most, dtype=np.uint32)
        full = np.repeat((self._order << 5 | self.lengths[self._order]).astype(np.uint32), self._sizes.astype(np.int64))
        out[: len(full)] = full
        return out

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of ids, padded to bytes, and the bit offsets of every STEP-th id."""
        n = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        word, shift = starts >> 6, 64 - (starts & 63) - n
        code = self.codes[ids]
        high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        out = np.zeros((int(ends[-1]) >> 6) + 2, dtype=np.uint64)
        firsts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[firsts]] = np.bitwise_or.reduceat(high, firsts)
        over = np.flatnonzero(shift < 0)
        out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::STEP].astype("<u4")


def decode(payload: bytes, starts: np.ndarray, counts: np.ndarray, table: np.ndarray, most: int) -> np.ndarray:
    """Ids of streams that begin at bit offsets and have so many ids (STEP each, but for the last of a block)."""
    raw = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8)
    wide = raw[:-3].astype(np.uint32) << 24 | raw[1:-2].astype(np.uint32) << 16 | raw[2:-1].astype(np.uint32) << 8 | raw[3:]
    out = np.zeros((STEP, len(starts)), dtype=np.uint32)
    at = starts.astype(np.int64)
    last, mask = len(wide) - 1, np.uint32((1 << most) - 1)
    for k in range(int(counts.max(initial=0))):
        seen = table[(wide[np.minimum(at >> 3, last)] >> (32 - most - (at & 7)).astype(np.uint32)) & mask]
        out[k] = seen >> 5
        at += seen & 31
    return out.T[np.arange(STEP) < counts[:, None]]


class Writer:
    def __init__(self, uri: str, code: Code):
        self.file, self.code = AtomicFile(uri), code
        self.docs: list[tuple[int | None, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        book = zlib.compress(code.symbols.astype("<u4").tobytes() + code.lengths[code.symbols].tobytes())
        self.file.write(MAGIC + struct.pack("<III", len(code.lengths), len(code.symbols), len(book)) + book)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        to = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, to, BLOCK):
            part = ids[at : min(at + BLOCK, to)]
            payload, starts = self.code.encode(part)
            self.file.write(struct.pack("<II", len(part), len(payload)) + starts.tobytes() + payload)
        self.held, self.n_held = [ids[to:]], len(ids) - to

    def close(self) -> int:
        self._blocks(True)
        at = self.file.size
        known = bytes(d is not None for d, _ in self.docs)
        self.file.write(known + np.array([d or 0 for d, _ in self.docs], dtype="<i8").tobytes() + np.array([n for _, n in self.docs], dtype="<u8").tobytes())
        self.file.write(struct.pack("<QQ", at, len(self.docs)) + MAGIC)
        return self.file.commit()


class Reader:
    """Documents of a file in order, or the ids of single blocks."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 20)
        tail = self.file.read(20)
        self.file.seek(0)
        head = self.file.read(16)
        if head[:4] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.end, n_docs = struct.unpack("<QQ", tail[:16])
        vocab, n, book_len = struct.unpack("<III", head[4:])
        book = zlib.decompress(self.file.read(book_len))
        lengths = np.zeros(vocab, dtype=np.uint8)
        lengths[np.frombuffer(book, "<u4", n)] = np.frombuffer(book, np.uint8, n, 4 * n)
        self.code, self.first = Code(lengths), 16 + book_len
        self.table = self.code.table()
        self.file.seek(self.end)
        raw = self.file.read(n_docs * 17)
        ids, self.counts = np.frombuffer(raw, "<i8", n_docs, n_docs), np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.doc_ids = [int(i) if known else None for known, i in zip(raw[:n_docs], ids, strict=True)]

    def ids(self, at_once: int = 48) -> Iterator[np.ndarray]:
        """All ids in order, from at_once blocks at a time."""
        self.file.seek(self.first)
        at = self.first
        while at < self.end:
            payloads, starts, counts, base = [], [], [], 0
            while at < self.end and len(payloads) < at_once:
                n, size = struct.unpack("<II", self.file.read(8))
                marks = -(-n // STEP)
                starts.append(np.frombuffer(self.file.read(4 * marks), "<u4").astype(np.int64) + 8 * base)
                counts.append(np.minimum(STEP, n - STEP * np.arange(marks)))
                payloads.append(self.file.read(size))
                base += size
                at += 8 + 4 * marks + size
            yield decode(b"".join(payloads), np.concatenate(starts), np.concatenate(counts), self.table, self.code.most)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held = np.zeros(0, dtype=np.uint32)
        more = self.ids()
        for doc, n in zip(self.doc_ids, self.counts, strict=True):
            if len(held) < n:
                parts = [held]
                have = len(held)
                while have < n:
                    parts.append(next(more))
                    have += len(parts[-1])
                held = np.concatenate(parts)
            yield doc, held[:n]
            held = held[n:]


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encoding(path: str, end_id: int, dtype: str = "<u4", most_cuts: int = 300_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of doc_id, text to batches of doc_id, ids (binary: little-endian unsigned ids of the whole text, then end_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lathe.llm.tokens import encoder

        width = np.dtype(dtype).itemsize
        for b in slices(batches, "text", 2 << 20):
            ids, lengths = encoder(path, most_cuts).encode(b.column(1))
            ends = np.cumsum(lengths)
            data = np.insert(ids, ends, end_id).astype(dtype)
            offsets = np.concatenate([[0], (ends + np.arange(1, len(ends) + 1)) * width]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])], names=["doc_id", "ids"])

    return run


def token_table(docs: DataFrame, path: str, end_id: int, dtype: str = "<u4") -> DataFrame:
    """doc_id, ids of each row."""
    return id_and_text(docs).mapInArrow(encoding(path, end_id, dtype), "doc_id long, ids binary")


def global_counts(rows: DataFrame, vocab: int, dtype: str) -> np.ndarray:
    """Counts of all ids: a row an id leaves each task, at most vocab rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocab, dtype=np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                n += np.bincount(np.frombuffer(x, dtype), minlength=vocab) if len(x) > 50_000 else 0
            small = b"".join(x for x in b.column(0).to_pylist() if len(x) <= 50_000)
            n += np.bincount(np.frombuffer(small, dtype), minlength=vocab)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])

    out = np.zeros(vocab, dtype=np.int64)
    for r in rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_files(rows: DataFrame, folder: str, vocab: int, dtype: str) -> DataFrame:
    """Writes rows (doc_id, ids) in ascending doc_id order; returns the list of files: part, file, n_docs, n_ids, n_bytes."""
    counts = global_counts(rows, vocab, dtype)
    limit = min(24, max(12, int(np.ceil(np.log2(max(2, np.count_nonzero(counts))))) + 4))
    lengths = code_lengths(counts, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        uri = f"{folder}/part-{part:06d}.lhc"
        with ExitStack() as open_file:
            for b in batches:
                for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if writer is None:
                        writer = Writer(uri, Code(lengths))
                        open_file.enter_context(writer.file)
                    writer.add(doc, np.frombuffer(ids, dtype).astype(np.uint32))
            size = writer.close() if writer else 0
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, uri, len(writer.docs), writer.n_ids, size)], names=["part", "file", "n_docs", "n_ids", "n_bytes"])

    # rows of one id (or none) may go to several files, by their content
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(run, "part long, file string, n_docs long, n_ids long, n_bytes long"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, unsigned 32-bit) of every document, decoded from the files."""
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    listed = files.select("file", before.alias("before")).repartition(max(1, files.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc, ids in Reader(file).documents():
                    rows.append((doc, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    held += len(ids)
                    if held > 1 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])


def encode_corpus(docs: DataFrame, path: str | None = None, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the token files of docs and returns their list, as write_files()."""
    from lathe.llm.tokens import encoder

    path = path or tokenizer_path()
    vocab = max(encoder(path).tokenizer.get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocab <= 1 << 16 else "<u4"
    rows = token_table(docs, path, end_id, dtype)
    place = scratch_path(docs.sparkSession, "ids")
    rows.write.option("compression", "zstd").parquet(place)
    rows = docs.sparkSession.read.schema(rows.schema).parquet(place)
    return write_files(rows, folder or scratch_path(docs.sparkSession, "tokens"), vocab, dtype)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_files(encode_corpus(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
