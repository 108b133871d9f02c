"""Exact dedup with Patricia-trie owners.

1. Each task turns its texts into bytes and inserts them into a trie of its own, so a copy leaves a task once, with
   the smallest identifier and the count of the task's copies (a hot group is thus added up before the shuffle).
2. Rows go to owners by length and content hash. An owner inserts the full byte strings of the texts into compressed
   radix tries, where texts share what they begin with; equality is decided there, by every byte, never by the hash.
   Terminal nodes keep the smallest identifier and the count. Beyond a byte budget the largest subtree goes to a spill
   file; at the end it is built again alone, below the prefix that all its texts share, under the same budget.
3. The owners' short rows are joined back to the documents by length and SHA-256 of the text.

Identifiers are ordered by a sign: keep="smallest" or "largest" (which stores the smallest of the negated ones).
Null texts count as empty. A null doc_id comes after all others, so it stays only in a group without any other id.
Repeated rows (same doc_id and text) count in group_size; each is returned, with the same decision. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import lower_ascii, materialize, slices, table

#: Stands for a null id in tries: after every other.
NO_ID = 1 << 63


class Patricia:
    """Compressed radix trie over byte strings; each terminal node holds the smallest identifier and a count."""

    __slots__ = ("root", "bytes")

    def __init__(self) -> None:
        # a node: [label, children by first byte (or None), smallest identifier (or None), count]
        self.root: list = [b"", None, None, 0]
        self.bytes = 0

    def insert(self, key: bytes, ident: int, count: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node[2] = ident if node[2] is None else min(node[2], ident)
                node[3] += count
                return
            child = node[1].get(key[at]) if node[1] else None
            if child is None:
                if node[1] is None:
                    node[1] = {}
                node[1][key[at]] = [key[at:], None, ident, count]
                self.bytes += len(key) - at + 200
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = self._common(label, key, at)
            upper = [label[:same], {label[same]: child}, None, 0]
            child[0] = label[same:]
            node[1][key[at]] = upper
            self.bytes += 200
            node, at = upper, at + same

    @staticmethod
    def _common(label: bytes, key: bytes, at: int) -> int:
        """Length of the common prefix of label and key[at:], by halving."""
        low, high = 0, min(len(label), len(key) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if key.startswith(label[:mid], at):
                low = mid
            else:
                high = mid - 1
        return low

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        """(key, smallest identifier, count) of every terminal node."""
        todo = [(b"", self.root)]
        while todo:
            prefix, node = todo.pop()
            whole = prefix + node[0]
            if node[3]:
                yield whole, node[2], node[3]
            if node[1]:
                todo += [(whole, child) for child in node[1].values()]


class Owner:
    """Subtrees of texts that share their first `depth` bytes, by the next byte, within a byte budget."""

    def __init__(self, budget: int, depth: int = 0) -> None:
        self.budget, self.depth, self.held = budget, depth, 0
        self.prefix, self.end = b"", None
        self.tries: dict[int, Patricia] = {}
        self.spilled: dict[int, BinaryIO] = {}

    def insert(self, text: bytes, ident: int, count: int) -> None:
        self.prefix = text[: self.depth]
        if len(text) == self.depth:
            self.end = (min(self.end[0], ident), self.end[1] + count) if self.end else (ident, count)
            return
        sub = text[self.depth]
        if sub in self.spilled:
            pickle.dump((text, ident, count), self.spilled[sub])
            return
        trie = self.tries.setdefault(sub, Patricia())
        before = trie.bytes
        trie.insert(text[self.depth :], ident, count)
        self.held += trie.bytes - before
        if self.held > self.budget:
            self._spill(max(self.tries, key=lambda s: self.tries[s].bytes))

    def _spill(self, sub: int) -> None:
        trie = self.tries.pop(sub)
        self.held -= trie.bytes
        out = self.spilled[sub] = tempfile.TemporaryFile()
        for rest, ident, count in trie.items():
            pickle.dump((self.prefix + rest, ident, count), out)

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        """(text, smallest identifier, count) of every terminal node; can be read once."""
        if self.end:
            yield self.prefix, *self.end
        for sub in list(self.tries):
            for rest, ident, count in self.tries.pop(sub).items():
                yield self.prefix + rest, ident, count
        for sub in list(self.spilled):
            with self.spilled.pop(sub) as file:
                shared = reduce(lambda a, b: os.path.commonprefix([a, b]), (text for text, _, _ in unpickled(file)))
                below = Owner(self.budget, max(self.depth + 1, len(shared)))
                for item in unpickled(file):
                    below.insert(*item)
            yield from below.items()


def unpickled(file: BinaryIO) -> Iterator[tuple[bytes, int, int]]:
    end = file.seek(0, os.SEEK_END)
    file.seek(0)
    while file.tell() < end:
        yield pickle.load(file)


def sha256(data: bytes) -> bytes:
    import hashlib

    return hashlib.sha256(data).digest()


ROWS = "length long, hash binary, text binary, ident long, n long"


def local_texts(sign: int, digest: Callable[[bytes], bytes], chunk: int = 32 << 20) -> Callable:
    """Of each chunk of a task's texts, one row a distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia()

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list = []
            size = 0
            for text, ident, n in trie.items():
                rows.append((len(text), digest(text), text, ident, n))
                size += len(text)
                if size > 4 << 20:
                    yield pack(rows)
                    rows, size = [], 0
            if rows:
                yield pack(rows)

        for b in slices(batches, "text"):
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass").lower()
                trie.insert(raw, NO_ID if ident is None else sign * ident)
            if trie.bytes > chunk:
                yield from flush()
                trie = Patricia()
        yield from flush()

    return run


def pack(rows: list[tuple]) -> pa.RecordBatch:
    length, digest, text, ident, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(digest, pa.binary()), pa.array(text, pa.binary()), pa.array([None if i == NO_ID else i for i in ident], pa.int64()), pa.array(n, pa.int64())], names=["length", "hash", "text", "ident", "n"])


def owners(budget: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = Owner(budget)
        for b in batches:
            for text, ident, n in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                owner.insert(text, NO_ID if ident is None else ident, n)
        rows: list = []
        for text, ident, n in owner.items():
            rows.append((len(text), sha256(text).hex(), None if ident == NO_ID else ident, n))
            if len(rows) >= 50_000:
                yield told(rows)
                rows = []
        if rows:
            yield told(rows)

    return run


def told(rows: list[tuple]) -> pa.RecordBatch:
    length, sha, ident, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(sha), pa.array(ident, pa.int64()), pa.array(n, pa.int64())], names=["length", "text_sha256", "ident", "group_size"])


def distinct_texts(docs: DataFrame, keep: str = "largest", digest: Callable[[bytes], bytes] = sha256, budget: int = 192 << 20) -> DataFrame:
    """length, text_sha256, keep_id, group_size: a row for each different text, from the owners' tries."""
    sign = {"smallest": 1, "largest": -1}[keep]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = rows.mapInArrow(local_texts(sign, digest), ROWS).repartition("length", "hash")
    found = sent.mapInArrow(owners(budget), "length long, text_sha256 string, ident long, group_size long")
    return found.select("length", "text_sha256", (F.col("ident") * sign).alias("keep_id"), "group_size")


def dedup(docs: DataFrame, keep: str = "largest", **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    norm = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.cast("binary").alias("norm")).select("doc_id", F.octet_length("norm").cast("long").alias("length"), F.sha2("norm", 256).alias("text_sha256"))
    groups = materialize(distinct_texts(docs, keep, **options), "dedup")
    return mine.join(groups, ["length", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), "largest")


SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
