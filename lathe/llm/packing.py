"""Packing by Karmarkar-Karp multiway differencing.

A task encodes and packs its own documents in one pass, group by group, without a shuffle (two passes in a row would keep twice as many Python workers alive). Whole windows are cut off long documents first.
The rests of a group (about `group` windows' worth) are dealt to k windows by multiway differencing: every item is a
partial partition of k loads; the two with the largest spread are merged, the heaviest window of one onto the lightest
of the other, until one partition is left, whose windows are near-equal. k is the least number that could hold the
group; whenever a window passes the capacity, k rises and the group is dealt anew. So a rest is never cut.

A piece's sequence_id is unique over the table: task number and window number. Nulls: a null text is empty (its
document is the end id alone); a null doc_id is packed like any other. Repeated rows are separate documents. No rows give
no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import table
from lathe.llm.huffman import encoding, id_and_text, tokenizer_path


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deals items to k windows of near-equal sums: the item numbers of each window."""
    n = len(sizes)
    if k == 1:
        return [list(range(n))]
    left, right = [], []  # of inner nodes n, n + 1, ...; a window's items are the leaves below its node
    heap = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        if isinstance(a, list) and isinstance(b, list) and len(a) + len(b) <= k:
            both = sorted(zip(a + b, na + nb, strict=True), reverse=True)
            loads, nodes = [x for x, _ in both], [x for _, x in both]
            spread = loads[0] - (loads[-1] if len(loads) == k else 0)
        else:
            (a, na), (b, nb) = _dense(a, na, k), _dense(b, nb, k)
            b, nb = b[::-1], nb[::-1]
            loads = a + b
            joined = (na >= 0) & (nb >= 0)
            nodes = np.maximum(na, nb)
            nodes[joined] = n + len(left) + np.arange(int(joined.sum()))
            left += na[joined].tolist()
            right += nb[joined].tolist()
            order = np.argsort(-loads, kind="stable")
            loads, nodes = loads[order], nodes[order]
            loads = loads - loads[-1]
            spread = int(loads[0])
        heapq.heappush(heap, (-spread, tick, loads, nodes))
        tick += 1
    out: list[list[int]] = []
    for root in _dense(heap[0][2], heap[0][3], k)[1].tolist():
        items, todo = [], [root] if root >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo += [left[x - n], right[x - n]]
        out.append(items)
    return out


def _dense(loads, nodes, k: int) -> tuple[np.ndarray, np.ndarray]:
    if not isinstance(loads, list):
        return loads, nodes
    pad = k - len(loads)
    return np.array(loads + [0] * pad, dtype=np.int64), np.array(nodes + [-1] * pad, dtype=np.int64)


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers, none above the capacity; every item must be within it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in dealt) <= capacity:
            return [w for w in dealt if w]
        k += 1


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packing(capacity: int = 2048, group: int = 128) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of doc_id, ids (binary of unsigned 32-bit ids) to batches of SCHEMA, a row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # document, start, ids of the rest, all ids
        tokens = 0
        out: list[tuple] = []

        def deal() -> None:
            nonlocal sequence, held, tokens
            for window in pack_group([len(h[2]) // 4 for h in held], capacity) if held else []:
                offset = 0
                for i in window:
                    doc, start, ids, n = held[i]
                    out.append((doc, start, len(ids) // 4, ids, n, sequence, offset))
                    offset += len(ids) // 4
                sequence += 1
            held, tokens = [], 0

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(ids) // 4
                whole = n // capacity * capacity
                for at in range(0, whole, capacity):
                    out.append((doc, at, capacity, ids[4 * at : 4 * (at + capacity)], n, sequence, 0))
                    sequence += 1
                    if len(out) >= 1024:
                        yield _batch(out)
                        out = []
                if n > whole:
                    held.append((doc, whole, ids[4 * whole :], n))
                    tokens += n - whole
                if tokens >= group * capacity:
                    deal()
                    yield _batch(out)
                    out = []
        deal()
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    long = pa.int64()
    kinds = (long, long, long, pa.binary(), long, long, long)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, most_cuts: int = 300_000, **options) -> DataFrame:
    """A row a piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset. most_cuts bounds the cache of each worker's encoder; it changes no result."""
    encoded, packed = encoding(path or tokenizer_path(), end_id, most_cuts=most_cuts), packing(**options)
    return id_and_text(docs).mapInArrow(lambda batches: packed(encoded(batches)), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
