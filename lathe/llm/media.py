"""Media columns: bytes as 8-bit grey PNG in a binary column, and a hash of their low cosine frequencies.

A payload is laid out in rows of WIDTH samples. The rows are filtered by the one of None, Sub and Up whose values have
the least entropy, packed with zlib into IDAT chunks, and every chunk carries its CRC-32. Reading tests the
signature, every chunk's checksum, zlib's own, and the sizes, and undoes all five filters with numpy. The feature is a
64-bit hash: samples averaged to 32 by 32, the 8 by 8 lowest cosine frequencies, each against their median.

Nulls: a null text is empty (one unit of 255s); a null doc_id is carried. Equal texts give equal values. An empty table
gives no rows; other columns are ignored. A damaged image raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import materialize, slices, table

WIDTH, UNIT, FILL = 96, 576, 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT = 1 << 16


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def entropy(samples: np.ndarray) -> float:
    n = np.bincount(samples.ravel(), minlength=256)
    p = n[n > 0] / samples.size
    return float(-(p * np.log2(p)).sum())


def write_png(samples: np.ndarray, level: int = 6) -> bytes:
    """PNG of a (height, width) array of 8-bit samples."""
    h, w = samples.shape
    up = samples.copy()
    up[1:] -= samples[:-1]
    sub = samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    best = min((entropy(x), kind) for kind, x in enumerate((samples, sub, up)))[1]
    lines = np.empty((h, w + 1), dtype=np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = (samples, sub, up)[best]
    data = zlib.compress(lines.tobytes(), level)
    parts = [chunk(b"IDAT", data[at : at + IDAT]) for at in range(0, len(data), IDAT)]
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + b"".join(parts) + chunk(b"IEND", b"")


def read_png(raw: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, all checksums tested."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at < len(raw) and not ended:
        if at + 12 > len(raw):
            raise ValueError("cut chunk")
        (n,) = struct.unpack_from(">I", raw, at)
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        if len(body) != n or zlib.crc32(kind + body) != int.from_bytes(raw[at + 8 + n : at + 12 + n], "big"):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey PNG")
    w, h = head[:2]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(lines) != h * (w + 1):
        raise ValueError("wrong number of samples")
    lines = lines.reshape(h, w + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undoes PNG filters: None and Sub for all rows at once, Up by row, Average and Paeth by sample."""
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    out = lines.copy()
    sub = kinds == 1
    out[sub] = np.cumsum(lines[sub], axis=1, dtype=np.uint8)
    for y in np.flatnonzero(kinds >= 2).tolist():
        above = out[y - 1] if y else np.zeros(out.shape[1], np.uint8)
        if kinds[y] == 2:
            out[y] = lines[y] + above
            continue
        a = c = 0
        row, up = lines[y].tolist(), above.tolist()
        for x, (v, b) in enumerate(zip(row, up, strict=True)):
            if kinds[y] == 3:
                a = (v + (a + b) // 2) & 255
            else:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                a, c = (v + near) & 255, b
            row[x] = a
        out[y] = row
    return out


def cosines(n: int = 32, low: int = 8) -> np.ndarray:
    """The low lowest rows of the orthonormal cosine transform of n samples."""
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(0.5), 1.0)


COSINES = cosines()


def resized(samples: np.ndarray, n: int = 32) -> np.ndarray:
    """Averages over an n by n grid (nearest samples along a side that is shorter than n)."""
    out = samples.astype(np.float64)
    for axis in (0, 1):
        size = out.shape[axis]
        at = np.arange(n) * size // n
        if size < n:
            out = np.take(out, at, axis=axis)
        else:
            width = np.diff(np.append(at, size))
            out = np.add.reduceat(out, at, axis=axis) / (width[:, None] if axis == 0 else width)
    return out


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: whether each of the 64 low frequencies is above the median of them."""
    low = COSINES @ resized(samples) @ COSINES.T
    low = np.round(low, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary PNG) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            sizes, media = [], []
            for text in b.column(1).to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                fill = -len(raw) % UNIT or (0 if raw else UNIT)
                sizes.append(len(raw))
                media.append(write_png(np.frombuffer(raw + bytes([FILL]) * fill, np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(stored: DataFrame) -> DataFrame:
    """Features of stored media (doc_id, n_bytes, media), from the decoded samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media in b.column(2).to_pylist():
                samples = read_png(media)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[f.split()[0] for f in FEATURES.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(materialize(encode_media(table(spark, sf_dir, "documents")), "media"))
