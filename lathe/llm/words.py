"""Hashes of words and n-gram sets of whole Arrow columns of texts, by numpy over their bytes.

A word is a run of anything but ASCII white space; A-Z count as a-z. Its hash is the sum of (number of byte k) * P^k
modulo 2^64, so the hashes of all words of a buffer come from one running sum. Texts longer than a buffer are read piece
by piece, cut at white space; a longer word is summed up over pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.cumprod(out)


class Hasher:
    """One a task: two tables of PIECE numbers (16 MB), made when first needed."""

    def __init__(self) -> None:
        self.number = mixed(np.arange(1, 257, dtype=np.uint64) * P)
        self.number[65:91] = self.number[97:123]
        self.number[[9, 10, 11, 12, 13, 32]] = 0
        self.up, self.down = powers(P, PIECE), powers(np.uint64(pow(int(P), -1, 1 << 64)), PIECE)

    def words(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of at most PIECE bytes, and where they start. begins: where texts begin."""
        number = self.number[raw]
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = number != 0
        new = np.zeros(len(raw) + 1, dtype=bool)
        new[begins] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | new[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | new[1:])) + 1
        number *= self.up[: len(raw)]
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(number, out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts]), starts

    def long_word(self, raw: np.ndarray) -> np.uint64:
        total = 0
        for at in range(0, len(raw), PIECE):
            part = self.number[raw[at : at + PIECE]]
            total += int((part * self.up[: len(part)]).sum(dtype=np.uint64)) * pow(int(P), at, 1 << 64)
        return mixed(np.array([total % (1 << 64)], dtype=np.uint64))[0]

    def long_text(self, raw: np.ndarray) -> np.ndarray:
        out, at = [], 0
        none = np.zeros(1, dtype=np.int64)
        while at < len(raw):
            to = min(at + PIECE, len(raw))
            if to < len(raw):
                gaps = np.flatnonzero(self.number[raw[at:to]] == 0)
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:
                    while to < len(raw) and self.number[raw[to]]:
                        to += 1
                    out.append(np.array([self.long_word(raw[at:to])]))
                    at = to
                    continue
            out.append(self.words(raw[at:to], none)[0])
            at = to
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts one after another, and the number of words of each; null: none."""
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
        i = 0
        while i < len(texts):
            j = int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1
            if j <= i:
                hashes.append(self.long_text(raw[at[i] : at[i + 1]]))
                counts[i] = len(hashes[-1])
                i += 1
                continue
            found, starts = self.words(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            hashes.append(found)
            counts[i:j] = np.diff(np.searchsorted(starts, at[i : j + 1] - at[i]))
            i = j
        return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), counts

    def sets(self, texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Of every text the sorted distinct 62-bit hashes of its word n-grams, one after another, and how many each has. Fewer words than size: all in one."""
        h, words = self.column(texts)
        ends = np.cumsum(words)
        begins = ends - words
        n = max(0, len(h) - size + 1)
        x = np.full(n, np.uint64(size))
        for i in range(size):
            x *= P
            x += h[i : i + n]
        x = (mixed(x) >> np.uint64(2)).view(np.int64)
        parts, lengths = [], np.zeros(len(words), dtype=np.int64)
        for i, (a, w) in enumerate(zip(begins.tolist(), words.tolist(), strict=True)):
            if not w:
                continue
            if w < size:
                y = np.full(1, np.uint64(w))
                for one in h[a : a + w]:
                    y = y * P + one
                part = (mixed(y) >> np.uint64(2)).view(np.int64)
            else:
                part = x[a : a + w - size + 1]
                part.sort()
                if len(part) > 1 and (same := part[1:] == part[:-1]).any():
                    part = part[np.concatenate([[True], ~same])]
            parts.append(part)
            lengths[i] = len(part)
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), lengths


def signatures(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, by sums that don't depend on order; 0 for an empty one."""
    x, some = flat.view(np.uint64), lengths > 0
    starts = (np.cumsum(lengths) - lengths)[some]
    out = []
    for y in (x + P, x ^ P):
        sums = np.zeros(len(lengths), dtype=np.uint64)
        if len(starts):
            sums[some] = np.add.reduceat(mixed(y), starts)
        out.append(sums.view(np.int64))
    return out[0], out[1]
