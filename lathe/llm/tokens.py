"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once a worker.

A byte-level BPE splits text before it merges: always before a space or newline that follows anything but white space,
and always between a letter or digit and a mark (but an apostrophe, which may begin a contraction). So a text may be cut
there, and the cuts' ids put together equal the text's ids. numpy finds the cuts in the texts' bytes, Arrow's
dictionary encoding numbers them, new cuts are encoded by the library (many at once) and kept in a bounded cache; ids are
then gathered with numpy. Texts in which some such cuts aren't safe (other white space, runs of white space, special
tokens) are encoded as they are, long ones in pieces cut at single spaces between letters or digits. The library sees
little at once, since its result takes hundreds of bytes an id.
"""

from __future__ import annotations

import string
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: RE2: white space other than space and newline, runs, outer white space, the special token's start.
UNSAFE = r"[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]|[ \n][ \n]|^[ \n]|[ \n]$|<\|"


#: New cuts, and bytes of texts without safe cuts, that the library gets at once.
MOST_NEW, MOST_BYTES = 16_384, 1 << 16


def bytes_in(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


GAPS, MARKS, SOLID = bytes_in(" \n"), bytes_in(string.punctuation.replace("'", "")), bytes_in(string.ascii_letters + string.digits)
#: Second bytes of the Latin letters U+00C0 to U+00FF, which are the two-byte characters after 0xC3 but for two signs.
LATIN = np.zeros(256, dtype=bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False


def cuts_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The cuts of all texts one after another, and the number of the first cut of each text and of the end."""
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    new = GAPS[raw]
    left = SOLID[raw[:-1]]
    left[1:] |= LATIN[raw[1:-1]] & (raw[:-2] == 0xC3)
    new[1:] |= MARKS[raw[1:]] & left
    new[at[:-1][at[:-1] < at[1:]]] = True
    bounds = np.flatnonzero(new)
    cuts = pa.Array.from_buffers(pa.string(), len(bounds), [None, pa.py_buffer(np.append(bounds, len(raw)).astype(np.int32)), pa.py_buffer(raw)])
    return cuts, np.searchsorted(bounds, at)


def pieces_of(text: str) -> list[str]:
    """A text in pieces of about MOST_BYTES, each but the first beginning with a space between two letters or digits (ASCII)."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if len(raw) <= MOST_BYTES:
        return [text]
    places = np.flatnonzero((raw[1:-1] == 32) & SOLID[raw[:-2]] & SOLID[raw[2:]]) + 1
    marks = [0]
    while (i := int(np.searchsorted(places, marks[-1] + MOST_BYTES))) < len(places):
        marks.append(int(places[i]))
    return [raw[a:b].tobytes().decode() for a, b in zip(marks, [*marks[1:], len(raw)], strict=True)]


class Encoder:
    def __init__(self, path: str, most_cuts: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for piece, i in vocab.items():
            self.n_bytes[i] = len(piece)  # a character of a byte-level piece is a byte
        self.most_cuts = most_cuts
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())  # cut i has lengths[i] ids, from ids[starts[i]]
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.starts, self.lengths, self.used = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64), 0

    def _keep(self, slots: np.ndarray) -> None:
        """Makes room: of the cuts so far, only those of the present texts (so all frequent ones) stay."""
        known, ids, starts, n = self.known, self.ids, self.starts[slots], self.lengths[slots]
        self._forget()
        if len(slots):
            ends = np.cumsum(n)
            self._add(known.take(pa.array(slots)), ids[np.arange(ends[-1]) + np.repeat(starts - (ends - n), n)], ends - n, ends)

    def _learn(self, cuts: pa.Array) -> None:
        """Encodes new cuts, all in one text: a newline before a cut that begins with neither space nor newline is an id of its own."""
        bare = pc.invert(pc.match_substring_regex(cuts, "^[ \n]"))
        whole = pc.if_else(bare, pc.binary_join_element_wise("\n", cuts, ""), cuts)
        n = pc.binary_length(whole).to_numpy()
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), "")[0].as_py()
        got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.searchsorted(np.cumsum(self.n_bytes[got]), np.cumsum(n)) + 1
        self._add(cuts, got, np.concatenate([[0], ends[:-1]]) + bare.to_numpy(zero_copy_only=False), ends)

    def _add(self, cuts: pa.Array, got: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n, m = len(self.known), len(cuts)
        if n + m > len(self.starts):
            more = max(n + m, len(self.starts) * 3 // 2) - len(self.starts)
            self.starts, self.lengths = np.pad(self.starts, (0, more)), np.pad(self.lengths, (0, more))
        if self.used + len(got) > len(self.ids):
            self.ids = np.pad(self.ids, (0, max(self.used + len(got), len(self.ids) * 3 // 2) - len(self.ids)))
        self.ids[self.used : self.used + len(got)] = got
        self.starts[n : n + m], self.lengths[n : n + m] = starts + self.used, ends - starts
        self.used += len(got)
        self.known = pa.concat_arrays([self.known, cuts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (uint32), and the number of ids of each text. Null: empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        unsafe = pc.match_substring_regex(texts, UNSAFE)
        safe = texts.filter(pc.invert(unsafe))
        ids, lengths = self._encode_safe(safe)
        if not pc.any(unsafe).as_py():
            return ids, lengths
        odd = (self._encode_whole(t.as_py()) for t in texts.filter(unsafe))
        even = iter(np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else [])
        parts = [next(odd if u else even) for u in unsafe.to_pylist()]
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)

    def _encode_whole(self, text: str) -> np.ndarray:
        parts = [np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype=np.uint32) for p in pieces_of(text)]
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def _encode_safe(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cuts, firsts = cuts_of(texts)
        if not len(cuts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cuts = cuts.dictionary_encode()
        found = pc.index_in(cuts.dictionary, self.known)
        if found.null_count:
            new = cuts.dictionary.filter(pc.is_null(found))
            if len(self.known) + len(new) > self.most_cuts:
                self._keep(found.drop_null().to_numpy())
                found = pc.index_in(cuts.dictionary, self.known)
            n = len(self.known)
            for i in range(0, len(new), MOST_NEW):
                self._learn(new.slice(i, MOST_NEW))
            later = np.zeros(len(found), dtype=np.int64)
            later[pc.is_null(found).to_numpy(zero_copy_only=False)] = np.arange(n, n + len(new))
            found = pc.if_else(pc.is_null(found), pa.array(later), found.cast(pa.int64()))
        slots = found.to_numpy()[cuts.indices.to_numpy()]
        n = self.lengths[slots]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[slots] - (ends - n), n)
        of = np.concatenate([[0], ends])
        return self.ids[at], np.diff(of[firsts])


@cache
def encoder(path: str, most_cuts: int = 300_000) -> Encoder:
    """One a worker process: its cache outlives tasks. A cut takes about 0.05 kB."""
    return Encoder(path, most_cuts)
