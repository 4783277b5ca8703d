"""Vectorised hashes of words and of word windows over Arrow batches of texts.

A slice holds the texts of a few documents, a few megabytes together. Words are the runs of bytes other
than the six ASCII spaces. A word's hash is a polynomial over its bytes, taken from prefix sums modulo
2**64 (odd bases have inverses there) and mixed; a window's hash is a polynomial over its words' hashes.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
CHUNK = 1 << 18
LONG_WORD = 4096
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_SEEDS = (0x165667B19E3779F9, 0x27D4EB2F165667C5)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables = {}


def _powers(base):
    """base**i and base**-i modulo 2**64 for i <= CHUNK."""
    if base not in _tables:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(CHUNK + 1, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _tables[base] = out
    return _tables[base]


def mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch, text="text", limit=SLICE_BYTES):
    """(first row, rows, bytes, offsets) of runs of rows with at most limit bytes of text, one row at least."""
    col = batch.column(batch.schema.get_field_index(text))
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """starts, ends: byte ranges of all words of a slice; first: index of each document's first word, and the end."""

    def __init__(self, data, offsets):
        self.data = data
        inside = ~_SPACE[data]
        edge = np.empty(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0] = len(data) > 0 and inside[0]
        edge[-1] = len(data) > 0 and inside[-1]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        both = cut[inside[cut] & inside[cut - 1]] if len(data) else cut[:0]  # a word ends and one begins where documents meet
        at = np.flatnonzero(edge)
        if len(both):
            at = np.sort(np.concatenate([at, np.repeat(np.unique(both), 2)]))
        self.starts, self.ends = at[0::2], at[1::2]
        self.first = np.searchsorted(self.starts, offsets)
        self.first[-1] = len(self.starts)

    def hashes(self, which):
        """64-bit hash of each word by one of two independent bases."""
        base = SEEDS[which]
        pw, inv = _powers(base)
        out = np.empty(len(self.starts), np.uint64)
        size = self.ends - self.starts
        i, n = 0, len(out)
        while i < n:
            s = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, s + CHUNK, "right")))
            if size[i] <= LONG_WORD or j > i + 1:
                x = (self.data[s : self.ends[j - 1]].astype(np.uint64) + np.uint64(1)) if self.ends[j - 1] - s <= CHUNK else None
            else:
                x = None
            if x is not None:
                total = np.zeros(len(x) + 1, np.uint64)
                np.cumsum(x * pw[: len(x)], out=total[1:])
                a, b = self.starts[i:j] - s, self.ends[i:j] - s
                out[i:j] = (total[b] - total[a]) * inv[a]
            i = j
        for k in np.flatnonzero(size > LONG_WORD):
            out[k] = int.from_bytes(hashlib.blake2b(self.data[self.starts[k] : self.ends[k]].tobytes(), digest_size=16).digest()[8 * which : 8 * which + 8], "little")
        return mix(out ^ (size.astype(np.uint64) * np.uint64(SEEDS[1 - which])))


def windows(words, length, which):
    """Hash of words[i : i + length] for each i where that many follow, document borders ignored."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pw, inv = _powers(WORD_SEEDS[which])
    out, step = np.empty(n, np.uint64), CHUNK - length
    for i in range(0, n, step):
        x = words[i : min(i + step, n) + length - 1]
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * pw[: len(x)], out=total[1:])
        k = min(i + step, n) - i
        out[i : i + k] = (total[length : length + k] - total[:k]) * inv[:k]
    return mix(out)
