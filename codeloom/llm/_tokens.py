"""Words and shingles of Arrow text columns as 64-bit hashes, without a Python loop over words.

A text is taken as UTF-8 bytes.  Words are the runs of bytes other than 0x20 and
0x09-0x0D, A-Z lower-cased; a word's hash is a polynomial over random byte values
modulo 2**64, read from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

B = 0x9E3779B97F4A7C13  # odd: it has an inverse modulo 2**64
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokenizer:
    """Tables of one worker; grows its power tables with the longest text."""

    def __init__(self, lower: bool = True):
        byte = np.arange(256)
        self.space = (byte == 32) | ((byte >= 9) & (byte <= 13))
        fold = np.where((byte >= 65) & (byte <= 90), byte + 32, byte) if lower else byte
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[fold]
        self.fold = fold.astype(np.uint8)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n + 1:
            n = max(n + 1, 1 << 18)
            for name, base in (("up", B), ("down", pow(B, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def words(self, data: np.ndarray, offs: np.ndarray):
        """(counts by row, hash, start, end) of the words of the rows data[offs[i]:offs[i+1]]."""
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return np.zeros(len(offs) - 1, np.int64), z.astype(np.uint64), z, z
        self.powers(n)
        space = self.space[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0] = after[-1] = True
        before[1:], after[:-1] = space[:-1], space[1:]
        before[offs[:-1][offs[:-1] < n]] = True
        after[offs[1:][offs[1:] > 0] - 1] = True
        word = ~space
        start, end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        self.sums = sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return np.diff(np.searchsorted(start, offs)), h, start, end

    def spell(self, start: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n bytes from each start in the text that words() saw last; equal to a word's hash of these bytes."""
        return mix((self.sums[start + n] - self.sums[start]) * self.down[start] + np.uint64(n * 0xC2B2AE3D27D4EB4F & MASK))


def pieces(texts: pa.Array, most: int = 1 << 18):
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, o, d = texts.buffers()
    offs = np.frombuffer(o, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        to = min(to, len(texts))
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def runs(texts: pa.Array, most: int = 1 << 20):
    """(first row, slice) of runs of rows of about ``most`` bytes, for steps that copy texts."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def shingles(counts: np.ndarray, h: np.ndarray, k: int):
    """(counts by row, hash) of the k-word shingles; a row of fewer words has its whole sequence as one."""
    n, off = len(h), np.concatenate(([0], np.cumsum(counts)))
    base = [np.uint64(pow(0x2545F4914F6CDD1D, j, 1 << 64)) for j in range(k)]
    full = max(n - k + 1, 0)
    s = np.zeros(full, np.uint64)
    for j in range(k):
        s += h[j : j + full] * base[j]
    ends = np.repeat(off[1:], counts)[:full]
    ok = np.arange(full) + k <= ends
    s = mix(s[ok] + np.uint64(k))
    per = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        at = np.concatenate(([0], np.cumsum(per)))[short]
        own = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            more = counts[short] > j
            own[more] += h[off[short[more]] + j] * base[j]
        s = np.insert(s, at, mix(own + counts[short].astype(np.uint64)))
        per = per.copy()
        per[short] = 1
    return per, s
