"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Words are the runs of letters, digits and other non-blank, non-punctuation
characters of the lower-cased text.  An item of w words is compared with every
window of w words of every document (a shorter document is one window).  Both are
weighted sets of ``k``-word shingles, a shingle's weight being how often it occurs.

* A window is worth a fingerprint only if it holds enough shingles of any item:
  similarity t needs a common weight of 2t / (1 + t) of the window's, which prefix
  sums over the places of item shingles bound from above.  Nothing is lost by it.
* A 128-bit SimHash is the sign of the weighted sum of the shingles' bits.  Items of
  a size are indexed by the distinct values of ``BLOCKS`` blocks of 16 bits, each with the
  list of its items.  Who differs in at most ``RADIUS`` bits differs in at most
  RADIUS // 4 bits of one of four 32-bit words, and in half as many of one of
  that word's two blocks: so all values of every block within these few bits, and of
  their items those whose word is near enough, hold every fingerprint within the
  radius.  Random fingerprints pass this in about 4 of 100 cases.  (Similarity 0.8
  is 19 bits apart on average; the radius is 4.7 deviations above.)
* Candidates are verified by exact weighted similarity, sum of minima over sum of
  maxima, and the best window of each document and item is told.

Items are indexed in parts of about ``ITEMS`` rows and ``CHARS`` characters, dealt by hash, so
what a task and the driver hold is bounded; documents
are read once for each such part of the benchmark and never shuffled.

Defined results: null or empty texts and items match nothing; an item shorter than
``k`` words is one shingle, matched as a whole; repeated rows and items are reported
each; items with a null id are reported with a null id; an empty table on either
side gives no matches; other columns, whatever their names, are ignored by ``leaks``
and passed through by ``decontaminate``; of windows of equal similarity the first
is told; texts of any length are searched whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from ._tokens import Tokenizer, mix, pieces, runs

K, LEAST = 5, 0.8
RADIUS, WORDS, BLOCKS = 38, 4, 8
#: Windows that look values up at once.
TOGETHER = 1024
ITEMS, CHARS = 20_000, 32_000_000
BITMAP = 24
MATCH = "item_id long, start_word long, n_words long, hamming int, similarity double"


def _tokenizer() -> Tokenizer:
    t = Tokenizer()
    t.space = t.space.copy()
    for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        t.space[c] = True
    return t


def _gram(h, n):
    """Hashes of all runs of n words."""
    full = max(len(h) - n + 1, 0)
    s = np.zeros(full, np.uint64)
    for j in range(n):
        s += h[j : j + full] * np.uint64(pow(0x2545F4914F6CDD1D, j, 1 << 64))
    return mix(s + np.uint64(n))


#: Two 64-bit hashes of a shingle: itself, and itself mixed with this number.
SECOND = np.uint64(0xA0761D6478BD642F)


def _bits(s: np.ndarray) -> np.ndarray:
    """A row of 128 bits for each shingle."""
    both = np.column_stack((s, mix(s ^ SECOND))).astype("<u8")
    return np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1)


def simhash(s: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers."""
    return np.packbits(2 * _bits(s).sum(0, dtype=np.int64) > len(s)).view("<u8")


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of fingerprints differ."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Index:
    """The items of one part of the benchmark, by size in words."""

    def __init__(self, ids, words, k=K, least=LEAST):
        self.k, self.least, self.sizes, self.short = k, least, {}, {}
        shingles = []
        for i, h in zip(ids, words):
            n = len(h)
            if not n:
                continue
            if n < k:
                self.short.setdefault(n, {}).setdefault(int(_gram(h, n)[0]), []).append(i)
                continue
            s = np.sort(_gram(h, k))
            self.sizes.setdefault(n, []).append((i, s, simhash(s)))
            shingles.append(s)
        self.known = np.unique(np.concatenate(shingles)) if shingles else np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << BITMAP, bool)
        self.bitmap[(self.known >> np.uint64(64 - BITMAP)).astype(np.int64)] = True
        for n, items in self.sizes.items():
            prints = np.array([x[2] for x in items], "<u8").reshape(-1, 2)
            parts, blocks = prints.view("<u2"), []
            for b in range(BLOCKS):
                order = np.argsort(parts[:, b], kind="stable")
                values, starts = np.unique(parts[order, b], return_index=True)
                blocks.append((values, np.append(starts, len(order)), order))
            self.sizes[n] = (items, prints, blocks)

    def hits(self, s: np.ndarray) -> np.ndarray:
        out = self.bitmap[(s >> np.uint64(64 - BITMAP)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = self.known[np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)] == s[at]
        return out

    def candidates(self, size: int, prints: np.ndarray):
        """(window, item, distance) within the radius, found by the blocks."""
        _, own, blocks = self.sizes[size]
        found = [np.zeros((3, 0), np.int64)]
        for lo in range(0, len(prints), TOGETHER):
            some, met = prints[lo : lo + TOGETHER].astype("<u8"), []
            parts = some.view("<u2")
            for b, (values, starts, order) in enumerate(blocks):
                w, v = np.nonzero(np.bitwise_count(parts[:, b, None] ^ values) <= RADIUS // WORDS // (BLOCKS // WORDS))
                n = starts[v + 1] - starts[v]
                window = np.repeat(w, n)
                item = order[np.repeat(starts[v] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                word = b // (BLOCKS // WORDS)
                near = np.bitwise_count(some.view("<u4")[window, word] ^ own.view("<u4")[item, word]) <= RADIUS // WORDS
                met.append(window[near] * len(own) + item[near])
            both = np.unique(np.concatenate(met))
            window, item = both // len(own), both % len(own)
            far = _far(some[window], own[item])
            ok = far <= RADIUS
            found.append(np.stack((window[ok] + lo, item[ok], far[ok])))
        return np.concatenate(found, axis=1)

    def match(self, h: np.ndarray, s: np.ndarray, hit: np.ndarray) -> list[dict]:
        """The best window for each item in a document of words h and shingles s, which hit marks as known."""
        out, k = [], self.k
        for n, grams in self.short.items():
            for at, g in enumerate(_gram(h, n).tolist()):
                for i in grams.get(g, ()):
                    out.append({"item_id": i, "start_word": at, "n_words": n, "hamming": 0, "similarity": 1.0})
        out = list({x["item_id"]: x for x in reversed(out)}.values())
        if not hit.any():
            return out
        sums = np.concatenate(([0], np.cumsum(hit)))
        common = 2 * self.least / (1 + self.least)
        for size, (items, *_) in self.sizes.items():
            m = min(size - k + 1, len(s))  # a shorter document is one window
            least = self.least * (size - k + 1) if m < size - k + 1 else common * m
            start = np.flatnonzero(sums[m:] - sums[:-m] >= least - 1e-9)
            if not len(start):
                continue
            lo, hi = int(start[0]), int(start[-1]) + m
            run = np.concatenate((np.zeros((1, 128), np.int32), np.cumsum(_bits(s[lo:hi]), 0, dtype=np.int32)))
            prints = np.packbits(2 * (run[start - lo + m] - run[start - lo]) > m, axis=1).view("<u8")
            best = {}
            for w, j, far in zip(*self.candidates(size, prints)):
                i, t, _ = items[j]
                u = np.sort(s[start[w] : start[w] + m])
                both = _common_weight(u, t)
                sim = both / (len(u) + len(t) - both)
                if sim >= self.least and (j not in best or sim > best[j]["similarity"]):
                    best[j] = {"item_id": i, "start_word": int(start[w]), "n_words": m + k - 1, "hamming": int(far), "similarity": float(sim)}
            out += best.values()
        return out


def _common_weight(u, t):
    """Sum of the minima of the weights of two sorted lists with repeats."""
    x, n = np.unique(u, return_counts=True)
    y, m = np.unique(t, return_counts=True)
    _, a, b = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[a], m[b]).sum())


def _scan(texts, index, tokenizer):
    """The matches of each row, in order."""
    for data, offs in ((d, o) for _, part in runs(texts) for _, d, o in pieces(pc.utf8_lower(part))):
        counts, h, _, _ = tokenizer.words(data, offs)
        s = _gram(h, index.k)
        ends = np.cumsum(counts)
        hit = index.hits(s) if len(index.known) and len(s) else np.zeros(len(s), bool)
        for n, to in zip(counts.tolist(), ends.tolist()):
            lo, m = to - n, max(n - index.k + 1, 0)
            if n and (index.short or hit[lo : lo + m].any()):
                yield index.match(h[lo:to], s[lo : lo + m], hit[lo : lo + m])
            else:
                yield []


def _parts(benchmark: DataFrame, key: str, text: str):
    """Indexes over at most about ITEMS items each, as broadcast variables."""
    rows = benchmark.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    parts = max(1, -(-n // ITEMS), -(-chars // CHARS))
    tokenizer = _tokenizer()
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).orderBy("i", "t").collect()
        words = []
        for _, data, offs in pieces(pc.utf8_lower(pa.array([r.t for r in own], pa.string()))):
            counts, h, _, _ = tokenizer.words(data, offs)
            words += np.split(h, np.cumsum(counts)[:-1])
        yield benchmark.sparkSession.sparkContext.broadcast(Index([r.i for r in own], words))


def _reports(index):
    def run(batches):
        tokenizer, at = _tokenizer(), index.value
        for batch in batches:
            found = list(_scan(batch.column(1), at, tokenizer))
            rows = [i for i, x in enumerate(found) for _ in x]
            flat = [m for x in found for m in x]
            cols = [pa.array([m[c] for m in flat], t) for c, t in (("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int32()), ("similarity", pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *cols], names=["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, start_word, n_words, hamming, similarity."""
    rows, out = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")), None
    for index in _parts(benchmark, item_key, item_text):
        found = rows.mapInArrow(_reports(index), f"doc_id long, {MATCH}")
        out = found if out is None else out.unionByName(found)
    return out


def _clean(index, text):
    def run(batches):
        tokenizer, at = _tokenizer(), index.value
        for batch in batches:
            t = batch.column(text)
            yield batch.filter(pa.array([not x for x in _scan(t.fill_null("") if t.null_count else t, at, tokenizer)], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item of the benchmark."""
    for index in _parts(benchmark, item_key, item_text):
        docs = docs.mapInArrow(_clean(index, docs.columns.index(text)), docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
