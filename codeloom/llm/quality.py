"""Document quality by a linear-chain conditional random field over lines.

Every line of a text (split at \\n) is good or bad.  A line's features are shares of
character kinds, word and line shapes, repeated words, cut into ``BINS`` bins each, and the same
numbers of the line before and after.  Two labels, a transition table and a start
bias make the chain; forward-backward gives each line's probability of being good,
and a document's quality is their mean weighted by line length.  A last logistic
step over that mean gives the score.

The field is fitted on a bounded sample of labelled rows outside fold 0 (at most
``FIT_ROWS`` documents and ``FIT_LINES`` lines), each line carrying its document's
label, by gradient ascent on the conditional likelihood.  Documents are taken in
the order of a hash until the lines are used up; a text of more than FIT_LINES // 10
lines is scored, but not sampled.  Only the chosen rows' line features come to the driver.  All documents are scored in one map, no shuffle.

Defined results: a null or empty text is one empty line; rows are scored each by
itself, repeats included; a null doc_id is not held out; labels that are null or of
unknown documents are ignored, and with fewer than two classes the score is a
constant (the label's share, or 0.5); an empty table gives no rows; very long texts
are scored whole; equal texts have equal scores; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint, fold, labelled, table
from ._tokens import Tokenizer, pieces
from .toxicity import logistic

FOLDS, FIT_ROWS, FIT_LINES = 5, 6_000, 150_000
BINS, ROUNDS, FEATURES = 6, 120, 12
THRESHOLD = 0.3


def _kinds() -> np.ndarray:
    """For each byte the character kinds it begins: letter, capital, digit, symbol, bar, mark, blank, character."""
    b, k = np.arange(256), np.zeros((8, 256), np.int8)
    capital = (b >= 65) & (b <= 90)
    k[0] = capital | ((b >= 97) & (b <= 122)) | (b >= 0xC0)
    k[1], k[2] = capital, (b >= 48) & (b <= 57)
    k[4] = b == ord("|")
    k[5] = np.isin(b, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    k[6] = (b == 32) | ((b >= 9) & (b <= 13))
    k[3] = (b < 128) & (b > 32) & ~(k[0] | k[2] | k[4] | k[5]).astype(bool)
    k[7] = (b < 0x80) | (b >= 0xC0)
    return k


def line_features(data: np.ndarray, offs: np.ndarray, kinds: np.ndarray, tokenizer: Tokenizer):
    """(lines by row, characters of each line, a row of numbers for each line)."""
    brk = np.flatnonzero(data == 10)
    rows = len(offs) - 1
    lines = 1 + np.diff(np.searchsorted(brk, offs))
    first = np.cumsum(lines) - lines
    start, end = np.empty(lines.sum(), np.int64), np.empty(lines.sum(), np.int64)
    is_first = np.zeros(len(start), bool)
    is_first[first] = True
    is_last = np.roll(is_first, -1)
    start[is_first], end[is_last] = offs[:-1], offs[1:]
    start[~is_first], end[~is_last] = brk + 1, brk
    n = np.empty((8, len(start)))
    for i in range(8):
        run = np.concatenate(([0], np.cumsum(kinds[i][data], dtype=np.int64)))
        n[i] = run[end] - run[start]
    size = len(data)
    blank = kinds[6][data].astype(bool) if size else np.zeros(0, bool)
    after = np.ones(size, bool)
    after[:-1] = blank[1:]
    odd_end = np.concatenate(([0], np.cumsum((kinds[3][data].astype(bool) if size else blank) & after)))
    counts, h, at, _ = tokenizer.words(data, offs)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[(np.cumsum(counts) - counts)[counts > 0]] = False
    again = np.concatenate(([0], np.cumsum(again)))
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
    words = hi - lo
    repeat = np.zeros(size, bool)
    if size > 1:
        repeat[1:] = (data[1:] == data[:-1]) & ~blank[1:]
    same = np.concatenate(([0], np.cumsum(repeat)))
    chars, some = n[7], np.maximum(n[7], 1)
    w = np.maximum(words, 1)
    out = np.column_stack(
        (n[0] / some, n[1] / np.maximum(n[0], 1), n[2] / some, n[3] / some, n[4] / w, n[5] / w, (odd_end[end] - odd_end[start]) / w, n[0] / w / 10, np.log1p(words) / 5, np.log1p(chars) / 8, (same[end] - same[start]) / some, (again[hi] - again[lo]) / w)
    )
    return lines if rows else lines[:0], chars, out


def _own_features(texts, kinds):
    lines, chars, feats, tokenizer = [], [], [], Tokenizer()
    for _, data, offs in pieces(texts):
        a, b, c = line_features(data, offs, kinds, tokenizer)
        lines.append(a)
        chars.append(b)
        feats.append(c)
    if not lines:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FEATURES))
    return np.concatenate(lines), np.concatenate(chars), np.concatenate(feats)


class Field:
    """The chain: cuts of the bins, weights of being good, transitions and the final logistic step."""

    def __init__(self, cuts):
        self.cuts = cuts
        self.weights = self.neighbours = None
        self.trans, self.start, self.last = np.zeros((2, 2)), np.zeros(2), np.zeros(2)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """For each line the numbers of its active bins: its own features, then one for each neighbour's."""
        return np.column_stack([np.searchsorted(c, x[:, j]) + j * BINS for j, c in enumerate(self.cuts)])

    def design(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        own = self.bins(x)
        width, n = len(self.cuts) * BINS, len(own)
        first = np.zeros(n + 1, bool)
        first[np.concatenate(([0], np.cumsum(lines)))] = True
        none = np.full(own.shape[1], -1)
        before, after = np.vstack((none, own[:-1])), np.vstack((own[1:], none))
        before[first[:-1]], after[first[1:]] = -1, -1
        return np.column_stack((own, np.where(before < 0, 3 * width, before + width), np.where(after < 0, 3 * width + 1, after + 2 * width)))

    def marginals(self, score: np.ndarray, lines: np.ndarray):
        """P(good) of each line, and what the chain expects: transitions and starts."""
        if not len(lines):
            return np.zeros(0), np.zeros((2, 2)), np.zeros(2)
        order = np.argsort(-lines, kind="stable")
        first = (np.cumsum(lines) - lines)[order]
        longest, n = int(lines.max()), len(lines)
        alive = np.searchsorted(-lines[order], -np.arange(longest), "left")  # rows with more than t lines
        node = np.zeros((len(score), 2))
        node[:, 1] = score
        a, t = np.zeros((len(score), 2)), self.trans
        a[first] = self.start + node[first]
        for i in range(1, longest):
            p = a[first[: alive[i]] + i - 1]
            m = p[:, :, None] + t
            a[first[: alive[i]] + i] = np.logaddexp(m[:, 0], m[:, 1]) + node[first[: alive[i]] + i]
        b, expected = np.zeros((len(score), 2)), np.zeros((2, 2))
        end = first + lines[order] - 1
        z = np.zeros(len(score))
        z[np.repeat(first, lines[order]) + _within(lines[order])] = np.repeat(np.logaddexp(a[end, 0], a[end, 1]), lines[order])
        for i in range(longest - 1, 0, -1):
            at = first[: alive[i]] + i
            m = t + (node[at] + b[at])[:, None, :]
            b[at - 1] = np.logaddexp(m[:, :, 0], m[:, :, 1])
            expected += np.exp(a[at - 1][:, :, None] + m - z[at][:, None, None]).sum(0)
        good = np.exp(a[:, 1] + b[:, 1] - z)
        starts = np.array([n - good[first].sum(), good[first].sum()])
        return good, expected, starts

    def fit(self, x, lines, y):
        """Gradient ascent; every line of a document carries its label."""
        d = self.design(x, lines)
        w, label = np.zeros(3 * len(self.cuts) * BINS + 2), np.repeat(y, lines).astype(float)
        seen = np.zeros((2, 2))
        for v in (0, 1):
            seen[v, v] = (lines[y == v] - 1).sum()
        begun = np.array([(y == 0).sum(), (y == 1).sum()], float)
        params = [w, self.trans, self.start]
        m1, m2, total = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], len(label)
        for step in range(1, ROUNDS + 1):
            good, expected, starts = self.marginals(params[0][d].sum(1), lines)
            g = np.bincount(d.ravel(), np.repeat(label - good, d.shape[1]), len(w))
            for p, q, r, grad in zip(params, m1, m2, (g / total - 1e-4 * params[0], (seen - expected) / total - 1e-4 * params[1], (begun - starts) / len(lines) - 1e-4 * params[2])):
                q += 0.1 * (grad - q)
                r += 0.01 * (grad * grad - r)
                p += 0.1 * (q / (1 - 0.9**step)) / (np.sqrt(r / (1 - 0.99**step)) + 1e-8)
        self.weights, self.trans, self.start = params
        mean = self.documents(x, lines, np.expm1(8 * x[:, 9]))
        self.last = logistic(_logit(mean), y.astype(float), 0.01)

    def documents(self, x, lines, chars) -> np.ndarray:
        good, _, _ = self.marginals(self.weights[self.design(x, lines)].sum(1), lines)
        if not len(lines):
            return np.zeros(0)
        at = np.cumsum(lines) - lines
        return np.add.reduceat(good * (chars + 1), at) / np.add.reduceat(chars + 1, at)

    def score(self, x, lines, chars) -> np.ndarray:
        if self.weights is None:
            return np.full(len(lines), float(self.last[0]))
        return 1 / (1 + np.exp(-np.clip(self.last[0] + _logit(self.documents(x, lines, chars))[:, 0] * self.last[1], -30, 30)))


def _within(n):
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))[:, None]


def _sampled(batches):
    kinds = _kinds()
    for batch in batches:
        lines, _, x = _own_features(batch.column(2), kinds)
        ends = np.cumsum(lines)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.int64()), pa.array([x[e - n : e].tobytes() for n, e in zip(lines, ends)], pa.binary())], names=["id", "y", "lines", "x"])


def _budget(rows, most):
    """The rows (h, id, lines, ...) in the order of h until the lines are used up, without h, by id."""
    kept, n = [], 0
    for r in sorted(rows):
        n += r[2]
        if n > most:
            break
        kept.append(r[1:])
    return sorted(kept)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Field:
    spark, sample = docs.sparkSession, checkpoint(labelled(labels, label, folds=FOLDS, most=FIT_ROWS))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")
    size = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    told = rows.select(F.xxhash64("id").alias("h"), "id", size.cast("long").alias("n")).where(F.col("n") <= FIT_LINES // 10)
    first = told.groupBy("id").agg(F.min("h").alias("h"), F.sum("n").alias("n"))  # FIT_ROWS rows of three numbers at most
    chosen = _budget([(r.h, r.id, r.n) for r in first.collect()], FIT_LINES)
    ids = spark.createDataFrame([(i,) for i, _ in chosen], "id long")
    kept = rows.where(size <= FIT_LINES // 10).join(F.broadcast(ids), "id").mapInArrow(_sampled, "id long, y int, lines long, x binary")
    kept = sorted((r.id, r.y, r.lines, bytes(r.x)) for r in kept.collect())  # FIT_LINES lines at most
    y = np.array([r[1] for r in kept], int)
    if len(set(y.tolist())) < 2:
        out = Field([])
        out.last[0] = y[0] if len(y) else 0.5
        return out
    lines, x = np.array([r[2] for r in kept]), np.concatenate([np.frombuffer(r[3]).reshape(-1, FEATURES) for r in kept])
    out = Field([np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T])
    out.fit(x, lines, y)
    return out


def _score(field):
    def run(batches):
        kinds, own = _kinds(), field.value
        for batch in batches:
            lines, chars, x = _own_features(batch.column(1), kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(x, lines, chars))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    own = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(_score(own), "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
