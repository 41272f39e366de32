import itertools
import math
import re

import numpy as np
import pyarrow as pa

from codeloom.llm import quality as Q


def test_marginals_are_sums_over_all_labellings():
    r = np.random.default_rng(2)
    lines = np.array([3, 1, 5, 2])
    f = Q.Field([])
    f.trans, f.start, score = r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=lines.sum()) * 2
    good, expected, starts = f.marginals(score, lines)
    at, want_e, want_s = 0, np.zeros((2, 2)), np.zeros(2)
    for n in lines:
        s, z, g, e, b = score[at : at + n], 0, np.zeros(n), np.zeros((2, 2)), np.zeros(2)
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(f.start[y[0]] + sum(s[i] for i in range(n) if y[i]) + sum(f.trans[y[i], y[i + 1]] for i in range(n - 1)))
            z += p
            g += p * np.array(y)
            b[y[0]] += p
            for i in range(n - 1):
                e[y[i], y[i + 1]] += p
        assert np.allclose(good[at : at + n], g / z)
        want_e, want_s, at = want_e + e / z, want_s + b / z, at + n
    assert np.allclose(expected, want_e) and np.allclose(starts, want_s)


def test_lines_and_words_are_counted_in_whole_texts():
    texts = ["one two two\n\nthree", "", "é | é", "x" * 300_000 + "\nlast line", None, "no break"]
    lines, chars, x = Q._own_features(pa.array(texts), Q._kinds())
    want = [line for t in texts for line in (t or "").split("\n")]
    assert lines.tolist() == [len((t or "").split("\n")) for t in texts]
    assert chars.tolist() == [len(line) for line in want]
    assert np.allclose(np.expm1(5 * x[:, 8]), [len(line.split()) for line in want])
    assert np.isclose(x[0, 11], 1 / 3) and np.isclose(x[4, 4], 1 / 3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = Q.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    pos, neg = ([r.score for r in rows if r.quality == y] for y in (1, 0))
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.98


def test_odd_rows_and_no_labels(spark):
    cols = "doc_id long, text string, score string, y int"
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "b", 2), (2, "", "b", 2), (None, "some text\nof lines", None, 0)], cols)
    labels = spark.createDataFrame([(1, 1, None), (2, None, None)], "doc_id long, quality int, toxic int")
    none = Q.score(docs, Q.fit(docs, labels.limit(0))).collect()
    assert [r.score for r in none] == [0.5] * 4
    assert Q.score(docs.limit(0), Q.fit(docs, labels)).count() == 0


def test_fit_sample_is_no_prefix_of_ids():
    h = np.random.default_rng(5).permutation(1000).tolist()
    kept = Q._budget([(h[i], i, 10 if i < 900 else 1) for i in range(1000)], 2000)
    ids = [i for i, _ in kept]
    assert ids == sorted(ids) and sum(n for _, n in kept) <= 2000
    assert max(h[i] for i in ids) < min(h[i] for i in range(1000) if i not in set(ids))
    assert 400 < np.mean(ids) < 600


def _slow_features(line, kinds=Q._kinds()):
    """A line's numbers, character by character and word by word."""
    raw, words = line.encode(), [w for w in re.split(rb"[\x20\x09-\x0D]+", line.encode()) if w]
    k = [sum(int(kinds[i][c]) for c in raw) for i in range(8)]
    some, w = max(k[7], 1), max(len(words), 1)
    odd = sum(1 for i, c in enumerate(raw) if kinds[3][c] and (i + 1 == len(raw) or kinds[6][raw[i + 1]]))
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words]
    again, same = sum(a == b for a, b in zip(low, low[1:])), sum(a == b and not kinds[6][b] for a, b in zip(raw, raw[1:]))
    return [k[0] / some, k[1] / max(k[0], 1), k[2] / some, k[3] / some, k[4] / w, k[5] / w, odd / w, k[0] / w / 10, math.log1p(len(words)) / 5, math.log1p(k[7]) / 8, same / some, again / w], k[7]


def test_document_scores_against_brute_force():
    """Features, bins with neighbours, all labellings, weighted mean and last step, one document at a time."""
    r = np.random.default_rng(9)
    texts = ["one two two\n\nthree !!!", "", "A B c|d 12", "é é\nBUY NOW $$$ $$$\nlast line here", None]
    rows = [[_slow_features(x) for x in (t or "").split("\n")] for t in texts]
    flat = np.array([f for doc in rows for f, _ in doc])
    field = Q.Field([np.unique(np.quantile(c, np.arange(1, Q.BINS) / Q.BINS)) + 1e-7 for c in flat.T])  # off the values, which are rounded differently
    width = Q.FEATURES * Q.BINS
    field.weights, field.trans, field.start, field.last = r.normal(size=3 * width + 2), r.normal(size=(2, 2)), r.normal(size=2), np.array([0.3, 1.2])
    got = field.score(*(lambda a, b, c: (c, a, b))(*Q._own_features(pa.array(texts), Q._kinds())))
    for doc, score in zip(rows, got):
        bins = [[int(np.searchsorted(c, f[j])) + j * Q.BINS for j, c in enumerate(field.cuts)] for f, _ in doc]
        s = [sum(field.weights[b] for b in own) + (sum(field.weights[width + b] for b in bins[i - 1]) if i else Q.FEATURES * field.weights[3 * width]) + (sum(field.weights[2 * width + b] for b in bins[i + 1]) if i + 1 < len(bins) else Q.FEATURES * field.weights[3 * width + 1]) for i, own in enumerate(bins)]
        z, good = 0.0, np.zeros(len(s))
        for y in itertools.product((0, 1), repeat=len(s)):
            p = math.exp(field.start[y[0]] + sum(s[i] for i in range(len(s)) if y[i]) + sum(field.trans[y[i], y[i + 1]] for i in range(len(s) - 1)))
            z, good = z + p, good + p * np.array(y)
        weight = np.array([n + 1 for _, n in doc])
        mean = float((good / z * weight).sum() / weight.sum())
        assert abs(score - 1 / (1 + math.exp(-(0.3 + 1.2 * math.log(mean / (1 - mean)))))) < 1e-9
