import re
from collections import Counter

import numpy as np

from codeloom.llm import decontam
from codeloom.llm.decontam import decontaminate, leaks, simhash

SPLIT = re.compile(r"[^\x20\x09-\x0D!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+")


def words(t):
    return SPLIT.findall((t or "").lower())


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute(docs, items):
    """(doc_id, item_id) -> best similarity over all windows of the item's size."""
    out, known = {}, set().union(*(set(bag(words(t))) for _, t in items))
    for d, t in docs:
        w = words(t)
        if not set(bag(w)) & known and not any(0 < len(words(x)) < 5 for _, x in items):
            continue
        for i, x in items:
            v = words(x)
            n, best = len(v), 0
            if not v or not w or len(w) < n < 5:
                continue
            a = bag(v)
            for p in range(max(len(w) - n, 0) + 1):
                b = bag(w[p : p + n])
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out[d, i] = best
    return out


def test_all_documents_against_all_windows(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(docs, items).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    clean = decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert clean.count() == docs.count() - len({d for d, _ in want})


def test_edits_short_items_nulls_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 2)
    w = [f"w{i}" for i in range(60)]
    one = list(w)
    one[0] = "other"
    rows = [(1, "Before " + " ".join(w).upper() + ", after"), (2, " ".join(one)), (3, " ".join(w[:30])), (4, " ".join(w[:56])), (5, None), (6, ""), (7, "it is the answer, indeed"), (None, " ".join(w))]
    items = [(10, " ".join(w)), (11, "The Answer"), (12, None), (13, ""), (None, "quite another text of seven words here")]
    docs = spark.createDataFrame([(*r, "s", "x") for r in rows], "doc_id long, text string, source string, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(docs, bench).collect()}
    assert got.keys() == {(1, 10), (2, 10), (4, 10), (7, 11), (None, 10)}
    assert got[1, 10] == 1 and abs(got[2, 10] - 55 / 57) < 1e-12
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} == {3, 5, 6}
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == 8


def test_blocks_find_every_print_within_the_radius():
    r = np.random.default_rng(5)
    words = [r.integers(0, 1 << 63, 12, dtype=np.uint64) for _ in range(300)]
    index = decontam.Index(list(range(300)), words)
    own = index.sizes[12][1]
    prints = r.integers(0, 1 << 63, (2400, 2), dtype=np.uint64) * np.uint64(2)
    prints[:300] = own
    for i in range(300):
        for b in r.choice(128, r.integers(0, 46), replace=False):
            prints[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    far = np.bitwise_count(prints[:, None] ^ own[None, :]).sum(-1)
    w, j, d = index.candidates(12, prints)
    assert set(zip(w.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= decontam.RADIUS))))
    assert (far[w, j] == d).all() and simhash(np.array([7], np.uint64))[0] == 7


def test_blocks_are_selective(monkeypatch):
    """Of random items, few get past the blocks to the comparison of whole fingerprints."""
    r = np.random.default_rng(6)
    index = decontam.Index(list(range(2000)), [r.integers(0, 1 << 63, 40, dtype=np.uint64) for _ in range(2000)])
    seen, far = [], decontam._far
    monkeypatch.setattr(decontam, "_far", lambda a, b: seen.append(len(a)) or far(a, b))
    index.candidates(40, r.integers(0, 1 << 63, (500, 2), dtype=np.uint64) * np.uint64(2))
    assert sum(seen) / (500 * 2000) < 0.05
