from collections import Counter

from codeloom.llm import mixing

COLS = "doc_id long, text string, source string, h string, d int, copies string, s string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "h", 1, "c", "s") for i, t, s in rows], COLS)


def check(spark, rows):
    """Targets by hand, and what every source takes."""
    got = mixing.mix(docs(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    open_, left, target = set(names), 1.5 * sum(size.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        for s in over or open_:
            target[s] = 2 * size[s] if over else level * weight[s]
            left -= 2 * size[s] if over else 0
        open_ -= over or set(open_)
    for s in names:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 for r in own)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max((r.size for r in own), default=0)
    return got


def test_targets_and_sums(spark):
    rows = [(i, "w " * (i % 40), "abcde"[i * i % 5]) for i in range(600)] + [(700 + i, "x y z", None) for i in range(9)] + [(800, None, "n"), (801, "", "n"), (None, "a b", "a")]
    first = check(spark, rows)
    again = check(spark, list(reversed(rows)))
    assert Counter((r.doc_id, r.taken) for r in first) == Counter((r.doc_id, r.taken) for r in again)


def test_repeats_of_an_id_are_cut_by_count(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 7)
    rows = [(1, "w " * 5, "a")] * 20 + [(2, "w " * 2, "b")] * 10 + [(2, "w " * 3, "b")] * 10 + [(3, "w " * 400, "c")] + [(None, "v w", "d")] * 30
    got = check(spark, rows)
    by = {s: sum(r.taken for r in got if r.source == s) for s in "abd"}
    target = {r.source: r.target for r in got}
    assert all(abs(by[s] - target[s]) <= 5 for s in by)


def test_rows_come_back_unchanged(spark):
    rows = [(i, f"some words {i}", "ab"[i % 2]) for i in range(40)] + [(1, "some words 1", "b")] * 7 + [(50, None, None)]
    own = docs(spark, rows)
    out = mixing.repeat(own)
    assert out.columns == own.columns
    want = Counter()
    for r in mixing.mix(own).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want
    assert {(r.h, r.d, r.copies, r.s) for r in out.collect()} == {("h", 1, "c", "s")}
    empty = own.limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.repeat(empty).count() == 0
