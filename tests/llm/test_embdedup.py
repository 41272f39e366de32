import numpy as np

from codeloom.llm import embdedup
from codeloom.llm.embdedup import near_vectors

COLS = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, cosine=0.93):
    fine = [(i, np.array(v, float), y) for i, v, y in rows if v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v))]
    root, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, v, y) in enumerate(fine):
        for j, w, z in fine[:n]:
            if y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (links[i], find(i)) for i, _, _ in rows}


def test_against_all_pairs_with_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "BLOCK", 16)
    monkeypatch.setattr(embdedup, "LEAF", 4)
    r = np.random.default_rng(3)
    rows, centres = [], r.normal(size=(6, 16))
    for i in range(300):
        v = centres[i % 6] + r.normal(size=16) * r.choice([0.0, 0.05, 0.2, 0.4])
        rows.append((i, np.float32(v).tolist(), int(i % 3)))
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    rows += [(300 + i, v, 0) for i, v in enumerate(odd)] + [(400, rows[0][1], None), (401, rows[0][1], 2)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], COLS)
    got = {x.vec_id: (x.n_links, x.component_id) for x in near_vectors(df).collect()}
    assert got == brute(rows)


def test_repeats_nulls_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (None, [1.0, 0.0], 1, None), (2, [0.0, 1.0], 1, "")]
    got = sorted((x.vec_id or -1, x.n_links, x.component_id, x.kept) for x in near_vectors(spark.createDataFrame(rows, COLS)).collect())
    assert got == [(-1, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]
    assert near_vectors(spark.createDataFrame([], COLS)).count() == 0
