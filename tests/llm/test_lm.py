import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from codeloom.llm import lm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def test_base_score_counts_and_held_out_perplexity(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 500)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(r.doc_id, words(r.text) + [""]) for r in docs.collect()]
    c = Counter(w for i, t in rows if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(w in c for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    total = lambda f: sum(f(got[i]) for i, _ in rows if held(i))
    assert total(lambda r: r.score) > total(lambda r: r.base_score)


def test_predictions_sum_to_one_in_every_context(spark):
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.3, r.integers(0, 60)) % 300) for _ in range(200)]
    top = ["w1", "w2", "w3"]
    h = lm.word_hashes(top)
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((h[order], order + 1))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    from pyspark.sql import functions as F

    cells = df.mapInArrow(lm._count_contexts(shared), "w string, u array<short>, n array<long>").groupBy("w").agg(F.flatten(F.collect_list("u")).alias("u"), F.flatten(F.collect_list("n")).alias("n"))
    want = Counter()
    for t in texts:
        u = 0
        for w in words(t) + [""]:
            want[w, u] += 1
            u = top.index(w) + 1 if w in top else u
    got = Counter()
    rows = cells.collect()
    for x in rows:
        for u, n in zip(x.u, x.n):
            got[x.w, u] += n
    assert got == want

    c = Counter()
    for (w, _), n in want.items():
        c[w] += n
    model = lm.fit(cells, sum(c.values()), len(c))
    batch = pa.RecordBatch.from_arrays([pa.array([x.w for x in rows]), pa.array([x.u for x in rows], pa.list_(pa.int16())), pa.array([x.n for x in rows], pa.list_(pa.int64()))], names=["w", "u", "n"])
    ws, offs, u, n = lm._cells(batch)
    p0, lp = model.predict(ws, offs, u, n)
    for ctx in range(4):
        total = 0.0
        for i in range(len(ws)):
            own = [10 ** lp[j] for j in range(offs[i], offs[i + 1]) if u[j] == ctx]
            total += own[0] if own else sum(model.back(s)[ctx] * p0[k][i] for k, s in enumerate(model.chosen())) / lm.SAMPLES
        total += sum(model.back(s)[ctx] * model.parent(np.zeros(1), np.zeros(1), s)[0] for s in model.chosen()) / lm.SAMPLES
        assert abs(total - 1) < 1e-9


def test_seating_law():
    """Means of the jumping sampler against seating customer by customer."""
    r, d = np.random.default_rng(6), 0.4
    for c, a in ((5, 0.7), (60, 3.0), (300, 0.5), (300, 8.0), (2000, 40.0)):
        t = lm.seat(np.full(4000, c), np.full(4000, a), d, np.arange(1, 4001, dtype=np.uint64) * np.uint64(7919), 1)
        own = np.ones(1500)
        for n in range(1, c):
            own += r.random(1500) * (a + n - d * own) < a
        assert 1 <= t.min() and t.max() <= c
        assert abs(t.mean() - own.mean()) < 0.06 * own.mean() + 0.1


def test_odd_rows(spark):
    cols = "doc_id long, text string, score string, w int"
    rows = [(1, "a b a", "x", 1), (2, None, None, None), (3, "", "x", 1), (3, "", "x", 1), (None, "A\tB", None, None), (5, "long " * 50_000, "", 0), (11, "zz zz", "", 0)]
    got = lm.score_texts(spark.createDataFrame(rows, cols)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 4), (2, 1), (3, 1), (3, 1), (5, 50_001), (11, 3)]
    assert all(r.score < 0 and math.isfinite(r.score) and r.n_known <= r.n_tokens for r in got)
    assert lm.score_texts(spark.createDataFrame([], cols)).count() == 0
    only = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.score_texts(spark.createDataFrame([(only, "a b", "", 0)], cols)).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)


def test_every_previous_word_is_a_context(spark):
    """Counts of all pairs, predictions that sum to one in each context, and pairs whose first word is rare."""
    r = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.3, r.integers(0, 40)) % 400) for _ in range(300)]
    want = Counter(p for t in texts for p in zip([""] + words(t), words(t) + [""]))
    vocabulary = sorted({w for p in want for w in p})
    assert len(vocabulary) > lm.CONTEXTS + 1
    name = dict(zip(lm.word_hashes(vocabulary).view(np.int64).tolist(), vocabulary))
    df = spark.createDataFrame([(True, t) for t in texts], "train boolean, text string")
    cells = df.mapInArrow(lm._count_pairs, "u long, w long, c long").groupBy("u", "w").sum("c").withColumnRenamed("sum(c)", "c")
    assert Counter({(name[x.u], name[x.w]): x.c for x in cells.collect()}) == want
    every = spark.createDataFrame([(h,) for h in [*name, 12345]], "w long")
    pairs = cells.select("u").distinct().crossJoin(every).join(cells, ["u", "w"], "left").fillna(0, ["c"])
    total = Counter()
    for x in lm.predictions(pairs)[0].collect():
        total[x.u] += 10**x.lp
    assert len(total) == len(vocabulary) and all(abs(x - 1) < 1e-9 for x in total.values())

    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(i, " ".join(f"a{j} b{j}" for j in r.permutation(500)[:40])) for i in range(600)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tokens, score = (sum(getattr(x, c) for x in got if held(x.doc_id)) for c in ("n_tokens", "score"))
    assert 10 ** (-score / tokens) < 60  # about 32 where b follows a, 1000 words in all


def test_packed_scores_equal_the_rows_of_the_model(spark, monkeypatch):
    """Pairs of frequent and of rare words over several buckets against predictions() on rows, and the size of packed pairs."""
    monkeypatch.setattr(lm, "FREQUENT", 20)
    monkeypatch.setattr(lm, "_BUCKET", 8000)
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.4, r.integers(0, 40)) % 200)) for i in range(250)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {x.doc_id: x for x in lm.score_texts(df).collect()}
    count = Counter()
    for i, t in rows:
        for p in zip([""] + words(t), words(t) + [""]):
            count[p] += not held(i)
    names = sorted({w for p in count for w in p})
    h = dict(zip(names, lm.word_hashes(names).view(np.int64).tolist()))
    cells = spark.createDataFrame([(h[u], h[w], int(c)) for (u, w), c in count.items()], "u long, w long, c long")
    lp = {(x.u, x.w): x.lp for x in lm.predictions(cells)[0].collect()}
    for i, t in rows:
        want = sum(lp[h[u], h[w]] for u, w in zip([""] + words(t), words(t) + [""]))
        assert abs(got[i].score - want) < 2.0**-25 * got[i].n_tokens
    monkeypatch.setattr(lm, "FREQUENT", 65_535)
    packed = df.coalesce(1).selectExpr("true", "doc_id", "text").mapInArrow(lm._pack_pairs(lm.frequent(df, len(rows)), 1), "bucket long, batch long, data binary")
    assert packed.where("bucket >= 0").selectExpr("sum(length(data))").first()[0] < 8 * len(count)  # rows of pairs took 19 bytes


def _packed(monkeypatch, texts, top, buckets):
    monkeypatch.setattr(lm, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())}))
    batch = pa.RecordBatch.from_arrays([pa.array([True] * len(texts)), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["train", "doc_id", "text"])
    return [r for out in lm._pack_pairs(top, buckets)(iter([batch])) for r in out.to_pylist()]


def test_memory_of_a_worker(monkeypatch):
    """Bytes that packing a piece takes at most for each word, and that freed memory goes back."""
    r = np.random.default_rng(7)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.3, 1000) % 50_000) for _ in range(800)]
    top = lm.word_hashes(["", *(f"w{i}" for i in range(1000))])
    tracemalloc.start()
    _packed(monkeypatch, texts, top, 40)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 * 1000 * len(texts)

    pages = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    held = [np.ones(12_000) for _ in range(2000)]  # 192 MB in blocks that the allocator keeps
    last = np.ones(12_000)
    full = pages()
    held.clear()
    assert list(lm._lean(lambda t: t)("x")) == ["x"]
    assert full - pages() > 120 << 20 and last.all()


def test_totals_of_frequent_words_are_no_rows(monkeypatch):
    """Totals by u and by w over several buckets, those of frequent words packed, against counting."""
    monkeypatch.setattr(lm, "_SPAN", 64)
    r = np.random.default_rng(9)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.3, r.integers(0, 60)) % 3000) for _ in range(300)]
    count = Counter(p for t in texts for p in zip([""] + words(t), words(t) + [""]))
    names = sorted({w for p in count for w in p})
    h = lm.word_hashes(names)
    top = np.concatenate((h[:1], h[1::2]))  # the end is the first name
    assert names[0] == "" and lm._SPAN < len(top) < len(names) - 100
    packed, spans, got = _packed(monkeypatch, texts, top, 5), {}, {"u": Counter(), "w": Counter()}
    for b in range(5):
        rows = [x for x in packed if x["bucket"] == b]
        t = lm._tally(top)(pa.table({k: [x[k] for x in rows] for k in ("bucket", "batch", "data")}))
        for x in t.to_pylist():
            if x["kind"] in ("u", "w"):
                assert not 0 <= x[x["kind"]] < len(top)
                got[x["kind"]].update({(x[x["kind"]], k): x[k] for k in ("c", "single", "some")})
            elif x["kind"] == "often":
                spans.setdefault(x["place"], []).append(x)
    for rows in spans.values():
        for x in lm._add_often(pa.table({k: [x[k] for x in rows] for k in ("place", "data")})).to_pylist():
            got["uw"[x["side"]]].update({(int(top[x["k"]].view(np.int64)), k): x[k] for k in ("c", "single", "some")})
    key = dict(zip(names, h.view(np.int64).tolist()))
    for side in (0, 1):
        want = Counter()
        for p, c in count.items():
            want.update({(key[p[side]], "c"): c, (key[p[side]], "single"): int(c == 1), (key[p[side]], "some"): 1})
        assert got["uw"[side]] == want
