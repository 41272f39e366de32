import re
from itertools import combinations

import pytest

from codeloom.llm import minhash
from codeloom.llm.minhash import near_duplicates

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLS = "doc_id long, text string, source string, id string"


def brute(rows, k=4, least=80):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    near = {p for ids in where.values() for p in combinations(sorted(ids), 2)}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= least * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_documents_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs).cache()
    assert result(out) == brute([tuple(r) for r in docs.collect()])
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_chains_blocks_and_clusters(spark, monkeypatch):
    """Chains of edits, one text in many near copies, and a passage that many different texts share."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    rows, w = [], list(base)
    for i in range(25):  # a chain: each differs from the last in one word
        rows.append((i, " ".join(w)))
        w[(i * 7) % 60] = f"c{i}"
    for i in range(40):  # near copies of one text
        v = [f"n{j}" for j in range(80)]
        v[i] = "x"
        rows.append((100 + i, " ".join(v)))
    for i in range(60):  # one long passage in texts that differ in the rest
        rows.append((200 + i, " ".join([f"p{j}" for j in range(50)] + [f"q{i}_{j}" for j in range(4 + i % 12)])))
    for i in range(30):
        rows.append((300 + i, "exactly the same words here"))
    for i in range(60):  # edited copies of a text that comes last: most are near it, few are near each other
        v = [f"h{j}" for j in range(120)]
        for j in range(1 + i % 4):
            v[(i * 13 + j * 29) % 120] = f"e{i}_{j}"
        rows.append((500 + i, " ".join(v)))
    rows.append((599, " ".join(f"h{j}" for j in range(120))))
    rows += [(401, None), (402, ""), (403, " \n\t"), (404, "two words"), (405, "TWO  words"), (406, "a " * 3000), (407, "a " * 9000)]
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a b c d e", "s", "x"), (1, "a b c d e", "s", "y"), (None, "a b c d e", None, None), (2, None, None, None), (3, "A B C D E", "t", None)]
    got = near_duplicates(spark.createDataFrame(rows, COLS)).collect()
    assert len(got) == 5
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 2), (3, 1)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_duplicates(spark.createDataFrame([], COLS)).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    a, b = (" ".join(f"{c}{j}" for j in range(80)) for c in "ab")
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (8, "something else altogether in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True)]
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(docs).collect()) == [3, 8]
