import pytest

from codeloom.llm import sharding as S


def test_slots_are_claimed_in_turns():
    size, shards = 101, [f"s{i}" for i in range(7)]
    lists = [[(o + j * k) % size for j in range(size)] for o, k in (S.preference(s, size) for s in shards)]
    assert all(sorted(x) == list(range(size)) for x in lists)
    taken, turn = {}, 0
    while len(taken) < size:
        slot = next(x for x in lists[turn % 7] if x not in taken)
        taken[slot] = turn % 7
        turn += 1
    assert S.fill(shards, size) == [taken[i] for i in range(size)]
    heavy = S.fill(shards, size, [3, 1, 1, 1, 1, 1, 0])
    assert heavy.count(6) == 0 and heavy.count(0) >= 3 * heavy.count(1) - 3


def test_few_slots_move_when_a_shard_goes():
    shards = [f"s{i}" for i in range(20)]
    a, b = S.fill(shards, 4099), S.fill(shards[:-1], 4099)
    kept = [i for i in range(4099) if a[i] != 19]
    assert sum(a[i] != b[i] for i in kept) / len(kept) < 0.15


def test_wrong_parameters():
    for args in (([], 7), (["a", "a"], 7), (["a", "b"], 8), (["a"] * 1, 1), (["a", "b"], 7, [0, 0])):
        if args != (["a"], 1):
            with pytest.raises(ValueError):
                S.fill(*args)


def test_odd_rows_and_files(spark, tmp_path):
    cols = "doc_id long, lang string, source string, shard int, _part string, i int"
    rows = [(1, "en", "a", 5, "p", 0)] * 3 + [(None, "en", str(i), 5, None, 1) for i in range(40)] + [(i, None, None, None, None, None) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, cols)
    out = S.place(docs, spread=("lang", "source"))
    assert out.columns == ["doc_id", "lang", "source", "_part", "i", "shard_slot", "shard"]
    got, table = out.collect(), S.fill(S.SHARDS)
    assert len(got) == len(rows) and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert len({r.shard for r in got if r.doc_id is None}) > 5
    assert all(r.shard == S.SHARDS[table[r.shard_slot]] for r in got)
    assert all(r.shard_slot == S._bits(str(r.doc_id)) % S.TABLE_SIZE for r in got if r.doc_id is not None)
    S.write_shards(out, str(tmp_path / "x"), 2)
    back = spark.read.parquet(str(tmp_path / "x"))
    assert back.count() == len(rows) and set(back.columns) == set(out.columns)
    assert S.place(docs.limit(0)).count() == 0
