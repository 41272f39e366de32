from collections import Counter

import corpus_pipeline as P
from codeloom.llm import mixing, sharding, toxicity
from codeloom.llm._common import stored, table
from test_decontam import brute as leaks
from test_minhash import brute as near


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    sizes = None
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, sf))
        if name != "sharding":
            assert docs.columns == columns
        got = Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name == "toxicity":
            assert bad
            kept = {i: t for i, t in kept.items() if i not in bad}
        elif name == "near_dedup":
            kept = {i: kept[i] for i, (_, c) in near(list(kept.items()), 5).items() if i == c}
        elif name == "decontamination":
            kept = {i: t for i, t in kept.items() if i not in {d for d, _ in leaks(list(kept.items()), items)}}
            sizes = {r.doc_id: r for r in mixing.mix(docs).collect()}
        elif name == "mixing":
            assert got == Counter({i: r.copies for i, r in sizes.items() if r.copies})
            for s in {r.source for r in sizes.values()}:
                own = [r for r in sizes.values() if r.source == s]
                assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
            continue
        else:
            slots, size = sharding.fill(sharding.SHARDS), sharding.TABLE_SIZE
            assert all(r.shard == sharding.SHARDS[slots[sharding._bits(str(r.doc_id)) % size]] for r in docs.collect())
            continue
        assert got == Counter(list(kept))


def test_odd_rows_pass_through(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, "same words in this text here", "en", "s", 5), (1, "same words in this text here", "en", "s", 5), (None, None, None, None, None), (2, "", None, "t", 0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, table(spark, sf, "documents").schema)
        for _, stage in P.STAGES[:3]:
            docs = stored(stage(spark, docs, sf))
        assert sorted((r.doc_id or -1) for r in docs.collect()) == ([-1, 1, 2] if data else [])
        for _, stage in P.STAGES[3:]:
            docs = stored(stage(spark, docs, sf))
        assert docs.count() >= 0
