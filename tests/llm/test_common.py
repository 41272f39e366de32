from pyspark.sql import functions as F

from codeloom.llm import _common


def test_join_sized_is_an_ordinary_join(spark):
    """One key with half of all rows, some with a share just over and under, repeated rows, and no rows."""
    key = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 1501)
    left = spark.range(6000).select(key.cast("string").alias("k"), (F.col("id") / 2).cast("long").alias("id"))
    right = left.select("k").distinct().withColumn("v", F.length("k")).withColumn("w", F.col("k") == "0")
    for rows in (left, left.limit(0)):
        got = _common.join_sized(rows, right, rows.groupBy("k").agg(F.count("*").alias("m")), "k", "id")
        assert got.columns == ["k", "id", "v", "w"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(right, "k").collect()))


def test_few_links_take_few_jobs(spark, monkeypatch):
    """A long chain, a star and pairs: the driver's components are those of the joins, in a bounded number of jobs."""
    import random

    from codeloom.llm import _common

    r = random.Random(3)
    chain = r.sample(range(1, 5000), 60)
    links = [*zip(chain, chain[1:]), *((-9, 10_000 + i) for i in range(80)), *((20_000 + 2 * i, 20_001 + 2 * i) for i in range(20)), (7_000, 7_000)]
    df = spark.createDataFrame(links, "a long, b long")
    context = spark.sparkContext
    context.setJobGroup("few-links", "")
    got = sorted(map(tuple, _common.components(df).collect()))
    jobs = len(context.statusTracker().getJobIdsForGroup("few-links"))
    context.setLocalProperty("spark.jobGroup.id", None)
    want = [(i, min(chain)) for i in chain] + [(i, -9) for i in (-9, *range(10_000, 10_080))] + [(20_000 + i, 20_000 + i - i % 2) for i in range(40)]
    assert got == sorted(want)
    assert jobs <= 10, jobs
    monkeypatch.setattr(_common, "LOCAL_LINKS", 0)
    assert sorted(map(tuple, _common.components(df).collect())) == got


def test_written_tables_have_few_files(spark):
    """At most a file for each part or core and no checksum files, and the rows come back."""
    import os

    scratch = _common.Scratch(spark, 1)
    df = spark.range(0, 1000, 1, 40).selectExpr("id", "id % 2 = 0 AS even")
    for kept in (scratch.keep(df), *scratch.keep_apart(df.selectExpr("id", "string(even) AS kind"), "kind", "true", "false")):
        names = os.listdir(scratch.paths[id(kept)][1])
        assert sum(n.startswith("part-") for n in names) <= spark.sparkContext.defaultParallelism + 1  # one is of the empty table
        assert kept.count() in (500, 1000)
        scratch.drop(kept)
    kept = scratch.keep(df)
    assert not [n for n in os.listdir(scratch.paths[id(kept)][1]) if n.endswith(".crc")]
    scratch.drop(kept)
