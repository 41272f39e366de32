"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words.  Sources in code point order (null
last) weigh 3, 1, 2 and so on again, and share ``share`` times all words; no
target exceeds ``cap`` times its source's size, and what is over is shared again
by weight until none is above (solved in closed form over the sources sorted by
size for weight).

A source gives whole copies of all its documents as often as they fit; for what
is left, a document gives one more copy if its hash lies below the source's
threshold.  The threshold is found without sorting documents: words are summed by
source and leading hash bits, the bucket in which the sum passes the budget is
found, and only this boundary bucket is refined by the next bits, ``LEVELS``
times.  A single row in the last boundary bucket goes to the nearer side.

Shuffled are partial sums by (source, bucket): a hot source is summed before it
moves.  The per-source table is broadcast only when it is counted and small.

Defined results: a null text has size 0; a null source is a source of its own; a
null doc_id is hashed by its text; rows that repeat an id share its hash, and where
that is the boundary hash, as many of them are taken as fit; a source without words
has target 0; an empty table gives no rows; ``mix`` ignores other columns and
``repeat`` passes all through, whatever their names; very long texts are counted
whole.

Sources are put in order by windows over the per-source table (one row a source, a
few numbers each) in one task: meant for up to some millions of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, checkpoint, md5_bits, stored, table

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
LEVELS, BITS = 3, 12
#: Per-source tables of more rows are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 100_000
#: Rows of one hash, source and size that are put in order at once.
RANKED = 1_000_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same with weight and target double."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ratio = cap * F.col("source_size") / F.col("weight")
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    rows = sizes.withColumn("weight", weigh).withColumn("ratio", ratio)
    rows = rows.withColumns(
        {
            "rest": F.sum("source_size").over(every) * share - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "sharing": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    rows = rows.withColumn("level", F.col("rest") / F.col("sharing"))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source", "level"))).over(every)["level"]
    target = F.least((cap * F.col("source_size")).cast("double"), F.coalesce(level * F.col("weight"), F.lit(float("inf"))))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def thresholds(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, size, h) -> by source: source_size, target, copies int, threshold long, and rest double words for its ties long rows at the threshold."""
    low = (LEVELS - 1) * BITS
    total = (F.sum("size").alias("words"), F.count("*").alias("ties"))
    hist = sized.groupBy("source", F.shiftright("h", low).alias("b")).agg(*total)
    goal = targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = checkpoint(goal.withColumn("copies", copies.cast("int")).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")))
    bound = goal.select("source", "left", F.lit(0).cast("long").alias("start"))
    for depth in range(LEVELS):
        low = (LEVELS - 1 - depth) * BITS
        if depth:
            near = sized.join(_small(bound.select(F.col("source").alias("s"), "start")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", low + BITS) == F.shiftright("start", low + BITS)))
            hist = near.groupBy("source", F.shiftright("h", low).alias("b")).agg(*total)
        run = Window.partitionBy("source").orderBy("b")  # at most 2 ** BITS rows a source
        sums = hist.withColumn("upto", F.sum("words").over(run)).withColumnRenamed("source", "s")
        over = sums.join(_small(bound.select("source", "left")), F.col("source").eqNullSafe(F.col("s"))).where("upto - words <= left and left < upto")
        rest = F.col("left") - F.col("upto") + F.col("words")
        bound = checkpoint(over.select("source", rest.alias("left"), F.shiftleft("b", low).alias("start"), "words", "ties"))
    one = F.col("ties") == 1  # a single row goes to the nearer side
    found = bound.select(F.col("source").alias("s"), (F.col("start") + (one & (F.col("left") > F.col("words") / 2)).cast("long")).alias("threshold"), F.when(one, 0.0).otherwise(F.col("left")).alias("rest"), F.when(one, 0).otherwise(F.col("ties")).alias("ties"))
    goal = goal.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    return goal.select("source", "source_size", "target", "copies", *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("threshold", "long"), ("rest", "double"), ("ties", "long"))))


def _taken(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with source, size, h and any others) and per-source numbers, joined, with ``copies`` the times to take each row.

    Rows that share their source's boundary hash (repeats of an id) are counted by
    size; of each size as many are taken as fit, which ones being told by their place
    in a written table, in buckets of ``RANKED`` rows.
    """
    found = checkpoint(found.withColumnRenamed("source", "s"))
    met = rows.join(_small(found), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    more = lambda c: (F.col("copies") + c).cast("int").alias("copies")
    rest = [c for c in met.columns if c not in ("copies", "threshold", "rest", "ties")]
    tie = (F.col("ties") > 0) & (F.col("h") == F.col("threshold"))
    plain = met.where(~tie).select(*rest, more((F.col("h") < F.col("threshold")).cast("int")))
    if found.where("ties > 0").isEmpty():
        return plain
    tied = stored(met.where(tie).select(F.struct(*rest).alias("row"), "source", "size", "copies", "rest", F.monotonically_increasing_id().alias("place")))
    sizes = tied.groupBy("source", "size").agg(F.count("*").alias("n"), F.first("rest").alias("rest"))
    before = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    fit = F.when(F.col("size") > 0, F.round((F.col("rest") - F.coalesce(before, F.lit(0))) / F.col("size"))).otherwise(0)
    sizes = sizes.select(F.col("source").alias("s"), F.col("size").alias("z"), F.least(F.greatest(fit, F.lit(0.0)), F.col("n")).cast("long").alias("fit"), F.ceil(F.col("n") / RANKED).alias("buckets"))
    dealt = tied.join(sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).withColumn("bucket", F.pmod(F.xxhash64("place"), F.col("buckets")))
    counts = dealt.groupBy(F.col("s").alias("cs"), F.col("z").alias("cz"), F.col("bucket").alias("cb")).agg(F.count("*").alias("m"))
    counts = counts.withColumn("upto", F.sum("m").over(Window.partitionBy("cs", "cz").orderBy("cb")) - F.col("m"))
    dealt = dealt.withColumn("at", F.row_number().over(Window.partitionBy("s", "z", "bucket").orderBy("place")))
    dealt = dealt.join(counts, F.col("s").eqNullSafe(F.col("cs")) & (F.col("z") == F.col("cz")) & (F.col("bucket") == F.col("cb")))
    return plain.unionByName(dealt.select("row.*", more((F.col("at") + F.col("upto") <= F.col("fit")).cast("int"))))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _measured(docs: DataFrame, key: str, text: str, source: str, *more) -> DataFrame:
    """source, size and a hash of ``LEVELS * BITS`` bits for each row, and ``more``."""
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(source).cast("string").alias("source"), size.alias("size"), md5_bits(name, LEVELS * BITS // 4).alias("h"), *more)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """For each row: key, source, size, source_size, target, copies int (times to take it), taken long."""
    sized = checkpoint(_measured(docs, key, text, source, F.col(key)))  # some tens of bytes a row: the texts are read once
    out = _taken(sized, thresholds(sized, weights, share, cap))
    return out.select(key, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, columns unchanged."""
    sized = checkpoint(_measured(docs, key, text, source).select("source", "size", "h"))
    found = thresholds(sized, weights, share, cap).select("source", "copies", "threshold", "rest", "ties")
    rows = _measured(docs, key, text, source, F.struct(*docs.columns).alias("d"))
    out = _taken(rows, found).where("copies > 0").select("d", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*(F.col("d")[c].alias(c) for c in docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 9))::BIGINT AS h
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS s, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(s) OVER ()::DOUBLE - 2 * coalesce(sum(s) OVER o, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level, 2 * s / w::DOUBLE AS ratio
  FROM weighed WINDOW o AS (ORDER BY 2 * s / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (SELECT source, s, least(2.0::DOUBLE * s, w * (SELECT arg_min(level, ratio) FROM levels WHERE ratio >= level)) AS target FROM levels),
goals AS (
  SELECT source, s, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT AS copies,
    target - CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT * s AS rest FROM aimed),
sums AS (SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM sized GROUP BY source, h),
cut AS (
  SELECT g.source, max(CASE WHEN upto - words <= rest AND rest < upto THEN h + (rest - (upto - words) > words / 2)::INT END) AS threshold
  FROM goals g JOIN sums ON sums.source IS NOT DISTINCT FROM g.source GROUP BY g.source)
SELECT doc_id, size, s AS source_size, target, (size * (copies + (h < coalesce(threshold, 0))::INT))::BIGINT AS taken
FROM sized JOIN goals ON goals.source IS NOT DISTINCT FROM sized.source JOIN cut ON cut.source IS NOT DISTINCT FROM sized.source"""
