"""Line dedup: drop lines that several documents share.

Every text is split at \\n and exploded.  A line's key is the line without blanks
at its ends (``[\\x20\\x09-\\x0D]``) and with A-Z lower-cased; keys shorter than
``min_chars`` code points never count.  Keys are hashed to 128 bits, the distinct
documents of each hash are counted, and a hash found in ``min_docs`` documents or
more loses its lines everywhere but in the smallest doc_id that holds it.  What is
left is put together again by position.

Texts are not shuffled to find the lines: only hash, id and position are.  The
hash's counts are partly summed before the shuffle, and the join that marks a hot
line's places has one row for a hash on one side, so Spark can split its other
side.  The dropped positions of a document (at most its lines) then meet its text.

Defined results: a null or empty text is one empty line; a null doc_id is a
document that comes after all others; rows that repeat a doc_id are one document
for counting, and each row is cleaned by itself; an empty table gives no rows;
columns besides the key and the text are passed through, whatever their names, but
for n_lines and n_dropped, which are replaced; very long texts are split whole; of
rows that tie for the smallest id each keeps its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lower_ascii, table

BLANKS = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with the text cleaned, n_lines long (before) and n_dropped long."""
    columns = docs.drop("n_lines", "n_dropped").columns
    rows = docs.select(F.struct(*columns).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("fp"))
    cut = F.split("t", "\n", -1)
    keyed = rows.select("id", "fp", F.posexplode(F.transform(cut, line_key)).alias("pos", "k")).where(F.length("k") >= min_chars)
    lines = keyed.select("id", "fp", "pos", F.unhex(F.md5(F.col("k").cast("binary"))).alias("h"))
    if min_docs == 2:  # two distinct documents: the smallest and the largest differ
        per = lines.groupBy("h").agg(F.min("id").alias("keep"), F.max("id").alias("last")).where("last > keep")
    else:
        per = lines.select("h", "id").distinct().groupBy("h").agg(F.min("id").alias("keep"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    hit = lines.join(per.select("h", "keep"), "h").where("id <> keep")
    drops = hit.groupBy("id", "fp").agg(F.collect_set("pos").alias("drop"))
    out = rows.select("d", "id", "fp").join(drops, ["id", "fp"], "left").select("d", "drop", F.split(F.coalesce(F.col("d")[text], F.lit("")), "\n", -1).alias("lines"))
    n = F.size("lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "drop"), lambda i: F.get("lines", i))
    clean = F.when(F.col("drop").isNull(), F.coalesce(F.col("d")[text], F.lit(""))).otherwise(F.array_join(kept, "\n"))
    told = [n.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped")]
    return out.select(*(clean.alias(c) if c == text else F.col("d")[c].alias(c) for c in columns), *told)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
),
shared AS (SELECT k, min(doc_id) AS keep FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM (SELECT doc_id, i, line, coalesce(doc_id <> keep, false) AS dropped FROM lines LEFT JOIN shared USING (k))
GROUP BY doc_id"""
