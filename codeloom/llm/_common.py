"""Helpers shared by the corpus operators: lineage cuts, folds, ASCII folding."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: One word: a run of anything but blank, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``.

    The setting is read from the session; only where it is unset and the master is
    local (tests on one machine) a temporary folder takes its place.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; text that is all ASCII takes the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as fold 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(1))


def md5_bits(key: Column, hex_digits: int) -> Column:
    """The leading ``4 * hex_digits`` bits of md5(key) as a long (at most 60)."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, hex_digits), 16, 10).cast("long")


def labelled(labels: DataFrame, label: str, key: str = "doc_id", folds: int = 5, most: int = 12_000) -> DataFrame:
    """(id, y): at most ``most`` labelled rows outside fold 0, the same ones in every run; repeats of an id count once."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key), folds) != 0))
    rows = rows.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)


#: Links up to which components are found on the driver (two longs a link); more are found by rounds of joins.
LOCAL_LINKS = 200_000


def _roots(a: np.ndarray, b: np.ndarray):
    """(id, smallest id reachable) of every id in a link: each root hooks to its smallest neighbour until none has a smaller one."""
    ids, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = both[: len(a)], both[len(a) :], np.arange(len(ids))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return ids, ids[root]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root[root] != root).any():
            root = root[root]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over ``links``, for each id in a link.

    Alternating large and small stars: every round rewires each node's larger,
    then smaller, neighbours to the smallest one, until only stars are left.
    Minima are partly taken before the shuffle and each node's minimum is one row,
    so the join with a hot node's neighbours can be split.  Once no more than
    LOCAL_LINKS links are left, the driver finds what remains.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    ends, last = checkpoint(ends), None
    while True:
        seen = ends.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            break
        last = seen
        if seen[0] <= LOCAL_LINKS:
            got = ends.toArrow()
            found = _roots(got.column("u").to_numpy(), got.column("v").to_numpy())
            return ends.sparkSession.createDataFrame(pa.table([*map(pa.array, found)], names=["id", "component"]))
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ends = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return ends.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(ends.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one of this machine, which only a local master may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one run of an operator, each deleted as soon as nothing reads it any more.

    With ``parts``, a table is written in at most so many files, or as many as there are cores,
    and in a local store without checksum files: where Hadoop's native library is absent, the
    JVM forks a chmod for every folder, file and checksum file.  Other stores ignore the options.
    """

    PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

    def __init__(self, spark: SparkSession, parts: int | None = None):
        self.spark, self.paths = spark, {}
        self.parts = parts and max(parts, spark.sparkContext.defaultParallelism)
        self.options = {"compression": "zstd"} | (self.PLAIN if parts else {})

    def few(self, df: DataFrame) -> DataFrame:
        return df.coalesce(self.parts) if self.parts else df

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/scratch-{uuid.uuid4().hex}"
        self.few(df).write.options(**self.options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def keep_apart(self, df: DataFrame, kind: str, *values: str) -> list[DataFrame]:
        """A table for each of these values of the column ``kind``, from one run of ``df``; each is dropped by itself."""
        path = f"{shared_folder(self.spark)}/scratch-{uuid.uuid4().hex}"
        self.few(df).write.options(**self.options).partitionBy(kind).parquet(path)
        out = []
        for v in values:
            self.spark.createDataFrame([], df.schema).drop(kind).write.options(**self.options).mode("append").parquet(f"{path}/{kind}={v}")
            out.append(self.spark.read.schema(df.drop(kind).schema).parquet(f"{path}/{kind}={v}"))
            self.paths[id(out[-1])] = (out[-1], f"{path}/{kind}={v}")
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths.pop(id(df))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Within it these settings of the session hold."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_removed(spark: SparkSession):
    """Within it each query's shuffle files are removed as soon as it ends, and not when the driver next collects garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def free(columns, *names: str) -> list[str]:
    """``names``, each with as many underscores as make it differ from ``columns`` in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


#: A key is hot from this share of all rows on, so at most as many keys are.
HOT_SHARE = 1000


def join_sized(left: DataFrame, right: DataFrame, sizes: DataFrame, key: str, by: str) -> DataFrame:
    """Each row of ``left`` with that of ``right``, which has one row for every key; ``sizes`` (key, m) counts the left rows of each.

    Keys that hold one row in HOT_SHARE or more, at most HOT_SHARE of them, meet by a
    broadcast, and their rows are dealt over the tasks by ``by``; all others meet by an
    ordinary join.
    """
    least = (sizes.agg(F.sum("m")).first()[0] or 0) / HOT_SHARE
    values = [c for c in right.columns if c != key]
    hot = F.broadcast(sizes.where(F.col("m") >= F.lit(least)).select(key))
    top = F.broadcast(right.join(hot, key, "left_semi").select(key, F.struct(*values).alias("_top")))
    salt = F.when(F.col("_top").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(by), F.lit(HOT_SHARE))).cast("int")
    met = left.join(top, key, "left").withColumn("_salt", salt).join(right.withColumn("_salt", F.lit(0)), [key, "_salt"], "left")
    return met.select(*left.columns, *(F.coalesce(F.col("_top")[v], F.col(v)).alias(v) for v in values))
