"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table and the
shards take turns claiming the next free slot of their permutation, a shard of
weight w taking w turns a round.  A document's slot is a hash of its key modulo
the table size; its shard is read from the table in constant time.  Changing the
shard list moves few slots besides those of the shards that came or went.

Only the table (``table_size`` rows, a parameter) is broadcast; documents are
placed by a map-side join without any shuffle.

Defined results: a document with a null key is placed by its ``spread`` columns,
so that rows without ids do not meet in one shard; repeated rows share a shard;
an empty table gives no rows; columns that already bear the output names are
replaced, others pass through; texts are not looked at, however long.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import md5_bits

#: Production parameters of the query: 32 shards in a table of 4099 slots.
SHARDS = tuple(f"shard-{i:03d}" for i in range(32))
TABLE_SIZE = 4099
HEX = 15


def _bits(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX], 16)


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's permutation: slot j is (offset + j * skip) % size."""
    return _bits(f"{name}/offset") % size, _bits(f"{name}/skip") % (size - 1) + 1


def fill(shards, size: int = TABLE_SIZE, weights=None) -> list[int]:
    """The lookup table: for each slot the index of the shard that claimed it."""
    shards = list(shards)
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("table_size must be a prime not below the number of shards")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights) or any(w != int(w) for w in weights):
        raise ValueError("weights must be whole, not negative and not all zero")
    order = [preference(s, size) for s in shards]
    step, out, left = [0] * len(shards), [-1] * size, size
    while left:
        for i, (offset, skip) in enumerate(order):
            for _ in range(weights[i]):
                if not left:
                    break
                while out[slot := (offset + step[i] * skip) % size] >= 0:
                    step[i] += 1
                out[slot] = i
                left -= 1
    return out


def lookup(spark: SparkSession, shards=SHARDS, size: int = TABLE_SIZE, weights=None) -> DataFrame:
    """The table as rows (shard_slot, shard); its size is the parameter ``size``."""
    text = ",".join(map(str, fill(shards, size, weights)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",").cast("array<int>")).alias("shard_slot", "i"))
    return slots.select("shard_slot", F.element_at(names, F.col("i") + 1).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(md5_bits(key, HEX), F.lit(size)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", spread=(), shards=SHARDS, size: int = TABLE_SIZE, weights=None) -> DataFrame:
    """``docs`` with shard_slot int and shard string."""
    docs = docs.drop("shard_slot", "shard")
    rest = F.concat_ws("|", F.lit("null"), *(F.coalesce(docs[c].cast("string"), F.lit("")) for c in spread))
    at = docs.withColumn("shard_slot", slot_of(F.coalesce(docs[key].cast("string"), rest), size))
    return at.join(F.broadcast(lookup(docs.sparkSession, shards, size, weights)), "shard_slot").select(*docs.columns, "shard_slot", "shard")


def write_shards(placed: DataFrame, path: str, parts_per_shard: int = 8) -> None:
    """One folder for each shard; a shard's rows are dealt over several tasks and files."""
    part = F.pmod(F.xxhash64(*placed.columns), F.lit(parts_per_shard))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    return place(docs, spread=("lang", "source", "n_chars")).select("doc_id", "shard_slot", "shard")


def _oracle() -> str:
    """The claims replayed turn by turn by a recursive query, then placement by hash."""
    n, m = len(SHARDS), TABLE_SIZE
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SHARDS))
    bits = f"('0x' || substr(md5({{}}), 1, {HEX}))::BIGINT"
    return f"""
WITH RECURSIVE shards(i, name) AS (VALUES {names}),
prefs AS (SELECT i, name, {bits.format("name || '/offset'")} % {m} AS off, {bits.format("name || '/skip'")} % {m - 1} + 1 AS skip FROM shards),
lists AS (SELECT list(off ORDER BY i) AS offs, list(skip ORDER BY i) AS skips FROM prefs),
turns(t, taken, step, slot) AS (
  SELECT 0, list_transform(range({m}), lambda x: false), list_transform(range({n}), lambda x: 0::BIGINT), -1::BIGINT
  UNION ALL
  SELECT t + 1, list_concat(taken[:slot2], [true], taken[slot2 + 2:]), list_concat(step[:t % {n}], [j], step[t % {n} + 2:]), slot2
  FROM (SELECT t, taken, step, j, (offs[t % {n} + 1] + j * skips[t % {n} + 1]) % {m} AS slot2
    FROM (SELECT t, taken, step, offs, skips,
        list_filter(range(step[t % {n} + 1], least(step[t % {n} + 1] + 400, {m})::BIGINT), lambda j: NOT taken[(offs[t % {n} + 1] + j * skips[t % {n} + 1]) % {m} + 1])[1] AS j1,
        coalesce(j1, list_filter(range({m}), lambda j: NOT taken[(offs[t % {n} + 1] + j * skips[t % {n} + 1]) % {m} + 1])[1]) AS j
      FROM turns, lists WHERE t < {m}))),
lookup AS (SELECT slot, name FROM turns JOIN shards ON i = (t - 1) % {n} WHERE slot >= 0),
docs AS (SELECT doc_id, ({bits.format("coalesce(doc_id::VARCHAR, concat_ws('|', 'null', coalesce(lang, ''), coalesce(source, ''), coalesce(n_chars::VARCHAR, '')))")} % {m})::INT AS shard_slot FROM documents)
SELECT doc_id, shard_slot, name AS shard FROM docs JOIN lookup ON slot = shard_slot"""


ORACLE = _oracle()
