"""Embedding near-dedup by an epsilon grid order join.

Vectors are scaled to length 1, so that cosine >= c is Euclidean distance <= eps =
sqrt(2 - 2c).  Equal vectors of one label are one class with a multiplicity; a
class's rows link with each other and with all rows of the classes it links with.

Classes are turned to their principal axes (from the second moments of all
vectors, summed on executors, DIMS x DIMS numbers) and put on a grid of cell width
eps over the leading ``GRID`` axes.  Vectors of a label within eps lie in equal or
neighbouring cells of every axis.  The epsilon grid order sorts by label and cell,
axis after axis; a range partitioning cuts it, and a task cuts its part into
intervals of at most ``BLOCK`` rows of one label, each with its bounds in all
``PROJECTED`` axes.  A cell of any size is cut like the rest.  Two intervals meet
only if they hold neighbouring cells of the first two axes and their bounds are
within eps.  Inside a task the two sequences are joined recursively: halves whose
bounds are further apart than eps are skipped, and leaves are compared by cosine in
double precision.  A task tells each vector's number of links and, instead of the
links, as many pairs as hold its components together.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components, or whose label is null, links with nothing and is kept; vectors of
unequal length never link; rows that repeat a vec_id are one vector each for
counting and share a component; a null vec_id counts in others' links but has a
null component; an empty table gives no rows; a cosine that double precision puts
at the threshold links, whichever way rounding took it; long vectors are compared
whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint, components, table
from .minhash import _groups

COSINE = 0.93
GRID, PROJECTED = 6, 24
BLOCK, LEAF = 1024, 48
#: Allowed for rounding when distances decide what is skipped.
SLACK = 1e-6


def _by_length(column):
    """(row numbers, matrix) for each vector length of a list column without nulls."""
    n = column.value_lengths().to_numpy()
    flat, start = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(n)))
    for d in np.unique(n):
        at = np.flatnonzero(n == d)
        yield at, flat[start[at][:, None] + np.arange(d)]


def _moments(batches):
    """Per task one (n, n) matrix for each vector length: sums of products of unit vectors."""
    sums = {}
    for batch in batches:
        for _, x in _by_length(batch.column(0)):
            sums[x.shape[1]] = sums.get(x.shape[1], 0) + x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["dim", "m"])


def _add(batches):
    """One matrix for each vector length: the sum of a task's."""
    sums = {}
    for batch in batches:
        for d, m in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[d] = sums.get(d, 0) + np.frombuffer(m.as_buffer())
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["dim", "m"])


def _cut(block):
    """Rows in grid order with the number b of their interval: at most so many rows of one group."""

    def run(batches):
        part, now, n, b = TaskContext.get().partitionId() << 32, None, 0, -1
        for batch in batches:
            groups, out = batch.column(1).to_numpy(), np.empty(len(batch), np.int64)
            for i, g in enumerate(groups.tolist()):
                if g != now or n == block:
                    now, n, b = g, 0, b + 1
                n += 1
                out[i] = part + b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "b"])

    return run


def _project(axes, eps):
    def run(batches):
        turn = axes.value
        for batch in batches:
            p = [None] * len(batch)
            for at, x in _by_length(batch.column(2)):
                for i, row in zip(at.tolist(), x @ turn[x.shape[1]]):
                    p[i] = row[:PROJECTED]
            cells = [np.floor(row[:GRID] / eps).astype(np.int32) for row in p]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32())), pa.array(p, pa.list_(pa.float64()))], names=[*batch.schema.names, "cell", "p"])

    return run


def _bounded(p, lo, hi):
    return p[lo:hi].min(0), p[lo:hi].max(0)


def _apart(a, b) -> float:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap)


def _join(x, p, q, r, eps2, cosine, same, out):
    """Pairs of two sequences sorted in grid order; skips halves that are provably distant."""
    todo = [((0, len(x)), (0, len(q)))]
    while todo:
        (a, b), (c, d) = todo.pop()
        if same and c < a or _apart(_bounded(p, a, b), _bounded(r, c, d)) > eps2:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            near = x[a:b] @ q[c:d].T >= cosine
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            out.append((i, j))
            continue
        left = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > LEAF else [(a, b)]
        right = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > LEAF else [(c, d)]
        todo += [(s, t) for s in left for t in right if not same or t[0] >= s[0]]


def _labels(n, i, j):
    """For each of n nodes the smallest node of its component over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link(cosine, eps):
    """(a, b, n): n links of vector a (b null), or b in the component of a (n 0)."""

    def run(batches):
        for t in _groups(batches):
            g, role, ids, times = (t.column(i).to_numpy() for i in range(4))
            edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
            a, b, n = [], [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                part = t.slice(lo, hi - lo)
                v, p, cell = (next(_by_length(_one(part.column(i))))[1] for i in (4, 5, 6))
                order = np.lexsort((*cell.T[::-1], role[lo:hi]))
                which, own, many = role[lo:hi][order], ids[lo:hi][order], times[lo:hi][order]
                v, p = v[order], p[order]
                m, out = int((which == 0).sum()), []
                if m == len(which):
                    _join(v, p, v, p, (eps + SLACK) ** 2, cosine, True, out)
                    m = 0
                elif m:
                    _join(v[:m], p[:m], v[m:], p[m:], (eps + SLACK) ** 2, cosine, False, out)
                if not sum(len(i) for i, _ in out):
                    continue
                i, j = (np.concatenate(x) for x in zip(*out))
                j = j + m
                degree = np.bincount(i, many[j], len(own)) + np.bincount(j, many[i], len(own))
                label, some = _labels(len(own), i, j), np.flatnonzero(degree)
                far = np.flatnonzero(label != np.arange(len(own)))
                a += [own[some], own[label[far]]]
                b += [np.full(len(some), -1), own[far]]
                n += [degree[some].astype(np.int64), np.zeros(len(far), np.int64)]
            a, b, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, n))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=n > 0), pa.array(n)], names=["a", "b", "n"])

    return run


def _one(c):
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) for each row."""
    spark, eps = rows.sparkSession, math.sqrt(2 - 2 * cosine)
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    fine = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("n", F.when(fine, norm)).withColumn("ok", F.coalesce((F.col("n") > 0) & (F.col("n") < float("inf")), F.lit(False)))
    rows = rows.withColumn("digest", F.when(F.col("ok"), F.md5(F.to_json(F.struct("label", F.transform("v", lambda x: x + 0.0).alias("v"))).cast("binary"))))
    rows = checkpoint(rows.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x / F.col("n")))).select("id", "label", "v", "digest"))

    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = checkpoint(classes.withColumn("c", F.xxhash64("digest")).withColumn("group", F.xxhash64("label", F.size("v"))))
    sums: dict[int, np.ndarray] = {}
    moments = classes.select("v").mapInArrow(_moments, "dim int, m binary")
    for tasks in (64, 4):
        moments = moments.repartition(tasks).mapInArrow(_add, "dim int, m binary")
    for dim, m in moments.collect():  # four dim x dim matrices for each length at most
        sums[dim] = sums.get(dim, 0) + np.frombuffer(m).reshape(dim, dim)
    axes = {d: np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1]) for d, m in sums.items()}
    axes = spark.sparkContext.broadcast(axes)
    placed = classes.select("c", "group", "v", "times").mapInArrow(_project(axes, eps), "c long, group long, v array<double>, times long, cell array<int>, p array<double>")
    order = ["group", "cell", "c"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpoint(placed.mapInArrow(_cut(BLOCK), "c long, group long, v array<double>, times long, cell array<int>, p array<double>, b long"))

    # Intervals: one row for about BLOCK vectors with bounds in every projected axis, and their cells.
    longest = max([min(d, PROJECTED) for d in sums], default=0)
    bounds = [f(F.get("p", F.lit(i))).alias(f"{n}{i}") for i in range(longest) for n, f in (("lo", F.min), ("hi", F.max))]
    blocks = placed.groupBy("b").agg(F.count("*").alias("m"), *bounds)
    lows, highs = F.array(*(F.col(f"lo{i}") for i in range(longest))), F.array(*(F.col(f"hi{i}") for i in range(longest)))
    blocks = checkpoint(blocks.select("b", lows.alias("lo"), highs.alias("hi")))
    cells = checkpoint(placed.select("b", "group", F.col("cell")[0].alias("x"), F.coalesce(F.get("cell", F.lit(1)), F.lit(0)).alias("y")).distinct())
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = cells.withColumn("near", near).select("group", (F.col("x") + F.col("near.i")).alias("x"), (F.col("y") + F.col("near.j")).alias("y"), F.col("b").alias("b1"))
    pairs = left.join(cells, ["group", "x", "y"]).where("b1 <= b").select("b1", "b").distinct()
    pairs = pairs.join(blocks, "b").join(blocks.select(F.col("b").alias("b1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1")), "b1")
    gap = F.aggregate(
        F.transform(F.arrays_zip("lo", "hi", "lo1", "hi1"), lambda z: F.greatest(F.lit(0.0), z["lo"] - z["hi1"], z["lo1"] - z["hi"])), F.lit(0.0), lambda s, z: s + F.coalesce(z * z, F.lit(0.0))
    )
    pairs = checkpoint(pairs.where(gap <= (eps + SLACK) ** 2).select("b1", F.col("b").alias("b2"), F.xxhash64("b1", "b").alias("g")))
    sent = pairs.select("g", F.lit(0).alias("role"), F.col("b1").alias("b")).unionByName(pairs.where("b1 <> b2").select("g", F.lit(1).alias("role"), F.col("b2").alias("b")))
    tasks = sent.join(placed, "b").select("g", "role", "c", "times", "v", "p", "cell").repartition("g").sortWithinPartitions("g")
    found = checkpoint(tasks.mapInArrow(_link(cosine, eps), "a long, b long, n long"))

    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    links, reps = found.where("b is not null").select("a", "b").distinct(), classes.select("c", "rep")
    named = links.join(reps.select(F.col("c").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("c").alias("b"), F.col("rep").alias("rb")), "b")
    node = checkpoint(components(named.where("ra is not null and rb is not null").select("ra", "rb"), "ra", "rb"))
    known = classes.join(degree, F.col("c") == F.col("a"), "left").join(node, F.col("rep") == F.col("id"), "left")
    known = known.select("digest", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "digest").join(known, "digest", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Brute force inside labels; DuckDB adds the products in its own order.
ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.c)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
JOIN (SELECT a, min(c) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id"""
