"""MinHash near-dedup by an inverted join on signature coordinates.

1. A document is the set of its distinct ``k``-word shingles.  Documents with
   equal sets are one class from here on (a 128-bit digest of the sorted set), so
   copies never meet each other in a join.
2. A class has ``COORDS`` minimum values and is posted under its coordinate-value
   pairs; two sets of Jaccard 0.8 agree in 51 of 64 coordinates on average, and
   pairs that agree in fewer than ``MATCHES`` (38: 4.1 standard deviations below)
   are not links.  Lists are counted: whoever has fewer than MATCHES pairs in lists of
   two or more has no partner and leaves all lists.  Of s pairs that are left, only the
   prefix of the s - MATCHES + 1 in the shortest lists stays posted, in one order
   for all: partners meet in it, and the long lists are skipped.
3. Each list links its members to two of them, its most central one (whose own
   lists are the longest: of many edited copies of a text, the text itself) and one
   drawn by hash: two candidates for a posting, however long the list.  Collisions
   are counted on the signatures, and a document's ``TRIES`` best pairs that pass are
   confirmed on the full sets.  Links make components.
4. Lists that still hold several components are merged (``merge``): members outside
   the largest component are compared with all others of similar size, in pairs of
   blocks dealt over many tasks; collisions are counted first, then the full sets
   decide.  A task tells only links that join two of its components.

Defined results: documents without words, or with a null text, have no shingles
and link with nothing; rows with a null id too (their component is null and they
are kept); rows that repeat an id are one document, with the links of each row;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, checkpoint, components, join_sized, free, table
from ._tokens import Tokenizer, mix, pieces, shingles

COORDS, MATCHES = 64, 38
#: Times that classes without enough partners are taken out of the lists.
PEELS = 2
#: Pairs of a document that are confirmed before lists are merged, and pairs that share one copy of their hub's text.
TRIES, TOGETHER = 3, 64
#: Members and shingles of a block when lists are merged.
BLOCK, SHINGLES = 2048, 1 << 20
#: Above so many rows the ids whose sets are needed, and the places they go to, are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_SIGNED = "id long, n_shingles long, digest binary, signature binary"


def _sets(texts, tokenizer, k):
    """Row and sorted distinct shingle hashes of every row, in order."""
    for at, data, offs in pieces(texts):
        counts, h, _, _ = tokenizer.words(data, offs)
        per, s = shingles(counts, h, k)
        ends = np.cumsum(per)
        for i, (n, to) in enumerate(zip(per.tolist(), ends.tolist())):
            yield at + i, np.unique(s[to - n : to])


def _coefficients(n=COORDS, seed=20240229):
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def _sign(k):
    def run(batches):
        import hashlib

        tokenizer, (mul, add) = Tokenizer(), _coefficients()
        for batch in batches:
            n, digests, signs = [], [], []
            held, size = [], 0

            def flush():
                if held:
                    all_, starts = np.concatenate(held), np.cumsum([0, *map(len, held)])[:-1]
                    out = np.empty((COORDS, len(held)), np.uint32)
                    for j in range(COORDS):
                        out[j] = mix(np.minimum.reduceat(all_ * mul[j] + add[j], starts)).astype(np.uint32)  # minima of large sets share their leading bits
                    signs.extend(row.tobytes() for row in np.ascontiguousarray(out.T))
                    held.clear()

            order = []
            for _, s in _sets(batch.column(1), tokenizer, k):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                order.append(len(s) > 0)
                if len(s):
                    held.append(s)
                    size += len(s)
                    if size > 1 << 16:
                        flush()
                        size = 0
            flush()
            it = iter(signs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array([next(it) if x else None for x in order], pa.binary())], names=["id", "n_shingles", "digest", "signature"])

    return run


def _matrix(column, kind=np.uint32, n=COORDS) -> np.ndarray:
    """The signatures of a column as rows of n numbers."""
    if not len(column):
        return np.zeros((0, n), kind)
    _, o, d = column.buffers()
    return np.frombuffer(d, kind, len(column) * n, np.frombuffer(o, np.int32)[column.offset]).reshape(-1, n)


def _keys(m: np.ndarray) -> np.ndarray:
    """A 64-bit key for each coordinate-value pair."""
    return mix(m.astype(np.uint64) + (np.arange(1, COORDS + 1, dtype=np.uint64) << np.uint64(32)))


def _post(batches):
    """id, its 64 coordinate-value pairs as keys."""
    for batch in batches:
        keys = _keys(_matrix(batch.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * COORDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "keys"])


def _low(batches):
    """id, n and the low byte of each coordinate."""
    for batch in batches:
        low = _matrix(batch.column(2)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "n", "sign"])


def prefixes(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, m): the postings by which every pair that agrees in MATCHES coordinates meets, and the length of their lists.

    A class of which fewer than MATCHES pairs are in a list of two or more has no such
    partner and goes, which shortens the lists, so this is done ``PEELS`` times.  Of s
    pairs that are left the s - MATCHES + 1 in the shortest lists are posted, in one
    order of all keys: partners share one of these, and the long lists are skipped.
    """
    posted = classes.select("id", "signature").mapInArrow(_post, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    shared = None
    for _ in range(PEELS + 1):
        lists = posted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        last, shared = shared, scratch.keep(posted.join(lists, "key"))
        if last is not None:
            scratch.drop(last)
        enough = shared.groupBy("id").agg(F.count("*").alias("s")).where(F.col("s") >= MATCHES).select("id")
        posted = shared.join(enough, "id").select("id", "key")
    first = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("m", "key"))).alias("all")).where(F.size("all") >= MATCHES)  # COORDS entries at most
    first = first.select("id", F.explode(F.slice("all", F.lit(1), F.size("all") - (MATCHES - 1))["key"]).alias("key"))
    first = scratch.keep(first)
    out = scratch.keep(first.join(first.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"))
    scratch.drop(shared, first)
    return out


def _agree(kind, n, matches):
    """Keeps the pairs whose signatures agree in so many coordinates."""

    def run(batches):
        for batch in batches:
            same = np.count_nonzero(_matrix(batch.column(2), kind, n) == _matrix(batch.column(3), kind, n), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same.astype(np.int32))], names=["a", "b", "same"]).filter(pa.array(same >= matches))

    return run


def _best(heads: DataFrame, signs: DataFrame, kind, n: int, matches: int) -> DataFrame:
    """Of each b's pairs (at most two a posting) the TRIES that agree most."""
    own = signs.toDF("s", "x")
    both = heads.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select("a", "b", "x", "y")
    agree = both.mapInArrow(_agree(kind, n, matches), "a long, b long, same int")
    top = F.slice(F.sort_array(F.collect_list(F.struct("same", "a")), asc=False), 1, TRIES)
    return agree.groupBy("b").agg(F.transform(top, lambda x: x["a"]).alias("a")).select(F.explode("a").alias("a"), "b")


def _groups(batches):
    """Record batches cut so that no run of equal first-column values is divided."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        g = held.column(0).to_numpy()
        cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and len(held):
        yield held.combine_chunks()


def _set_rows(k):
    """id and the sorted shingle hashes of each row that has shingles."""

    def run(batches):
        tokenizer = Tokenizer()
        for batch in batches:
            rows, out = [], []
            for i, x in _sets(batch.column(1), tokenizer, k):
                if len(x):
                    rows.append(i)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())], names=["id", "shingles"])

    return run


def _common(mark, flat, start, n, i, at) -> np.ndarray:
    """How many shingles set i shares with each set of ``at``; mark is all 0 before and after."""
    own = flat[start[i] : start[i] + n[i]]
    mark[own] = 1
    off = np.concatenate(([0], np.cumsum(n[at])))
    places = np.repeat(start[at] - off[:-1], n[at]) + np.arange(off[-1])
    both = np.add.reduceat(mark[flat[places]], off[:-1], dtype=np.int64)
    mark[own] = 0
    return both


def _merge(least):
    """Within each group of a sorted partition: a link between any two components that have one, no more than join them."""

    def run(batches):
        for t in _groups(batches):
            g, ids, comp, blk, two = (t.column(i).to_numpy() for i in range(5))
            signs, sets = _matrix(_one(t.column(5)), np.uint8), _one(t.column(6))
            edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
            a, b = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                c, own, block, sign = comp[lo:hi].copy(), ids[lo:hi], blk[lo:hi], signs[lo:hi]
                if c.min() == c.max():
                    continue
                whole = np.frombuffer(b"".join(x.as_py() for x in sets.slice(lo, hi - lo)), np.uint64)
                n = np.array([len(x.as_buffer()) // 8 for x in sets.slice(lo, hi - lo)])
                names, flat = np.unique(whole, return_inverse=True)
                start, mark = np.cumsum(n) - n, np.zeros(len(names), np.uint8)
                for i in range(hi - lo - 1):
                    r = slice(i + 1, hi - lo)
                    ok = (c[r] != c[i]) & (100 * np.minimum(n[r], n[i]) >= least * np.maximum(n[r], n[i]))
                    if two[lo]:
                        ok &= block[r] != block[i]
                    at = np.flatnonzero(ok) + i + 1
                    if len(at):
                        at = at[np.count_nonzero(sign[at] == sign[i], axis=1) >= MATCHES]
                    if not len(at):
                        continue
                    both = _common(mark, flat, start, n, i, at)
                    for j in at[100 * both >= least * (n[i] + n[at] - both)].tolist():
                        if c[j] != c[i]:
                            a.append(min(own[i], own[j]))
                            b.append(max(own[i], own[j]))
                            c[c == c[j]] = c[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _one(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _packed(batches):
    """id, size in bytes, and the compressed text of each row."""
    codec = pa.Codec("zstd")
    for batch in batches:
        texts = [x.as_buffer() for x in batch.column(1).fill_null("").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x.size for x in texts], pa.int64()), pa.array([codec.compress(x, asbytes=True) if x.size else b"" for x in texts], pa.binary())], names=["id", "size", "text"]
        )


def _unpacked(sizes, packed, most: int = 1 << 20):
    """(first row, texts) of runs of rows of about ``most`` bytes."""
    codec, at, held, total = pa.Codec("zstd"), 0, [], 0
    for i, n in enumerate(sizes.tolist()):
        held.append(codec.decompress(packed[i].as_buffer(), n, asbytes=True) if n else b"")
        total += n
        if total >= most:
            yield at, pa.array(held, pa.binary())
            at, held, total = i + 1, [], 0
    if held:
        yield at, pa.array(held, pa.binary())


def _confirm(k, least):
    """Sorted by (hub, salt, hub's rows first): keeps members whose full sets are as similar as asked."""

    def run(batches):
        now, hubs, tokenizer = None, [], Tokenizer()
        for batch in batches:
            hub, salt, role, ids, sizes = (batch.column(i).to_numpy() for i in range(5))
            a, b = [], []
            for at, texts in _unpacked(sizes, batch.column(5)):
                for row, s in _sets(texts, tokenizer, k):
                    i = at + row
                    if (hub[i], salt[i]) != now:
                        now, hubs = (hub[i], salt[i]), []
                    if role[i] == 0:
                        hubs.append(s)
                        continue
                    for x in hubs:
                        if 100 * min(len(x), len(s)) < least * max(len(x), len(s)):
                            continue
                        both = len(np.intersect1d(x, s, assume_unique=True))
                        if both and 100 * both >= least * (len(x) + len(s) - both):
                            a.append(hub[i])
                            b.append(ids[i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of these ids, which are counted: beyond BROADCAST_ROWS they meet by shuffle."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.join(ids, "id", "left_semi").select("id", "text")


def confirm(pairs: DataFrame, docs: DataFrame, k: int, least: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    Sets travel as their compressed texts, a hub's once for about ``TOGETHER`` of its
    pairs; a hot hub's pairs are dealt over as many groups.
    """
    pairs = checkpoint(pairs.select("a", "b"))
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("groups"))
    pairs = checkpoint(pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt")))
    ids = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = _only(docs, ids).mapInArrow(_packed, "id long, size long, text binary")
    want = pairs.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id")).distinct().unionByName(pairs.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id")))
    want = F.broadcast(want) if pairs.count() <= BROADCAST_ROWS // 2 else want
    rows = sets.join(want, "id").select("a", "salt", "role", "id", "size", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(_confirm(k, least), "a long, b long").distinct()


def _drawn(turn: int):
    """A member of the list drawn by hash."""
    return F.max_by("id", F.xxhash64("key", "id", F.lit(turn)))


def _cost(n):
    """Rows that a group of n sends when each of its blocks meets each other one."""
    return F.col(n) * F.ceil(F.col(n) / BLOCK)


def merge(postings: DataFrame, low: DataFrame, comp: DataFrame, docs: DataFrame, k: int, least: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join the components which meet in lists of several.

    Lists that share members make a bundle.  Where a bundle as a whole sends fewer
    rows than its lists one by one, it is one group, so that its pairs meet once;
    otherwise each list is.  In a group the members of the largest component meet only
    the others, and those meet everyone, in pairs of blocks of at most about ``BLOCK``
    rows and ``SHINGLES`` shingles, each pair of blocks in a task with its full sets.
    """
    rows = postings.select("key", "id").join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("id").alias("head"), F.count("*").alias("m")).where("x <> y").select("key", "head", "m")
    rows = scratch.keep(rows.join(mixed, "key"))
    bundles = checkpoint(components(rows.select("head", "id").distinct(), "head", "id").withColumnRenamed("component", "bundle"))
    apart = rows.groupBy("key").agg(F.min("head").alias("id"), F.min("m").alias("m")).join(bundles, "id").groupBy("bundle").agg(F.sum(_cost("m")).alias("apart"))
    sizes = checkpoint(bundles.groupBy("bundle").agg(F.count("*").alias("m")))
    whole = checkpoint(sizes.join(apart, "bundle").select("bundle", (_cost("m") <= F.col("apart")).alias("whole")))
    placed = join_sized(bundles, whole, sizes, "bundle", "id")
    group = F.when(F.col("whole"), F.xxhash64("bundle", F.lit(1))).otherwise(F.xxhash64("key", F.lit(0)))
    members = rows.join(placed, "id").select(group.alias("group"), "id", "comp").distinct()
    members = scratch.keep(members.join(low.groupBy("id").agg(F.max("n").alias("n")), "id"))
    per = members.groupBy("group", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("n")).groupBy("group")
    per = per.agg(F.max(F.struct("m", "comp", "n")).alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    blocks = lambda m, n: F.greatest(F.ceil(m / BLOCK), F.ceil(n / SHINGLES)).cast("int")
    per = checkpoint(per.select("group", "m", F.col("top.comp").alias("most"), blocks(F.col("top.m"), F.col("top.n")).alias("inner"), blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("outer")))
    within = F.col("comp") == F.col("most")
    blk = F.pmod(F.xxhash64("id"), F.when(within, F.col("inner")).otherwise(F.col("outer"))) + F.when(within, 0).otherwise(F.col("inner"))
    sent = join_sized(members, per.drop("m"), per.select("group", "m"), "group", "id").withColumn("blk", blk.cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.when(within, F.col("inner")).otherwise(0), F.col("inner") + F.col("outer") - 1)))
    g = F.xxhash64("group", F.least("blk", "other"), F.greatest("blk", "other"))
    sent = sent.select(g.alias("g"), "id", "comp", "blk", (F.col("other") != F.col("blk")).cast("int").alias("two")).join(low.select("id", "sign"), "id")
    ids = checkpoint(members.select("id").distinct())
    sets = _only(docs, ids).mapInArrow(_set_rows(k), "id long, shingles binary")
    found = sent.join(sets, "id").select("g", "id", "comp", "blk", "two", "sign", "shingles").repartition("g").sortWithinPartitions("g")
    found = checkpoint(found.mapInArrow(_merge(least), "a long, b long").distinct())
    scratch.drop(rows, members)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, least: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row: links are pairs with 100 * |A & B| >= least * |A | B|."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(docs.mapInArrow(_sign(k), _SIGNED))  # an id, a digest and a signature a row: the texts are read once for it
    full = signed.where("digest is not null and id is not null")
    classes = scratch.keep(full.groupBy("digest").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n"), F.first("signature").alias("signature")).drop("digest"))
    own = scratch.keep(signed.drop("signature"))
    scratch.drop(signed)
    full = own.where("digest is not null and id is not null")
    postings = prefixes(classes, scratch)
    near = classes.join(postings.select("id").distinct(), "id", "left_semi")
    low = scratch.keep(near.select("id", "n", "signature").mapInArrow(_low, "id long, n long, sign binary"))
    scratch.drop(classes)
    central = postings.groupBy("id").agg(F.round(F.sum(F.log("m")), 6).alias("central"))
    ranked = postings.join(central, "id")
    first = F.max(F.struct(F.col("central").alias("c"), (-F.col("id")).alias("i")))["i"]
    hubs = ranked.groupBy("key").agg((-first).alias("x"), _drawn(0).alias("y")).select("key", F.explode(F.array("x", "y")).alias("hub"))
    heads = postings.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    best = _best(heads, low.select("id", "sign"), np.uint8, COORDS, MATCHES)
    links = confirm(best, docs, k, least)
    several = checkpoint(full.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("id"))
    if not several.isEmpty():  # an id that bears several texts links their classes
        rep = full.groupBy("digest").agg(F.min("id").alias("rep"))
        shared = full.join(several, "id", "left_semi").select("id", "digest").join(rep, "digest")
        links = links.unionByName(shared.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct())
    links = checkpoint(links)

    found = merge(postings, low, components(links), docs, k, least, scratch)
    node = checkpoint(components(links.unionByName(found)))

    # A class belongs to the component of its smallest id.
    per_class = checkpoint(full.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    named = per_class.join(node.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = join_sized(full, named, per_class, "digest", "id").select("id", "n_shingles", "component_id")
    rest = own.where("digest is null or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = scratch.keep(out.unionByName(rest))
    scratch.drop(own, postings, low)
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, least: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns: one of each group, the one with the smallest id; of rows that repeat an id, one."""
    again, row = free(docs.columns, "again", "row")
    found = near_duplicates(docs, key, text, k, least).select(key, "kept").where(F.col(key).isNotNull())
    gone = found.where(~F.col("kept")).select(key).distinct()
    repeated = found.where("kept").groupBy(key).count().where("count > 1").select(key)
    gone = checkpoint(gone.withColumn(again, F.lit(False)).unionByName(repeated.withColumn(again, F.lit(True))))
    small = gone.count() <= BROADCAST_ROWS
    left = docs.join(F.broadcast(gone) if small else gone, key, "left_anti")
    twice = gone.where(again).select(key)
    if twice.isEmpty():
        return left
    order = Window.partitionBy(key).orderBy(*(c for c in docs.columns if c != key))
    one = docs.join(twice, key, "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).select(*docs.columns)
    return left.unionByName(one)
