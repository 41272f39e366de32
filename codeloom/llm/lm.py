"""LM scoring by a hierarchical Pitman-Yor model with sampled seating.

A text is its words (runs of anything but blanks, A-Z lower-cased) and one end
token.  The outcomes are the V words of the training texts and one unknown word.  A
token's context is the word before it in its text, or the text's start.  Every
context has a Pitman-Yor restaurant, however rare the word; all of them share one
parent restaurant of words, whose base is uniform over the V + 1 outcomes; a table in
a context is a customer of the parent.  Words are known by their 64-bit hashes.

Seating is sampled by Gibbs sweeps.  A sweep seats the customers of every dish anew
in its context restaurants, given the parent's predictions and all others' tables,
and then the tables as customers in the parent.  Customers are seated one by one
where they are few; where they are many, the next customer to open a table is drawn
at once (the survival function is a ratio of gammas), or for strong parents the
number of tables by its normal limit.  All draws are hashes of word, context, sweep
and step, so a lost task draws the same again.  A pair seen once has one table in
every sweep, so only pairs seen more often are seated.  After ``BURN`` sweeps, each of
``SAMPLES`` sweeps gives a predictive probability; a token's probability is their
mean, and perplexity follows.  Whether the seating has settled is not checked.

What moves: the pairs of each piece of text, packed (two bytes for each of the FREQUENT
words, others as hashes, zstd), to the buckets that count them; pairs seen more than
once, to meet their context's and their word's totals, which for the frequent words are
broadcast; packed probabilities (in steps of 2**-25 of log10) back to the pieces, whose
documents wait as packed places of pairs.  Totals of frequent words are packed by
spans.  Each step's shuffle files are removed when it ends, and written tables as soon
as nothing reads them.

Defined results: a null or empty text is the end token alone; a null doc_id is a
training document; each row is scored by itself and repeats count as often as they
come; without training rows every token is unknown (probability 1); an empty table
gives no rows.
"""

from __future__ import annotations

import ctypes
from functools import reduce
from inspect import isgeneratorfunction, signature

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, fold, settings, shuffles_removed, table
from ._tokens import Tokenizer, mix, pieces

FOLDS = 10
CONTEXTS = 255  # of the dense form alone
BURN, SAMPLES = 1, 2
FREQUENT = 65_535  # words that are written in two bytes
SAMPLE = 8_192  # texts from which they are taken
STRENGTH = 10.0
ADD = 0.1
_PIECE = 2 << 20
_LARGE = 6 << 20  # bytes of text whose pairs are packed together
_BUCKET = 4 << 20  # bytes of text for each bucket of cells
_SPAN = 1_024  # numbers of frequent words whose totals travel together
_FILE = 10  # buckets for each file of a table
SLICES = 3  # parts in which the buckets answer, so that their shuffles need not be on disk together


# ---- words of texts -------------------------------------------------------


def _strings(tokenizer, data, start, end) -> pa.StringArray:
    """The lower-cased words at these places, in order."""
    n = end - start
    off = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(start - off[:-1], n) + np.arange(off[-1])
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(tokenizer.fold[data[at]]))


def word_hashes(words: list[str]) -> np.ndarray:
    """The tokenizer's hashes of these words, in order; the empty word is 0."""
    out, at = np.zeros(len(words), np.uint64), [i for i, w in enumerate(words) if w]
    for _, data, offs in pieces(pa.array([" ".join(words[i] for i in at)], pa.string()), 1 << 62):
        out[at] = Tokenizer(lower=False).words(data, offs)[1]
    return out


def _find(keys: np.ndarray, h: np.ndarray):
    """(place in the sorted keys, whether it is there)."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _contexts(keys, number, counts, h):
    """The context of every word, and of every row's end token."""
    at, hit = _find(keys, h)
    own = np.where(hit, number[at], 0)
    stop = np.cumsum(counts)
    place = np.where(hit, np.arange(1, len(h) + 1), 0)
    last = np.concatenate(([0], np.maximum.accumulate(place)))  # 1 + the latest context word before each place
    own = np.concatenate(([0], own))
    before = np.where(last[:-1] > np.repeat(stop - counts, counts), own[last[:-1]], 0)
    return before, np.where(last[stop] > stop - counts, own[last[stop]], 0)


def _count_contexts(shared):
    """(w, contexts, counts): each batch's words with the contexts they stand in."""

    def run(batches):
        tokenizer, (keys, number) = Tokenizer(), shared.value
        for batch in batches:
            for _, data, offs in pieces(batch.column(0), _PIECE):
                counts, h, start, end = tokenizer.words(data, offs)
                before, at_end = _contexts(keys, number, counts, h)
                h = np.concatenate((h, np.zeros(len(counts), np.uint64)))
                u = np.concatenate((before, at_end))
                order = np.lexsort((u, h))
                h, u = h[order], u[order]
                word = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                cell = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (u[1:] != u[:-1]))))
                n = np.diff(np.append(cell, len(h)))
                lists = np.append(np.searchsorted(cell, word), len(cell)).astype(np.int32)
                first = order[word]
                ends = h[word] == 0  # the end token comes first, if any
                texts = _strings(tokenizer, data, start[first[~ends]], end[first[~ends]])
                texts = pa.concat_arrays([pa.array([""] * int(ends.sum()), pa.string()), texts])
                yield pa.RecordBatch.from_arrays(
                    [texts, pa.ListArray.from_arrays(pa.array(lists), pa.array(u[cell].astype(np.int16))), pa.ListArray.from_arrays(pa.array(lists), pa.array(n.astype(np.int64)))],
                    names=["w", "u", "n"],
                )

    return run


# ---- seating --------------------------------------------------------------


def uniform(seed: np.ndarray, *steps: int) -> np.ndarray:
    """Numbers in (0, 1) that only depend on the seeds and steps."""
    salt = 0
    for s in steps:
        salt = (salt * 0x9E3779B97F4A7C15 + s + 1) & ((1 << 64) - 1)
    return ((mix(seed ^ mix(np.full(1, salt, np.uint64))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def seat(c: np.ndarray, a: np.ndarray, d: float, seed: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of dishes with c customers, seated in a restaurant where a new table weighs ``a``."""
    t = np.minimum(c, 1)
    few = np.flatnonzero((c > 1) & (c <= 64))
    for n in range(1, 64):
        few = few[c[few] > n]
        if not len(few):
            break
        t[few] += uniform(seed[few], sweep, n) * (a[few] + n - d * t[few]) < a[few]
    many = np.flatnonzero(c > 64)
    strong = many[a[many] >= 20]
    own, low, high = a[strong], np.ones(len(strong)), c[strong].astype(float)
    for _ in range(40):  # tables t of dt/dn = a / (n - d t + a), by halving
        mid = (low + high) / 2
        over = mid > 1 + own * np.log(np.maximum((c[strong] - d * mid + own * (1 - d)) / ((1 + own) * (1 - d)), 1e-300))
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    mean = low - 1
    z = np.sqrt(-2 * np.log(uniform(seed[strong], sweep, 100))) * np.cos(2 * np.pi * uniform(seed[strong], sweep, 101))
    t[strong] = np.clip(np.rint(1 + mean + np.sqrt(mean * np.maximum(1 - mean / c[strong], 0)) * z), 1, c[strong]).astype(t.dtype)
    weak, n = many[(a[many] < 20) & (a[many] > 0)], None
    n = np.ones(len(weak))
    for step in range(2000):
        if not len(weak):
            break
        own = a[weak]
        x = np.maximum(n - d * t[weak] + (own - 1) / 2, 0.5 * (1 - d))
        with np.errstate(over="ignore"):
            n = np.ceil(n + x * (uniform(seed[weak], sweep, 200 + step) ** (-1 / own) - 1)) + 1e-9
        go = n <= c[weak]
        weak, n = weak[go], n[go]
        t[weak] += 1
    return t


class Model:
    """The dense form for at most ``CONTEXTS`` contexts, which scoring does not use: discounts and, after each sweep, the totals of all restaurants; a word's own seating is replayed."""

    def __init__(self, tokens, types, d, d0, customers):
        self.tokens, self.types, self.d, self.d0, self.customers = tokens, types, d, d0, customers
        self.totals: list = []  # (tables by context, customers of the parent, its tables)

    def replay(self, words, offs, u, c, sweeps):
        """For each sweep so far (word of each cell, tables of cells, parent's customers and tables of words)."""
        word = np.repeat(np.arange(len(words)), np.diff(offs))
        seed0 = word_hashes(words.to_pylist())
        seed = mix(seed0[word] + u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        t, t0 = np.minimum(c, 1), np.ones(len(words), np.int64)
        n0 = np.bincount(word, t, len(words)).astype(np.int64)
        out = [(word, t, n0, t0)]
        for s in range(1, sweeps + 1):
            tables, _, all0 = self.totals[s - 1]
            base = self.parent(n0, t0, s - 1)
            t = seat(c, (STRENGTH + self.d * tables[u]) * base[word], self.d, seed, s)
            n0 = np.bincount(word, t, len(words)).astype(np.int64)
            t0 = seat(n0, np.full(len(words), (STRENGTH + self.d0 * all0) / (self.types + 1)), self.d0, seed0, s)
            out.append((word, t, n0, t0))
        return out

    def parent(self, n0, t0, s):
        """The parent's predictions after a sweep for words with n0 customers at t0 tables (0 at 0: the unknown word)."""
        _, all_n, all_t = self.totals[s]
        return (np.maximum(n0 - self.d0 * t0, 0) + (STRENGTH + self.d0 * all_t) / (self.types + 1)) / (STRENGTH + all_n)

    def back(self, s) -> np.ndarray:
        """The share of each context's predictions that is its parent's."""
        return (STRENGTH + self.d * self.totals[s][0]) / (STRENGTH + self.customers)

    def chosen(self):
        return range(BURN + 1, BURN + SAMPLES + 1)

    def predict(self, words, offs, u, c):
        """(parent's prediction of each word by sample, log10 of the mean prediction of each cell)."""
        seats, p0, p = self.replay(words, offs, u, c, BURN + SAMPLES), [], 0
        for s in self.chosen():
            word, t, n0, t0 = seats[s]
            p0.append(self.parent(n0, t0, s))
            p = p + np.maximum(c - self.d * t, 0) / (STRENGTH + self.customers[u]) + self.back(s)[u] * p0[-1][word]
        return p0, np.log10(p / SAMPLES)


def _cells(batch):
    """Words, list offsets, contexts and counts of a batch of (w, u, n), contexts summed."""
    words, offs = batch.column(0), np.concatenate(([0], np.cumsum(batch.column(1).value_lengths().to_numpy())))
    word = np.repeat(np.arange(len(words)), np.diff(offs))
    key, which = np.unique(word * 1024 + batch.column(1).flatten().to_numpy().astype(np.int64), return_inverse=True)
    c = np.bincount(which, batch.column(2).flatten().to_numpy()).astype(np.int64)
    return words, np.searchsorted(key, np.arange(len(words) + 1) * 1024), key % 1024, c


def _sweep(shared, sweep):
    """(key, n) sums of a task after a sweep: tables by context, then the parent's customers (-1) and tables (-2)."""

    def run(batches):
        m, out = shared.value, np.zeros(CONTEXTS + 3, np.int64)
        for batch in batches:
            words, offs, u, c = _cells(batch)
            _, t, n0, t0 = m.replay(words, offs, u, c, sweep)[sweep]
            out[: CONTEXTS + 1] += np.bincount(u, t, CONTEXTS + 1).astype(np.int64)
            out[-2] += n0.sum()
            out[-1] += t0.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["key", "n"])

    return run


def _start(batches):
    """(key, n) sums of a task: customers by context, then cells of 1 and 2 customers, and words in 1 and 2 contexts."""
    out = np.zeros(CONTEXTS + 5, np.int64)
    for batch in batches:
        words, offs, u, c = _cells(batch)
        out[: CONTEXTS + 1] += np.bincount(u, c, CONTEXTS + 1).astype(np.int64)
        n = np.diff(offs)
        out[-4:] += [(c == 1).sum(), (c == 2).sum(), (n == 1).sum(), (n == 2).sum()]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["key", "n"])


def _sums(df: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for key, n in df.groupBy("key").agg(F.sum("n")).collect():  # one row for each of the fixed keys
        out[key] = n
    return out


def fit(cells: DataFrame, tokens: int, types: int) -> Model:
    """A model from (w, u, n)."""
    context = cells.sparkSession.sparkContext
    first = _sums(cells.mapInArrow(_start, "key long, n long"), CONTEXTS + 5)
    d, d0 = (float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95)) for a, b in (first[-4:-2], first[-2:]))
    model = Model(tokens, types, d, d0, first[: CONTEXTS + 1])
    for sweep in range(BURN + SAMPLES + 1):
        got = _sums(cells.mapInArrow(_sweep(context.broadcast(model), sweep), "key long, n long"), CONTEXTS + 3)
        model.totals.append((got[: CONTEXTS + 1], int(got[-2]), int(got[-1])))
    return model


# ---- all contexts ---------------------------------------------------------


def _give_back() -> None:
    """Memory that this worker has freed goes back to the system: beside an executor workers wait that ran before."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def _lean(run):
    """``run``, which maps batches or a group, with _give_back() at its end."""

    def batches_(batches):
        yield from run(batches)
        _give_back()

    def group(table):
        try:
            return run(table)
        finally:
            _give_back()

    def groups(left, right):
        try:
            return run(left, right)
        finally:
            _give_back()

    if isgeneratorfunction(run):
        return batches_
    return group if len(signature(run).parameters) == 1 else groups


def _runs(*columns):
    """Order and first places of the runs of equal rows; rows whose keys collide only make more runs."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    return order, np.flatnonzero(new)


def _tokens(tokenizer, data, offs):
    """(row, previous word, word) of every token; 0 is the start of a text as context and its end as word."""
    counts, h, _, _ = tokenizer.words(data, offs)
    w = np.insert(h, np.cumsum(counts), np.uint64(0))
    return np.repeat(np.arange(len(counts)), counts + 1), np.concatenate((np.zeros(1, np.uint64), w[:-1])), w


def _count_pairs(batches):
    """(u, w, c): the pairs of each batch of (train, text), those of held-out texts with 0 customers."""
    tokenizer = Tokenizer()
    for batch in batches:
        train = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, data, offs in pieces(batch.column(1), _PIECE):
            doc, u, w = _tokens(tokenizer, data, offs)
            order, first = _runs(u, w)
            c = np.add.reduceat(train[row + doc[order]], first)
            yield pa.RecordBatch.from_arrays([pa.array(u[order[first]].view(np.int64)), pa.array(w[order[first]].view(np.int64)), pa.array(c)], names=["u", "w", "c"])


def _seat_cells(d, sweep, top):
    """Cells (u, w, c, seats, a, ...) with their tables t for a."""

    def run(batches):
        for batch in batches:
            u, w = (_hashes(batch.column(c).to_numpy().view(np.uint64), top) for c in ("u", "w"))
            t = seat(batch.column("c").to_numpy(), batch.column("a").to_numpy(), d, mix(w + u * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), sweep)
            yield batch.drop_columns(["a"]).append_column("t", pa.array(t))

    return _lean(run)


def _seat_words(a, d0, sweep, top):
    """Words (w, n0, t0, ...) with t0 seated anew."""

    def run(batches):
        for batch in batches:
            n0 = batch.column("n0").to_numpy()
            t0 = seat(n0, np.full(len(n0), a), d0, _hashes(batch.column("w").to_numpy().view(np.uint64), top), sweep)
            yield batch.set_column(batch.schema.get_field_index("t0"), "t0", pa.array(t0))

    return _lean(run)


def _met(left: DataFrame, right: DataFrame, key: str, top) -> DataFrame:
    """Each row of ``left`` with the one of ``right`` with its key; the numbered words, FREQUENT at most, meet by a broadcast."""
    if top is None:
        return left.join(right, key)
    often = (F.col(key) >= 0) & (F.col(key) < len(top))
    return left.where(often).join(F.broadcast(right.where(often)), key).unionByName(left.where(~often).join(right.where(~often), key))


def _each(name: str) -> list[str]:
    """A column for each sample."""
    return [f"{name}{i + 1}" for i in range(SAMPLES)]


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _settle(contexts: DataFrame, words: DataFrame, many: DataFrame, scratch: Scratch, top=None):
    """The sweeps: (contexts (u, customers, back1, ...), words (w, c, p1, ...), many (..., t1, ...), d, tokens, types) and the tables to drop.

    From contexts (u, customers, single, tables), words (w, c, single, n0, ...) and the cells ``many`` (u, w, c, ...) with
    more than one customer; a cell with one has one table in every sweep.  For each sample, ``back`` and ``p`` hold the
    parent's share and prediction, ``t`` the cells' tables.
    """
    contexts = scratch.keep(contexts)
    words = written = scratch.keep(words.withColumn("t0", F.least("n0", F.lit(1).cast("long"))))
    got = words.agg(F.sum("t0"), F.sum("n0"), F.count_if(F.col("n0") == 1), F.count_if(F.col("n0") == 2), F.sum("c"), F.sum("single")).first()
    types, all_n, m1, m2, tokens, n1 = (x or 0 for x in got)
    n2 = many.where("c = 2").count()
    all_t = types
    d, d0 = (float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95)) for a, b in ((n1, n2), (m1, m2)))
    share = (F.lit(STRENGTH) + d * F.col("tables")) / (F.lit(STRENGTH) + F.col("customers"))
    parent = lambda: (F.greatest(F.col("n0") - d0 * F.col("t0"), F.lit(0.0)) + (STRENGTH + d0 * all_t) / (types + 1)) / (STRENGTH + all_n)
    moves = F.col("tables") > F.col("single")  # the others have cells of one customer alone
    still = contexts.where(~moves).select("u", "customers", *(share.alias(x) for x in _each("back")))
    start, contexts = contexts, contexts.where(moves)
    first = None
    for s in range(1, BURN + SAMPLES + 1):
        met = _met(_met(many, contexts.select("u", "tables"), "u", top), words.select("w", parent().alias("base")), "w", top)
        met = met.select(*many.columns, ((STRENGTH + d * F.col("tables")) * F.col("base")).alias("a"))
        seated, old = scratch.keep(scratch.few(met).mapInArrow(_seat_cells(d, s, top), _fields(many) + ", t long")), (written, *([first, contexts] if first is not None else []))
        tables = seated.groupBy("u").agg(F.sum("t").alias("t"))
        contexts = contexts.join(tables, "u").withColumn("tables", F.col("single") + F.col("t")).drop("t")
        moved = words.where("n0 > single").join(seated.groupBy("w").agg(F.sum("t").alias("t")), "w").withColumn("n0", F.col("single") + F.col("t"))
        moved = scratch.few(moved.select(*words.columns).unionByName(words.where("n0 <= single")))
        words = written = scratch.keep(moved.mapInArrow(_seat_words((STRENGTH + d0 * all_t) / (types + 1), d0, s, top), _fields(words)))
        all_n, all_t = (x or 0 for x in words.agg(F.sum("n0"), F.sum("t0")).first())
        first, many = seated, seated.drop("t")
        contexts = scratch.keep(contexts.withColumn(f"back{s - BURN}", share) if s > BURN else contexts)
        if s > BURN:
            many = seated.withColumnRenamed("t", f"t{s - BURN}")
            words = words.withColumn(f"p{s - BURN}", parent())
        scratch.drop(*old)
    every = contexts.select("u", "customers", *_each("back")).unionByName(still)
    return every, words, many, d, tokens, types, (start, contexts, written, first)


def predictions(cells: DataFrame):
    """(u, w, known, base, lp) of every cell (u, w, c), and the number of training tokens: the model as rows."""
    scratch = Scratch(cells.sparkSession)
    one, some = F.count_if(F.col("c") == 1).alias("single"), F.count_if(F.col("c") > 0)
    contexts = cells.groupBy("u").agg(F.sum("c").alias("customers"), one, some.alias("tables"))
    words = cells.groupBy("w").agg(F.sum("c").alias("c"), one, some.alias("n0"))
    contexts, words, many, d, tokens, types, _ = _settle(contexts, words, cells.where("c > 1").select("u", "w", "c"), scratch)
    c = F.col("c").cast("double")
    few = cells.where("c < 2").select("u", "w", "c", *(F.col("c").alias(t) for t in _each("t")))
    own = few.unionByName(many)
    own = own.select("u", "w", *(F.greatest(c - d * F.col(t), F.lit(0.0)).alias(t) for t in _each("t")))
    own = own.join(contexts, "u")
    base = F.log10((F.col("c") + ADD) / F.lit(float(tokens + ADD * (types + 1))))
    own = own.join(words.select("w", (F.col("c") > 0).cast("long").alias("known"), base.alias("base"), *_each("p")), "w")
    p = sum(F.col(t) / (F.lit(STRENGTH) + F.col("customers")) + F.col(b) * F.col(p0) for t, b, p0 in zip(*map(_each, ("t", "back", "p")))) / SAMPLES
    return own.select("u", "w", "known", "base", F.log10(p).alias("lp")), tokens


# ---- packed pairs ---------------------------------------------------------


def _pack(*arrays) -> bytes:
    """The arrays byte by byte in planes, compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind), a.dtype.itemsize, len(a)))], np.int64).tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(blob) -> list[np.ndarray]:
    blob = memoryview(blob)
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 * (1 + 3 * n)
    for kind, size, length in np.frombuffer(raw, np.int64, 3 * n, 8).reshape(-1, 3).tolist():
        planes = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{size}"))
        at += size * length
    return out


def _steps(places, sizes):
    """The places of each list as steps from the one before, the first from 0."""
    out = np.diff(places, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[first] = places[first]
    return out.astype(np.uint32)


def _places(steps, sizes):
    if not len(steps):
        return np.zeros(0, np.int64)
    total = np.cumsum(steps.astype(np.int64))
    before = np.concatenate(([0], total))[np.cumsum(sizes) - sizes]
    return total - np.repeat(before, sizes)


def _hashes(ids, top):
    """The words' hashes; ids below len(top) are numbers of frequent words, all others are the hashes themselves."""
    return ids if top is None else np.where(ids < len(top), top[np.minimum(ids, len(top) - 1).astype(np.int64)], ids)


def _codes(ids, top):
    """Two bytes for each word and the hashes of those that are not numbered."""
    often = ids < len(top)
    return np.where(often, ids, 65535).astype(np.uint16), ids[~often]


def _ids(codes, rare):
    out = codes.astype(np.uint64)
    out[codes == 65535] = rare
    return out


def _count_words(batches):
    """(w, n) of each batch."""
    tokenizer = Tokenizer()
    for batch in batches:
        for _, data, offs in pieces(batch.column(0), _PIECE):
            w, n = np.unique(tokenizer.words(data, offs)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])


def frequent(rows: DataFrame, texts: int) -> np.ndarray:
    """Hashes of at most FREQUENT words, the most frequent first, from about SAMPLE texts; the text's end is always one.

    They are only written shorter and met by a broadcast; no result depends on them.
    """
    some = rows if texts <= SAMPLE else rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(texts)) < SAMPLE)
    top = some.select("text").mapInArrow(_count_words, "w long, n long").where("w <> 0").groupBy("w").agg(F.sum("n").alias("n"))
    top = top.orderBy(F.desc("n"), "w").limit(max(min(FREQUENT, 65_535) - 1, 0)).select("w").collect()
    return np.array([0, *(r.w for r in top)], np.int64).view(np.uint64)


def _large(tokenizer, texts):
    """(first row, counts by row, hashes) of runs of rows of about ``_LARGE`` bytes, whose words are found in smaller pieces."""
    first, size, held = 0, 0, []
    for row, data, offs in pieces(texts, _PIECE // 8):
        if size >= _LARGE:
            yield first, *map(np.concatenate, zip(*held))
            first, size, held = row, 0, []
        held.append(tokenizer.words(data, offs)[:2])
        size += len(data)
    if held:
        yield first, *map(np.concatenate, zip(*held))


def _pack_pairs(top, buckets):
    """(bucket, batch, data): the pairs of each piece of (train, doc_id, text) with their customers, dealt over the buckets; below bucket 0 its documents.

    All pairs of a word that is not frequent share a bucket, those of a first word that is
    not with frequent words too, and pairs of frequent words are dealt one by one.
    """

    def run(batches):
        tokenizer, order, part, made = Tokenizer(), np.argsort(top), TaskContext.get().partitionId(), 0
        keys = top[order]
        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, counts, h in _large(tokenizer, batch.column(2)):
                doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts + 1)
                h = np.insert(h, np.cumsum(counts), np.uint64(0))
                names, w = np.unique(h, return_inverse=True)
                del h
                at, hit = _find(keys, names)
                ids = np.where(hit, order[at].astype(np.uint64), names)
                by = np.argsort(ids)
                ids, place = ids[by], np.empty(len(by), np.int32)
                place[by] = np.arange(len(by))
                w = place[w]
                u = np.concatenate((w[:1], w[:-1]))
                u[np.concatenate(([True], doc[1:] != doc[:-1]))] = np.searchsorted(ids, 0)  # the end is number 0
                pair, which = np.unique(u.astype(np.int64) * len(ids) + w, return_inverse=True)
                del u, w
                which = which.astype(np.int32)
                pu, pw = ids[pair // len(ids)], ids[pair % len(ids)]
                deal = np.where(pw >= len(top), pw, np.where(pu >= len(top), pu, mix(pu * np.uint64(0x9E3779B97F4A7C15) + pw)))
                bucket = (mix(deal) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                place = np.empty(len(by), np.int64)
                place[by] = np.arange(len(by))
                c = np.bincount(which, train[row + doc], len(pair)).astype(np.int64)
                # documents
                cell, n = np.unique(doc * np.int64(len(pair)) + place[which], return_counts=True)
                del doc, which
                sizes = np.bincount(cell // len(pair), minlength=len(counts))
                names = batch.column(1).slice(row, len(counts))
                null = names.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                number = (part << 32) + made
                made += 1
                where, what = [-1 - number % (1 << 30)], [_pack(names.fill_null(0).to_numpy(), null, sizes, _steps(cell % len(pair), sizes), n)]
                pu, pw, c, bucket = pu[by], pw[by], c[by], bucket[by]
                edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    where.append(int(bucket[lo]))
                    what.append(_pack(*_codes(pu[lo:hi], top), *_codes(pw[lo:hi], top), c[lo:hi]))
                for lo in range(0, len(where), 1024):
                    n = len(where[lo : lo + 1024])
                    yield pa.RecordBatch.from_arrays([pa.array(where[lo : lo + n], pa.int64()), pa.array([number] * n, pa.int64()), pa.array(what[lo : lo + n], pa.binary())], names=["bucket", "batch", "data"])

    return _lean(run)


_TALLY = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("batch", pa.int64()), ("u", pa.int64()), ("w", pa.int64()), ("place", pa.int64()), ("c", pa.int64()), ("single", pa.int64()), ("some", pa.int64()), ("data", pa.binary())])
_TALLIED = "kind string, bucket long, batch long, u long, w long, place long, c long, single long, some long, data binary"


def _rows(kind, n, **columns):
    columns = {"kind": pa.array([kind] * n, pa.string())} | {k: pa.array(v.view(np.int64) if isinstance(v, np.ndarray) else v, _TALLY.field(k).type) for k, v in columns.items()}
    return pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _TALLY], schema=_TALLY)


def _tally(top):
    """Of a bucket: its cells and which of them each piece holds (packed), the cells of several customers, and the totals by u and by w.

    Totals of words that are not frequent are rows; those of frequent ones, which are in
    every bucket, are packed by spans of their numbers: place p those by u, -1 - p those by w.
    """

    def run(t):
        bucket, batch, data = t.column("bucket")[0].as_py(), t.column("batch").to_pylist(), t.column("data")
        if bucket < 0:
            return _rows("document", len(t), bucket=[bucket] * len(t), batch=batch, data=data.combine_chunks())
        got = [_unpack(x.as_buffer()) for x in data]
        u = np.concatenate([_ids(x[0], x[1]) for x in got])
        w = np.concatenate([_ids(x[2], x[3]) for x in got])
        sizes = np.array([len(x[0]) for x in got])
        ids, both = np.unique(np.concatenate((u, w)), return_inverse=True)
        pair, which = np.unique(both[: len(u)] * len(ids) + both[len(u) :], return_inverse=True)
        c = np.bincount(which, np.concatenate([x[4] for x in got]), len(pair)).astype(np.int64)
        pu, pw = pair // len(ids), pair % len(ids)
        lists = _steps(which, sizes)
        out = [_rows("cells", 1, bucket=[bucket], data=[_pack(*_codes(ids[pu], top), *_codes(ids[pw], top), c, np.array(batch), sizes, lists)])]
        at = np.flatnonzero(c > 1)
        out.append(_rows("many", len(at), bucket=np.full(len(at), bucket), u=ids[pu[at]], w=ids[pw[at]], place=at, c=c[at]))
        places, spans = [], []
        for name, p in (("u", pu), ("w", pw)):
            have = np.flatnonzero(np.bincount(p, minlength=len(ids)))
            totals = [np.bincount(p, x, len(ids))[have].astype(np.int64) for x in (c, c == 1, c > 0)]
            often = int(np.searchsorted(ids[have], np.uint64(len(top))))  # ids ascend
            numbers = ids[have[:often]].astype(np.int64)
            edges = np.searchsorted(numbers, np.arange(0, len(top) + _SPAN, _SPAN)).tolist()
            for n, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                if lo < hi:
                    places.append(n if name == "u" else -1 - n)
                    spans.append(_pack((numbers[lo:hi] % _SPAN).astype(np.uint16), *(x[lo:hi] for x in totals)))
            rare = {k: x[often:] for k, x in zip(("c", "single", "some"), totals)}
            out.append(_rows(name, len(have) - often, bucket=np.full(len(have) - often, bucket), **rare, **{name: ids[have[often:]]}))
        out.append(_rows("often", len(places), bucket=[bucket] * len(places), place=places, data=spans))
        return pa.concat_tables(out)

    return _lean(run)


def _add_often(t):
    """(side, k, c, single, some): the totals of a span of frequent words over all buckets, side 0 by u and 1 by w."""
    place = t.column("place")[0].as_py()
    out = np.zeros((4, _SPAN), np.int64)
    for x in t.column("data"):
        at, *totals = _unpack(x.as_buffer())
        out[:3, at] += totals
        out[3, at] = 1
    at = np.flatnonzero(out[3])
    k = at + _SPAN * (place if place >= 0 else -1 - place)
    return pa.table([pa.array(np.full(len(at), int(place < 0))), pa.array(k), *(pa.array(x[at]) for x in out[:3])], names=["side", "k", "c", "single", "some"])


def _answer(top, often_u, often_w, d):
    """(batch, bucket, data): log10 probability and word count for each pair that a piece sent to this bucket, in its order.

    Probabilities are written in steps of 2**-25.
    """

    def values(ids, often, got):
        out = [x[np.minimum(ids, len(top) - 1).astype(np.int64)] for x in often]
        rare = np.flatnonzero(ids >= len(top))
        if len(rare):
            key = got.column("key").to_numpy().view(np.uint64)
            order = np.argsort(key)
            at = order[np.searchsorted(key[order], ids[rare])]
            for i, x in enumerate(out):
                x[rare] = got.column(f"x{i}").to_numpy()[at]
        return out

    def run(left, right):
        batch, bucket, data = [], [], []
        for number, blob in zip(left.column("bucket").to_pylist(), left.column("data")):
            a, b, e, f, c, batches, sizes, lists = _unpack(blob.as_buffer())
            u, w = _ids(a, b), _ids(e, f)
            kind = right.column("kind").to_numpy()
            told = [right.filter(pa.array(kind == i)) for i in range(3)]
            (customers, *back), (count, *p0) = values(u, often_u, told[0]), values(w, often_w, told[1])
            p, at = 0, told[2].column("key").to_numpy()
            for i in range(SAMPLES):
                t = np.minimum(c, 1).astype(float)
                t[at] = told[2].column(f"x{i + 1}").to_numpy()
                p = p + np.maximum(c - d * t, 0) / (STRENGTH + customers) + back[i] * p0[i]
            lp, count = np.rint(np.log10(p / SAMPLES) * 2.0**25).astype(np.int32), count.astype(np.int64)
            places, to = _places(lists, sizes), np.cumsum(sizes)
            for i, (n, end) in enumerate(zip(sizes.tolist(), to.tolist())):
                own = places[end - n : end]
                batch.append(int(batches[i]))
                bucket.append(number)
                data.append(_pack(lp[own], count[own]))
        return pa.table([pa.array(batch, pa.int64()), pa.array(bucket, pa.int64()), pa.array(data, pa.binary())], names=["batch", "bucket", "data"])

    return _lean(run)


def _add_up(tokens, types):
    """(doc_id, n_tokens, n_known, base_score, score) of the documents of a piece."""

    def run(left, right):
        out = []
        got = [_unpack(x.as_buffer()) for x in right.take(pa.array(np.argsort(right.column("bucket").to_numpy()))).column("data")]
        for blob in left.column("data"):
            names, null, sizes, steps, n = _unpack(blob.as_buffer())
            places, doc = _places(steps, sizes), np.repeat(np.arange(len(names)), sizes)
            lp, c = (np.concatenate([x[i] for x in got])[places] for i in (0, 1))
            total = lambda x: np.bincount(doc, n * x, len(names))  # noqa: B023, E731
            base = np.log10((c + ADD) / (tokens + ADD * (types + 1)))
            known = [total(x).astype(np.int64) for x in (np.ones(len(n)), c > 0)]
            out.append(pa.table([pa.array(names, pa.int64(), mask=null.astype(bool)), *map(pa.array, known), pa.array(total(base)), pa.array(total(lp / 2.0**25))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    return _lean(run)


# ---- scoring --------------------------------------------------------------


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    # an Arrow batch is one piece of text; the kinds of rows of a bucket are written side by side and not sorted first
    held = {"spark.sql.execution.arrow.maxBytesPerBatch": str(_LARGE), "spark.sql.maxConcurrentOutputFileWriters": "8"}
    with shuffles_removed(spark), settings(spark, held):
        return _score_texts(docs, key, text, folds)


def _score_texts(docs, key, text, folds):
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    held = fold(F.col("doc_id"), folds) == 0
    texts, size = (x or 0 for x in rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first())
    top = frequent(rows, texts)
    buckets = -(-(size + texts) // _BUCKET) or 1
    scratch = Scratch(docs.sparkSession, -(-buckets // _FILE))
    packed = rows.select((~held).alias("train"), "doc_id", "text").mapInArrow(_pack_pairs(top, buckets), "bucket long, batch long, data binary")
    tallied = packed.groupBy("bucket").applyInArrow(_tally(top), _TALLIED)
    documents, cells, many, by_u, by_w, often = scratch.keep_apart(tallied, "kind", "document", "cells", "many", "u", "w", "often")
    added = scratch.keep(often.select("place", "data").groupBy("place").applyInArrow(_add_often, "side long, k long, c long, single long, some long"))
    by = lambda side, k, c, some, *more: added.where(F.col("side") == side).select(F.col("k").alias(k), *more, F.col("c").alias(c), "single", F.col("some").alias(some))
    contexts = by_u.groupBy("u").agg(F.sum("c").alias("customers"), F.sum("single").alias("single"), F.sum("some").alias("tables")).unionByName(by(0, "u", "customers", "tables"))
    words = by_w.select("w", "bucket", "c", "single", F.col("some").alias("n0"))  # a word that is not frequent has one bucket
    words = words.unionByName(by(1, "w", "c", "n0", F.lit(-1).cast("long").alias("bucket")))
    contexts, words, seated, d, tokens, types, kept = _settle(contexts, words, many.select("bucket", "place", "u", "w", "c"), scratch, top)
    scratch.drop(many, by_w, often, added)

    told, often = [], []
    for number, table_, k, first, rest in ((0, contexts, "u", "customers", _each("back")), (1, words, "w", "c", _each("p"))):
        numbered = (F.col(k) >= 0) & (F.col(k) < len(top))
        at = np.zeros((SAMPLES + 1, len(top)))
        for r in table_.where(numbered).select(k, F.col(first).cast("double"), *rest).collect():  # FREQUENT rows at most
            at[:, r[0]] = r[1:]
        often.append(at)
        met = table_.where(~numbered)
        met = met if k == "w" else by_u.select("bucket", k).join(met, k)
        told.append(scratch.keep(met.select("bucket", F.lit(number).alias("kind"), F.col(k).alias("key"), F.col(first).cast("double").alias("x0"), *(F.col(x).cast("double").alias(f"x{i + 1}") for i, x in enumerate(rest)))))
    scratch.drop(by_u)
    apart = reduce(lambda a, b: a | b, (F.col(t) != 1 for t in _each("t")))  # cells at one table need no message
    told.append(scratch.keep(seated.where(apart).select("bucket", F.lit(2).alias("kind"), F.col("place").alias("key"), F.col("c").cast("double").alias("x0"), *(F.col(t).cast("double").alias(f"x{i + 1}") for i, t in enumerate(_each("t"))))))
    scratch.drop(*kept)
    told_, answers = told[0].unionByName(told[1]).unionByName(told[2]), []
    for i in range(SLICES):
        own = F.pmod("bucket", F.lit(SLICES)) == i
        both = cells.where(own).select("bucket", "data").groupBy("bucket").cogroup(told_.where(own).groupBy("bucket"))
        answers.append(scratch.keep(both.applyInArrow(_answer(top, *often, d), "batch long, bucket long, data binary")))
    scratch.drop(cells, *told)
    every = reduce(DataFrame.unionByName, answers)
    both = documents.select("batch", "data").groupBy("batch").cogroup(every.groupBy("batch"))
    out = scratch.keep(both.applyInArrow(_add_up(tokens, types), "doc_id long, n_tokens long, n_known long, base_score double, score double"))
    scratch.drop(documents, *answers)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, texts, and perplexity a token of the model and of the base."""
    ppl = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.count("*").alias("texts"), ppl("score").alias("perplexity"), ppl("base_score").alias("base_perplexity"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
