"""Toxicity by a weighted finite-state pattern grammar.

Words of a lexicon get a class: insult, threat, target (who is addressed),
negation, reported speech; all others are plain.  Five small transducers read the
classes of a clause, and their composition is one machine whose states are tuples:

* insult: any insult ends a pattern with its weight;
* threat: a threat ends a pattern, stronger once a target was seen;
* target: a target within the clause strengthens what follows it;
* negation: for SCOPE words after a negation, patterns count little;
* reported speech: after a speech verb in the clause, patterns count for half.

A clause's score is the best path's plus a share of its other patterns.  An insult
alone in its clause is an accepted path of factor 1, a threat alone one of 0.75 (in
the texts this is made for, insults mostly stand without an address); targets,
negations and reports alone are not accepted and count nothing.  A document's
features are its best clause, the log of the sum of its clauses, and the number of
clauses that match; logistic regression turns them into a score.

Insults are learned from labelled rows: words and stems (with at least three
completions) whose documents are labelled toxic far more often than not, supported
by at least MIN_CONTEXTS different neighbourhoods, so that copies of one text count
once.  The sample is bounded by ``FIT_ROWS`` rows, and by ``FIT_CHARS`` characters
of each label in the order of a hash; it is read as a stream by one task, and only the lexicon (``LEXICON`` entries at most) and three numbers a row of
the sample come to the driver.  All documents are scored in one map without shuffle.

Defined results: a null or empty text has no clause and scores the model's floor;
rows are scored each by itself, repeats included; a null doc_id is not held out;
labels that are null, or of unknown documents, are ignored, and without any label
the built-in lexicon scores alone; an empty table gives no rows.  Texts of any
length are scored whole, in pieces of rows, never of texts; equal texts have equal
scores; columns besides the key and the text, whatever their names, are ignored by
``score`` and passed through by ``drop_toxic``.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint, fold, labelled, table
from ._tokens import Tokenizer, pieces, runs

FOLDS, FIT_ROWS, LEXICON = 5, 12_000, 2_000
#: Characters of each label's sampled texts that the learner reads.
FIT_CHARS = 32_000_000
MIN_CONTEXTS, MIN_ODDS, STEM = 5, 2.5, (4, 8)
SCOPE, OTHERS = 3, 0.25
PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEEDS = {
    INSULT: "idiot idiots moron morons loser losers scum worthless pathetic stupid imbecile idiota estúpido estúpida idiote imbécile connard trottel dummkopf abschaum".split(),
    THREAT: "kill killed murder strangle töten umbringen tuer matar".split(),
    TARGET: "you your you're yourself he she they them dich dir euch ihr toi vous eux tú ti usted ustedes ellos".split(),
    NEGATION: "not no never isn't aren't wasn't nicht kein keine nie ne pas jamais nunca jamás".split(),
    REPORT: "said says saying wrote quoted called claimed sagte schrieb disait écrivit dijo escribió".split(),
}
SEED_WEIGHT = 3.0


class Machine:
    """A transducer: step(state, class) -> (state, factor); accepted patterns are scaled by the factor."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, other: "Machine") -> "Machine":
        """Composition: both read the same classes; factors multiply."""

        def step(state, c):
            (a, x), (b, y) = self.step(state[0], c), other.step(state[1], c)
            return (a, b), x * y

        return Machine((self.start, other.start), step)

    def table(self):
        """next state and factor for each (state, class), over the states that can be reached."""
        known, todo, rows = {self.start: 0}, [self.start], []
        while todo:
            row = []
            for c in range(6):
                to, factor = self.step(todo[0], c)
                if to not in known:
                    known[to] = len(known)
                    todo.append(to)
                row.append((known[to], factor))
            rows.append(row)
            todo.pop(0)
        return rows


def grammar() -> list:
    insult = Machine(0, lambda s, c: (0, 1.0 if c in (INSULT, THREAT) else 0.0))
    threat = Machine(0, lambda s, c: (1 if c == TARGET else s, 1.0 if c != THREAT else 1.5 if s else 0.75))
    target = Machine(0, lambda s, c: (1 if c == TARGET else s, 1.25 if s and c in (INSULT, THREAT) else 1.0))
    negation = Machine(0, lambda s, c: (SCOPE if c == NEGATION else max(s - 1, 0), 0.25 if s and c in (INSULT, THREAT) else 1.0))
    report = Machine(0, lambda s, c: (1 if c == REPORT else s, 0.5 if s and c in (INSULT, THREAT) else 1.0))
    return (insult @ threat @ target @ negation @ report).table()


def clause_score(classes, weights, machine) -> float:
    """Best pattern of a clause plus a share of the others; 0 if no pattern is accepted."""
    state, found = 0, []
    for c, w in zip(classes, weights):
        state, factor = machine[state][c]
        if factor:
            found.append(factor * w)
    return (1 - OTHERS) * max(found) + OTHERS * sum(found) if found else 0.0


def _tokenizer() -> Tokenizer:
    t = Tokenizer()
    t.space = t.space.copy()
    for c in b"!\"#$%&()*+,-./0123456789:;<=>?@[\\]^_`{|}~":
        t.space[c] = True
    return t


def _marks(texts):
    """Lower-cased; what is neither ASCII nor a letter becomes a blank, as for the learner."""
    return pc.replace_substring_regex(pc.replace_substring(pc.utf8_lower(texts), "n\u2019t", "n't"), r"[^\p{L}\p{Nl}\p{No}\x00-\x7F]", " ")


def _quotes(data, offs):
    """The bytes with a blank for each apostrophe that is not between two letters of its row."""
    letter = ((data | 32) - 97 < 26) | (data > 127)
    at = np.flatnonzero(data == 39)
    row = np.searchsorted(offs, at, "right")
    inner = (at > offs[row - 1]) & (at + 1 < offs[row])
    inner[inner] = letter[at[inner] - 1] & letter[at[inner] + 1]
    data = data.copy()
    data[at[~inner]] = 32
    return data


_END = np.zeros(256, bool)
_END[list(b".!?;\n")] = True


class Lexicon:
    """Whole words and stems with class and weight, found by hash."""

    def __init__(self, entries):
        """entries: (text, is stem, class, weight)."""
        self.machine, by = grammar(), {}
        for text, stem, c, w in entries:
            by.setdefault(len(text.encode()) if stem else 0, {})[text] = (c, w)
        tokenizer, self.tables = _tokenizer(), []
        for n in sorted(by, reverse=True):  # whole words have the last say
            texts = sorted(by[n])
            _, h, start, _ = tokenizer.words(*next((d, o) for _, d, o in pieces(pa.array([" ".join(texts)]))))
            if len(h) != len(texts):
                raise ValueError("a lexicon entry is not one word")
            order = np.argsort(h)
            filt = np.zeros(1 << 16, bool)
            filt[(h >> np.uint64(48)).astype(np.int64)] = True
            self.tables.append((n, h[order], np.array([by[n][t][0] for t in texts], np.int8)[order], np.array([by[n][t][1] for t in texts])[order], filt))

    def classify(self, tokenizer, h, start, end):
        classes, weights = np.zeros(len(h), np.int8), np.zeros(len(h))
        for n, keys, c, w, filt in self.tables:
            at = np.flatnonzero(end - start >= n) if n else None
            own = tokenizer.spell(start[at], n) if n else h
            hit = np.flatnonzero(filt[(own >> np.uint64(48)).astype(np.int64)])
            to = np.minimum(np.searchsorted(keys, own[hit]), len(keys) - 1)
            same = keys[to] == own[hit]
            hit, to = hit[same], to[same]
            hit = at[hit] if n else hit
            classes[hit], weights[hit] = c[to], w[to]
        return classes, weights

    def features(self, texts, tokenizer):
        """A row of three numbers for each text."""
        out = np.zeros((len(texts), 3))
        for row, data, offs in ((at + i, d, o) for at, part in runs(texts) for i, d, o in pieces(_marks(part))):
            data = _quotes(data, offs)
            counts, h, start, end = tokenizer.words(data, offs)
            if not len(h):
                continue
            classes, weights = self.classify(tokenizer, h, start, end)
            hot = np.flatnonzero((classes == INSULT) | (classes == THREAT))
            if not len(hot):
                continue
            doc = np.repeat(np.arange(len(counts)), counts)
            clause = np.concatenate(([0], np.cumsum(_END[data])))[start]
            cut = np.concatenate(([0], np.flatnonzero((np.diff(clause) > 0) | (np.diff(doc) > 0)) + 1, [len(h)]))
            for c in np.unique(np.searchsorted(cut, hot, "right") - 1).tolist():
                lo, hi = cut[c], cut[c + 1]
                s = clause_score(classes[lo:hi].tolist(), weights[lo:hi].tolist(), self.machine)
                if s > 0:
                    f = out[row + doc[lo]]
                    f[0] = max(f[0], s)
                    f[1] += s
                    f[2] += 1
        return np.column_stack((out[:, 0], np.log1p(out[:, 1]), np.log1p(out[:, 2])))


def _learn(batches):
    """One task over the sample, toxic rows first: the insults found, as (text, stem, weight)."""
    import re

    word = re.compile(r"[^\W\d_]+")
    texts, contexts, completions, docs_pos, docs_neg = [], {}, {}, Counter(), Counter()
    bad, good, candidates, read = 0, 0, None, [0, 0]

    def forms(w):
        return [(w, False), *((w[:n], True) for n in range(STEM[0], min(STEM[1], len(w)) + 1))]

    def choose():
        return {f for f, c in contexts.items() if len(c) >= MIN_CONTEXTS and (not f[1] or len(completions[f]) >= 3)}

    def contexts_of_toxic():
        """Neighbourhoods of forms that come often enough to have MIN_CONTEXTS of them."""
        often = Counter()
        for text in texts:
            often.update(f for x in word.findall(text) for f in forms(x))
        often = {f for f, n in often.items() if n >= MIN_CONTEXTS}
        for text in texts:
            w, seen = word.findall(text), set()
            for i, x in enumerate(w):
                where = hash((w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""))
                for f in forms(x):
                    if f not in often:
                        continue
                    c = contexts.setdefault(f, set())
                    if len(c) < 64:
                        c.add(where)
                    if f[1]:
                        s = completions.setdefault(f, set())
                        if len(s) < 8:
                            s.add(x)
                    seen.add(f)
            docs_pos.update(seen)
        texts.clear()

    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = (text or "").lower()
            read[y] += len(text)
            if read[y] > FIT_CHARS:  # rows come in the order of a hash
                continue
            if y:
                bad += 1
                texts.append(text)
            else:
                if candidates is None:
                    contexts_of_toxic()
                    candidates = choose()
                good += 1
                docs_neg.update({f for x in set(word.findall(text)) for f in forms(x) if f in candidates})
    found = []
    for f in choose() if bad and good else ():
        a, b = docs_pos[f], docs_neg[f]
        odds = math.log((a + 0.5) / (bad + 1)) - math.log((b + 0.5) / (good + 1))
        pure = b <= 0.005 * a if f[1] else b <= 0.2 * a
        if odds >= MIN_ODDS and pure and len(contexts[f]) >= 0.3 * min(a, 64):
            found.append((odds, f))
    stems, out = set(), []
    for odds, (text, stem) in sorted(found, key=lambda x: (not x[1][1], len(x[1][0]), x[1][0])):
        if not any(text[:n] in stems for n in range(STEM[0], len(text) + (not stem))):
            if stem:
                stems.add(text)
            out.append((text, stem, min(odds, 6.0)))
    out.sort(key=lambda x: (-x[2], x[0], x[1]))
    out = out[:LEXICON]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.float64())], names=["text", "stem", "weight"])


def _features(lexicon):
    def run(batches):
        tokenizer, own = _tokenizer(), lexicon.value
        for batch in batches:
            f = own.features(batch.column(1), tokenizer)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[:, i]) for i in range(3))], names=["y", "a", "b", "c"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights, intercept first, by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - pull * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, texts, tokenizer) -> np.ndarray:
        z = self.weights[0] + self.lexicon.features(texts, tokenizer) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from a bounded sample of the labelled rows outside fold 0."""
    spark = docs.sparkSession
    sample = checkpoint(labelled(labels, label, folds=FOLDS, most=FIT_ROWS))  # FIT_ROWS pairs of numbers at most
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")
    learned = rows.repartition(1).sortWithinPartitions(F.col("y").desc(), F.xxhash64("id"), "id").select("y", "text").mapInArrow(_learn, "text string, stem boolean, weight double").collect()
    entries = {(w, False): (c, SEED_WEIGHT) for c, words in SEEDS.items() for w in words}
    entries |= {(r.text, r.stem): (INSULT, r.weight) for r in learned}
    lexicon = Lexicon([(t, stem, c, w) for (t, stem), (c, w) in entries.items()])
    own = spark.sparkContext.broadcast(lexicon)
    seen = np.array(rows.select("y", "text").mapInArrow(_features(own), "y int, a double, b double, c double").collect(), float).reshape(-1, 4)
    if len({*seen[:, 0]}) < 2:
        return Model(lexicon, np.array([-2.5, 1.0, 0.5, 0.0]))
    seen = seen[np.lexsort(seen.T)]  # the same sums in every run
    w = logistic(seen[:, 1:], seen[:, 0])
    if not (w[1:] >= 0).all():  # more or worse matches never make a text milder
        w = np.concatenate((logistic(seen[:, 1:2], seen[:, 0]), [0, 0]))
    return Model(lexicon, w)


def _score(model):
    def run(batches):
        tokenizer, own = _tokenizer(), model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(batch.column(1), tokenizer))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    own = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(_score(own), "doc_id long, score double")


def _mild(model, text, least):
    def run(batches):
        tokenizer, own = _tokenizer(), model.value
        for batch in batches:
            t = batch.column(text)
            yield batch.filter(pa.array(own.score(t.fill_null("") if t.null_count else t, tokenizer) < least))

    return run


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``least``."""
    own = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_mild(own, docs.columns.index(text), least), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
