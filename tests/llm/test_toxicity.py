import random

from codeloom.llm import toxicity as T
from codeloom.llm.toxicity import INSULT, NEGATION, PLAIN, REPORT, TARGET, THREAT


def brute(classes, weights):
    """The grammar read word by word, without the composed machine."""
    found, target, report, scope = [], False, False, 0
    for c, w in zip(classes, weights):
        if c in (INSULT, THREAT):
            f = (0.25 if scope else 1) * (0.5 if report else 1) * (1.25 if target else 1)
            f *= (1.5 if target else 0.75) if c == THREAT else 1
            found.append(f * w)
        target, report = target or c == TARGET, report or c == REPORT
        scope = T.SCOPE if c == NEGATION else max(scope - 1, 0)
    return (1 - T.OTHERS) * max(found) + T.OTHERS * sum(found) if found else 0.0


def test_composed_machine_is_the_grammar():
    r, machine = random.Random(1), T.grammar()
    for _ in range(2000):
        c = [r.choice((PLAIN, PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT)) for _ in range(r.randint(0, 12))]
        w = [r.random() * 5 for _ in c]
        assert abs(T.clause_score(c, w, machine) - brute(c, w)) < 1e-12
    one = lambda *c: T.clause_score(c, [1.0] * len(c), machine)
    assert one(TARGET, INSULT) > one(INSULT) > one(REPORT, INSULT) > one(NEGATION, PLAIN, INSULT) > one(PLAIN) == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = T.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    found = sum(r.predicted and r.toxic for r in rows) / sum(r.toxic for r in rows)
    assert right > 0.98 and found > 0.9


def test_all_rows_and_odd_texts(spark):
    cols = "doc_id long, text string, score string, y int"
    rows = [(1, None, "a", 1), (2, "", "b", 2), (2, "", "b", 2), (3, "You are an idiot. " * 5, None, None), (None, "you worthless, stupid moron!", "c", 0), (4, "plain " * 50_000, "d", 0)]
    docs = spark.createDataFrame(rows, cols)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = T.fit(docs, labels)
    got = {(r.doc_id, round(r.score, 6)) for r in T.score(docs, model).collect()}
    by = dict(got)
    assert T.score(docs, model).count() == 6 and by[1] == by[2] == by[4] < 0.5 < by[3] and by[None] > 0.5
    assert {r.doc_id for r in T.drop_toxic(docs, model).collect()} == {1, 2, 4}
    assert T.drop_toxic(docs, model).columns == docs.columns
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels)).count() == 0


def test_words_beside_quotes_and_marks_are_found():
    import pyarrow as pa

    entries = [("idiot", False, INSULT, 3.0), ("moro", True, INSULT, 3.0), ("isn't", False, NEGATION, 1.0), ("you're", False, TARGET, 1.0)]
    lexicon, tokenizer = T.Lexicon(entries), T._tokenizer()
    best = lambda *texts: lexicon.features(pa.array(texts), tokenizer)[:, 0].tolist()
    said = ("an 'idiot' here", "'idiot", "idiot'", "‘idiot’", "“idiot”", "«idiot»", "an idiot here", "idiot…", "''moronic''", "…moronic", "¿idiot?")
    assert best(*said) == [3.0] * len(said)
    assert best("you're idiot", "isn't idiot", "isn’t idiot", "idiotés", "x'idiot") == [3.75, 0.75, 0.75, 0.0, 0.0]
