import random

from codeloom.llm.linededup import dedup_lines

COLS = "doc_id long, text string, _id string, _drop int, h string, lines string, d int"
BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=10, min_docs=2):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANKS))
    last, where = 1 << 63, {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                where.setdefault(key(x), set()).add(last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < min_docs or min(where[key(x)]) == (last if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def result(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "keep me", 7, "h", "l", 3) for i, t in rows], COLS)
    out = dedup_lines(docs, **more)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = out.collect()
    assert {(r._id, r._drop, r.h, r.lines, r.d) for r in got} <= {("keep me", 7, "h", "l", 3)}
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got], key=str)


def test_against_brute_force(spark):
    r = random.Random(4)
    pool = [f"a line that is shared {i}" for i in range(30)] + ["short", "", "  ", "ÄÖ A LINE in Capitals", " no break blank"]
    rows = []
    for i in range(120):
        lines = [r.choice(pool) if r.random() < 0.5 else f"own line number {i} {j}" for j in range(r.randint(0, 9))]
        rows.append((i if i % 11 else None, "\n".join(x.upper() + "\t\r" if r.random() < 0.3 and x.isascii() else x for x in lines)))
    rows += [(200, None), (201, ""), (3, rows[3][1]), (3, "another text of one id\na line that is shared 1"), (202, "\n".join(["the same long line"] * 30_000)), (203, "the same long line\n")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, min_docs=3) == brute(rows, min_docs=3)


def test_empty_table(spark):
    assert result(spark, []) == []
