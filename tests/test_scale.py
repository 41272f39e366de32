"""How queries grow: plans without a step whose task, memory or repeated reading grows faster than the input."""

import duckdb
import pytest

from codeloom.operators import knowledge
from codeloom.plans import virtual

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _same(df, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    columns = sorted(df.columns)
    got = con.execute(f"select {', '.join(columns)} from ({virtual.ORACLES[name]})").fetchall()
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, got))


@pytest.mark.parametrize("pairs", (1, 7, 20_000_000))
def test_notes_of_wide_scopes_are_dealt_out(spark, monkeypatch, pairs):
    """Scopes of many pairs are cut into pieces, and no pair is compared with others after the join."""
    monkeypatch.setattr(knowledge, "PAIRS", pairs)
    monkeypatch.setattr(knowledge, "PACK", 2)
    df = virtual.notes_for_scope(spark, SF)
    assert "keys=[path" not in _plan(df).split("Join")[0]
    _same(df, "notes_for_scope")


def test_a_note_of_nested_scopes_is_told_once(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("a/bb/e.py",), ("f.py",)], "path string")
    notes = spark.createDataFrame([(1, "a"), (1, "a/b"), (1, "a/b"), (2, "a/b"), (2, "a/d.py"), (3, None), (4, "f.py")], "note int, scope string")
    got = sorted(map(tuple, knowledge.scoped(files, notes).collect()))
    assert got == [("a/b/c.py", 1), ("a/b/c.py", 2), ("a/bb/e.py", 1), ("a/d.py", 1), ("a/d.py", 2), ("f.py", 4)]


@pytest.mark.parametrize("name", ("graph_nodes", "graph_edges", "graph_kinds", "symbol_naming", "neighbors", "find_symbol", "module_summary", "feature_view", "explain_modules"))
def test_no_calls_are_written_for_the_graph(spark, monkeypatch, name):
    """What is checkpointed is names; the texts' tokens meet the names where they are read."""
    from codeloom import runtime
    from codeloom.operators import graph, modules

    kept, plain = [], runtime.checkpoint

    def seen(df):
        kept.append(df.columns)
        return plain(df)

    for m in (virtual, graph, modules, runtime):
        monkeypatch.setattr(m, "checkpoint", seen)
    df = virtual.QUERIES[name](spark, SF)
    assert kept and not any({"calls", "text"} & set(c) for c in kept)
    if name in ("graph_nodes", "symbol_naming"):
        assert not any("source" in c for c in kept) and len(kept) == 1


def test_briefs_of_odd_texts(spark):
    """Breaks of all kinds, noise before, inside and after; only the paragraph's lines are looked at, and once."""
    from pyspark.sql import functions as F

    from codeloom.functions import text

    texts = [
        "", "\n", "\r\n", "#", "# a\n\nb", "a\r\nb\r\n\r\nc", "a\rb\r\rc", " \t\n\x1f a \x1f\n # no\n b\n \t\nc", "<x>\n\n---\n===\n```\nz", "! a\nb ! c\n[!x]\nd", "[x]\n--\n==\n``\n\x0b\x0cq", "a b  c",
        "a\x85\x85b", "x" * 700, ("w" * 9 + " ") * 60 + "end\n\nmore", "w" * 599 + " \nv", "w" * 600 + "\nv", "\n".join(["line"] * 5_000), "\n" * 5_000 + "late", "#\n" * 5_000 + "late\n", " " * 5_000 + "wide" + " " * 5_000 + "\r\n\n x", "a\n\r\nb", "a\r\n\nb", "a\n \x1f\t\rb",
    ]

    def want(body):
        lines = []
        for raw in body.splitlines():
            line = raw.strip()
            if not line and lines:
                break
            if line and not line.startswith(("#", "!", "<", "[!", "---", "===", "```")):
                lines.append(line)
        whole = " ".join(lines)
        return whole[:600].rstrip() + ("…" if len(whole) > 600 else "") if lines else None

    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, text string").select("i", text.first_paragraph(F.col("text")).alias("b"))
    assert "aggregate(" not in _plan(df)
    got = {r.i: r.b for r in df.collect()}
    assert got.pop(len(texts)) is None
    assert got == {i: want(t) for i, t in enumerate(texts)}


def test_only_latest_commits_files_are_joined(spark):
    """The latest commits are counted and few, so files of other commits go without a sort or a shuffle of all files."""
    df = virtual.churn_last_1000(spark, SF)
    assert "SortMergeJoin" not in _plan(df) and "Window" not in _plan(df).split("BroadcastExchange")[0]
    _same(df, "churn_last_1000")
