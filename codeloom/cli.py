"""The command line: ``python -m codeloom COMMAND``.  Every command prints JSON, or a few lines of text without ``--json``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import artifacts, context, dims, evaluate, server
from .operators import changes
from .tools import Memory, Tools

#: Rows that text output shows of lists.
SHOWN = {"dependencies": 15, "modules": 15, "critical_files": 10}


def session() -> SparkSession:
    """The running session, or one on this machine."""
    got = SparkSession.getActiveSession()
    if got is None:
        got = SparkSession.builder.master("local[*]").appName("codeloom").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
        got.sparkContext.setLogLevel("ERROR")
    return got


def _tables(root) -> str:
    return f"file://{artifacts.folder(root)}/tables"


def opened(path) -> Tools:
    """The tools over a repository's written memory, built and written first if there is none."""
    spark = session()
    root = Memory(spark, path).roots
    return Tools(Memory.ensure(spark, _tables(next(iter(root.values()))), root))


def _build(path) -> Tools:
    m = Memory(session(), path)
    tools = Tools(m)
    m.write(_tables(tools.root))
    artifacts.write(tools)
    return tools


def _update(path) -> dict:
    spark = session()
    root = next(iter(Memory(spark, path).roots.values()))
    old = Memory.load(spark, _tables(root))
    if old is None:
        _build(path)
        return {"full_rebuild": True}
    now, changed = old.updated()
    now.write(_tables(root))
    artifacts.write(Tools(now))
    counts = changes.change_counts(changed).collect()
    paths = {s: [r.path for r in changed.where(f"status = '{s}'").orderBy("path").collect()] for s in ("added", "modified", "deleted")}
    return {"full_rebuild": False, "unchanged": counts[0]["unchanged"] if counts else 0, **paths}


def _graph(a) -> dict:
    t = opened(a.path)
    if not a.no_save:
        artifacts.write(t, ("graph",))
    if a.json:
        return artifacts.documents(t)["graph"]
    by = lambda df: {r["kind"]: r["count"] for r in df.groupBy("kind").count().orderBy("kind").collect()}
    return {"nodes": by(t.m.nodes), "edges": by(t.m.edges)}


def _scan(a) -> dict:
    t = opened(a.path)
    if not a.no_save:
        artifacts.write(t, ("repository",))
    return artifacts.documents(t)["repository"] if a.json else {k: v for k, v in t.get_project_summary().items() if k != "conventions"}


def _eval(a) -> dict:
    got = evaluate.run(opened(evaluate.reference_repository(a.path) if a.make else a.path))
    return {"accuracy": got.accuracy, "passed": got.passed, "total": len(got.results), "context_tokens": got.context_tokens, "raw_tokens": got.raw_tokens, "token_reduction": got.token_reduction, "results": got.results}


def _init(a) -> dict:
    t = _build(a.path)
    return artifacts.onboard(t, not a.no_hook, not a.no_mcp)


def _context(a):
    got = opened(a.path).get_context()
    return got if a.json else context.markdown(got)


def _decide(a) -> dict:
    return opened(a.path).record_decision(a.title, a.status, a.why)


#: name: (what it does, arguments, function of the arguments)
COMMANDS = {
    "init": ("build memory, write the brief, add the server and the hook", ("path", "--no-hook", "--no-mcp"), _init),
    "analyze": ("the fingerprint", ("path",), lambda a: opened(a.path).get_fingerprint()),
    "scan": ("the inventory", ("path", "--no-save"), _scan),
    "graph": ("nodes and edges", ("path", "--no-save"), _graph),
    "build": ("build and write the memory", ("path",), lambda a: {"built": _build(a.path).root}),
    "update": ("bring the memory up to date", ("path",), lambda a: _update(a.path)),
    "explain": ("explain a module", ("target", "-p"), lambda a: opened(a.path).explain_module(a.target)),
    "impact": ("what a change of a file reaches", ("target", "-p"), lambda a: opened(a.path).analyze_impact(a.target)),
    "knowledge": ("decisions, patterns, history, documents", ("path",), lambda a: opened(a.path).get_knowledge()),
    "decide": ("record a decision", ("title", "--why", "--status", "-p"), _decide),
    "context": ("the context pack", ("path",), _context),
    "benchmark": ("tokens of sources and pack", ("paths",), lambda a: [opened(p).benchmark() for p in a.paths or ["."]]),
    "eval": ("grade the answers about the reference project", ("path", "--make"), _eval),
    "serve": ("answer tool calls on standard input", ("path",), lambda a: server.serve(opened(a.path))),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("codeloom", description="Build and ask a memory of a code base.")
    subs = out.add_subparsers(dest="command", required=True)
    for name, (told, arguments, _) in COMMANDS.items():
        p = subs.add_parser(name, help=told)
        p.add_argument("--json", action="store_true")
        for a in arguments:
            if a == "-p":
                p.add_argument("--path", "-p", default=".")
            elif a in ("path", "paths"):
                p.add_argument(a, nargs="?" if a == "path" else "*", default="." if a == "path" else None)
            elif a in ("--why", "--status"):
                p.add_argument(a, a[1:3], default="accepted" if a == "--status" else None)
            else:
                p.add_argument(a, action="store_true") if a.startswith("--") else p.add_argument(a)
    return out


def lines(told, indent: str = "") -> list[str]:
    """A dictionary as text, long lists cut at SHOWN."""
    out = []
    for k, v in told.items():
        if isinstance(v, dict):
            out += [f"{indent}{k}:", *lines(v, indent + "  ")]
        elif isinstance(v, list):
            most = SHOWN.get(k, dims.REFERENCE_LIMIT)
            out.append(f"{indent}{k}: " + (", ".join(str(next(iter(x.values())) if isinstance(x, dict) and x else x) for x in v[:most]) or "-") + (f", and {len(v) - most} more" if len(v) > most else ""))
        elif v is not None:
            out.append(f"{indent}{k}: {v}")
    return out


def main(argv=None) -> int:
    a = parser().parse_args(argv)
    told = COMMANDS[a.command][2](a)
    if isinstance(told, str):
        print(told, end="")
    elif told is not None:
        print(json.dumps(told, indent=2, default=str) if a.json else "\n".join(x for one in (told if isinstance(told, list) else [told]) for x in lines(one)))
    return 1 if isinstance(told, dict) and "error" in told or a.command == "eval" and told["accuracy"] < 1 else 0
