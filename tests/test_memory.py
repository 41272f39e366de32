"""Knowledge, context pack, update, artifacts, command line, server and eval over small source trees."""

import io
import json
import subprocess

import pytest

from codeloom import artifacts, cli, context, evaluate, server
from codeloom.operators import knowledge
from codeloom.tools import Memory, Tools


def put(root, path, content):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(content)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    evaluate.reference_repository(root)
    put(root, "README.md", "![badge](x)\n\n# The Shop\n\nSells things\nto people.\n\n## Install\ntext\n### More #\n")
    put(root, "CONTRIBUTING.md", "  \n")
    put(root, "ARCHITECTURE.md", "No heading here, prose only.\n")
    put(root, "docs/adr/0001-use-x.md", "# ADR-0001: Use X\nDate: 2024-01-02\n\n## Status\n\nAccepted\nand more\n\n## Context\nWe need x.\n\n## Decision\nUse it.\n## Consequences\nNone.\n")
    put(root, "docs/adr/README.md", "# 1. no record\n")
    put(root, "adr/0001-use-x.md", "# 2. a later copy of the id\n")
    put(root, "adr/0003-bare.md", "nothing\n")
    put(root, "pkg/tool.go", "package main\n")
    return root


@pytest.fixture(scope="module")
def tools(spark, root):
    return Tools(Memory(spark, {"shop": root}))


def test_knowledge(tools):
    got = tools.get_knowledge()
    first, second = got["decisions"]
    assert first == {"id": "0001-use-x", "title": "Use X", "status": "Accepted", "date": "2024-01-02", "context": "We need x.", "rationale": "Use it.", "source": "adr:docs/adr/0001-use-x.md"}
    assert (second["id"], second["title"], second["status"]) == ("0003-bare", "0003-bare", None)
    assert [(d["source"], d["title"], d["summary"], d["headings"]) for d in got["docs"]] == [
        ("README.md", "The Shop", "Sells things to people.", ["Install", "More"]), ("ARCHITECTURE.md", "ARCHITECTURE", "No heading here, prose only.", []),
    ]
    assert {p["kind"] for p in got["patterns"]} >= {"architecture", "convention"} and got["history"]["is_git"] is False
    made = [tools.record_decision("Use Y!", rationale="why")["id"] for _ in range(2)]
    assert made == ["use-y", "use-y-2"] and [d["title"] for d in tools.get_knowledge()["decisions"]][-2:] == ["Use Y!"] * 2
    assert tools.record_note("Mind the gap", "src/shop")["note"]["id"] == "mind-the-gap" and tools.notes_for("src/shop/models.py")[0]["text"] == "Mind the gap"


def test_context_pack_is_small(tools):
    got = tools.get_context()
    assert (got["language"], got["framework"], got["top_dependencies"], got["key_files"][0]) == ("Python", "FastAPI", ["fastapi"], "src/shop/models.py")
    text = context.markdown(got)
    assert text.startswith("# shop\n\nLanguage: Python · Framework: FastAPI") and "## Key files\nsrc/shop/models.py" in text and "## About\nSells things to people. (from README.md, ARCHITECTURE.md)" in text
    assert context.tokens("12345") == 2 and tools.benchmark()["pack_tokens"] == context.tokens(context.markdown(tools.get_context()))


def test_warnings_and_staleness(spark, tools):
    health = tools.get_health()
    assert health["warnings"] == ["Inventory only (no dependency graph) for: Go. Impact/consumer results do not account for these files."]
    assert [(x["language"], x["graphed"]) for x in health["languages"]] == [("Python", True), ("Go", False)]
    cols = "repo_id string, source_files long, connectivity double, import_edges long"
    rows = spark.createDataFrame([("a", 6, 0.0, 0), ("b", 6, 0.333, 1), ("c", 4, 0.0, 0), ("d", 9, 0.5, 3)], cols)
    none = spark.createDataFrame([], "repo_id string, language string, files long, graphed boolean")
    told = {r.repo_id: r.warnings for r in knowledge.warnings(rows, none).collect()}
    assert "no import edges at all import edge across 6 graphed" in told["a"][0] and "only 33% have any" in told["b"][0] and told["c"] == told["d"] == []
    say = knowledge.staleness
    assert say(None, None, None)["message"] is None and "no build-commit" in say(None, "b" * 40, None)["message"]
    assert say("a" * 40, "b" * 40, None)["stale"] and not say("a" * 40, "a" * 40, None)["stale"] and not say("a" * 40, "b" * 40, 0)["stale"]
    assert say("a" * 40, "b" * 40, 2) | {"message": ""} == {"is_git": True, "stale": True, "built_at_commit": "a" * 40, "current_commit": "b" * 40, "changed_files": 2, "message": ""}


def rows(df):
    return sorted(map(str, df.collect()))


def test_update_equals_a_full_build(spark, tmp_path):
    root, folder = evaluate.reference_repository(tmp_path / "shop"), str(tmp_path / "memory")
    assert Memory.load(spark, folder) is None
    Memory.ensure(spark, folder, {"shop": root})
    put(root, "src/shop/models.py", "class User:\n    name = 1\n\nclass Order(User):\n    pass\n")
    put(root, "src/shop/new.py", "from shop.models import Order\n\ndef fresh():\n    return Order()\n")
    (root / "src/shop/service.py").unlink()
    old = Memory.load(spark, folder)
    now, changed = old.updated()
    assert {(r.path, r.status) for r in changed.where("status <> 'unchanged'").collect()} == {("src/shop/models.py", "modified"), ("src/shop/new.py", "added"), ("src/shop/service.py", "deleted")}
    full = Memory(spark, {"shop": root})
    for name in ("files", "ir", "imports", "nodes", "edges", "summary", "coverage"):
        assert rows(getattr(now, name)) == rows(getattr(full, name)), name
    now.write(folder)
    assert rows(Memory.load(spark, folder).edges) == rows(full.edges)


def test_artifacts_server_and_onboarding(tools):
    paths = artifacts.write(tools)
    assert [p.name for p in paths] == [f"{n}.json" for n in artifacts.FILES]
    graph = artifacts.read(tools.root, "graph")
    assert len(graph["nodes"]) == tools.m.nodes.count() and artifacts.read(tools.root, "nothing") is None
    out = io.StringIO()
    calls = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "find_symbol", "arguments": {"name": "make_service"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "find_symbol", "arguments": {"wrong": 1}}}, {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "rm"}},
    ]
    server.serve(tools, [*map(json.dumps, calls), "no json"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in got] == [1, 2, 3, 4, 5, None] and len(got[1]["result"]["tools"]) == 16
    assert json.loads(got[2]["result"]["content"][0]["text"])["definitions"][0]["path"] == "src/shop/service.py"
    assert got[3]["result"]["isError"] and "error" in got[4] and "error" in got[5]
    assert next(t for t in got[1]["result"]["tools"] if t["name"] == "record_note")["inputSchema"]["required"] == ["text"]
    (tools.root and open(f"{tools.root}/.mcp.json", "w")).write('{"mcpServers": {"other": {}}}')
    assert artifacts.onboard(tools) == {"brief": f"{tools.root}/.codeloom/BRIEF.md", "server_added": True, "hook": "not-git"}
    assert set(json.load(open(f"{tools.root}/.mcp.json"))["mcpServers"]) == {"other", "codeloom"} and not artifacts.add_server(tools.root)


def test_hook_leaves_foreign_hooks_alone(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert artifacts.add_hook(tmp_path) == artifacts.add_hook(tmp_path) == "installed"
    (tmp_path / ".git/hooks/pre-commit").write_text("#!/bin/sh\n")
    assert artifacts.add_hook(tmp_path) == "exists-foreign"


def test_eval_and_command_line(spark, tmp_path, capsys):
    root = str(evaluate.reference_repository(tmp_path / "shop"))
    assert cli.main(["eval", root, "--json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert (got["accuracy"], got["passed"]) == (1.0, 8)
    assert cli.main(["impact", "models.py", "-p", root]) == 0 and "affected_file_count: 3" in capsys.readouterr().out
    assert cli.main(["explain", "nowhere", "-p", root, "--json"]) == 1 and "available" in capsys.readouterr().out
    put(tmp_path / "shop", "src/shop/more.py", "x = 1\n")
    assert cli.main(["update", root, "--json"]) == 0 and json.loads(capsys.readouterr().out)["added"] == ["src/shop/more.py"]
    assert cli.main(["decide", "Use Z", "--why", "because", "-p", root]) == 0 and "use-z" in capsys.readouterr().out
    assert cli.main(["context", root]) == 0 and "## Decisions\nUse Z" in capsys.readouterr().out
    assert set(cli.COMMANDS) == set("init analyze scan graph build update explain impact knowledge decide context benchmark eval serve".split())
    broken = evaluate.Case("broken", "?", lambda t: 1 / 0, bool)
    assert evaluate.grade(None, broken)["detail"].startswith("error")


def test_odd_manifests(spark, tmp_path):
    for i, text in enumerate(('project = "x"\n', "[project]\ndependencies = 3\nscripts = []\n", "[tool]\npoetry = 1\n", "[build-system]\nrequires = [1]\n", "broken = [\n")):
        put(tmp_path, f"r{i}/pyproject.toml", text)
    put(tmp_path, "r9/pyproject.toml", '[project]\ndependencies = ["a>=1", 2]\n[tool.poetry.dependencies]\npython = "3"\nb = {version = "1"}\n')
    m = Memory(spark, {d.name: d for d in tmp_path.iterdir()})
    assert sorted((r.repo_id, r.name, r.version) for r in m.dependencies.collect()) == [("r9", "a", ">=1"), ("r9", "b", None)]
