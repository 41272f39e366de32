"""Answers as JSON files in a repository's memory folder, and the files that bring a repository's users on board.

The tables of a corpus stay Parquet (``Memory.write``); these files hold one repository's
answers, whose lists are as long as the repository has files, modules or nodes.
"""

from __future__ import annotations

import json
import os
import stat
from pathlib import Path

from . import context, dims
from .tools import Tools, _rows

#: Names of the files.
FILES = ("repository", "graph", "repo", "architecture", "modules", "conventions", "knowledge", "cache")
SERVER = "codeloom"
MARK = "# codeloom: refresh memory"
HOOK = f"#!/bin/sh\n{MARK}\ncommand -v codeloom >/dev/null 2>&1 && codeloom update . >/dev/null 2>&1\nexit 0\n"
IGNORE = "*\n!.gitignore\n!BRIEF.md\n"


def folder(root) -> Path:
    return Path(root) / dims.MEMORY_DIR


def _put(path: Path, text: str) -> Path:
    """Replaced at once, so that a reader never meets half a file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)
    return path


def documents(tools: Tools) -> dict[str, dict]:
    """The content of each JSON file."""
    m = tools.m
    nodes, edges = (_rows(x) for x in (m.nodes.orderBy("id"), m.edges.orderBy("source", "kind", "target")))
    files = _rows(m.files.orderBy("path"))
    return {
        "repository": {"files": files, "dependencies": tools.get_dependencies()["dependencies"], "fingerprint": tools.get_fingerprint()},
        "graph": {"nodes": nodes, "edges": edges},
        "repo": tools.get_project_summary() | {"coverage": tools.get_health(), "built_at_commit": m.stamp().get(m.repo)},
        "architecture": tools.get_architecture(),
        "modules": tools.get_module_info(),
        "conventions": tools.get_conventions(),
        "knowledge": tools.get_knowledge(),
        "cache": {"files": {f["path"]: {k: f[k] for k in ("size", "mtime", "loc")} for f in files if f["language"]}},
    }


def write(tools: Tools, only=FILES) -> list[Path]:
    told = documents(tools)
    return [_put(folder(tools.root) / f"{n}.json", json.dumps(told[n], indent=2, default=str) + "\n") for n in only]


def read(root, name: str) -> dict | None:
    """A written answer; None if it is absent or broken."""
    try:
        return json.loads((folder(root) / f"{name}.json").read_text("utf-8"))
    except (OSError, ValueError):
        return None


# ---- onboarding ------------------------------------------------------------------


def write_brief(tools: Tools) -> Path:
    return _put(folder(tools.root) / "BRIEF.md", context.markdown(tools.get_context()))


def write_ignore(root) -> Path:
    return _put(folder(root) / ".gitignore", IGNORE)


def add_server(root) -> bool:
    """An entry in .mcp.json beside whatever else is there; False if there is one already."""
    path = Path(root) / ".mcp.json"
    try:
        data = json.loads(path.read_text("utf-8"))
    except (OSError, ValueError):
        data = {}
    data = data if isinstance(data, dict) else {}
    servers = data.setdefault("mcpServers", {})
    if SERVER in servers:
        return False
    servers[SERVER] = {"command": SERVER, "args": ["serve", str(root)]}
    _put(path, json.dumps(data, indent=2) + "\n")
    return True


def add_hook(root) -> str:
    """installed, exists-foreign (a hook of others is never replaced) or not-git."""
    git = Path(root) / ".git"
    if not git.is_dir():
        return "not-git"
    hook = git / "hooks" / "pre-commit"
    if hook.exists() and MARK not in hook.read_text("utf-8", "ignore"):
        return "exists-foreign"
    _put(hook, HOOK)
    hook.chmod(hook.stat().st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)
    return "installed"


def onboard(tools: Tools, hook: bool = True, server: bool = True) -> dict:
    brief = write_brief(tools)
    write_ignore(tools.root)
    return {"brief": str(brief), "server_added": add_server(tools.root) if server else None, "hook": add_hook(tools.root) if hook else None}
