"""The tool server: JSON-RPC messages, one a line, over standard input and output."""

from __future__ import annotations

import inspect
import json
import sys

from . import __doc__ as about
from .tools import Tools

#: Tools by name and what they tell.
TOOLS = {
    "get_context": "The compact context pack: a whole repository in one call.",
    "get_project_summary": "Identity: fingerprint, counts, entry points, conventions.",
    "get_architecture": "Style, layers and the most imported files.",
    "get_knowledge": "Decisions, patterns, history, documents and notes.",
    "get_conventions": "Naming, layout, layering, patterns and testing.",
    "get_module_info": "One module's numbers, or all modules.",
    "get_feature": "A feature that spans several directories, as a whole.",
    "get_dependencies": "Declared dependencies with versions.",
    "get_health": "How much of the graph is resolved, with warnings and staleness.",
    "get_critical_files": "The most imported files.",
    "get_hotspots": "Churn times in-degree.",
    "explain_module": "Purpose, dependencies, consumers, blast radius and risk of a module.",
    "record_note": "Write a discovery back into memory.",
    "find_symbol": "Where a class, function or method is defined, and who refers to it.",
    "what_tests": "The tests that cover a source file.",
    "analyze_impact": "Files and modules that a change of one file reaches.",
}
_KINDS = {"int": "integer", "str": "string"}


def described(name: str) -> dict:
    """A tool's description with the schema of its arguments, read from its signature."""
    own = [p for p in inspect.signature(getattr(Tools, name)).parameters.values() if p.name != "self"]
    kinds = {p.name: {"type": _KINDS.get(str(p.annotation).split(" ")[0], "string")} for p in own}
    return {"name": name, "description": TOOLS[name], "inputSchema": {"type": "object", "properties": kinds, "required": [p.name for p in own if p.default is p.empty]}}


def answer(tools: Tools, message: dict) -> dict | None:
    """The reply to one message; None for notifications."""
    method, params, reply = message.get("method"), message.get("params") or {}, {"jsonrpc": "2.0", "id": message.get("id")}
    if "id" not in message:
        return None
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "codeloom", "version": "1"}, "instructions": (about or "").strip()}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [described(n) for n in TOOLS]}}
    if method == "tools/call":
        name = params.get("name")
        if name not in TOOLS:
            return reply | {"error": {"code": -32602, "message": f"unknown tool {name}"}}
        try:
            got, failed = getattr(tools, name)(**(params.get("arguments") or {})), False
        except Exception as e:  # the agent is told, the server goes on
            got, failed = {"error": f"{type(e).__name__}: {e}"}, True
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(got, default=str)}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(tools: Tools, lines=None, out=None) -> None:
    out = out or sys.stdout
    for line in lines or sys.stdin:
        if not line.strip():
            continue
        try:
            got = answer(tools, json.loads(line))
        except ValueError:
            got = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if got is not None:
            print(json.dumps(got), file=out, flush=True)
