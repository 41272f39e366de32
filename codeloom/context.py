"""The context pack: a repository's essence in some hundred tokens, as a dictionary and as Markdown."""

from __future__ import annotations

from . import dims


def tokens(text: str) -> int:
    return -(-len(text) // dims.CHARS_PER_TOKEN)


def pack(summary: dict, architecture: dict, conventions: dict, knowledge: dict, dependencies: list[str], health: dict) -> dict:
    """Everything comes from answers about the repository; nothing is computed anew."""
    facts, history, docs = summary["fingerprint"], knowledge["history"], knowledge["docs"]
    line = None
    if history.get("is_git"):
        line = dims.HISTORY_LINE.format(history["total_commits"], history["contributor_count"], history["first_commit_date"] or "?", history["last_commit_date"] or "?")
    return {
        "name": summary["name"],
        **{k: facts.get(k) for k in ("language", "framework", "architecture", "package_manager")},
        **{k: summary.get(k, 0) for k in ("file_count", "module_count", "total_loc", "dependency_count")},
        "entry_points": summary.get("entry_points", [])[: dims.ENTRY_LIMIT],
        "key_files": architecture["key_files"][: dims.KEY_FILE_LIMIT],
        "layers": [f"{x['name']} ({x['file_count']} files)" for x in architecture["layers"]],
        "class_naming": conventions.get("classes"),
        "function_naming": conventions.get("functions"),
        "dependency_injection": conventions.get("dependency_injection"),
        "patterns": [p["name"] for p in knowledge["patterns"]],
        "testing": (conventions.get("testing") or {}).get("framework"),
        "top_dependencies": dependencies,
        "decisions": [d["title"] for d in knowledge["decisions"]][: dims.DECISION_LIMIT],
        "history": line,
        "confidence": health.get("confidence"),
        "warnings": list(health.get("warnings", [])) + [m for m in [health.get("staleness", {}).get("message")] if m],
        "stale": bool(health.get("staleness", {}).get("stale")),
        "summary": docs[0]["summary"] if docs else None,
        "doc_sources": [d["source"] for d in docs],
        "provenance": facts.get("evidence", {}),
    }


def markdown(p: dict) -> str:
    """The pack as an agent reads it: a title, one line of identity, one of counts, then sections that have something."""
    pairs = lambda *names: " · ".join(f"{label}: {p[key]}" for label, key in names if p[key])
    counts = f"{p['file_count']} files · {p['module_count']} modules · {p['total_loc']} LOC · {p['dependency_count']} deps"
    top = [pairs(("Language", "language"), ("Framework", "framework"), ("Architecture", "architecture"), ("Package manager", "package_manager")), counts]
    top += [f"Graph confidence: {p['confidence']}" if p["confidence"] else "", *(f"⚠️ {w}" for w in p["warnings"])]
    about = (p["summary"] or "") + (f" (from {', '.join(p['doc_sources'])})" if p["summary"] and p["doc_sources"] else "")
    sections = {
        "About": about,
        "Conventions": pairs(("Classes", "class_naming"), ("Functions", "function_naming"), ("DI", "dependency_injection"), ("Testing", "testing")),
        **{title: ", ".join(p[key]) for title, key in (("Patterns", "patterns"), ("Layers", "layers"), ("Key files", "key_files"), ("Top dependencies", "top_dependencies"), ("Entry points", "entry_points"), ("Decisions", "decisions"))},
        "History": p["history"] or "",
        "Sources": "\n".join(f"- {fact}: {said}" for fact, said in p["provenance"].items()),
    }
    blocks = [f"# {p['name']}", "\n".join(x for x in top if x), *(f"## {title}\n{body}" for title, body in sections.items() if body)]
    return "\n\n".join(blocks) + "\n"
