"""Grades answers about a repository whose truth is known, and counts tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from .tools import Tools


@dataclass(frozen=True)
class Case:
    """A question; ``ask`` gets the tools and returns what was answered, ``good`` says whether that is right."""

    name: str
    question: str
    ask: Callable[[Tools], object]
    good: Callable[[object], bool]


@dataclass
class Report:
    results: list[dict] = field(default_factory=list)
    context_tokens: int = 0
    raw_tokens: int = 0

    @property
    def passed(self) -> int:
        return sum(r["passed"] for r in self.results)

    @property
    def accuracy(self) -> float:
        return round(self.passed / len(self.results), 3) if self.results else 0.0

    @property
    def token_reduction(self) -> float:
        return round(self.raw_tokens / self.context_tokens, 1) if self.context_tokens else 0.0


#: A small project with known answers, and the questions about it.
SHOP = {
    "pyproject.toml": '[project]\nname = "shop"\ndependencies = ["fastapi>=0.110"]\n',
    "src/shop/__init__.py": "",
    "src/shop/models.py": "class User:\n    pass\n",
    "src/shop/repository.py": "from shop.models import User\n\n\nclass UserRepository:\n    def get(self) -> User:\n        return User()\n",
    "src/shop/service.py": "from shop.repository import UserRepository\n\n\ndef make_service() -> UserRepository:\n    return UserRepository()\n",
    "tests/test_models.py": "from shop.models import User\n\n\ndef test_user():\n    assert User\n",
}


def reference_repository(root) -> Path:
    for path, content in SHOP.items():
        at = Path(root) / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content, encoding="utf-8")
    return Path(root)


def _first(rows: list[dict], key: str):
    return rows[0][key] if rows else None


CASES = (
    Case("language", "What language is this repo?", lambda t: t.get_fingerprint().get("language"), "Python".__eq__),
    Case("framework", "What framework does it use?", lambda t: t.get_fingerprint().get("framework"), "FastAPI".__eq__),
    Case("dependency", "Does it depend on fastapi?", lambda t: [d["name"] for d in t.get_dependencies()["dependencies"]], lambda x: "fastapi" in x),
    Case("critical_file", "What is the most depended-on file?", lambda t: _first(t.get_critical_files()["critical_files"], "path"), "src/shop/models.py".__eq__),
    Case("find_symbol", "Where is make_service defined?", lambda t: _first(t.find_symbol("make_service")["definitions"], "path"), "src/shop/service.py".__eq__),
    Case("what_tests", "Which tests cover models.py?", lambda t: [x["path"] for x in t.what_tests("models.py")["tests"]], lambda x: "tests/test_models.py" in x),
    Case("impact", "Is changing models.py isolated?", lambda t: t.analyze_impact("models.py").get("affected_file_count", 0), lambda x: x > 0),
    Case("trust", "Is the graph trustworthy (imports resolved)?", lambda t: t.get_health()["confidence"], lambda x: x in ("high", "medium")),
)


def grade(tools: Tools, case: Case) -> dict:
    """An answer that fails to come is a wrong one."""
    try:
        got = case.ask(tools)
        passed, detail = bool(case.good(got)), repr(got)
    except Exception as e:
        passed, detail = False, f"error: {e}"
    return {"name": case.name, "question": case.question, "passed": passed, "detail": detail}


def run(tools: Tools, cases=CASES) -> Report:
    sizes = tools.benchmark()
    return Report([grade(tools, c) for c in cases], sizes["pack_tokens"], sizes["raw_tokens"])
