"""Known answers about small source trees."""

import subprocess

import pytest

from codeloom.plugins import GO, Registry, builtin
from codeloom.sources import parsers
from codeloom.tools import Memory, Tools

SHOP = {
    "pyproject.toml": '[project]\nname = "shop"\ndependencies = ["fastapi>=0.110"]\n',
    "src/shop/__init__.py": "",
    "src/shop/models.py": "class User:\n    pass\n",
    "src/shop/repository.py": "from shop.models import User\n\n\nclass UserRepository:\n    def get(self) -> User:\n        return User()\n",
    "src/shop/service.py": "from shop.repository import UserRepository\n\n\ndef make_service() -> UserRepository:\n    return UserRepository()\n",
    "tests/test_models.py": "from shop.models import User\n\n\ndef test_user():\n    assert User\n",
    ".env": "SECRET=1\n",
    "node_modules/x.py": "import os\n",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for path, content in SHOP.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return Tools(Memory(spark, {"shop": root}))


def test_graph_of_the_shop(shop):
    kinds = {r["kind"]: r["count"] for r in shop.m.nodes.groupBy("kind").count().collect()}
    assert kinds == {"module": 2, "file": 5, "class": 2, "function": 3}
    assert {(r.path, r.target) for r in shop.m.imports.collect()} == {
        ("src/shop/repository.py", "src/shop/models.py"), ("src/shop/service.py", "src/shop/repository.py"), ("tests/test_models.py", "src/shop/models.py"),
    }
    assert {r["kind"]: r["count"] for r in shop.m.edges.groupBy("kind").count().collect()} == {"contains": 10, "imports": 3}
    assert shop.m.files.count() == 6 and shop.m.files.agg({"loc": "sum"}).first()[0] == 18


def test_answers_about_the_shop(shop):
    facts = shop.get_fingerprint()
    assert (facts["language"], facts["framework"], facts["package_manager"]) == ("Python", "FastAPI", "pip")
    assert [(d["name"], d["version"], d["dev"]) for d in shop.get_dependencies()["dependencies"]] == [("fastapi", ">=0.110", False)]
    assert shop.get_critical_files()["critical_files"][0] == {"path": "src/shop/models.py", "imported_by": 2}
    assert shop.find_symbol("make_service")["definitions"][0]["path"] == "src/shop/service.py"
    assert shop.what_tests("models.py")["tests"] == [{"path": "tests/test_models.py", "matched_by": ["imports", "name"]}]
    got = shop.analyze_impact("models.py")
    assert got["affected_file_count"] == 3 and got["risk_level"] == "medium" and len(got["direct_dependents"]) == 2
    health = shop.get_health()
    assert (health["confidence"], health["connectivity"]) == ("high", 0.8)
    told = shop.explain_module("shop")
    assert (told["module"], told["classes"], told["functions"], told["loc"], told["blast_radius"]) == ("src/shop", 2, 2, 13, 1)
    assert told["consumers"] == ["tests"] and told["risk_level"] == "low" and "provides data access" in told["purpose"]


def test_dart_declarations_and_noise():
    code = "import 'a.dart';\n// void no(\nclass Counter extends Base<int> implements A, B {\n  final s = 'int fake(';\n  Counter(this.s);\n  void increment() { return go(); }\n  String get label => 'x';\n}\nint add(int a) => a;\n"
    got = parsers.parse_dart(code)
    assert [m["name"] for m in got["classes"][0]["methods"]] == ["increment", "label"]
    assert (got["classes"][0]["bases"], got["classes"][0]["interfaces"]) == (["Base"], ["A", "B"])
    assert [(f["name"], f["line"]) for f in got["functions"]] == [("add", 9)]
    assert Registry(builtin()).parser_for("Go") is None and Registry([GO]).parser_for("Go")("type S struct {}\nfunc Run() {}\n")["functions"][0]["line"] == 2


def test_history_is_told_from_one_that_could_not_be_read(spark, tmp_path):
    """A repository with an odd subject, one without commits, one whose commits are damaged, and no repository."""
    run = lambda d, *a: subprocess.run(["git", "-C", str(tmp_path / d), "-c", "user.name=A", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    for d in ("good", "new", "bad", "none"):
        (tmp_path / d).mkdir()
    for d in ("good", "new", "bad"):
        run(d, "init", "-q")
    for d in ("good", "bad"):
        for i, subject in enumerate(("first", "page\x0cbreak line")):
            (tmp_path / d / "a.txt").write_text(str(i))
            run(d, "add", "-A")
            run(d, "commit", "-q", "-m", subject)
    sha = run("bad", "rev-parse", "HEAD~1").stdout.decode().strip()
    (tmp_path / "bad/.git/objects" / sha[:2] / sha[2:]).unlink()
    m = Memory(spark, {d: tmp_path / d for d in ("good", "new", "bad", "none")})
    rows = m._git("commits").orderBy("repo_id", "ordinal").collect()
    assert [(r.repo_id, r.subject, r.is_root) for r in rows if r.error is None] == [("good", "page\x0cbreak line", False), ("good", "first", True)]
    assert [(r.repo_id, r.sha, r.error) for r in rows if r.error] == [("bad", None, "git log ended with 128")]
    files = m._git("files").collect()
    assert sorted((r.repo_id, r.path) for r in files if r.error is None) == [("good", "a.txt")] * 2
    assert [r.repo_id for r in files if r.error] == ["bad"]


def test_a_path_that_is_not_utf8(spark, tmp_path):
    with open(bytes(tmp_path) + b"/odd\xff.py", "w") as h:
        h.write("x = 1\n")
    assert [(r.path, r.text) for r in Memory(spark, tmp_path).tree.collect()] == [("odd\ufffd.py", "x = 1\n")]
