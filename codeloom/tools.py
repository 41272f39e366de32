"""One repository's questions and answers as dictionaries, over the DataFrame operators."""

from __future__ import annotations

import datetime
import json
import os
import uuid
from functools import cached_property
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context, dims, sources
from .functions import paths, text
from .operators import changes, ecosystems, graph, inventory, knowledge, modules
from .plugins import Registry, default_registry
from .runtime import checkpoint
from .sources import git, parsers
from .sources.tree import resolve_root


class Memory:
    """The tables of a corpus of repositories, each built when first asked for and then kept.

    ``roots``: a folder, or a dictionary of repo_id and folder.
    """

    def __init__(self, spark: SparkSession, roots, registry: Registry | None = None):
        sources.register(spark)
        self.roots = {k: resolve_root(v) for k, v in (roots if isinstance(roots, dict) else {Path(roots).name: roots}).items()}
        self.spark, self.registry = spark, registry or default_registry()
        self.repo = next(iter(self.roots), None)

    def _git(self, table: str, **more) -> DataFrame:
        """Commits or their files; a repository whose history could not be read has one row with an error."""
        return self.spark.read.format("gitlog").options(roots=json.dumps(self.roots), table=table, **more).load()

    @cached_property
    def tree(self):
        return checkpoint(self.spark.read.format("repotree").option("roots", json.dumps(self.roots)).load())

    @cached_property
    def files(self):
        return checkpoint(inventory.files(self.tree))

    @cached_property
    def module_rows(self):
        return checkpoint(inventory.modules(self.files))

    @cached_property
    def ir(self):
        source = self.tree.join(self.files.where("language is not null").select("repo_id", "path", "language"), ["repo_id", "path"])
        return checkpoint(parsers.parse(source, self.registry.parsers()))

    @cached_property
    def imports(self):
        """Resolved and valid: both ends are source files."""
        own = self.files.where("language is not null").select("repo_id", F.col("path").alias("target"))
        found = graph.resolve_imports(self.ir, self.files, graph.dart_packages(self.tree))
        return checkpoint(found.join(own, ["repo_id", "target"], "left_semi").select("repo_id", "path", "target"))

    @cached_property
    def elements(self):
        return checkpoint(graph.elements(self.ir))

    @cached_property
    def nodes(self):
        return checkpoint(graph.nodes(self.files, self.module_rows, self.elements))

    @cached_property
    def edges(self):
        return checkpoint(graph.edges(self.files, self.elements, self.imports, self.nodes))

    @cached_property
    def scan(self):
        return ecosystems.scan(self.tree, self.registry.scanners())

    @cached_property
    def facts(self):
        stats = inventory.language_stats(self.files).where("rank = 1")
        first = stats.select("repo_id", F.lit("language").alias("attr"), F.col("language").alias("value"), F.concat(F.col("files").cast("string"), F.lit(" source files")).alias("evidence"), F.lit(0).alias("ordinal"))
        style = inventory.architecture_style(self.files).where("style is not null")
        last = style.select("repo_id", F.lit("architecture").alias("attr"), F.col("style").alias("value"), "evidence", F.lit(900).alias("ordinal"))
        return checkpoint(ecosystems.fingerprint(self.scan.facts.unionByName(first).unionByName(last)))

    @cached_property
    def dependencies(self):
        return checkpoint(self.scan.dependencies)

    @cached_property
    def entry_points(self):
        return checkpoint(self.scan.entry_points)

    @cached_property
    def summary(self):
        return checkpoint(modules.summarize(self.files, self.module_rows, self.nodes, self.imports))

    @cached_property
    def coverage(self):
        return checkpoint(graph.coverage(self.nodes, self.imports, sorted(self.registry.languages())))

    @cached_property
    def decisions(self):
        return checkpoint(knowledge.decisions(self.tree))

    @cached_property
    def documents(self):
        return checkpoint(knowledge.documents(self.tree))

    TABLES = ("tree", "files", "module_rows", "ir", "imports", "nodes", "edges", "facts", "dependencies", "entry_points", "summary", "coverage", "decisions", "documents")

    def stamp(self) -> dict[str, str | None]:
        """The commit of each repository that the tables were built at."""
        return self.__dict__.setdefault("_stamp", {k: git.head(v) for k, v in self.roots.items()})

    def write(self, folder: str) -> None:
        """Every table as Parquet, into a new folder of its own that the manifest then names; imports are kept as parsed.

        The tree is kept without texts.  The manifest is a one-row table, replaced last,
        so a reader never meets tables of two builds; the build before is kept.
        """
        build = f"{folder}/build-{uuid.uuid4().hex}"
        for name in self.TABLES:
            df = getattr(self, name)
            (df.withColumn("text", F.lit(None).cast("string")) if name == "tree" else df).write.parquet(f"{build}/{name}")
        rows = [(k, self.roots[k], v, build) for k, v in self.stamp().items()]
        self.spark.createDataFrame(rows, "repo_id string, root string, built_at_commit string, build string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, registry: Registry | None = None) -> "Memory | None":
        """A written memory, its tables read again; None if there is none."""
        try:
            rows = spark.read.parquet(f"{folder}/manifest").collect()  # one row a repository
        except AnalysisException:
            return None
        out = cls(spark, {r.repo_id: r.root for r in rows}, registry)
        out._stamp = {r.repo_id: r.built_at_commit for r in rows}
        for name in cls.TABLES if rows else ():
            out.__dict__[name] = spark.read.parquet(f"{rows[0].build}/{name}")
        return out

    @classmethod
    def ensure(cls, spark: SparkSession, folder: str, roots, registry: Registry | None = None) -> "Memory":
        """The written memory, or one that is built and written now."""
        out = cls.load(spark, folder, registry)
        if out is None:
            out = cls(spark, roots, registry)
            out.write(folder)
        return out

    def updated(self) -> tuple["Memory", DataFrame | None]:
        """A memory of the trees as they are now, and the changes (repo_id, path, status) of their source files.

        Files whose size and time are the same keep their parsed rows, everything else
        is parsed again; imports are resolved anew, so the outcome equals a full build.
        """
        now = Memory(self.spark, self.roots, self.registry)
        source = lambda files: files.where("language is not null")
        changed = checkpoint(changes.change_set(source(now.files), source(self.files)))
        kept, again = changes.reuse(source(now.files), changed, self.ir)
        texts = now.tree.join(again.select("repo_id", "path", "language"), ["repo_id", "path"])
        now.__dict__["ir"] = checkpoint(kept.unionByName(parsers.parse(texts, now.registry.parsers())))
        return now, changed


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.drop("repo_id").collect()]  # answers about one repository


class Tools:
    """The questions of an agent about the first repository of a memory."""

    def __init__(self, memory: Memory):
        self.m, self.spark = memory, memory.spark
        self.root = memory.roots[memory.repo]

    def _ask(self, **columns) -> DataFrame:
        return self.spark.createDataFrame([(self.m.repo, *columns.values())], ["repo_id", *columns])

    def get_dependencies(self) -> dict:
        rows = _rows(self.m.dependencies.orderBy("ordinal").drop("ordinal"))
        return {"count": len(rows), "dependencies": rows}

    def get_fingerprint(self) -> dict:
        rows = _rows(self.m.facts)
        out = {r["attr"]: r["value"] for r in rows if r["attr"] != "database"}
        return out | {"databases": [r["value"] for r in rows if r["attr"] == "database"], "evidence": {r["attr"]: r["evidence"] for r in rows}}

    def get_project_summary(self) -> dict:
        one = _rows(inventory.counts(self.m.tree, self.m.files, self.m.module_rows))
        points = [r["path"] for r in _rows(self.m.entry_points.orderBy("path"))]
        more = {"dependency_count": self.m.dependencies.count(), "entry_points": points}
        return {"name": self.m.repo, "fingerprint": self.get_fingerprint(), "conventions": self.get_conventions(), **(one[0] if one else {}), **more}

    def get_architecture(self) -> dict:
        layers = _rows(inventory.layers(self.m.module_rows).orderBy(F.desc("file_count"), "name"))
        keys = graph.in_degree(self.m.imports).orderBy(F.desc("imported_by"), "path").limit(dims.KEY_FILE_LIMIT)
        return {"style": self.get_fingerprint().get("architecture"), "layers": layers, "key_files": [r["path"] for r in _rows(keys)]}

    def get_conventions(self) -> dict:
        m, primary = self.m, self.m.facts.where("attr = 'language'").select("repo_id", F.col("value").alias("language"))
        first = lambda df, c: (df.head() or {c: None})[c]
        out = {"source_layout": first(inventory.source_layout(m.module_rows), "source_layout"), "file_naming": first(inventory.file_naming(m.files), "file_naming")}
        for kind, name in (("class", "classes"), ("function", "functions")):
            naming = checkpoint(inventory.symbol_naming(m.nodes, kind))
            out[name] = first(inventory.primary_style(naming, primary), "style")
            out[f"{name}_by_language"] = {r["language"]: r["dominant"] for r in _rows(naming) if r["dominant"]}
        blob = m.dependencies.groupBy("repo_id").agg(F.array_join(F.collect_list(F.lower("name")), " ").alias("b"))
        di = first(blob.select(text.first_match(F.col("b"), dims.DI_FRAMEWORKS).alias("di")), "di")
        state = first(m.facts.where("attr = 'state_management'"), "value")
        out["dependency_injection"] = di or (state if (state or "").lower() in dims.STATE_AS_WIRING else None)
        dirs = inventory.directories(m.tree)
        words = inventory.segments(dirs)
        out["layering"] = sorted(r["segment"] for r in _rows(inventory.layering(words)))
        flags = inventory.pattern_flags(words.unionByName(inventory.file_tokens(m.files)).distinct())
        out["patterns"] = (first(flags, "patterns") or []) + ["dependency_injection"] * bool(out["dependency_injection"])
        out["testing"] = (_rows(inventory.testing(m.files, dirs, m.dependencies)) or [{}])[0]
        return out

    def get_module_info(self, module: str | None = None) -> dict:
        if module is None:
            return {"modules": _rows(self.m.summary.select("repo_id", "path", "language", "file_count", "loc").orderBy("path"))}
        p, q = F.col("path"), module.strip("/")
        hit = self.m.summary.where((p == q) | F.endswith(p, F.lit("/" + q)))
        hit = _rows(hit.orderBy(p != q, paths.has_test_segment(p), paths.depth(p), p).limit(1))
        return hit[0] if hit else {"error": f"no module matches {module}", "available": [r["path"] for r in _rows(self.m.summary.orderBy("path"))]}

    def get_critical_files(self, limit: int = 10) -> dict:
        tests = graph.in_degree(self.m.imports).where(paths.is_test(F.col("path"))).count()
        return {"critical_files": _rows(graph.critical_files(self.m.imports, limit)), "test_files_excluded": tests}

    def get_hotspots(self, limit: int = 10) -> dict:
        churn = checkpoint(changes.churn(*(self.m._git(t, max_commits=dims.CHURN_COMMITS).where("error is null").drop("error") for t in ("commits", "files"))))
        if churn.isEmpty():
            return {"available": False, "hotspots": [], "reason": "no git history"}
        return {"available": True, "hotspots": _rows(graph.hotspots(churn, self.m.imports, limit))}

    def get_history(self) -> dict:
        rows = checkpoint(self.m._git("commits"))
        commits, failed = rows.where("error is null").drop("error"), _rows(rows.where("error is not null").select("repo_id", "error"))
        one = _rows(changes.history(commits))
        return {"is_git": bool(one), **(one[0] if one else {}), "top_contributors": _rows(changes.contributors(commits).orderBy("rank")), **({"error": failed[0]["error"]} if failed else {})}

    def explain_module(self, target: str) -> dict:
        got = _rows(modules.explain(self.m.summary, self.m.nodes, self.m.imports, self._ask(target=target), self.m.entry_points))
        if not got:
            return {"error": f"no module matches {target}", "available": [r["path"] for r in _rows(self.m.summary.orderBy("path"))]}
        return got[0] | {"notes": self.notes_for(got[0]["module"])}

    def analyze_impact(self, target: str) -> dict:
        """A file by its path, else the only one that ends with the target."""
        p, files = F.col("path"), self.m.files.where("language is not null").select("repo_id", "path")
        found = files.where((p == target) | F.endswith(p, F.lit("/" + target)))
        names = sorted(r["path"] for r in _rows(found))
        one = target if target in names else names[0] if len(names) == 1 else None
        if one is None:
            return {"error": f"no single file matches {target}", "candidates": names}
        return {"target": target} | _rows(graph.impact(self.m.imports, self._ask(path=one)))[0]

    def find_symbol(self, name: str) -> dict:
        rows = graph.symbols(self.m.nodes, self.m.edges, self._ask(symbol=name)).orderBy(F.desc("reference_count"), "path", "line")
        found = _rows(rows.drop("symbol"))
        return {"symbol": name, "found": bool(found), "definitions": found}

    def get_feature(self, name: str) -> dict:
        got = _rows(modules.features(self.m.summary, self.m.imports, self._ask(target=name)))
        if got:
            return {"feature": name, "found": True} | got[0]
        parts = self.m.summary.select(F.explode(F.split("path", "/")).alias("s")).distinct().orderBy("s")
        return {"feature": name, "found": False, "available": [r.s for r in parts.collect()]}

    def what_tests(self, target: str) -> dict:
        p, q = F.col("path"), target.strip("/")
        found = self.m.files.where("language is not null").where((p == target) | F.endswith(p, F.lit("/" + q)) | (p == q))
        best = found.orderBy(p != target, paths.is_test(p), paths.depth(p), p).limit(1).collect()
        if not best:
            return {"target": target, "found": False, "tests": []}
        rows = graph.tests_for(self.m.nodes, self.m.imports, self._ask(path=best[0].path)).orderBy("test")
        return {"target": best[0].path, "found": True, "tests": [{"path": r["test"], "matched_by": r["matched_by"]} for r in _rows(rows)]}

    def get_health(self) -> dict:
        got, by = _rows(self.m.coverage), checkpoint(knowledge.language_coverage(self.m.files, sorted(self.m.registry.languages())))
        told = _rows(knowledge.warnings(self.m.coverage, by))
        rest = {"languages": _rows(by.orderBy(F.desc("graphed"), F.desc("files"), "language")), "warnings": told[0]["warnings"] if told else []}
        built, current = self.m.stamp().get(self.m.repo), git.head(self.root)
        fresh = knowledge.staleness(built, current, git.changed_since(self.root, built) if built and current else None)
        return (got[0] if got else {"confidence": "unknown"}) | rest | {"current_commit": current, "staleness": fresh}

    def get_knowledge(self) -> dict:
        """Decisions found and recorded (of one id the first), patterns, history, documents, notes."""
        found = [{k: v for k, v in r.items() if k != "ordinal"} for r in _rows(self.m.decisions.orderBy("ordinal"))]
        found = list({d["id"]: d for d in reversed([*found, *self._read("decisions")])}.values())[::-1]
        docs = [{k: v for k, v in r.items() if k != "ordinal"} for r in _rows(self.m.documents.orderBy("ordinal"))]
        history = self.get_history()
        return {"decisions": found, "patterns": knowledge.patterns(self.get_conventions(), self.get_fingerprint().get("architecture")), "history": history, "docs": docs, "notes": self.notes()}

    def get_context(self) -> dict:
        names = [r["name"] for r in _rows(inventory.top_dependencies(self.m.dependencies).orderBy("rank"))]
        return context.pack(self.get_project_summary(), self.get_architecture(), self.get_conventions(), self.get_knowledge(), names, self.get_health())

    def benchmark(self) -> dict:
        """Tokens of the sources against those of the context pack."""
        sizes = self.m.files.where("language is not null").agg(F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), F.coalesce(F.sum("size"), F.lit(0)).alias("chars")).first()
        raw, own = -(-sizes.chars // dims.CHARS_PER_TOKEN), context.tokens(context.markdown(self.get_context()))
        return {"name": self.m.repo, "files": sizes.files, "loc": sizes["loc"], "raw_tokens": raw, "pack_tokens": own, "ratio": round(raw / own, 1) if own else 0.0}

    # ---- notes: an append-only file of JSON lines in the repository's memory folder

    def _read(self, kind: str) -> list[dict]:
        path = Path(self.root) / dims.MEMORY_DIR / f"{kind}.jsonl"
        return [json.loads(x) for x in path.read_text("utf-8").splitlines() if x.strip()] if path.exists() else []

    def _append(self, kind: str, title: str, default: str, most: int | None, used, row: dict) -> dict:
        """The row with an id made from its title that no other row has."""
        base = "".join(c if c.isascii() and c.isalnum() else "-" for c in title.lower())
        base = "-".join(x for x in base.split("-") if x)[:most] or default
        n, name = 2, base
        while name in used:
            name, n = f"{base}-{n}", n + 1
        row = {"id": name} | row
        folder = Path(self.root) / dims.MEMORY_DIR
        os.makedirs(folder, exist_ok=True)
        with (folder / f"{kind}.jsonl").open("a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")
        return row

    def notes(self) -> list[dict]:
        return self._read("notes")

    def record_note(self, text: str, scope: str | None = None, source: str = "agent") -> dict:
        row = {"text": text, "scope": scope, "created": datetime.date.today().isoformat(), "source": source}
        return {"recorded": True, "note": self._append("notes", text, "note", 40, {x["id"] for x in self.notes()}, row)}

    def record_decision(self, title: str, status: str = "accepted", rationale: str | None = None, context: str | None = None, date: str | None = None) -> dict:
        used = {r["id"] for r in _rows(self.m.decisions)} | {x["id"] for x in self._read("decisions")}
        row = {"title": title, "status": status, "date": date or datetime.date.today().isoformat(), "context": context, "rationale": rationale, "source": "manual"}
        return self._append("decisions", title, "decision", None, used, row)

    def notes_for(self, scope: str) -> list[dict]:
        return [x for x in self.notes() if x["scope"] and (scope == x["scope"] or scope.startswith(x["scope"] + "/"))]


__all__ = ["Memory", "Tools"]
