"""What manifests say of a repository: fingerprint facts, dependencies, entry points.

Facts are rows (repo_id, attr, value, evidence, ordinal); of one attribute the row with
the highest ordinal counts, so later scanners overrule earlier ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims, schemas
from ..functions import paths, text

FACTS = "repo_id string, attr string, value string, evidence string, ordinal int"


@dataclass
class Scan:
    facts: DataFrame
    dependencies: DataFrame
    entry_points: DataFrame


def _root(tree: DataFrame, names) -> DataFrame:
    """One row for each repository that has any of these root files: a column of text for each, null if it is not there."""
    rows = tree.where(~F.col("is_dir") & F.col("path").isin(*names))
    return rows.groupBy("repo_id").agg(*(F.max(F.when(F.col("path") == n, F.coalesce("text", F.lit("")))).alias(n.replace(".", "_")) for n in names))


def _facts(rows: DataFrame, items: list[tuple[str, Column, Column]], base: int) -> DataFrame:
    each = F.array(*(F.struct(F.lit(a).alias("attr"), v.cast("string").alias("value"), e.cast("string").alias("evidence"), F.lit(base + i).alias("ordinal")) for i, (a, v, e) in enumerate(items)))
    return rows.select("repo_id", F.explode(each).alias("f")).select("repo_id", "f.*").where("value is not null")


def _databases(rows: DataFrame, blob: Column, needles, evidence: Column, base: int) -> DataFrame:
    found = rows.select("repo_id", evidence.alias("evidence"), F.posexplode(text.all_matches(blob, needles)).alias("o", "value"))
    return found.select("repo_id", F.lit("database").alias("attr"), "value", "evidence", (F.col("o") + base).cast("int").alias("ordinal"))


# ---- Python --------------------------------------------------------------------------


def _toml(batches):
    """Dependencies, scripts and build requirements of pyproject files; what is broken or of another type than it should be has none."""
    import tomllib

    import pyarrow as pa

    dep = pa.struct([("spec", pa.string()), ("name", pa.string()), ("version", pa.string()), ("source", pa.string()), ("dev", pa.bool_())])

    def of(kind, data, *keys):
        """The value below these keys, an empty one if it or what is above is of another type."""
        for k in keys[:-1]:
            data = data.get(k) if isinstance(data, dict) else None
        data = data.get(keys[-1]) if isinstance(data, dict) else None
        return data if isinstance(data, kind) else kind()

    def specs(data, source, dev):
        return [{"spec": s, "name": None, "version": None, "source": source, "dev": dev} for s in data if isinstance(s, str)] if isinstance(data, list) else []

    for batch in batches:
        out = {"repo_id": [], "deps": [], "scripts": [], "requires": []}
        for repo, raw in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                data = tomllib.loads(raw or "")
            except tomllib.TOMLDecodeError:
                data = {}
            said = specs(of(list, data, "project", "dependencies"), "pyproject.toml [project]", False)
            for group, items in of(dict, data, "project", "optional-dependencies").items():
                said += specs(items, f"pyproject.toml [optional: {group}]", True)
            for group, items in of(dict, data, "dependency-groups").items():
                said += specs(items, f"pyproject.toml [group: {group}]", True)
            for name, want in of(dict, data, "tool", "poetry", "dependencies").items():
                if name.lower() != "python":
                    said.append({"spec": None, "name": name, "version": want if isinstance(want, str) else None, "source": "pyproject.toml [tool.poetry]", "dev": False})
            out["repo_id"].append(repo)
            out["deps"].append(said)
            out["scripts"].append([f"{k} = {v}" for k, v in of(dict, data, "project", "scripts").items()])
            out["requires"].append(" ".join(x for x in of(list, data, "build-system", "requires") if isinstance(x, str)).lower())
        kinds = [pa.string(), pa.list_(dep), pa.list_(pa.string()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def scan_python(tree: DataFrame) -> Scan:
    manifests = (*dims.PYTHON_MARKERS, "uv.lock", "poetry.lock", "pdm.lock")
    rows = _root(tree, manifests)
    rows = rows.where(F.coalesce(*(F.col(n.replace(".", "_")) for n in dims.PYTHON_MARKERS)).isNotNull())
    has = lambda n: F.col(n.replace(".", "_")).isNotNull()
    py = F.coalesce("pyproject_toml", F.lit(""))
    said = lambda s: F.contains(py, F.lit(s))
    managers = (
        (has("uv.lock"), "uv", "uv.lock"),
        (has("poetry.lock") | said("[tool.poetry]"), "Poetry", "poetry.lock / [tool.poetry]"),
        (has("pdm.lock") | said("[tool.pdm]"), "PDM", "pdm.lock / [tool.pdm]"),
        (has("Pipfile"), "Pipenv", "Pipfile"),
        (has("requirements.txt") | has("setup.py"), "pip", "requirements.txt / setup.py"),
        (said("[project]") | said("[build-system]"), "pip", "pyproject.toml (PEP 621)"),
    )
    pick = lambda i: F.coalesce(*(F.when(m[0], F.lit(m[i])) for m in managers))
    toml = rows.select("repo_id", F.coalesce("pyproject_toml", F.lit("")).alias("t")).mapInArrow(
        _toml, "repo_id string, deps array<struct<spec:string,name:string,version:string,source:string,dev:boolean>>, scripts array<string>, requires string"
    )
    rows = rows.join(toml, "repo_id")
    blob = F.lower(F.concat_ws("\n", *(n.replace(".", "_") for n in dims.PYTHON_MARKERS)))
    quoted = lambda c, needles, form: F.coalesce(*(F.when(F.contains(c, F.lit(n)), F.lit(form.format(n))) for n, _ in needles))
    facts = _facts(
        rows,
        [
            ("package_manager", pick(1), pick(2)),
            ("build_system", text.first_match(F.col("requires"), dims.BUILD_BACKENDS), quoted(F.col("requires"), dims.BUILD_BACKENDS, "build-system requires '{}'")),
            ("framework", text.first_match(blob, dims.PYTHON_FRAMEWORKS), quoted(blob, dims.PYTHON_FRAMEWORKS, "dependency '{}'")),
        ],
        100,
    ).unionByName(_databases(rows, blob, dims.PYTHON_DATABASES, F.lit("declared dependencies"), 150))

    own = rows.select("repo_id", F.posexplode("deps").alias("ordinal", "d")).select("repo_id", "ordinal", "d.*")
    lines = rows.where("size(deps) = 0").select("repo_id", F.posexplode(F.split(F.coalesce("requirements_txt", F.lit("")), text.LINE_BREAKS)).alias("ordinal", "spec"))
    lines = lines.withColumn("spec", text.strip(F.col("spec"))).where("spec <> '' and not startswith(spec, '#') and not startswith(spec, '-')")
    none = F.lit(None).cast("string")
    both = own.unionByName(lines.select("repo_id", "ordinal", "spec", none.alias("name"), none.alias("version"), F.lit("requirements.txt").alias("source"), F.lit(False).alias("dev")))
    deps = both.select("repo_id", F.coalesce("name", text.requirement_name(F.col("spec"))).alias("name"), F.coalesce("version", text.requirement_version(F.col("spec"))).alias("version"), "source", "dev", "ordinal").where("name is not null")
    entries = rows.select("repo_id", F.explode("scripts").alias("path"))
    runnable = tree.where(~F.col("is_dir") & paths.basename(F.col("path")).isin(*dims.PYTHON_ENTRY_FILES)).join(rows.select("repo_id"), "repo_id", "left_semi").select("repo_id", "path")
    return Scan(facts, deps, entries.unionByName(runnable).distinct())


# ---- Dart -----------------------------------------------------------------------------


def pubspec_entries(rows: DataFrame) -> DataFrame:
    """(repo_id, path, text) of pubspecs -> their dependency lines: the section is carried forward over the lines below it."""
    lines = rows.select("repo_id", "path", F.posexplode(F.split("text", text.LINE_BREAKS)).alias("ordinal", "line")).withColumn("line", F.regexp_replace("line", r"\s+$", ""))
    lines = lines.where(r"line <> '' and not line rlike '^\\s*#'").withColumn("indent", F.length(F.regexp_extract("line", r"^(\s*)", 1)))
    head = F.when(F.col("indent") == 0, text.strip(F.regexp_replace("line", ":+$", "")))
    run = Window.partitionBy("repo_id", "path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)  # the lines of one manifest
    own = lines.withColumn("section", F.last(head, True).over(run)).where("indent between 1 and 2 and section in ('dependencies', 'dev_dependencies')")
    name, version = text.strip(F.substring_index("line", ":", 1)), text.strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    prefix = F.when(F.col("path") != "pubspec.yaml", F.concat("path", F.lit(" "))).otherwise("")
    return own.select(
        "repo_id", name.alias("name"), F.nullif(version, F.lit("")).alias("version"), F.concat(prefix, F.lit("pubspec.yaml ["), "section", F.lit("]")).alias("source"),
        (F.col("section") == "dev_dependencies").alias("dev"), F.col("ordinal").cast("int").alias("ordinal"),
    ).where("name <> ''")


def scan_dart(tree: DataFrame) -> Scan:
    p = F.col("path")
    specs = tree.where(~F.col("is_dir") & (paths.basename(p) == "pubspec.yaml"))
    main = specs.groupBy("repo_id").agg(F.min_by(F.struct("path", F.coalesce("text", F.lit("")).alias("text")), F.struct(paths.depth(p), "path")).alias("m")).select("repo_id", "m.*")
    low = F.lower("text")
    flutter = F.contains(low, F.lit("flutter:")) | F.contains(low, F.lit("sdk: flutter"))
    quoted = lambda needles: F.coalesce(*(F.when(F.contains(low, F.lit(n)), F.lit(f"dependency '{n.rstrip(':')}'")) for n, _ in needles))
    facts = _facts(
        main,
        [
            ("language", F.lit("Dart"), p),
            ("framework", F.when(flutter, "Flutter").otherwise("Dart"), F.when(flutter, F.concat(F.lit("flutter SDK in "), p)).otherwise("pure Dart package")),
            ("package_manager", F.lit("pub"), p),
            ("build_system", F.when(flutter, "Flutter SDK").otherwise("Dart SDK"), p),
            ("state_management", text.first_match(low, dims.DART_STATE), quoted(dims.DART_STATE)),
            ("navigation", text.first_match(low, dims.DART_NAVIGATION), quoted(dims.DART_NAVIGATION)),
        ],
        200,
    ).unionByName(_databases(main, low, dims.DART_DATABASES, F.concat(p, F.lit(" dependencies")), 250))
    base = main.select("repo_id", F.expr("substring(path, 1, length(path) - length('pubspec.yaml'))").alias("base"))
    near = tree.where(~F.col("is_dir") & F.endswith(p, F.lit(".dart"))).join(base, "repo_id")
    entry = near.where((p == F.concat("base", F.lit("lib/main.dart"))) | F.startswith(p, F.concat("base", F.lit("bin/"))))
    return Scan(facts, pubspec_entries(main), entry.select("repo_id", "path").distinct())


# ---- together ---------------------------------------------------------------------------


def scan(tree: DataFrame, scanners) -> Scan:
    """All scanners' results: facts united, dependencies once for each (name, source), entry points once."""
    parts = [s(tree) for s in scanners]
    spark = tree.sparkSession
    facts, deps = spark.createDataFrame([], FACTS), spark.createDataFrame([], schemas.DEPENDENCIES)
    entries = spark.createDataFrame([], "repo_id string, path string")
    for i, x in enumerate(parts):
        facts = facts.unionByName(x.facts)
        deps = deps.unionByName(x.dependencies.withColumn("ordinal", (F.col("ordinal") + i * 1_000_000).cast("int")))
        entries = entries.unionByName(x.entry_points)
    from .inventory import dedup_first

    return Scan(facts, dedup_first(deps, ["repo_id", "name", "source"], "ordinal"), entries.distinct())


def fingerprint(facts: DataFrame) -> DataFrame:
    """(repo_id, attr, value, evidence): the last word on each attribute; databases stay a row each."""
    one = facts.where("attr <> 'database'").groupBy("repo_id", "attr").agg(F.max_by(F.struct("value", "evidence"), "ordinal").alias("f")).select("repo_id", "attr", "f.*")
    return one.unionByName(facts.where("attr = 'database'").select("repo_id", "attr", "value", "evidence"))
