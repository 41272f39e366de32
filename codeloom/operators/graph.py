"""The property graph: nodes and edges from files and parsed rows, by joins; traversal, reach, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import paths
from ..runtime import checkpoint, few

NODE = ("repo_id", "id", "kind", "name", "path", "line", "language")


def node_id(kind: str, *parts) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


# ---- import resolution -----------------------------------------------------------


def dotted_index(files: DataFrame) -> DataFrame:
    """(repo_id, dotted, target): the file that a dotted module name means; lowest root prefix, then path, wins."""
    bare = F.regexp_replace("path", r"\.py$", "")
    each = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(p).alias("prefix")) for i, p in enumerate(dims.DOTTED_PREFIXES)))
    rows = files.where(F.endswith("path", F.lit(".py"))).select("repo_id", "path", bare.alias("bare"), F.explode(each).alias("r")).where(F.startswith("bare", F.col("r.prefix")))
    rest = F.regexp_replace(F.substring(F.col("bare"), F.length("r.prefix") + 1, F.length("bare")), "/__init__$", "")
    rows = rows.select("repo_id", "path", F.replace(rest, F.lit("/"), F.lit(".")).alias("dotted"), "r.ord").where("dotted <> ''")
    return rows.groupBy("repo_id", "dotted").agg(F.min_by("path", F.struct("ord", "path")).alias("target"))


def dart_packages(tree: DataFrame) -> DataFrame:
    """(repo_id, package, lib): every pubspec's name and the folder its package: imports lie in."""
    rows = tree.where(~F.col("is_dir") & (paths.basename(F.col("path")) == "pubspec.yaml"))
    name = F.regexp_extract("text", r"(?m)^name:\s*(\S+)", 1)
    lib = F.when(F.instr("path", "/") > 0, F.concat(paths.parent_dir(F.col("path")), F.lit("/lib"))).otherwise("lib")
    rows = rows.select("repo_id", name.alias("package"), lib.alias("lib"), "path").where("package <> ''")
    return rows.groupBy("repo_id", "package").agg(F.min_by("lib", F.struct(paths.depth(F.col("path")), "path")).alias("lib"))


def resolve_imports(ir: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo_id, path, target), distinct, without a file's import of itself; what is not in the repository is dropped."""
    said = ir.select("repo_id", "path", F.explode("imports").alias("i")).select("repo_id", "path", "i.*")
    there = files.select("repo_id", F.col("path").alias("target"))
    index = dotted_index(files).withColumnRenamed("dotted", "module")
    absolute = said.where("kind = 'abs'").select("repo_id", "path", "module").join(index, ["repo_id", "module"]).select("repo_id", "path", "target")

    folder = F.filter(F.split(paths.parent_dir(F.col("path")), "/"), lambda s: s != ".")
    up = F.col("level") - 1
    base = F.when(up <= F.size(folder), F.slice(folder, F.lit(1), F.greatest(F.size(folder) - up, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    wanted = F.when(F.col("module").isNotNull(), F.array(F.concat(base, F.split("module", r"\.")))).otherwise(F.transform("names", lambda n: F.concat(base, F.array(n))))
    ways = F.transform(wanted, lambda w: F.array_join(w, "/"))
    relative = said.where("kind = 'rel'").select("repo_id", "path", F.explode(ways).alias("stem"))
    tries = relative.select("repo_id", "path", "stem", F.posexplode(F.array(F.concat("stem", F.lit(".py")), F.concat("stem", F.lit("/__init__.py")))).alias("o", "target"))
    relative = tries.join(there, ["repo_id", "target"], "left_semi").groupBy("repo_id", "path", "stem").agg(F.min_by("target", "o").alias("target")).select("repo_id", "path", "target")

    dart = said.where("kind = 'dart' and not startswith(module, 'dart:')").select("repo_id", "path", F.col("module").alias("spec"))
    far = dart.where("startswith(spec, 'package:')").select("repo_id", "path", F.regexp_extract("spec", "^package:([^/]*)/(.*)$", 1).alias("package"), F.regexp_extract("spec", "^package:([^/]*)/(.*)$", 2).alias("sub"))
    far = far.join(packages, ["repo_id", "package"]).select("repo_id", "path", F.concat_ws("/", "lib", "sub").alias("target"))
    near = dart.where("not startswith(spec, 'package:')").select("repo_id", "path", paths.resolve_relative(paths.parent_dir(F.col("path")), F.col("spec")).alias("target"))
    dart = far.unionByName(near).join(there, ["repo_id", "target"], "left_semi")
    return absolute.unionByName(relative).unionByName(dart.select("repo_id", "path", "target")).where("path <> target").distinct()


# ---- assembly --------------------------------------------------------------------


def elements(ir: DataFrame) -> DataFrame:
    """Functions, classes and methods, one row for each occurrence: node columns, owner id, bare name, is_top, calls, bases, interfaces.

    A file's elements are one array of structs, so that its row is read and exploded once.
    """
    none, p = F.lit(None).cast("array<string>"), F.col("path")

    def one(kind, name, x, owner, bare, top, ord_, calls=none, bases=none, interfaces=none):
        kinds = (("kind", F.lit(kind)), ("name", name), ("line", x["line"]), ("owner", owner), ("bare", bare), ("is_top", F.lit(top)), ("calls", calls), ("bases", bases), ("interfaces", interfaces), ("ord", ord_.cast("long")))
        return F.struct(*(c.alias(n) for n, c in kinds))

    in_file = node_id("file", p)
    functions = F.transform("functions", lambda f, o: one("function", f["name"], f, in_file, f["name"], True, o, f["calls"]))
    classes = F.transform("classes", lambda c, o: one("class", c["name"], c, in_file, c["name"], True, o, none, c["bases"], c["interfaces"]))
    full = lambda c, m: F.concat_ws(".", c["name"], m["name"])
    methods = F.flatten(F.transform("classes", lambda c, o: F.transform(c["methods"], lambda m, i: one("function", full(c, m), m, node_id("class", p, c["name"]), m["name"], False, o * 100_000 + i, m["calls"]))))
    rows = ir.select("repo_id", "path", "language", F.explode(F.concat(functions, classes, methods)).alias("e")).select("repo_id", "path", "language", "e.*")
    return rows.select("repo_id", node_id(F.col("kind"), p, F.col("name")).alias("id"), "kind", "name", "path", "line", "language", "owner", "bare", "is_top", "calls", "bases", "interfaces", "ord")


def nodes(files: DataFrame, modules: DataFrame, elements: DataFrame) -> DataFrame:
    """Modules, files and code elements; of equal ids the first occurrence stays."""
    line = F.lit(None).cast("int").alias("line")
    mods = modules.select("repo_id", node_id("module", F.col("path")).alias("id"), F.lit("module").alias("kind"), F.col("path").alias("name"), "path", line, "language")
    own = files.where("language is not null").select("repo_id", node_id("file", F.col("path")).alias("id"), F.lit("file").alias("kind"), paths.basename(F.col("path")).alias("name"), "path", line, "language")
    code = elements.groupBy("repo_id", "id").agg(F.min_by(F.struct(*NODE[2:]), F.struct("ord", "line")).alias("n")).select("repo_id", "id", "n.*")
    return mods.unionByName(own).unionByName(code)


def inheritance(elements: DataFrame) -> DataFrame:
    """extends and implements edges: a class of the same file first, else the only other class of that name."""
    classes = elements.where("kind = 'class'")
    kinds = F.array(F.struct(F.lit("extends").alias("kind"), F.col("bases").alias("names")), F.struct(F.lit("implements").alias("kind"), F.col("interfaces").alias("names")))
    said = classes.select("repo_id", "id", "path", F.explode(kinds).alias("k")).select("repo_id", "id", "path", "k.kind", F.explode("k.names").alias("base"))
    said = said.select("repo_id", "id", "kind", "base", node_id("class", F.col("path"), F.col("base")).alias("near")).distinct()
    per_id = classes.groupBy("repo_id", F.col("id").alias("near")).agg(F.count("*").alias("here"))
    per_name = classes.groupBy("repo_id", F.col("name").alias("base")).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    rows = said.join(per_name, ["repo_id", "base"]).join(per_id, ["repo_id", "near"], "left")
    others = F.col("n") - F.when(F.col("near") == F.col("id"), F.coalesce("here", F.lit(0))).otherwise(0)
    target = F.when(F.col("here").isNotNull() & (F.col("near") != F.col("id")), F.col("near")).when(others == 1, F.when(F.col("lo") != F.col("id"), F.col("lo")).otherwise(F.col("hi")))
    return rows.select("repo_id", F.col("id").alias("source"), target.alias("target"), "kind").where("target is not null")


def said_calls(elements: DataFrame) -> DataFrame:
    """(repo_id, source, callee): the names that functions and methods call."""
    return elements.where("kind = 'function'").select("repo_id", F.col("id").alias("source"), F.explode(F.array_distinct("calls")).alias("callee"))


def calls(elements: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """calls edges: to the top-level function that alone has the called name; names are met before rows are made distinct.

    ``said``: (repo_id, source, callee), the elements' own by default.  It is as large as
    the texts, so it is not moved where the names that one function alone has are few.
    """
    once = elements.where("kind = 'function' and is_top").groupBy("repo_id", F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1")
    said = said_calls(elements) if said is None else said
    met = said.join(few(once.select("repo_id", "callee", "target")), ["repo_id", "callee"]).where("source <> target")
    return met.select("repo_id", "source", "target", F.lit("calls").alias("kind")).distinct()


def edges(files: DataFrame, elements: DataFrame, imports: DataFrame, nodes: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """All edges whose two ends are nodes, each once.

    The ends of calls and inheritance are elements, so they are nodes and distinct by
    construction; what files and imports tell is held against the nodes.
    """
    p = F.col("path")
    held = files.where("language is not null").select("repo_id", node_id("module", paths.parent_dir(p)).alias("source"), node_id("file", p).alias("target"), F.lit("contains").alias("kind"))
    code = elements.select("repo_id", F.col("owner").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"))
    imp = imports.select("repo_id", node_id("file", p).alias("source"), node_id("file", F.col("target")).alias("target"), F.lit("imports").alias("kind"))
    ids = nodes.select("repo_id", "id")
    told = held.unionByName(code).unionByName(imp).distinct()
    told = told.join(ids.withColumnRenamed("id", "source"), ["repo_id", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["repo_id", "target"], "left_semi")
    return told.select("repo_id", "source", "target", "kind").unionByName(inheritance(elements)).unionByName(calls(elements, said))


# ---- lookups ---------------------------------------------------------------------


def in_degree(imports: DataFrame) -> DataFrame:
    return imports.groupBy("repo_id", F.col("target").alias("path")).agg(F.count("*").alias("imported_by"))


def critical_files(imports: DataFrame, limit: int = 10) -> DataFrame:
    """The files that most others import, tests left out before the limit (one repository's, or the corpus's overall)."""
    return in_degree(imports).where(~paths.is_test(F.col("path"))).orderBy(F.desc("imported_by"), "path", "repo_id").limit(limit)


def neighbors(edges: DataFrame, nodes: DataFrame, ids: DataFrame, kind: str | None = None, incoming: bool = False) -> DataFrame:
    """Nodes one hop from ``ids`` (repo_id, id), a row for each edge."""
    at, to = ("target", "source") if incoming else ("source", "target")
    own = edges if kind is None else edges.where(F.col("kind") == kind)
    hop = own.select("repo_id", F.col(at).alias("id"), F.col(to).alias("other"), F.col("kind").alias("via")).join(ids.select("repo_id", "id"), ["repo_id", "id"])
    far = nodes.select("repo_id", F.col("id").alias("other"), "kind", "name", "path", "line", "language")
    return hop.join(far, ["repo_id", "other"])


def reach(imports: DataFrame, seeds: DataFrame) -> DataFrame:
    """(repo_id, root, path): all files that import a seed, directly or not.

    ``seeds``: (repo_id, root, path).  Every level is one join of the frontier with the
    imports, less the levels before; a seed is in its own set only if it lies on a cycle.
    Files and roots are numbered first, so a level moves pairs of numbers; each level
    is checkpointed once and never written again.
    """
    edges = imports.select("repo_id", "target", "path").distinct()
    ends = edges.select("repo_id", F.explode(F.array("target", "path")).alias("path")).unionByName(seeds.select("repo_id", "path"))
    names = checkpoint(ends.distinct().withColumn("n", F.monotonically_increasing_id()))
    roots = checkpoint(seeds.select("repo_id", "root").distinct().withColumn("r", F.monotonically_increasing_id()))
    back = edges.join(names.select("repo_id", F.col("path").alias("target"), F.col("n").alias("at")), ["repo_id", "target"])
    back = checkpoint(back.join(names.select("repo_id", "path", F.col("n").alias("next")), ["repo_id", "path"]).select("at", "next"))
    front, seen = seeds.join(names, ["repo_id", "path"]).join(roots, ["repo_id", "root"]).select("r", F.col("n").alias("at")).distinct(), None
    while True:
        step = front.join(back, "at").select("r", F.col("next").alias("at")).distinct()
        front = checkpoint(step if seen is None else step.join(seen, ["r", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = front if seen is None else seen.unionByName(front)
    seen = front if seen is None else seen
    return seen.withColumnRenamed("at", "n").join(names, "n").join(roots.drop("repo_id"), "r").select("repo_id", "root", "path")


def impact(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target file (repo_id, path): direct and transitive importers, own imports, modules touched, risk."""
    roots = checkpoint(targets.select("repo_id", F.col("path").alias("file")).distinct())
    got = reach(imports, roots.select("repo_id", F.col("file").alias("root"), F.col("file").alias("path")))
    far = got.groupBy("repo_id", F.col("root").alias("file")).agg(
        F.sort_array(F.collect_set("path")).alias("affected_files"), F.sort_array(F.collect_set(paths.parent_dir(F.col("path")))).alias("affected_modules")
    )
    near = imports.select("repo_id", F.col("target").alias("file"), "path").groupBy("repo_id", "file").agg(F.sort_array(F.collect_list("path")).alias("direct_dependents"))
    own = imports.select("repo_id", F.col("path").alias("file"), "target").groupBy("repo_id", "file").agg(F.sort_array(F.collect_list("target")).alias("dependencies"))
    rows = roots
    for part in (far, near, own):
        rows = rows.join(part, ["repo_id", "file"], "left")
    empty = F.array().cast("array<string>")
    rows = rows.select("repo_id", "file", *(F.coalesce(c, empty).alias(c) for c in ("direct_dependents", "affected_files", "affected_modules", "dependencies")))
    n, m, d = F.size("affected_files"), F.size("affected_modules"), F.size("direct_dependents")
    level = F.when((n >= 10) | (m >= 5), "high").when((n >= 3) | (m >= 2), "medium").otherwise("low")
    spread = F.concat(n.cast("string"), F.lit(" file(s) across "), m.cast("string"), F.lit(" module(s) transitively import this file."))
    told = F.when(n == 0, F.array(F.lit("No files import this — the change is isolated to the file itself."))).otherwise(
        F.array_compact(F.array(spread, F.when(d > 0, F.concat(d.cast("string"), F.lit(" file(s) import it directly.")))))
    )
    return rows.withColumns({"affected_file_count": n.cast("long"), "risk_level": level, "risks": told})


def symbols(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """For each name asked for (repo_id, symbol): definitions by full or bare name with their callers and heirs."""
    code = nodes.where("kind in ('class', 'function')")
    keys = F.array_distinct(F.array_compact(F.array(F.col("name"), F.when(F.col("kind") == "function", F.substring_index("name", ".", -1)))))
    found = code.withColumn("symbol", F.explode(keys)).join(names.select("repo_id", "symbol").distinct(), ["repo_id", "symbol"])
    used = edges.where("kind in ('calls', 'extends', 'implements')").select("repo_id", F.col("target").alias("id"), F.col("source").alias("other"), F.col("kind").alias("via"))
    far = nodes.select("repo_id", F.col("id").alias("other"), F.col("name").alias("o_name"), F.col("path").alias("o_path"), F.col("line").alias("o_line"))
    one = F.struct(F.coalesce("o_path", F.lit("")).alias("path"), F.coalesce("o_line", F.lit(0)).alias("line"), F.col("o_name").alias("name"), "via")
    met = used.join(found.select("repo_id", "id").distinct(), ["repo_id", "id"], "left_semi").join(far, ["repo_id", "other"]).select("repo_id", "id", one.alias("user"))
    count = met.groupBy("repo_id", "id").agg(F.count("*").alias("reference_count"))
    first = met.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id", "id").orderBy("user"))).where(F.col("rank") <= dims.REFERENCE_LIMIT)
    users = count.join(first.groupBy("repo_id", "id").agg(F.sort_array(F.collect_list("user")).alias("referenced_by")), ["repo_id", "id"])
    out = found.join(users, ["repo_id", "id"], "left")
    return out.select("repo_id", "symbol", "name", "kind", "path", "line", "language", paths.parent_dir(F.col("path")).alias("module"), F.coalesce("reference_count", F.lit(0)).cast("long").alias("reference_count"), "referenced_by")


def tests_for(nodes: DataFrame, imports: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_id, source, test, matched_by): test files that import a source or are named after it."""
    own = sources.select("repo_id", F.col("path").alias("source")).distinct()
    tests = nodes.where((F.col("kind") == "file") & paths.is_test(F.col("path"))).select("repo_id", F.col("path").alias("test"))
    by_import = imports.select("repo_id", F.col("target").alias("source"), F.col("path").alias("test")).where(paths.is_test(F.col("test"))).join(own, ["repo_id", "source"], "left_semi")
    keyed = own.where(paths.stem(F.col("source")) != "").withColumn("stem", F.explode(paths.test_names(F.col("source"))))
    by_name = keyed.join(tests.withColumn("stem", paths.stem(F.col("test"))), ["repo_id", "stem"]).select("repo_id", "source", "test")
    both = by_import.withColumn("how", F.lit("imports")).unionByName(by_name.withColumn("how", F.lit("name")))
    return both.groupBy("repo_id", "source", "test").agg(F.sort_array(F.collect_set("how")).alias("matched_by"))


def hotspots(churn: DataFrame, imports: DataFrame, limit: int = 10) -> DataFrame:
    """Churn times in-degree, tests left out: repo_id, path, score, commits, imported_by."""
    rows = churn.where(~paths.is_test(F.col("path"))).join(in_degree(imports), ["repo_id", "path"])
    rows = rows.withColumn("score", F.col("commits") * F.col("imported_by")).where("score > 0")
    return rows.orderBy(F.desc("score"), F.desc("commits"), "path", "repo_id").limit(limit).select("repo_id", "path", "score", "commits", "imported_by")


def coverage(nodes: DataFrame, imports: DataFrame, languages) -> DataFrame:
    """How much of each repository's graph is connected: counts, connectivity and confidence."""
    ends = imports.select("repo_id", F.explode(F.array("path", "target")).alias("path")).distinct().withColumn("hit", F.lit(1))
    own = nodes.where((F.col("kind") == "file") & F.col("language").isin(*languages)).join(ends, ["repo_id", "path"], "left")
    rows = own.groupBy("repo_id").agg(F.count("*").alias("source_files"), F.count("hit").alias("connected_files"))
    rows = rows.join(imports.groupBy("repo_id").agg(F.count("*").alias("import_edges")), "repo_id", "left").fillna(0, ["import_edges"])
    share = F.bround(F.col("connected_files") / F.col("source_files"), 3)
    rows = rows.withColumns({"isolated_files": F.col("source_files") - F.col("connected_files"), "connectivity": share})
    n, c = F.col("source_files"), F.col("connectivity")
    return rows.withColumn("confidence", F.when(n < 5, "unknown").when(c >= 0.7, "high").when(c >= 0.5, "medium").otherwise("low"))
