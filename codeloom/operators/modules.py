"""Modules and what is asked of them: summaries, explanations, features, for many targets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import paths
from ..runtime import checkpoint
from . import graph


def module_edges(imports: DataFrame) -> DataFrame:
    """(repo_id, path, target): distinct imports between different modules."""
    rows = imports.select("repo_id", paths.parent_dir(F.col("path")).alias("path"), paths.parent_dir(F.col("target")).alias("target"))
    return rows.where("path <> target").distinct()


def summarize(files: DataFrame, modules: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """Every module with loc, classes, functions, files and the modules it imports."""
    own = files.where("language is not null").groupBy("repo_id", paths.parent_dir(F.col("path")).alias("path")).agg(F.sum("loc").alias("loc"), F.sort_array(F.collect_list("path")).alias("files"))
    kinds = nodes.where("kind in ('class', 'function')").groupBy("repo_id", paths.parent_dir(F.col("path")).alias("path"))
    kinds = kinds.agg(F.count(F.when(F.col("kind") == "class", 1)).alias("classes"), F.count(F.when(F.col("kind") == "function", 1)).alias("functions"))
    out = module_edges(imports).groupBy("repo_id", "path").agg(F.sort_array(F.collect_set("target")).alias("imports"))
    rows = modules
    for part in (own, kinds, out):
        rows = rows.join(part, ["repo_id", "path"], "left")
    empty = F.array().cast("array<string>")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("repo_id", "path", "language", "file_count", number("loc"), number("classes"), number("functions"), F.coalesce("files", empty).alias("files"), F.coalesce("imports", empty).alias("imports"))


def resolve(modules: DataFrame, targets: DataFrame) -> DataFrame:
    """(repo_id, target) -> root: a module or any directory above one, named in full, by its tail or its last part; source before tests, then the shallowest."""
    dirs = modules.select("repo_id", F.explode(paths.ancestors(F.col("path"))).alias("root")).distinct()
    keyed = dirs.select("repo_id", "root", F.explode(paths.tails(F.col("root"))).alias("q"))
    asked = targets.select("repo_id", "target", F.btrim("target", F.lit("/")).alias("q")).where("q <> ''")
    best = F.min_by("root", F.struct(paths.has_test_segment(F.col("root")), paths.depth(F.col("root")), "root"))
    return asked.join(keyed, ["repo_id", "q"]).groupBy("repo_id", "target").agg(best.alias("root"))


def resolve_feature(modules: DataFrame, names: DataFrame) -> DataFrame:
    """(repo_id, target) -> root: up to the segment's first place in the best module that has it."""
    keyed = modules.select("repo_id", "path", F.explode(F.array_distinct(F.split("path", "/"))).alias("q"))
    asked = names.select("repo_id", "target", F.btrim("target", F.lit("/")).alias("q"))
    best = F.min_by("path", F.struct(paths.is_test(F.col("path")), paths.depth(F.col("path")), "path"))
    rows = asked.join(keyed, ["repo_id", "q"]).groupBy("repo_id", "target", "q").agg(best.alias("path"))
    return rows.select("repo_id", "target", paths.feature_root(F.col("path"), F.col("q")).alias("root"))


def members(modules: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo_id, root, path): a subtree's modules; by equality on exploded ancestors, so no prefix join is needed."""
    up = modules.select("repo_id", "path", F.explode(paths.ancestors(F.col("path"))).alias("root"))
    return up.join(roots.select("repo_id", "root").distinct(), ["repo_id", "root"]).select("repo_id", "root", "path")


def crossing(edges: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what a subtree's modules import outside, who outside imports them): (repo_id, root, path) each."""
    key = ["repo_id", "root", "path"]
    there = inside.join(edges, ["repo_id", "path"]).select("repo_id", "root", F.col("target").alias("path")).distinct()
    back = inside.withColumnRenamed("path", "target").join(edges, ["repo_id", "target"]).select("repo_id", "root", "path").distinct()
    return there.join(inside, key, "left_anti"), back.join(inside, key, "left_anti")


def _lists(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("repo_id", "root").agg(F.sort_array(F.collect_list("path")).alias(name))


def role(classes: Column) -> Column:
    """The phrase of the first suffix that any class name ends with."""

    def ends(suffix):
        return F.exists(classes, lambda c: F.endswith(c, F.lit(suffix)))

    return F.coalesce(*(F.when(ends(s), F.lit(p)) for s, p in dims.ROLE_SUFFIXES))


def explain(summary: DataFrame, nodes: DataFrame, imports: DataFrame, targets: DataFrame, entry_points: DataFrame | None = None) -> DataFrame:
    """For each target (repo_id, target) that resolves: totals, classes, neighbours, critical files, blast radius, risk and purpose."""
    found = checkpoint(resolve(summary, targets))
    inside = checkpoint(members(summary, found))
    edges = checkpoint(module_edges(imports))
    key = ["repo_id", "root"]
    deps, users = crossing(edges, inside)
    per = inside.join(summary, ["repo_id", "path"])
    total = per.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("file_count", "classes", "functions", "loc")), F.count("*").alias("modules"))
    langs = per.groupBy(*key, "language").agg(F.sum("file_count").alias("n")).groupBy(*key).agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language"))
    files = checkpoint(per.select("repo_id", "root", F.explode("files").alias("path")))
    own = files.join(nodes.where("kind = 'class'").select("repo_id", "path", "name"), ["repo_id", "path"]).groupBy(*key).agg(F.sort_array(F.collect_set("name")).alias("all_classes"))
    degree = files.join(graph.in_degree(imports), ["repo_id", "path"])
    critical = degree.groupBy(*key).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("imported_by")).alias("n"), "path"))), 1, dims.CRITICAL_LIMIT).alias("c"))
    critical = critical.select(*key, F.transform("c", lambda x: x["path"]).alias("critical_files"))
    far = graph.reach(imports, files).join(files, ["repo_id", "root", "path"], "left_anti")
    blast = far.groupBy(*key).agg(F.count("*").alias("blast_radius"))
    rows = found
    parts = [total, langs, own, critical, blast, _lists(deps, "dependencies"), _lists(users, "consumers")]
    if entry_points is not None:
        parts.append(_lists(files.join(entry_points, ["repo_id", "path"], "left_semi"), "entry_points"))
    for part in parts:
        rows = rows.join(part, key, "left")
    empty = F.array().cast("array<string>")
    for c in ("all_classes", "critical_files", "dependencies", "consumers"):
        rows = rows.withColumn(c, F.coalesce(c, empty))
    rows = rows.withColumn("blast_radius", F.coalesce("blast_radius", F.lit(0)).cast("long"))
    n, b, loc = F.size("consumers"), F.col("blast_radius"), F.col("loc")
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    risks = F.array_compact(
        F.array(
            F.when(n > 0, text("Imported by ", n, " other module(s) — changes ripple to consumers.")),
            F.when(b > 0, text(b, " file(s) transitively depend on this.")),
            F.when(loc >= 1000, text("Large (", loc, " LOC) widens the surface for regressions.")),
            F.when((n == 0) & (b == 0), F.lit("No internal consumers — likely safe to change in isolation.")),
        )
    )
    feature = F.col("modules") > 1
    name = F.when(F.col("root") == ".", "the root package").otherwise(paths.basename(F.col("root")))
    detail = text("defines ", F.col("classes"), " class(es) and ", F.col("functions"), " function(s) across ", F.col("file_count"), " file(s)")
    detail = F.concat(detail, F.when(feature, text(" in ", F.col("modules"), " sub-modules")).otherwise(""))
    detail = F.when(F.col("language").isNotNull(), text("is written in ", F.col("language"), " and ", detail)).otherwise(detail)
    what = role(F.col("all_classes"))
    purpose = F.concat(text("The `", name, "` "), F.when(feature, "feature ").otherwise("module "), detail, F.lit("."), F.when(what.isNotNull(), text(" It primarily ", what, ".")).otherwise(""))
    level = F.when((b >= 10) | (n >= 5), "high").when((b >= 3) | (n >= 2), "medium").otherwise("low")
    rows = rows.withColumns({"risks": risks, "risk_level": level, "purpose": purpose, "key_classes": F.slice("all_classes", 1, dims.KEY_CLASS_LIMIT)})
    return rows.drop("all_classes").withColumnRenamed("root", "module")


def features(summary: DataFrame, imports: DataFrame, names: DataFrame) -> DataFrame:
    """For each name (repo_id, target): its subtree's modules, totals of what is not test code, neighbours."""
    found = checkpoint(resolve_feature(summary, names))
    inside = checkpoint(members(summary, found))
    key = ["repo_id", "root"]
    deps, users = crossing(checkpoint(module_edges(imports)), inside)
    per = inside.join(summary, ["repo_id", "path"]).withColumn("t", paths.is_test(F.col("path")))
    sums = [F.coalesce(F.sum(F.when(~F.col("t"), F.col(c))), F.lit(0)).alias(c) for c in ("file_count", "loc", "classes", "functions")]
    total = per.groupBy(*key).agg(F.sort_array(F.collect_list("path")).alias("modules"), F.sort_array(F.collect_list(F.when(F.col("t"), F.col("path")))).alias("test_modules"), *sums)
    langs = per.groupBy(*key, "language").agg(F.sum("file_count").alias("n"))
    langs = langs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("language", "n"))).alias("languages"))
    rows = found
    for part in (total, langs, _lists(deps, "depends_on"), _lists(users, "consumers")):
        rows = rows.join(part, key, "left")
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("depends_on", "consumers")})
