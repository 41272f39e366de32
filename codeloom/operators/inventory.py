"""Inventory of trees: files, languages, modules, layers, configs, dependencies, headline counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import paths, text


def files(tree: DataFrame) -> DataFrame:
    """One row for each file; language null and loc 0 for what is not hand-written source."""
    p = F.col("path")
    rows = tree.where(~F.col("is_dir")).withColumn("raw_language", paths.raw_language(p))
    rows = rows.withColumn("language", F.when(~paths.is_generated(p), F.col("raw_language")))
    return rows.select("repo_id", "path", "raw_language", "language", "size", "mtime", F.when(F.col("language").isNotNull(), paths.loc(F.col("text"))).otherwise(0).cast("long").alias("loc"))


def directories(tree: DataFrame) -> DataFrame:
    return tree.where("is_dir").select("repo_id", "path")


def language_stats(files: DataFrame) -> DataFrame:
    """Source files by language, generated ones included; rank 1 is the primary language."""
    counts = files.where("raw_language is not null").groupBy("repo_id", F.col("raw_language").alias("language")).agg(F.count("*").alias("files"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("files"), "language")).cast("long"))


def source_dirs(files: DataFrame) -> DataFrame:
    return files.where("raw_language is not null").select("repo_id", paths.parent_dir(F.col("path")).alias("path")).distinct()


def modules(files: DataFrame) -> DataFrame:
    """Directories that directly hold source, with their dominant language (ties: the smallest name)."""
    per = files.where("language is not null").groupBy("repo_id", paths.parent_dir(F.col("path")).alias("path"), "language").agg(F.count("*").alias("n"))
    top = F.min_by("language", F.struct(-F.col("n"), F.col("language")))
    return per.groupBy("repo_id", "path").agg(top.alias("language"), F.sum("n").alias("file_count"))


def layers(modules: DataFrame) -> DataFrame:
    rows = modules.groupBy("repo_id", paths.layer_of(F.col("path")).alias("name"))
    return rows.agg(F.sort_array(F.collect_list("path")).alias("modules"), F.sum("file_count").alias("file_count"))


def configs(files: DataFrame) -> DataFrame:
    return files.where(paths.is_config(F.col("path"))).select("repo_id", "path")


def dedup_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``: an aggregate, so nothing is sorted and a hot key is cut down before it moves."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return one.select(*keys, "_r.*").select(*rows.columns)


def top_dependencies(dependencies: DataFrame, limit: int = dims.DEP_LIMIT) -> DataFrame:
    """Runtime dependencies first, by lower-cased name, each name once: repo_id, name, rank."""
    lowest = dependencies.groupBy("repo_id", "name").agg(F.min(F.struct("dev", F.lower("name").alias("low"), "ordinal")).alias("k"))
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy("k"))
    return lowest.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).select("repo_id", "name", "rank")


def counts(tree: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """file_count, source_files, total_loc, directory_count, module_count by repository."""
    own = files.groupBy("repo_id").agg(F.count("*").alias("file_count"), F.count("language").alias("source_files"), F.sum("loc").alias("total_loc"))
    dirs = directories(tree).groupBy("repo_id").agg(F.count("*").alias("directory_count"))
    mods = modules.groupBy("repo_id").agg(F.count("*").alias("module_count"))
    out = own.join(dirs, "repo_id", "left").join(mods, "repo_id", "left")
    return out.fillna(0, ["directory_count", "module_count"])


# ---- conventions ---------------------------------------------------------------


def file_naming(files: DataFrame) -> DataFrame:
    style = text.file_style(F.col("path"))
    rows = files.where("language is not null").groupBy("repo_id").agg(*(F.count(F.when(style == s, 1)).alias(s) for s in dims.FILE_STYLES))
    return rows.withColumn("file_naming", text.dominant({s: F.col(f"`{s}`") for s in dims.FILE_STYLES}))


def symbol_naming(nodes: DataFrame, kind: str) -> DataFrame:
    """repo_id, language, a count for each style, the dominant style and all symbols of the language."""
    rows = nodes.where((F.col("kind") == kind) & F.col("path").isNotNull()).withColumn("lang", paths.raw_language(F.col("path"))).where("lang is not null")
    style = text.identifier_style(F.substring_index("name", ".", -1))
    rows = rows.withColumn("style", style).groupBy("repo_id", F.col("lang").alias("language"))
    rows = rows.agg(*(F.count(F.when(F.col("style") == s, 1)).alias(s) for s in dims.SYMBOL_STYLES), F.count("*").alias("symbols"))
    return rows.withColumn("dominant", text.dominant({s: F.col(s) for s in dims.SYMBOL_STYLES}))


def primary_style(naming: DataFrame, primary: DataFrame) -> DataFrame:
    """repo_id, style: the primary language's, else that of the language with most symbols (then the largest name)."""
    own = naming.where("dominant is not null").join(primary.select("repo_id", F.col("language").alias("primary")), "repo_id", "left")
    best = F.max_by("dominant", F.struct((F.col("language") == F.coalesce("primary", F.lit(""))).alias("is_primary"), "symbols", "language"))
    return own.groupBy("repo_id").agg(best.alias("style"))


def segments(directories: DataFrame) -> DataFrame:
    """Distinct lower-cased directory parts, the source root stripped."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    own = F.when(F.get(parts, F.lit(0)).isin(*dims.SOURCE_ROOTS), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    return directories.select("repo_id", F.explode(own).alias("s")).select("repo_id", F.lower("s").alias("segment")).distinct()


def file_tokens(files: DataFrame) -> DataFrame:
    """Distinct lower-cased stems of source files, and their parts at - and _."""
    s = F.lower(paths.stem(F.col("path")))
    rows = files.where("language is not null").select("repo_id", F.explode(F.array_union(F.array(s), F.split(s, "[_-]"))).alias("segment"))
    return rows.where("segment <> ''").distinct()


def layering(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("segment").isin(*dims.LAYER_NAMES)).select("repo_id", "segment")


def pattern_flags(words: DataFrame) -> DataFrame:
    """Structural patterns by repository, in a fixed order, from directory parts and file tokens."""
    w, any_ = F.col("segment"), lambda c: F.bool_or(c)
    flags = {
        "repository_pattern": any_(F.startswith(w, F.lit("repositor"))),
        "service_layer": any_(F.startswith(w, F.lit("service"))),
        "controller_layer": any_(F.startswith(w, F.lit("controller"))),
        "use_case_pattern": any_(w.isin("usecases", "use_cases")),
        "feature_modules": any_(w.isin("features", "modules")),
    }
    rows = words.groupBy("repo_id").agg(*(c.alias(n) for n, c in flags.items()))
    return rows.select("repo_id", F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in flags))).alias("patterns"))


def source_layout(modules: DataFrame) -> DataFrame:
    top = F.get(F.split("path", "/"), F.lit(0))
    return modules.groupBy("repo_id").agg(F.when(F.bool_or(top == "src"), "src").when(F.bool_or(top == "lib"), "lib").otherwise("flat").alias("source_layout"))


def testing(files: DataFrame, directories: DataFrame, dependencies: DataFrame) -> DataFrame:
    """repo_id, framework, test_dir, test_count."""
    hit = F.col("path").rlike(dims.TEST_FILE)
    own = files.groupBy("repo_id").agg(F.count(F.when(hit, 1)).alias("test_count"), F.bool_or(hit & F.endswith("path", F.lit(".py"))).alias("py"))
    dirs = directories.where(paths.basename(F.col("path")).isin("test", "tests")).groupBy("repo_id").agg(F.min("path").alias("test_dir"))
    name = F.lower("name")
    deps = dependencies.groupBy("repo_id").agg(F.bool_or(name == "pytest").alias("pytest"), F.bool_or(name == "flutter_test").alias("flutter"))
    rows = own.join(dirs, "repo_id", "left").join(deps, "repo_id", "left")
    framework = F.when(F.col("pytest"), "pytest").when(F.col("flutter"), "flutter_test").when(F.col("py"), "unittest")
    return rows.select("repo_id", framework.alias("framework"), "test_dir", "test_count")


def architecture_style(files: DataFrame) -> DataFrame:
    """repo_id, style, evidence: the most specific style that the source directories' names show; null if none does."""
    words = source_dirs(files).select("repo_id", F.explode(F.split(F.lower("path"), "/")).alias("s"))
    named = ("domain", "data", "presentation", "application", "infrastructure", "features", "modules", "models", "views", "controllers", "src", "lib")
    one = words.groupBy("repo_id").agg(
        *(F.bool_or(F.col("s") == n).alias(n) for n in named), *(F.bool_or(F.startswith("s", F.lit(p))).cast("int").alias(f"p_{p}") for p in ("controller", "service", "repositor"))
    )
    has = lambda *n: F.expr(" and ".join(n))
    rules = (
        (has("domain", "data", "presentation") | has("domain", "application", "infrastructure"), "Clean Architecture", "domain/data/presentation layers"),
        (F.expr("features or modules"), "Feature Based", "features/ or modules/ directory"),
        (F.expr("p_controller + p_service + p_repositor >= 2"), "Layered", "controller/service/repository directories"),
        (has("models", "views", "controllers"), "MVC", "models/views/controllers directories"),
        (F.expr("src or lib"), "Standard (src/lib layout)", "src/ or lib/ directory"),
    )
    pick = lambda i: F.coalesce(*(F.when(r[0], F.lit(r[i])) for r in rules))
    return one.select("repo_id", pick(1).alias("style"), pick(2).alias("evidence"))
