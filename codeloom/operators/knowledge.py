"""Why a repository is as it is: decisions, documents, patterns, coverage warnings, staleness; all by repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import paths, text
from ..runtime import checkpoint

#: Pairs of a file and a note that one task makes of a scope; a scope with more is cut into pieces.
PAIRS = 20_000_000
#: Notes that travel as one array.
PACK = 1_000

DECISIONS = "repo_id string, id string, title string, status string, date string, context string, rationale string, source string, ordinal int"


def _place(names) -> F.Column:
    """The place of ``path`` or its folder in a fixed list; null if it is not there."""
    return F.array_position(F.array(*map(F.lit, names)), F.col("k"))


def decisions(tree: DataFrame) -> DataFrame:
    """Decision records in the known folders: by folder, then path; of one id the first counts."""
    p, t = F.col("path"), F.coalesce("text", F.lit(""))
    rows = tree.where(~F.col("is_dir") & F.endswith(p, F.lit(".md")) & ~F.lower(paths.basename(p)).isin(*dims.ADR_SKIP))
    rows = rows.withColumn("k", paths.parent_dir(p)).withColumn("folder", _place(dims.ADR_DIRS)).where("folder > 0")
    heading = text.strip(F.regexp_extract(t, r"(?md)^#\s+(.*)$", 1))
    title = F.regexp_replace(heading, dims.ADR_NUMBER, "")
    status = F.filter(F.transform(F.split(text.section(t, "Status"), text.LINE_BREAKS), text.strip), lambda x: x != "")
    rows = rows.select(
        "repo_id",
        paths.stem(p).alias("id"),
        F.when(title != "", title).otherwise(paths.stem(p)).alias("title"),
        F.get(status, F.lit(0)).alias("status"),
        F.nullif(text.strip(F.regexp_extract(t, r"(?imd)^Date:\s*(.+)$", 1)), F.lit("")).alias("date"),
        text.section(t, "Context").alias("context"),
        text.section(t, "Decision").alias("rationale"),
        F.concat(F.lit("adr:"), p).alias("source"),
        F.struct("folder", "path").alias("o"),
    )
    rest = [c for c in rows.columns if c not in ("repo_id", "id")]
    one = rows.groupBy("repo_id", "id").agg(F.min_by(F.struct(*rest), "o").alias("r")).select("repo_id", "id", "r.*")
    by = Window.partitionBy("repo_id").orderBy("o")
    return one.withColumn("ordinal", F.row_number().over(by)).drop("o")


def documents(tree: DataFrame) -> DataFrame:
    """Briefs of the known documents, at most DOC_LIMIT a repository: source, title, summary, headings, ordinal."""
    t = F.col("text")
    rows = tree.where(~F.col("is_dir") & F.col("path").isin(*dims.DOC_CANDIDATES) & (text.strip(t) != "")).withColumn("k", F.col("path"))
    by = Window.partitionBy("repo_id").orderBy("place")
    rows = rows.withColumn("place", _place(dims.DOC_CANDIDATES)).withColumn("ordinal", F.row_number().over(by)).where(F.col("ordinal") <= dims.DOC_LIMIT)
    return rows.select("repo_id", F.col("path").alias("source"), *brief(t, paths.stem(F.col("path"))), "ordinal")


def brief(body: F.Column, name: F.Column) -> list:
    """title, summary and headings of a document; the first heading is the title, or else its name."""
    heads = text.headings(body)
    return [F.coalesce(F.get(heads, F.lit(0)), name).alias("title"), text.first_paragraph(body).alias("summary"), F.slice(heads, 2, dims.HEADING_LIMIT).alias("headings")]


def scoped(files: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, note): every note (note, scope) of a file, its own or a directory's above it, each pair once; null scopes mean nothing.

    A scope below another of the same note tells nothing new, so it goes; of the rest a path
    is under one at most, and no pair has to be compared with another.  The pairs of a
    directory are files times notes by nature: a scope of more than ``PAIRS`` has its files
    dealt out into pieces, which meet the notes packed in arrays.
    """
    ours = notes.where("scope is not null").groupBy("note").agg(F.collect_set("scope").alias("all"))
    top = F.filter("all", lambda s: ~F.exists("all", lambda o: F.startswith(s, F.concat(o, F.lit("/")))))
    ours = checkpoint(ours.select("note", F.explode(top).alias("scope")))
    up = files.select("path").distinct().select("path", F.explode(paths.ancestors(F.col("path"))).alias("scope"))
    size = ours.groupBy("scope").agg(F.count("*").alias("n")).join(up.groupBy("scope").agg(F.count("*").alias("f")), "scope")
    wide = checkpoint(size.where(F.col("n") * F.col("f") > PAIRS).select("scope", F.ceil(F.col("n") * F.col("f") / PAIRS).cast("int").alias("pieces"), F.ceil(F.col("n") / PACK).cast("int").alias("packs")))
    light = up.join(ours, "scope").select("path", "note")
    pieces = wide.agg(F.sum("pieces")).first()[0]
    if not pieces:
        return light
    known = F.broadcast(wide)  # a row for each PAIRS pairs of the result at most
    light = up.join(known, "scope", "left_anti").join(ours.join(known, "scope", "left_anti"), "scope").select("path", "note")
    packed = ours.join(known, "scope").groupBy("scope", "pieces", F.pmod(F.xxhash64("note"), "packs").alias("k")).agg(F.collect_list("note").alias("notes"))
    packed = packed.select("scope", "notes", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    dealt = up.join(known, "scope").select("path", "scope", F.pmod(F.xxhash64("path"), "pieces").cast("int").alias("piece"))
    many = min(pieces, 20_000)
    met = dealt.repartition(many, "scope", "piece").join(packed.repartition(many, "scope", "piece"), ["scope", "piece"])
    return light.unionByName(met.select("path", F.explode("notes").alias("note")))


def patterns(conventions: dict, style: str | None) -> list[dict]:
    """Named patterns of one repository from its conventions, in a fixed order of kinds."""
    one = lambda name, kind, description, evidence: {"name": name, "kind": kind, "description": description, "evidence": evidence}
    out, di, say = [], conventions.get("dependency_injection"), dims.PATTERN_SENTENCES
    if style:
        out.append(one(style, "architecture", say["architecture"].format(style), "directory layout"))
    if di:
        out.append(one(di, "dependency", say["dependency"].format(di), "declared dependencies"))
    flags = (n for n in conventions.get("patterns", ()) if n != "dependency_injection")
    out += [one(n, "structural", dims.PATTERN_TEXTS.get(n, n.replace("_", " ")), "directory and file names") for n in flags]
    out += [one(f"{s} {label}", "convention", say["convention"].format(label.capitalize(), s), "graph symbols") for label in ("classes", "functions") if (s := conventions.get(label))]
    framework = (conventions.get("testing") or {}).get("framework")
    if framework:
        out.append(one(framework, "testing", say["testing"].format(framework), "dependencies and test files"))
    return out


def language_coverage(files: DataFrame, languages) -> DataFrame:
    """repo_id, language, files, graphed: parsed languages first, then by number of files."""
    rows = files.where("language is not null").groupBy("repo_id", "language").agg(F.count("*").alias("files"))
    return rows.withColumn("graphed", F.col("language").isin(*languages) if languages else F.lit(False))


def warnings(coverage: DataFrame, by_language: DataFrame) -> DataFrame:
    """(repo_id, warnings): texts about low connectivity and about languages without a graph."""
    low = F.when((F.col("source_files") >= 5) & (F.col("connectivity") < 0.5), F.lit(1))
    detail = F.when(F.col("import_edges") == 0, F.lit(dims.NO_IMPORTS)).otherwise(F.format_string(dims.FEW_IMPORTS, F.bround(F.col("connectivity") * 100).cast("int")))
    said = F.when(low.isNotNull(), F.format_string(dims.LOW_CONNECTIVITY, detail, F.col("source_files")))
    names = by_language.where("not graphed").groupBy("repo_id").agg(F.sort_array(F.collect_list("language")).alias("names"))  # a few dozen languages at most
    rest = F.when(F.size("names") > 0, F.format_string(dims.INVENTORY_ONLY, F.array_join("names", ", ")))
    rows = coverage.join(names, "repo_id", "full_outer")
    return rows.select("repo_id", F.array_compact(F.array(said, rest)).alias("warnings"))


def staleness(built: str | None, current: str | None, changed: int | None) -> dict:
    """Whether memory built at one commit still tells the truth at another; ``changed``: files that differ, None if unknown."""
    out = {"is_git": current is not None, "stale": False, "built_at_commit": built, "current_commit": current, "changed_files": 0, "message": None}
    if current is None:
        return out
    if not built:
        return out | {"message": dims.NO_STAMP}
    if changed is None:
        moved = built != current
        return out | {"stale": moved, "message": dims.HEAD_MOVED.format(built[:8], current[:8]) if moved else None}
    return out | {"changed_files": changed, "stale": changed > 0, "message": dims.FILES_CHANGED.format(built[:8], changed) if changed else None}
