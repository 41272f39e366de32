"""Change sets between two snapshots of files, what can be reused, churn and history of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..runtime import few


def change_set(now: DataFrame, before: DataFrame) -> DataFrame:
    """(repo_id, path, status) by comparing size and mtime: added, modified, deleted or unchanged."""
    a = now.select("repo_id", "path", F.struct("size", "mtime").alias("new"))
    b = before.select("repo_id", "path", F.struct("size", "mtime").alias("old"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return a.join(b, ["repo_id", "path"], "full_outer").select("repo_id", "path", status.alias("status"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("repo_id").agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("added", "modified", "deleted", "unchanged")))


def reuse(files: DataFrame, changes: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached rows that still hold, files to read again); imports are cached unresolved, so a row holds whatever else changed."""
    same = changes.where("status = 'unchanged'").select("repo_id", "path")
    kept = cached.join(same, ["repo_id", "path"], "left_semi")
    return kept, files.join(kept.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def latest(commits: DataFrame, most: int = dims.CHURN_COMMITS) -> DataFrame:
    """(repo_id, sha, ordinal) of each repository's latest ``most`` commits, counted."""
    n = F.row_number().over(Window.partitionBy("repo_id").orderBy("ordinal"))
    return few(commits.select("repo_id", "sha", "ordinal").withColumn("n", n).where(F.col("n") <= most).drop("n"))


def churn(commits: DataFrame, commit_files: DataFrame, most: int = dims.CHURN_COMMITS) -> DataFrame:
    """(repo_id, path, commits): how many of a repository's latest ``most`` commits touched a file; other commits' files go before any row is moved."""
    own = commit_files.join(latest(commits, most).select("repo_id", "sha"), ["repo_id", "sha"], "left_semi")
    return own.distinct().groupBy("repo_id", "path").agg(F.count("*").alias("commits"))


def history(commits: DataFrame, recent: int = 20) -> DataFrame:
    """Commits, first date (of the oldest root), last date, latest subjects, authors."""
    one = commits.groupBy("repo_id").agg(
        F.count("*").alias("total_commits"),
        F.min_by("author_date", "ordinal").alias("last_commit_date"),
        F.min_by("author_date", F.when(F.col("is_root"), F.col("ordinal"))).alias("first_commit_date"),
        F.count_distinct("author").alias("contributor_count"),
    )
    top = commits.withColumn("n", F.row_number().over(Window.partitionBy("repo_id").orderBy("ordinal"))).where(F.col("n") <= recent)
    subjects = F.transform(F.sort_array(F.collect_list(F.struct("n", "subject"))), lambda x: x["subject"])
    return one.join(top.groupBy("repo_id").agg(F.filter(subjects, lambda s: s != "").alias("recent_commits")), "repo_id")


def contributors(commits: DataFrame, limit: int = 5) -> DataFrame:
    """(repo_id, name, commits, rank)."""
    rows = commits.groupBy("repo_id", F.col("author").alias("name")).agg(F.count("*").alias("commits"))
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("commits"), "name"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)
