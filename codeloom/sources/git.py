"""The "gitlog" source: commits or commit files of repositories as Arrow batches, one partition each, by the git command.

A folder outside a work tree, a repository without commits or a missing binary gives
no rows.  A call that fails or takes over SECONDS gives one row of repo_id and error,
all else null, so a history that could not be read does not look like none.
"""

from __future__ import annotations

import json
import subprocess

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas

SECONDS = 15


def call(root: str, *args: str) -> tuple[str | None, str | None]:
    """(output, None), or (None, what went wrong)."""
    try:
        done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, timeout=SECONDS)
    except subprocess.TimeoutExpired:
        return None, f"git {args[0]} took more than {SECONDS} seconds"
    except (OSError, subprocess.SubprocessError) as e:
        return None, f"git {args[0]}: {type(e).__name__}"
    if done.returncode:
        return None, f"git {args[0]} ended with {done.returncode}"
    return done.stdout.decode("utf-8", "replace"), None


def git(root: str, *args: str) -> str | None:
    return call(root, *args)[0]


def head(root: str) -> str | None:
    return (git(root, "rev-parse", "HEAD") or "").strip() or None


def changed_since(root: str, commit: str) -> int | None:
    """Tracked files that differ between a commit and the working tree; None if that can't be told."""
    out = git(root, "diff", "--name-only", commit)
    return None if out is None else sum(1 for x in out.splitlines() if x.strip())


class _Part(InputPartition):
    def __init__(self, repo: str, root: str):
        self.repo, self.root = repo, root


class GitSource(DataSource):
    """Options ``roots`` (JSON object of repo_id and folder), ``table`` ("commits" or "files"), ``max_commits``."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return schemas.COMMIT_FILES if self.options.get("table") == "files" else schemas.COMMITS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("roots", "{}")), self.options.get("table") == "files", self.options.get("max_commits"))


class _Reader(DataSourceReader):
    def __init__(self, roots, files, most):
        self.roots, self.files, self.most = roots, files, most

    def partitions(self):
        return [_Part(*x) for x in self.roots.items()] or [_Part("", "")]

    def read(self, part):
        schema, rows = _FILES if self.files else _COMMITS, []
        for row in self._rows(part):
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    def _rows(self, part):
        if not part.root or (git(part.root, "rev-parse", "--is-inside-work-tree") or "").strip() != "true" or head(part.root) is None:
            return
        limit = [f"-n{int(self.most)}"] if self.most else []
        form = ["--relative", "--name-only", "--format=%x01%H"] if self.files else ["--format=%H%x01%an%x01%aI%x01%P%x01%s"]
        out, error = call(part.root, "log", *limit, *form)
        if error:
            yield (part.repo, *[None] * (2 if self.files else 6), error)
            return
        lines = filter(None, out.split("\n"))
        if not self.files:
            for i, line in enumerate(lines):
                sha, author, date, parents, subject = line.split("\x01", 4)
                yield part.repo, sha, author, date, subject, not parents, i, None
            return
        sha = None
        for line in lines:
            if line.startswith("\x01"):
                sha = line[1:]
            elif line.strip():
                yield part.repo, sha, line.strip(), None


BATCH = 10_000
_TEXTS = lambda *names: [(n, pa.string()) for n in names]
_FILES = pa.schema(_TEXTS("repo_id", "sha", "path", "error"))
_COMMITS = pa.schema([*_TEXTS("repo_id", "sha", "author", "author_date", "subject"), ("is_root", pa.bool_()), ("ordinal", pa.int64()), ("error", pa.string())])


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
