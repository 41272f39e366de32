"""The "repotree" source: files of source trees, one partition for each repository or top-level folder.

Ignored directories are pruned while walking and secrets are never opened.  Links
to directories are not followed.  A corpus that already lies in a table of
(repo_id, path, text) goes through ``from_table`` instead and stays in the JVM.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import dims, schemas
from ..functions import paths

READABLE = (".md", ".rst", ".toml", ".yaml", ".yml", ".txt", ".cfg", ".ini", ".lock", *dims.CODE_EXTENSIONS)


def sensitive(name: str) -> bool:
    name = name.lower()
    if name == ".env" or name.startswith(".env.") and not name.endswith(dims.ENV_SAFE_SUFFIXES):
        return True
    return name.endswith(dims.SECRET_SUFFIXES) or name in dims.SECRET_FILENAMES


def resolve_root(path: str | Path) -> str:
    """The folder itself if it holds a manifest or not exactly one child does; else that child."""
    root = Path(path).resolve()
    marked = lambda d: any((d / m).exists() for m in dims.PROJECT_MARKERS)
    if marked(root) or not root.is_dir():
        return str(root)
    inside = [d for d in root.iterdir() if d.is_dir() and d.name not in dims.IGNORED_DIRS and marked(d)]
    return str(inside[0] if len(inside) == 1 else root)


class _Part(InputPartition):
    def __init__(self, repo: str, root: str, top: str | None):
        self.repo, self.root, self.top = repo, root, top


class TreeSource(DataSource):
    """Option ``roots``: a JSON object of repo_id and folder; ``split``: "top" gives each top-level folder its own partition."""

    @classmethod
    def name(cls) -> str:
        return "repotree"

    def schema(self) -> str:
        return schemas.TREE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("roots", "{}")), self.options.get("split", "repo") == "top")


class _Reader(DataSourceReader):
    def __init__(self, roots: dict[str, str], split: bool):
        self.roots, self.split = roots, split

    def partitions(self):
        out = []
        for repo, root in self.roots.items():
            tops = [d.name for d in os.scandir(root) if d.is_dir(follow_symlinks=False) and d.name not in dims.IGNORED_DIRS] if self.split and os.path.isdir(root) else []
            out += [_Part(repo, root, t) for t in sorted(tops)]
            out.append(_Part(repo, root, "" if self.split else None))  # "": only what lies directly in the root
        return out or [_Part("", "", "")]

    def read(self, part):
        """Arrow batches of about BATCH characters of text; a larger text ends its batch."""
        rows, held = [], 0
        for row in self._rows(part):
            rows.append(row)
            held += 64 + len(row[5] or "")
            if held >= BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, part):
        if not part.root:
            return
        start = os.path.join(part.root, part.top) if part.top else part.root
        if part.top:
            yield part.repo, part.top, True, 0, 0.0, None
        for folder, dirs, files in os.walk(start):
            dirs[:] = [] if part.top == "" else sorted(d for d in dirs if d not in dims.IGNORED_DIRS)
            rel = os.path.relpath(folder, part.root).replace(os.sep, "/")
            rel = "" if rel == "." else rel + "/"
            for d in dirs:
                yield part.repo, rel + d, True, 0, 0.0, None
            for f in sorted(files):
                if f in dims.IGNORED_DIRS or sensitive(f):
                    continue
                full, size, mtime, text = os.path.join(folder, f), 0, 0.0, None
                try:
                    s = os.stat(full)
                    size, mtime = s.st_size, s.st_mtime
                    if f.lower().endswith(READABLE) or f in dims.CONFIG_FILENAMES:
                        with open(full, "rb") as h:
                            text = h.read().decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
                except OSError:
                    pass
                yield part.repo, rel + f, False, size, mtime, text


BATCH = 4 << 20
_TREE = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime", pa.float64()), ("text", pa.string())])


def _batch(rows):
    """Bytes of a path that are not UTF-8 become the replacement character."""
    rows = [(r[0], r[1].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), *r[2:]) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _TREE)], schema=_TREE)


def from_table(rows: DataFrame) -> DataFrame:
    """A tree from a table of (repo_id, path, text): the same rows that a walk would give, by predicates."""
    keep = ~paths.is_ignored(F.col("path")) & ~paths.is_sensitive(F.col("path"))
    size = F.col("size") if "size" in rows.columns else F.octet_length("text")
    mtime = F.col("mtime") if "mtime" in rows.columns else F.lit(0.0)
    own = rows.where(keep).select("repo_id", "path", F.lit(False).alias("is_dir"), size.cast("long").alias("size"), mtime.cast("double").alias("mtime"), "text")
    above = F.explode(F.filter(paths.ancestors(paths.parent_dir(F.col("path"))), lambda d: d != "."))
    dirs = own.select("repo_id", above.alias("path")).distinct()
    return own.unionByName(dirs.select("repo_id", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("mtime"), F.lit(None).cast("string").alias("text")))
