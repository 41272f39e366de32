"""Predicates and parts of repository-relative POSIX paths, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def any_suffix(c: Column, suffixes) -> Column:
    return reduce(or_, (F.endswith(c, F.lit(s)) for s in suffixes))


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def parent_dir(p: Column) -> Column:
    """The directory, "." for the root."""
    return F.when(F.instr(p, "/") > 0, F.substring(p, F.lit(1), F.length(p) - F.length(basename(p)) - 1)).otherwise(F.lit("."))


def suffix(p: Column) -> Column:
    """The last extension with its dot; none for names like ".py"."""
    return F.regexp_extract(basename(p), r"^.+(\.[^.]+)$", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"^(.+)\.[^.]+$", "$1")


def raw_language(p: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in dims.CODE_EXTENSIONS.items() for x in kv))
    return F.try_element_at(table, F.lower(suffix(p)))


def is_generated(p: Column) -> Column:
    return any_suffix(p, dims.GENERATED_SUFFIXES)


def language(p: Column) -> Column:
    """Null for what is not hand-written source."""
    return F.when(~is_generated(p), raw_language(p))


def is_ignored(p: Column) -> Column:
    return F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, dims.IGNORED_DIRS)))


def is_sensitive(p: Column) -> Column:
    name = F.lower(basename(p))
    dotenv = (name == ".env") | (F.startswith(name, F.lit(".env.")) & ~any_suffix(name, dims.ENV_SAFE_SUFFIXES))
    return dotenv | any_suffix(name, dims.SECRET_SUFFIXES) | name.isin(*dims.SECRET_FILENAMES)


def is_test(p: Column) -> Column:
    """Test code by a directory above the last part, or by the file's name."""
    parts, name = F.split(p, "/"), F.lower(basename(p))
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.arrays_overlap(above, F.array(*map(F.lit, dims.TEST_SEGMENTS))) | any_suffix(name, dims.TEST_NAME_SUFFIXES) | F.startswith(bare, F.lit("test_")) | F.endswith(bare, F.lit("_test"))


def has_test_segment(p: Column) -> Column:
    """Any part, the last one included, is a test directory's name."""
    return F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, dims.TEST_SEGMENTS)))


def is_config(p: Column) -> Column:
    workflow = F.startswith(p, F.lit(".github/workflows/")) & any_suffix(p, (".yml", ".yaml"))
    return basename(p).isin(*dims.CONFIG_FILENAMES) | workflow | ((F.instr(p, "/") == 0) & suffix(p).isin(".toml", ".cfg", ".ini"))


def layer_of(p: Column) -> Column:
    parts = F.split(p, "/")
    first = F.get(parts, F.lit(0))
    name = F.when(first.isin(*dims.SOURCE_ROOTS), F.get(parts, F.lit(1))).otherwise(first)
    return F.coalesce(F.when(name != "", name), F.lit("(root)"))


def depth(p: Column) -> Column:
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def loc(text: Column) -> Column:
    """Lines by \\n; an unfinished last line counts, an empty text has none."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce(F.when(text != "", breaks + (~F.endswith(text, F.lit("\n"))).cast("int")), F.lit(0)).cast("long")


def ancestors(p: Column) -> Column:
    """The path and every directory above it, within the path's own parts."""
    parts = F.split(p, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def tails(p: Column) -> Column:
    """The path and every suffix of it at a segment boundary: a suffix match becomes an equi-join."""
    parts = F.split(p, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def resolve_relative(directory: Column, spec: Column) -> Column:
    """``spec`` against a directory's parts: "." and "" stay, ".." climbs and stops at the root."""
    start = F.filter(F.split(directory, "/"), lambda s: (s != "") & (s != "."))
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(spec, "/"), start, step), "/")


def feature_root(p: Column, segment: Column) -> Column:
    """The path up to the first part that equals ``segment``."""
    parts = F.split(p, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.array_position(parts, segment).cast("int")), "/")


def test_names(source: Column) -> Column:
    """The stems that a test of ``source`` has by convention."""
    s = stem(source)
    return F.array(F.concat(s, F.lit("_test")), F.concat(F.lit("test_"), s), F.concat(s, F.lit("_spec")), F.concat(s, F.lit(".test")), F.concat(s, F.lit(".spec")))
