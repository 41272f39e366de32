"""Naming styles, requirement lines, slugs, token estimates, document briefs: Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .paths import stem

#: Where Python's str.splitlines() breaks a text.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "")


def identifier_style(name: Column) -> Column:
    """A casing label; null for names that are no choice (dunders, only underscores)."""
    core = F.btrim(name, F.lit("_"))
    skip = (core == "") | (F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__")))
    return (
        F.when(skip, None)
        .when((F.instr(core, "_") > 0) & core.rlike(dims.SCREAMING), "SCREAMING_SNAKE")
        .when(core.rlike(dims.PASCAL), "PascalCase")
        .when(core.rlike(dims.CAMEL), "camelCase")
        .when(core.rlike(dims.SNAKE), "snake_case")
        .otherwise("other")
    )


def file_style(path: Column) -> Column:
    s = stem(path)
    snake = s.rlike(dims.SNAKE)
    return (
        F.when(snake & (F.instr(s, "_") > 0), "snake_case")
        .when(s.rlike(dims.KEBAB) & (F.instr(s, "-") > 0), "kebab-case")
        .when(s.rlike(dims.CAMEL), "camelCase")
        .when(snake, "snake_case")
        .otherwise("other")
    )


def dominant(counts: dict[str, Column]) -> Column:
    """The label with the highest count, in declared order on ties; "mixed" without a majority, null without any."""
    labels = list(counts)
    total = sum((counts[x] for x in labels[1:]), counts[labels[0]])
    top = F.greatest(*counts.values())
    label = F.coalesce(*(F.when(counts[x] == top, F.lit(x)) for x in labels))
    return F.when(total == 0, None).when(label == "other", "mixed").when(top / total >= dims.MAJORITY, label).otherwise("mixed")


def requirement_name(spec: Column) -> Column:
    return F.nullif(F.regexp_extract(spec, r"^\s*([A-Za-z0-9._-]+)", 1), F.lit(""))


def requirement_version(spec: Column) -> Column:
    """What follows the name and its extras; null if nothing does."""
    return F.nullif(strip(F.regexp_extract(spec, r"^\s*[A-Za-z0-9._-]+\s*(?:\[[^\]]*\])?\s*(.*)$", 1)), F.lit(""))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def tokens_of(chars: Column) -> Column:
    return F.ceil(chars / dims.CHARS_PER_TOKEN).cast("long")


def first_match(blob: Column, needles) -> Column:
    """The label of the first needle that the text holds; at most a few dozen needles, no join needed."""
    return F.coalesce(*(F.when(F.contains(blob, F.lit(n)), F.lit(label)) for n, label in needles))


def all_matches(blob: Column, needles) -> Column:
    """The labels of all needles that the text holds, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(blob, F.lit(n)), F.lit(label)) for n, label in needles))))


def headings(text: Column) -> Column:
    """Markdown headings of the first three levels, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,3}\s+(.+?)\s*#*$"), F.lit(1))
    return F.transform(found, strip)


def first_paragraph(text: Column) -> Column:
    """The first lines of prose up to a blank one, cut at SUMMARY_CHARS; null without any.

    The paragraph is cut out first, so only its own lines are split and looked at.
    """
    noise, blank, breaks = r"(?:#|!|<|\[!|---|===|```)", r"[ \t\x1f]*+", LINE_BREAKS.removeprefix("\r\n|")
    rest = F.regexp_extract(text, rf"(?s)(?<![^{breaks[1:-1]}]){blank}(?!{noise})([^ \t\x1f{breaks[1:-1]}].*)", 1)
    body = F.get(F.split(rest, rf"(?>\r\n|{breaks}){blank}(?={breaks})", 2), F.lit(0))
    lines = F.transform(F.split(body, LINE_BREAKS), lambda line: F.btrim(line, F.lit(" \t\x1f")))
    joined = F.array_join(F.filter(lines, lambda line: (line != "") & ~line.rlike("^" + noise)), " ")
    cut = lambda j: F.concat(F.regexp_replace(F.substring(j, 1, dims.SUMMARY_CHARS), r"\s+$", ""), F.when(F.length(j) > dims.SUMMARY_CHARS, "…").otherwise(""))
    return F.get(F.transform(F.array(joined), lambda j: F.when(j != "", cut(j))), F.lit(0))  # named once, made once


def section(text: Column, name: str) -> Column:
    """The body below a heading of level two or more, up to the next; null if empty or absent."""
    body = F.regexp_extract(text, rf"(?ims)^##+[ \t]+{name}[ \t]*$(.*?)(?=^##+\s|\z)", 1)
    return F.nullif(strip(body), F.lit(""))
