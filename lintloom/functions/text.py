"""Column functions over texts: lines, excerpts, keys and markers. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "NO VIOLATIONS FOUND"


def lines(text: Column) -> Column:
    """The lines of a text; a trailing line break gives an empty last line."""
    return F.split(text, "\n", -1)


def right_aligned(number: Column) -> Column:
    """A number in three places; wider numbers stay whole (lpad would cut them)."""
    digits = number.cast("string")
    return F.when(number < 1000, F.lpad(digits, 3, " ")).otherwise(digits)


def number_lines(text: Column, first: int = 1) -> Column:
    """O-68, O-69: each line after its number and a space."""
    return F.array_join(F.transform(lines(text), lambda line, i: F.concat(right_aligned(i + first), F.lit(" "), line)), "\n")


def excerpt(text: Column, start: Column | int, end: Column | int) -> Column:
    """O-70: lines start to end, both from 1 and inclusive."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.array_join(F.slice(lines(text), start, end - start + 1), "\n")


def normalize_space(text: Column) -> Column:
    """O-78: lower case, white space of any kind as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def strip_comments(text: Column) -> Column:
    """O-76: without triple-quoted strings, without what follows a # in a line, without blank lines."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)(\"\"\".*?\"\"\"|'''.*?''')", ""), "#[^\n]*", "")
    return F.array_join(F.filter(lines(bare), lambda x: F.length(F.regexp_replace(x, r"[ \t\r\f]+", "")) > 0), "\n")


def has_all(text: Column, words: list[str]) -> Column:
    """O-36."""
    out = F.lit(True)
    for word in words:
        out = out & F.contains(text, F.lit(word))
    return out


def has_url(text: Column) -> Column:
    """O-37."""
    return F.contains(text, F.lit("http:")) | F.contains(text, F.lit("https:"))


def urls(text: Column) -> Column:
    """O-77."""
    return F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>]+)"), 1)


def fits(text: Column, max_lines: int, max_length: int) -> Column:
    """O-34, O-35: at most so many lines, none longer than so many characters."""
    return (F.size(lines(text)) <= max_lines) & ~F.exists(lines(text), lambda x: F.length(x) > max_length)


def middle_cut(text: Column, limit: int, keep: int) -> Column:
    """O-74: a text of more than ``limit`` characters keeps its first and last ``keep``."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.right(text, F.lit(keep)))).otherwise(text)


def line_numbers(excerpt_text: Column) -> Column:
    """O-67: the distinct numbers that lead the lines of an excerpt; one colon may follow a number."""
    found = F.transform(lines(excerpt_text), lambda x: F.expr("try_cast(NULL AS BIGINT)") if x is None else F.regexp_extract(x, r"^\s*([+-]?[0-9]+):?(?:\s|$)", 1).try_cast("bigint"))
    return F.array_distinct(F.array_compact(found))


def has_markers(text: Column, markers: tuple[str, ...]) -> Column:
    """O-38."""
    return has_all(text, list(markers))


def split_report(text: Column, header: str) -> tuple[Column, Column]:
    """O-66: (reasoning, report); a text without just one header is all report."""
    parts = F.split(text, header.replace("*", r"\*"), -1)
    two = F.size(parts) == 2
    return F.when(two, F.get(parts, F.lit(0))).otherwise(F.lit("")), F.when(two, F.get(parts, F.lit(1))).otherwise(text)


def docstring(text: Column) -> Column:
    """O-79: between the quotes; of two docstrings the second; null for any other number of quotes."""
    parts = F.split(text, '"""', -1)
    return F.when(F.size(parts) == 3, F.get(parts, F.lit(1))).when(F.size(parts) == 5, F.get(parts, F.lit(3)))


#: Where files of a release tell a version, and what is written there.
VERSION_PLACES = {
    "init": (r'(?m)^__version__\s+=\s+"([^"]+)"\s*$', '__version__ = "VERSION"\n'),
    "setup": (r'(?m)^(\s*)version\s*=\s*"[^"]+",', '$1version="VERSION",'),
    "citation": (r"(?m)^version:\s+[^ ]+", "version: VERSION"),
    "readme": (r"(?m)version\s+=\s+\{[^}]+\}", "version = {VERSION}"),
}


def with_version(text: Column, place: str, version: Column) -> Column:
    """O-90: a file's text with another version in all places of a kind. Digits, letters, dots, + and - make a version."""
    pattern, told = VERSION_PLACES[place]
    before, after = told.split("VERSION")
    return F.when(version.rlike(r"^[\w.+-]+$"), F.regexp_replace(text, F.lit(pattern), F.concat(F.lit(before), version, F.lit(after))))
