"""Positions, code spans and edits of a text as Column expressions. Rows and columns count from 1, offsets from 0."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintloom.functions.text import lines

#: What parts the two halves of a rule's example (a fixed value of the rule pages).
EXAMPLE_MARK = "\n\nUse instead:\n\n"


#: Lines of a block when places of lines are summed up.
BLOCK = 256


def to_offset(text: Column, row: Column, column: Column) -> Column:
    """O-84: characters before a position. For many positions of a text, ``line_starts`` reads it once."""
    return F.when(row > 1, F.length(F.call_function("substring_index", text, F.lit("\n"), (row - 1).cast("int"))) + 1).otherwise(0) + column - 1


def line_starts(text: Column) -> Column:
    """The offset of each line, and that of one more below the last, as an array.

    Lengths are summed within blocks of lines and then over blocks, since an array that grows line by line is copied
    each time; so the time is in proportion to the text up to some 10^5 lines.
    """
    running = lambda sizes: F.aggregate(
        sizes, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )
    kind = "array<struct<at:bigint,out:array<bigint>>>"

    def sums(sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: running(F.slice(sizes, b * BLOCK + 1, BLOCK)))
        return _with(blocks.cast(kind), lambda parts: _with(running(F.transform(parts, lambda p: p["at"])), lambda above: F.concat(
            F.flatten(F.zip_with(parts, above["out"], lambda p, at: F.transform(p["out"], lambda x: x + at))), F.array(above["at"])
        )))

    return _with(F.transform(lines(text), lambda x: (F.length(x) + 1).cast("long")), sums)


def _with(value: Column, body) -> Column:
    """``body`` of a value that is made once: what stands in a lambda is made again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def offset_in(starts: Column, row: Column, column: Column) -> Column:
    """O-84 by the starts of lines; rows beyond the text begin below its last line."""
    return F.coalesce(F.get(starts, F.greatest(row, F.lit(1)).cast("int") - 1), F.element_at(starts, -1)) + column - 1


def row_in(starts: Column, offset: Column) -> Column:
    """O-84: the row of an offset, by a search of halves among the starts of lines."""
    top = F.size(starts) - 1
    span = F.struct(F.lit(0).alias("low"), top.alias("high"))

    def halve(acc, _):
        middle = F.shiftright(acc["low"] + acc["high"] + 1, 1)
        fits = (acc["low"] < acc["high"]) & (F.get(starts, middle) <= offset) & (middle < top)
        above = (acc["low"] < acc["high"]) & ~fits
        return F.struct(F.when(fits, middle).otherwise(acc["low"]).alias("low"), F.when(above, middle - 1).otherwise(acc["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), span.cast("struct<low:int,high:int>"), lambda a, x: halve(a, x).cast("struct<low:int,high:int>"), lambda a: a["low"] + 1)


def to_row(text: Column, offset: Column) -> Column:
    """O-84: the row of an offset."""
    before = F.left(text, offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def to_column(text: Column, offset: Column) -> Column:
    """O-84: the column of an offset."""
    return F.length(F.substring_index(F.left(text, offset), "\n", -1)) + 1


def line_spans(text: Column, start: Column, end: Column) -> Column:
    """O-71b: (line, span) of each line from one position to another; the columns are those of the two on every line.

    Lines beyond the text are left out; an empty or reversed range of columns gives an empty span.
    """
    some = F.slice(lines(text), start["row"], F.greatest(end["row"] - start["row"] + 1, F.lit(0)))
    return F.transform(some, lambda x: F.struct(x.alias("line"), F.substring(x, start["column"], F.greatest(end["column"] - start["column"], F.lit(0))).alias("span")))


def safe_findings(text: Column, violations: Column) -> Column:
    """O-71b: findings as code, spans and first and last row; of fixes only safe ones stay, as spans with new content."""

    def fix(v):
        edits = F.transform(v["fix"]["edits"], lambda e: F.struct(e["content"].alias("content"), line_spans(text, e["location"], e["end_location"]).alias("code_spans_and_lines")))
        return F.when(v["fix"]["applicability"] == "safe", edits)

    return F.transform(violations, lambda v: F.struct(
        v["code"].alias("code"), line_spans(text, v["location"], v["end_location"]).alias("code_spans_and_lines"),
        F.array(v["location"]["row"], v["end_location"]["row"]).alias("line_span"), fix(v).alias("fix"),
    ))


def in_order(violations: Column) -> Column:
    """O-92: findings by their row and column; those of one place stay as they came."""
    keyed = F.transform(violations, lambda v, i: F.struct(v["location"]["row"].alias("r"), v["location"]["column"].alias("c"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def edited(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text after edits of (start, stop, content), and the edits that restore it, in one pass."""
    pieces, reverse, at, size = [], [], 0, 0
    for start, stop, content in sorted(edits):
        if start < at or stop < start:
            continue
        kept = text[at:start]
        size += len(kept)
        pieces += [kept, content]
        reverse.append((size, size + len(content), text[start:stop]))
        size += len(content)
        at = stop
    return "".join([*pieces, text[at:]]), reverse


EDITED = "text string, reverse array<struct<start:int,stop:int,content:string>>"
_REVERSE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("content", pa.string())]))
#: Texts that are edited before they are given on: of a batch's texts there are no more as Python's objects.
TEXTS = 64


def _by_parts(texts: pa.Array, edits: pa.Array, offsets: Callable[[str, list[dict]], list[tuple[int, int, str]]]) -> Iterator[pa.Array]:
    for at in range(0, len(texts), TEXTS):
        rows = [
            None if text is None or wanted is None else edited(text, offsets(text, wanted))
            for text, wanted in zip(texts.slice(at, TEXTS).to_pylist(), edits.slice(at, TEXTS).to_pylist(), strict=True)
        ]
        text = pa.array([r and r[0] for r in rows], pa.string())
        reverse = pa.array([r and [{"start": a, "stop": b, "content": c} for a, b, c in r[1]] for r in rows], _REVERSE)
        yield pa.StructArray.from_arrays([text, reverse], names=["text", "reverse"])


def _edit(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, edits in batches:
        yield from _by_parts(texts, edits, lambda _, wanted: [(e["start"], e["stop"], e["content"]) for e in wanted])


def _edit_at(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    def offsets(text: str, wanted: list[dict]) -> list[tuple[int, int, str]]:
        starts = [0, *accumulate(len(x) + 1 for x in text.split("\n"))]
        place = lambda p: starts[min(max(p["row"], 1), len(starts)) - 1] + p["column"] - 1
        return [(place(e["location"]), place(e["end_location"]), e["content"]) for e in wanted]

    for texts, edits in batches:
        yield from _by_parts(texts, edits, offsets)


def edit(text: Column, edits: Column) -> Column:
    """O-83: (text, reverse) after edits of (start, stop, content), in offsets of the text as it was.

    Edits are done in the order of their offsets; one that begins inside its predecessor is left out. ``reverse``
    holds the edits that restore the text. A null text gives null in both; no edits leave the text as it is. The pass
    over a text is Python's, TEXTS at a time: natively each piece would be looked for from the beginning of the text.
    """
    # not to be repeated where its fields are used: Spark copies what it takes to be deterministic
    return F.arrow_udf(_edit, EDITED).asNondeterministic()(text, edits)


def edit_at(text: Column, edits: Column) -> Column:
    """O-83: the same with edits between positions (location, end_location, content), as findings have them."""
    return F.arrow_udf(_edit_at, EDITED).asNondeterministic()(text, edits)


def offsets(text: Column, edits: Column) -> Column:
    """Edits between positions as edits between offsets; the text is read once for all of them."""

    def placed(starts: Column) -> Column:
        at = lambda p: offset_in(starts, p["row"], p["column"])
        return F.transform(edits, lambda e: F.struct(at(e["location"]).alias("start"), at(e["end_location"]).alias("stop"), e["content"].alias("content")))

    return _with(line_starts(text), placed)


def example_split(example: Column) -> Column:
    """O-81: (before, after) of an example; what follows a blank line in the second half isn't part of it."""
    after = F.substring_index(F.substring_index(example, EXAMPLE_MARK, -1), "\n\n", 1)
    return F.struct(F.substring_index(example, EXAMPLE_MARK, 1).alias("before"), after.alias("after"))


def reversed_rules(specs: DataFrame) -> DataFrame:
    """O-82: rules with a fix and both halves of an example, the halves swapped."""
    some = specs.where("fix_safety IS NOT NULL AND example_split.before IS NOT NULL AND example_split.after IS NOT NULL")
    return some.withColumn("example_split", F.struct(F.col("example_split.after").alias("before"), F.col("example_split.before").alias("after")))


def _ascii(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else json.dumps(x))


def json_text(text: Column, quotes: bool = True, ascii_only: bool = False) -> Column:
    """O-85: a text as a JSON string; natively unless other characters than ASCII are escaped too."""
    if ascii_only:
        whole = F.pandas_udf(_ascii, "string")(text)
    else:
        record = F.to_json(F.struct(text.alias("a")))
        whole = F.substring(record, F.lit(6), F.length(record) - 6)
    whole = F.when(text.isNotNull(), whole)
    return whole if quotes else F.substring(whole, F.lit(2), F.length(whole) - 2)
