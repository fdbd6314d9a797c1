"""Prompts as Column expressions: rule texts, templates with named places, instructions and examples."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintloom.functions.text import lines, number_lines
from lintloom.operators.edits import json_text

#: What a prompt ends with, and what stands before its code.
ASKS = "Violations per idiom:"
CODE_MARK = "\n\nCode file:\n"

#: Prompts of one's own wording; any text with the same places will do.
LINT_TEMPLATE = "Find the lines of the code file that go against the idioms below.\n\n{specs}\n\nCode file:\n\n{code}\n\nViolations per idiom:\n\n"
REASON_TEMPLATE = "Explain how the violations below follow from the idioms.\n\n{specs}\n\nCode file:\n\n{code}\n\nViolations:\n\n{violations}"


def spec(code: Column, name: Column, definition: Column, rationale: Column, example: Column) -> Column:
    """O-72s: heading, definition, rationale and, unless it is null, the example of a rule."""
    shown = F.coalesce(F.concat(F.lit("\n\nExample:\n"), example), F.lit(""))
    return F.concat(F.lit("# Idiom "), code, F.lit(" ("), name, F.lit(")\n\nDefinition: "), definition, F.lit("\n\nRationale: "), rationale, shown)


def specs(texts: Column) -> Column:
    """The rules of a task, one after the other."""
    return F.array_join(texts, "\n\n")


def fill(template: str, **places: Column) -> Column:
    """O-73: the template with ``{name}`` replaced by the column of that name; ``{{`` and ``}}`` stand for braces.

    What a column holds is never read as a place. A place without a column is an error; a null column gives null.
    """
    parts = []
    for literal, name in re.findall(r"((?:[^{}]|\{\{|\}\})*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(F.lit(literal.replace("{{", "{").replace("}}", "}")))
        if name:
            parts.append(places[name])
    return F.concat(*parts) if parts else F.lit("")


def with_instructions(prompt: Column, instructions: str) -> Column:
    """O-75: a prompt that ends with ASKS, but for line breaks, with the instructions before that. Null for any other prompt."""
    bare = F.btrim(prompt, F.lit("\n"))
    return F.when(F.endswith(bare, F.lit(ASKS)), F.concat(F.left(bare, F.length(bare) - len(ASKS)), F.lit(f"{instructions}\n\n{ASKS}")))


def example(code: Column, spans: Column, rule: Column, header: str) -> Column:
    """An example of O-75: numbered code and, as a report, its lines from ``start`` to ``end`` of each span."""
    numbered = number_lines(code)
    found = F.transform(spans, lambda s: F.concat(
        F.lit('{"line": '), json_text(F.array_join(F.slice(lines(numbered), s["start"], s["end"] - s["start"] + 1), "\n")), F.lit(', "fix": null}')
    ))
    return F.concat(
        F.lit("\nCode file:\n\n"), numbered, F.lit(f"\n\nViolations per idiom: \n\n{header}\n\n**Idiom "), rule, F.lit(" Violations:**\n\n"), F.array_join(found, "\n"), F.lit("\n")
    )


def with_examples(prompt: Column, examples: Column, lead: str) -> Column:
    """O-75: examples, an array of texts, before the code of a prompt. Null where CODE_MARK isn't there just once."""
    parts = F.split(prompt, CODE_MARK, -1)
    shown = F.array_join(examples, "")
    return F.when(F.size(parts) == 2, F.concat(F.get(parts, F.lit(0)), F.lit(f"\n\n{lead}\n"), shown, F.lit("\nCode file:\n\n"), F.get(parts, F.lit(1))))
