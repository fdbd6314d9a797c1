"""Detectors and parsers as table functions by name, for SQL and for ``lateralJoin``.

    table_functions.register(spark)
    spark.sql("SELECT d.doc_id, f.* FROM documents d, LATERAL detect(d.text, 'pep_498') f")
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lintloom.operators import patterns, reports

_TEXT, _INT = StringType(), IntegerType()


def _struct(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


def _lines(text: str | None) -> list[tuple]:
    return reports.parse_text(text)


def _items(parser: Callable[[str | None], list]) -> Callable[[str | None], list[tuple]]:
    return lambda text: [(x.get("code") if isinstance(x, dict) else None, json.dumps(x)) for x in parser(text)]


#: Parsers of reports: the columns of each, and its rows of a text.
PARSERS: dict[str, tuple[StructType, Callable[[str | None], list[tuple]]]] = {"lines": (_struct(code=_TEXT, line=_TEXT), _lines)} | {
    name: (_struct(code=_TEXT, item=_TEXT), _items(parser)) for name, parser in reports.PARSERS.items()
}
MATCH = _struct(pattern=_TEXT, start_line=_INT, end_line=_INT, kind=_TEXT, snippet=_TEXT)


def _constant(argument: AnalyzeArgument, known, what: str) -> str:
    """The value of an argument that must be a known name when the query is analysed."""
    if not argument.isConstantExpression or argument.value not in known:
        raise ValueError(f"{what} must be one of {', '.join(sorted(known))}")
    return argument.value


class Detect:
    """detect(code, pattern): the matches of one pattern in a text of code; with no pattern, of all.

    A file that can't be parsed, or is nested too deep, has a row of its own: its pattern is null, its kind says why.
    """

    @staticmethod
    def analyze(code: AnalyzeArgument, pattern: AnalyzeArgument | None = None) -> AnalyzeResult:
        if pattern is not None and not (pattern.isConstantExpression and pattern.value is None):
            _constant(pattern, patterns.names(), "a pattern")
        return AnalyzeResult(schema=MATCH)

    def eval(self, code: str | None, pattern: str | None = None) -> Iterator[tuple]:
        fault = patterns.fault(code)
        if fault is not None:
            yield None, None, None, fault, None
        yield from patterns.detect(code, None if pattern is None else frozenset([pattern]))


class ParseReport:
    """parse_report(text, parser): the rows that a parser of reports finds; its columns follow from its name."""

    def __init__(self):
        self.parser, self.rows = None, None

    @staticmethod
    def analyze(text: AnalyzeArgument, parser: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=PARSERS[_constant(parser, PARSERS, "a parser")][0])

    def eval(self, text: str | None, parser: str) -> Iterator[tuple]:
        if parser != self.parser:
            self.parser, self.rows = parser, PARSERS[parser][1]
        yield from self.rows(text)


def register(spark: SparkSession) -> None:
    """Makes ``detect`` and ``parse_report`` known to the session."""
    spark.udtf.register("detect", udtf(Detect))
    spark.udtf.register("parse_report", udtf(ParseReport))
