"""Samples in JSON of mixed types: pairs of a text and a reward as arrays, some of them shorter or of other kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintloom.operators.edits import json_text


def samples(text: Column) -> Column:
    """P-02, D8, D11: array<struct<text, reward, whole>> of a JSON array of ``[text, reward]`` pairs.

    A pair without a reward has a null one; an entry that isn't an array which begins with a text is kept in its place,
    with ``whole`` false and no text. Null for a text that isn't a JSON array. The types are looked at value by value,
    by VARIANT: no schema would hold for an array of a text and a number.
    """
    entries = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")

    def one(v: Column) -> Column:
        first = F.try_variant_get(v, "$[0]", "variant")
        is_text = F.coalesce(F.schema_of_variant(first) == "STRING", F.lit(False))
        return F.struct(
            F.when(is_text, F.try_variant_get(first, "$", "string")).alias("text"), F.when(is_text, F.try_variant_get(v, "$[1]", "double")).alias("reward"), is_text.alias("whole"))

    return F.transform(entries, one)


def explode_samples(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, text, reward, whole): a row a sample by its place; bad entries come after, at -1 and once each.

    A text that is no array at all is one bad entry.
    """
    found = rows.select(F.col(id_col).alias("id"), F.coalesce(samples(F.col(text_col)), F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("reward"), F.lit(False).alias("whole")))).alias("s"))
    good = F.transform(F.filter("s", lambda x: x["whole"]), lambda x, i: F.struct(i.cast("int").alias("at"), x["text"].alias("text"), x["reward"].alias("reward"), x["whole"].alias("whole")))
    bad = F.transform(F.filter("s", lambda x: ~x["whole"]), lambda x: F.struct(F.lit(-1).alias("at"), x["text"].alias("text"), x["reward"].alias("reward"), x["whole"].alias("whole")))
    return found.select("id", F.explode(F.concat(good, bad)).alias("x")).select("id", "x.*")


def as_json(values: Column) -> Column:
    """The samples as JSON again, pairs of a text and a reward."""
    pair = lambda x: F.concat(F.lit("["), json_text(x["text"]), F.lit(", "), F.coalesce(x["reward"].cast("string"), F.lit("null")), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(values, pair), ", "), F.lit("]"))
