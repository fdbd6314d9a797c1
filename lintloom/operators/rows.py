"""Row and column filters of a dataset of tasks, predictions and findings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """O-30: only these columns, in the order of the table; names that it hasn't are left out. No names, no columns."""
    return df.select(*(c for c in df.columns if c in names))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """O-31."""
    return df.withColumnsRenamed(names)


def with_codes(findings: DataFrame, codes: list[str], but: tuple[str, ...] = ()) -> DataFrame:
    """O-33: findings of these codes, except some."""
    return findings.where(F.col("code").isin([c for c in codes if c not in but]))


def by_presence(tasks: DataFrame, findings: DataFrame, key: str, present: bool) -> DataFrame:
    """O-39: tasks with, or without, any finding."""
    return tasks.join(findings.select(key).distinct(), key, "left_semi" if present else "left_anti")


def within_budget(df: DataFrame, tokens: Column, limit: int, strict: bool = False) -> DataFrame:
    """O-40: rows of at most so many tokens, of fewer if ``strict``. Null counts go."""
    return df.where(tokens < limit if strict else tokens <= limit)


def about_tokens(text: Column) -> Column:
    """A token for every four characters begun: a native count for budgets, where no vocabulary is at hand."""
    return F.ceil(F.length(text) / 4)


def token_counter(rank_file: str, pattern: str):
    """A column function that counts the tokens of a byte-pair vocabulary, given as a file of ranks."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(rank_file), special_tokens={})
        return texts.map(lambda t: None if t is None else len(coder.encode_ordinary(t))).astype("Int64")

    return count


def not_blank(df: DataFrame, column: str) -> DataFrame:
    """O-41: rows whose text isn't empty; null goes too."""
    return df.where(F.col(column) != "")


def without_errors(df: DataFrame, flag: str = "error") -> DataFrame:
    """O-43: rows that aren't flagged as errors; a row without a flag stays."""
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """O-54."""
    return df.select(column).distinct()


def distinct_issues(df: DataFrame, key: str, *parts: str) -> DataFrame:
    """O-55: of each key the different issues, in order, as one array of structs."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*parts))).alias("issues"))
