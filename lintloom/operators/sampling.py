"""Samples, shuffles, offsets and cuts in a fixed order. The order by seed is that of a hash of key and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintloom.operators.keys import ranked, sampled


def seed_order(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), F.col(key)]


def shuffled(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """S-11: all rows with their place, from 1, in an order by seed; ranked by ranges over all tasks."""
    return ranked(df.withColumn("_all", F.lit(0)), "_all", seed_order(key, seed), name).drop("_all")


def take(df: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """S-12, S-13: k rows of all, or all there are. Each task gives its first k; k is a whole number of at least 0."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ValueError("k must be a whole number of at least 0")
    return df.orderBy(*seed_order(key, seed)).limit(k)


def balanced(df: DataFrame, stratum: str, flag: str, key: str, seed: int, ceiling: int, strict: bool = False) -> DataFrame:
    """S-03: of each stratum up to min(rows with the flag, ceiling) rows with, and as many without it.

    ``strict`` makes a stratum with fewer rows without the flag an error; else all of them are taken.
    """
    sizes = df.groupBy(stratum).agg(F.least(F.count(F.when(F.col(flag), 1)), F.lit(ceiling)).alias("_k"), F.count(F.when(~F.col(flag), 1)).alias("_no"))
    if strict and (short := sizes.where("_no < _k").first()) is not None:
        raise ValueError(f"{short[stratum]}: {short['_no']} rows of {short['_k']}")
    # the ceiling bounds each task's part before the shuffle
    some = sampled(df, [stratum, flag], key, seed, ceiling)
    rank = sampled_rank(some, [stratum, flag], key, seed)
    return rank.join(sizes.select(stratum, "_k"), stratum).where("_rank <= _k").select(*df.columns)


def sampled_rank(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*strata).orderBy(*seed_order(key, seed))))


def offset_rows(df: DataFrame, order: str, start: int, count: int) -> DataFrame:
    """O-13: ``count`` rows from place ``start`` (from 0) by an order of ids; two adjoining slices share no row."""
    placed = ranked(df.withColumn("_all", F.lit(0)), "_all", [F.col(order)], "_rank")
    return placed.where((F.col("_rank") > start) & (F.col("_rank") <= start + count)).select(*df.columns)


def halves(df: DataFrame, order: str) -> DataFrame:
    """O-25: each row with its part, 0 for the first n // 2 rows by the order and 1 for the others. No input is deleted."""
    n = df.count()
    placed = ranked(df.withColumn("_all", F.lit(0)), "_all", [F.col(order)], "_rank")
    return placed.withColumn("part", (F.col("_rank") > n // 2).cast("int")).select(*df.columns, "part")


def split_common(a: DataFrame, b: DataFrame, key: str, seed: int) -> DataFrame:
    """O-49: the keys that are in both tables, half of them, rounded down, for training and the rest for tests.

    The half is chosen by the order of seed_order, ranked over all tasks.
    """
    common = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    n = common.agg(F.floor(F.count("*") / 2).alias("_half"))
    placed = shuffled(common, key, seed, "_place").crossJoin(F.broadcast(n))  # one row
    return placed.select(key, F.when(F.col("_place") <= F.col("_half"), "train").otherwise("test").alias("part"))
