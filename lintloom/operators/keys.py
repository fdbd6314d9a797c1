"""Keys: keeping the last row, set operations on ids, ensembles, and ranks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintloom.sources.scratch import Scratch


#: Rows up to which a running total is one window.
SMALL = 100_000


def keep_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """O-44: the last row of each key. An aggregate, so that rows of a hot key meet combined."""
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(last.alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def pending(inputs: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """O-27, O-47: inputs whose key isn't written yet."""
    return inputs.join(written.select(key).distinct(), key, "left_anti")


def partition_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """O-48, O-50: each distinct id with the side it is on: both, left or right."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.select(key, F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def ensemble(a: DataFrame, b: DataFrame, union: bool) -> DataFrame:
    """O-51 to O-53 over (doc_id, code, line_no): the union or the intersection of two sets of findings."""
    rows = a.select("doc_id", "code", "line_no", F.lit(1).alias("side")).union(b.select("doc_id", "code", "line_no", F.lit(2).alias("side")))
    sides = rows.groupBy("doc_id", "code", "line_no").agg(F.bit_or("side").alias("s"))
    return (sides if union else sides.where("s = 3")).select("doc_id", "code", "line_no")


def sampled(df: DataFrame, strata: list[str], key: str, seed: int, k: int | Column) -> DataFrame:
    """Up to k rows of each stratum, in the order of a hash of key and seed. Spark limits each task's part first."""
    order = [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), F.col(key)]
    rank = F.row_number().over(W.partitionBy(*strata).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def running_total(df: DataFrame, strata: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over the rows of a stratum that come before a row, in a total order. A null stratum is one like any other.

    Rows are dealt into ranges of (stratum, order) between bounds taken from a sample of bounded size, chosen by a
    hash: the same bounds in every pass and every retry. Only the sums of each range and stratum are accumulated,
    so a stratum is as many tasks as it has ranges. The rows are written first, as they are read several times; what
    isn't needed for the result should be left out of ``df``. SMALL rows or fewer are no more than a window in one task
    holds easily, which gives the same sums without the passes for bounds.
    """
    df = Scratch(df.sparkSession).put(df, "ordered")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col(strata).alias("s"), *(c.alias(f"k{i}") for i, c in enumerate(order)))
    keyed = df.withColumn("_key", key).withColumn("_value", value)
    n = df.count()
    if n <= SMALL:
        ahead = W.partitionBy(strata).orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
        return keyed.withColumn("_own", F.coalesce(F.sum("_value").over(ahead), F.lit(0))).select(*df.columns, F.col("_own").alias(name))
    wide = 1 << 30
    some = keyed.where(F.pmod(F.xxhash64("_key"), F.lit(wide)) < int(min(1.0, 100.0 * parts / max(1, n)) * wide))
    # each key once, as rows that are equal in it are all in the sample or none of them is
    ordered = some.agg(F.array_sort(F.collect_set("_key")).alias("a"))
    step = F.greatest(F.ceil(F.size("a") / parts), F.lit(1)).cast("int")
    bounds = ordered.select(F.filter("a", lambda x, i: (i + 1) % step == 0).alias("_bounds"))
    # coarse bounds first, then those between two of them
    wide_step = max(1, int(parts**0.5))
    coarse = F.filter("_bounds", lambda x, i: (i + 1) % wide_step == 0)
    at = keyed.crossJoin(F.broadcast(bounds.select("_bounds", coarse.alias("_coarse"))))
    below = F.size(F.filter("_coarse", lambda x: x < F.col("_key"))) * wide_step
    part = below + F.size(F.filter(F.slice("_bounds", below + 1, wide_step), lambda x: x < F.col("_key")))
    placed = at.withColumn("_part", part).drop("_bounds", "_coarse")
    runs = placed.groupBy("_part", F.col(strata).alias("_s")).agg(F.sum("_value").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_part").alias("_p"), "_s", before.alias("_before"))
    own = F.coalesce(F.sum("_value").over(W.partitionBy("_part", strata).orderBy("_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    both = placed.withColumn("_own", own).join(runs, (F.col("_part") == F.col("_p")) & F.col(strata).eqNullSafe(F.col("_s")))
    return both.select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def ranked(df: DataFrame, strata: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Rank within a stratum by a total order, from 1: one more than the running total of rows."""
    placed = running_total(df, strata, order, F.lit(1).cast("long"), "_before_it")
    return placed.select(*df.columns, (F.col("_before_it") + 1).alias(name))


def prefix_fraction(df: DataFrame, strata: str, order: str, fractions: dict[str, float]) -> DataFrame:
    """O-93, S-09: the first floor(fraction * n) rows of each stratum. A negative fraction is an error before any work."""
    if any(f < 0 for f in fractions.values()):
        raise ValueError("fractions of a mix must not be negative")
    share = F.element_at(F.create_map(*(F.lit(x) for pair in fractions.items() for x in pair)), F.col(strata))
    sizes = df.where(F.col(strata).isin(list(fractions))).groupBy(strata).agg(F.floor(F.count("*") * share).alias("_take"))
    return ranked(df.where(F.col(strata).isin(list(fractions))), strata, [F.col(order)], "_rank").join(F.broadcast(sizes), strata).where("_rank <= _take").select(*df.columns)


def contiguous_prefix(df: DataFrame, index: str) -> DataFrame:
    """ST-01: the rows before the first index that is missing, counting from 0.

    The first block of indexes that isn't full is found from counts by blocks, the missing index among those of that
    block: a number and at most a block of indexes come to the driver, however many there are.
    """
    block = 1 << 16
    distinct = df.select(F.col(index).cast("long").alias("_i")).where("_i >= 0").distinct()
    per = distinct.groupBy(F.floor(F.col("_i") / block).alias("_b")).agg(F.count("*").alias("_n"))
    full = per.where(F.col("_n") == block).select("_b")
    zero = df.sparkSession.range(1).select(F.col("id").alias("_b"))
    at = zero.union(full.select(F.col("_b") + 1)).join(full, "_b", "left_anti").agg(F.min("_b")).first()[0]
    inside = {r["_i"] for r in distinct.where((F.col("_i") >= at * block) & (F.col("_i") < (at + 1) * block)).collect()}
    first = next(i for i in range(at * block, (at + 1) * block + 1) if i not in inside)
    return df.where((F.col(index) >= 0) & (F.col(index) < first))


def complete_groups(df: DataFrame, key: str, size: int) -> DataFrame:
    """ST-02: the keys of which ``size`` rows are there."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= size)
