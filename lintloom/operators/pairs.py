"""Samples with rewards: rollouts, preference pairs, shortest valid responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def preference_pairs(samples: DataFrame, gap: float, symmetric: bool = False) -> DataFrame:
    """P-01, J-04 over (id, idx, reward, valid): for i < j, the better of the two where the gap is exceeded.

    i is chosen only if both are valid; j is chosen whatever their validity, unless ``symmetric``. The samples of an
    id meet in one array, whose pairs are made in place: no self join.
    """
    if gap <= 0:
        raise ValueError("the gap must be positive")
    per = samples.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "reward", "valid"))).alias("s"))
    crossed = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["idx"] > a["idx"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = per.select("id", F.explode(crossed).alias("x")).select("id", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    both = F.col("a.valid") & F.col("b.valid")
    first = (F.col("a.reward") > F.col("b.reward") + gap) & both
    second = (F.col("b.reward") > F.col("a.reward") + gap) & (both if symmetric else F.lit(True))
    won = pairs.withColumn("side", F.when(first, ">").when(second, "<")).where("side IS NOT NULL")
    return won.select(
        F.concat(F.col("id").cast("string"), F.lit("_"), F.col("a.idx").cast("string"), "side", F.col("b.idx").cast("string")).alias("pair_id"), "id",
        F.when(F.col("side") == ">", F.col("a.idx")).otherwise(F.col("b.idx")).alias("chosen"), F.when(F.col("side") == ">", F.col("b.idx")).otherwise(F.col("a.idx")).alias("rejected"),
        F.col("a.reward").alias("reward_i"), F.col("b.reward").alias("reward_j"), F.round(F.abs(F.col("a.reward") - F.col("b.reward")), 6).alias("reward_gap"),
    )


def shortest_valid(samples: DataFrame, k: int) -> DataFrame:
    """O-94 over (id, idx, reward, valid, length): the k shortest with reward 1 that are valid; ties to the first."""
    rank = F.row_number().over(W.partitionBy("id").orderBy("length", "idx"))
    return samples.where("reward = 1 AND valid").withColumn("rank", rank).where(F.col("rank") <= k).select("id", "idx", "length", "rank")
