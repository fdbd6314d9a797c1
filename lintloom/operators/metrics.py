"""Detection and localization metrics over findings (doc_id, code, line_no). Empty means are null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintloom.operators.fuzzy import partners
from lintloom.operators.keys import running_total


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f_score(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def aligned(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row per distinct finding with g and p, 1 where gold or prediction has it. Partitioned by document once, which all later groupings share."""
    both = gold.select("doc_id", "code", "line_no", F.lit(1).alias("g"), F.lit(0).alias("p")).union(pred.select("doc_id", "code", "line_no", F.lit(0).alias("g"), F.lit(1).alias("p")))
    return both.repartition("doc_id").groupBy("doc_id", "code", "line_no").agg(F.max("g").alias("g"), F.max("p").alias("p"))


def by_code(rows: DataFrame) -> DataFrame:
    """Counts of gold, predicted and common lines of each document and code."""
    return rows.groupBy("doc_id", "code").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum(F.col("g") * F.col("p")).alias("n_hit"))


def line_localization(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """M-01: mean precision and recall of lines over pairs of document and gold code, and F of the means."""
    pairs = by_code(aligned(gold, pred)).where("n_gold > 0")
    means = pairs.agg(F.avg(ratio(F.col("n_hit"), F.col("n_pred"))).alias("p"), F.avg(F.col("n_hit") / F.col("n_gold")).alias("r"))
    return means.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f_score(F.col("p"), F.col("r")), 6).alias("f1"))


def overall_match(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """M-03 with codes: per document with findings on either side, the matched shares; one empty side gives 0."""
    per = aligned(gold, pred).groupBy("doc_id").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(F.col("g") * F.col("p")).alias("h"))
    return per.agg(F.round(F.avg(ratio(F.col("h"), F.col("p"))), 6).alias("precision"), F.round(F.avg(ratio(F.col("h"), F.col("g"))), 6).alias("recall"), F.count("*").alias("n_docs"))


def detection(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """M-04: precision and recall of presence in a document, for each code."""
    seen = by_code(aligned(gold, pred)).select("code", (F.col("n_gold") > 0).cast("int").alias("g"), (F.col("n_pred") > 0).cast("int").alias("p"))
    sums = seen.groupBy("code").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))
    return sums.select("code", "tp", "n_gold", "n_pred", ratio(F.col("tp"), F.col("n_pred")).alias("p"), ratio(F.col("tp"), F.col("n_gold")).alias("r"))


def macro(per_code: DataFrame, group: Column | None = None) -> DataFrame:
    """M-05: means over codes that gold has, and F of the means; overall or for each tool group."""
    rows = per_code.where("n_gold > 0").withColumn("grp", F.lit("all") if group is None else group)
    means = rows.groupBy("grp").agg(F.avg("p").alias("p"), F.avg("r").alias("r"), F.count("*").alias("n_codes"))
    return means.select("grp", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f_score(F.col("p"), F.col("r")), 6).alias("f1"), "n_codes")


def rewards(gold: DataFrame, pred: DataFrame, docs: DataFrame) -> DataFrame:
    """M-16 to M-18 for every document. Without gold findings: 1 if nothing is predicted, else 0.

    v1: F of all findings, 0 if nothing is predicted. v2: mean over codes of either side of the F of their lines.
    v3: F of mean precision and recall over gold codes.
    """
    per = by_code(aligned(gold, pred)).withColumn("p", ratio(F.col("n_hit"), F.col("n_pred"))).withColumn("r", ratio(F.col("n_hit"), F.col("n_gold")))
    own = F.col("n_gold") > 0
    sums = per.groupBy("doc_id").agg(
        F.sum("n_gold").alias("g"), F.sum("n_pred").alias("q"), F.sum("n_hit").alias("h"), F.avg(f_score(F.col("p"), F.col("r"))).alias("v2"),
        F.avg(F.when(own, F.col("p"))).alias("mp"), F.avg(F.when(own, F.col("r"))).alias("mr"),
    )
    all_docs = docs.select("doc_id").join(sums, "doc_id", "left").fillna(0, ["g", "q", "h"])
    empty = F.when(F.col("q") == 0, 1.0).otherwise(0.0)
    v1 = F.when(F.col("g") == 0, empty).otherwise(f_score(ratio(F.col("h"), F.col("q")), ratio(F.col("h"), F.col("g"))))
    v2 = F.when((F.col("g") == 0) & (F.col("q") == 0), 1.0).otherwise(F.coalesce("v2", F.lit(0.0)))
    v3 = F.when(F.col("g") == 0, empty).otherwise(f_score(F.coalesce("mp", F.lit(0.0)), F.coalesce("mr", F.lit(0.0))))
    return all_docs.select("doc_id", F.round(v1, 6).alias("reward_v1"), F.round(v2, 6).alias("reward_v2"), F.round(v3, 6).alias("reward_v3"), F.col("g").alias("n_gold"), F.col("q").alias("n_pred"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """M-19: Cohen's kappa of two 0/1 columns; null where chance agreement is whole."""
    t = rows.agg(F.count("*").alias("n"), F.sum((F.col(a) == F.col(b)).cast("int")).alias("same"), F.sum(a).alias("a"), F.sum(b).alias("b"))
    po, pe = F.col("same") / F.col("n"), (F.col("a") * F.col("b") + (F.col("n") - F.col("a")) * (F.col("n") - F.col("b"))) / (F.col("n") * F.col("n"))
    return t.select(F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"), "n")


#: Pairs up to which, without ties, the p value comes from all signs of all ranks.
EXACT_PAIRS = 50


def _erfc(x: Column) -> Column:
    """The complementary error function of x >= 0 by a Chebyshev fit, to 1.2e-7 of its value (fixed coefficients)."""
    t = 1 / (1 + 0.5 * x)
    fit = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    return t * F.exp(-x * x + fit)


def _exact_p(n: pd.Series, w: pd.Series) -> pd.Series:
    """Two-sided: of all ways to sign the ranks 1 to n, twice the share with a sum of at most w."""

    def one(n: int, w: float) -> float:
        ways = [1]
        for rank in range(1, int(n) + 1):
            ways = [(ways[i] if i < len(ways) else 0) + (ways[i - rank] if i >= rank else 0) for i in range(len(ways) + rank)]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2 ** int(n))

    return pd.Series([one(a, b) if a <= EXACT_PAIRS else None for a, b in zip(n, w, strict=True)], dtype="float64")


def wilcoxon(pairs: DataFrame, x: str, y: str, group: str | None = None, alpha: float | None = None) -> DataFrame:
    """M-20: W+ and W- of the signed-rank test and the least of them, their two-sided p value, by ``group`` if given.

    Pairs without a difference take no part. Without ties and with up to EXACT_PAIRS pairs the p value is exact, else
    that of the normal approximation with its variance corrected for ties; it is null without pairs. With ``alpha``,
    ``significant`` is whether it is below alpha over the number of groups (Bonferroni). Ranks come from counts of
    equal differences and running totals over ranges of them, not from a sort of all rows in one task.
    """
    own = pairs.select(F.col(group).alias("_g") if group else F.lit(0).alias("_g"), (F.col(x) - F.col(y)).alias("d")).where("d <> 0")
    d = own.groupBy("_g", F.abs("d").alias("m")).agg(F.count(F.when(F.col("d") > 0, 1)).alias("up"), F.count(F.when(F.col("d") < 0, 1)).alias("down"))
    n = F.col("up") + F.col("down")
    placed = running_total(d, "_g", [F.col("m")], n, "before").withColumn("k", n)
    ranked = placed.withColumn("rank", F.col("before") + (F.col("k") + 1) / 2)
    plus, minus = (F.coalesce(F.sum(F.col(c) * F.col("rank")), F.lit(0.0)) for c in ("up", "down"))
    sums = (ranked.groupBy("_g") if group else ranked.groupBy()).agg(
        plus.alias("w_plus"), minus.alias("w_minus"), F.least(plus, minus).alias("w"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")), F.lit(0)).alias("ties"),
    )
    count = F.col("n").cast("double")
    variance = count * (count + 1) * (2 * count + 1) / 24 - F.col("ties") / 48
    z = F.when(variance > 0, F.abs(F.col("w") - count * (count + 1) / 4) / F.sqrt(variance))
    near = F.when(z.isNotNull(), F.least(_erfc(z / F.sqrt(F.lit(2.0))), F.lit(1.0)))  # least passes over nulls
    exact = (F.col("ties") == 0) & (F.col("n") <= EXACT_PAIRS) & (F.col("n") > 0)
    out = sums.withColumn("p", F.when(exact, F.pandas_udf(_exact_p, "double")("n", "w")).otherwise(near))
    if alpha is not None:
        out = out.withColumn("significant", F.col("p") < alpha / F.count("*").over(W.partitionBy()))  # a row for each group
    return out.withColumnRenamed("_g", group).drop("ties") if group else out.drop("ties")


def confusable(gold: DataFrame, pred: DataFrame, like: dict[str, list[str]]) -> DataFrame:
    """M-13: how often a code of ``like`` that a document has is mistaken for one of the codes that are like it.

    Of (document, code) with the code in gold: ``strict`` is the share where a code like it is predicted and it isn't
    itself, ``relaxed`` where one is predicted, ``any_code`` where any code on the right of ``like`` is; n is their number.
    """
    spark = gold.sparkSession
    own = spark.createDataFrame([(c, sorted(set(x))) for c, x in like.items()], "code string, similar array<string>")
    wrong = sorted({c for x in like.values() for c in x})
    said = pred.groupBy("doc_id").agg(F.collect_set("code").alias("said"))
    cases = gold.select("doc_id", "code").distinct().join(F.broadcast(own), "code").join(said, "doc_id", "left")
    said = F.coalesce("said", F.array().cast("array<string>"))
    hit = F.arrays_overlap("similar", said)
    share = lambda test: F.round(F.avg(test.cast("int")), 6)
    return cases.agg(
        share(hit & ~F.array_contains(said, F.col("code"))).alias("strict"), share(hit).alias("relaxed"),
        share(F.arrays_overlap(F.array(*map(F.lit, wrong)), said)).alias("any_code"), F.count("*").alias("n"),
    )


def first_lines(findings: DataFrame) -> DataFrame:
    """The first line of each run of consecutive lines of a document and code."""
    rows = findings.select("doc_id", "code", "line_no").distinct()
    before = F.lag("line_no").over(W.partitionBy("doc_id", "code").orderBy("line_no"))
    return rows.withColumn("_before", before).where("_before IS NULL OR _before < line_no - 1").drop("_before")


def listed_macro(per_code: DataFrame, codes: list[str]) -> DataFrame:
    """M-06: means over all listed codes; one that no document has counts as 0."""
    spark = per_code.sparkSession
    rows = spark.createDataFrame([(c,) for c in codes], "code string").join(per_code, "code", "left").fillna(0.0, ["p", "r"])
    means = rows.agg(F.avg("p").alias("p"), F.avg("r").alias("r"), F.count("*").alias("n_codes"))
    return means.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f_score(F.col("p"), F.col("r")), 6).alias("f1"), "n_codes")


def presence(gold: DataFrame, pred: DataFrame, docs: DataFrame, codes: list[str]) -> DataFrame:
    """M-08, M-22: of each document, whether any listed code is there (g) and is predicted (p), and whether they agree."""
    own = F.col("code").isin(codes)
    marks = docs.select("doc_id", F.lit(0).alias("g"), F.lit(0).alias("p")).union(gold.where(own).select("doc_id", F.lit(1), F.lit(0))).union(pred.where(own).select("doc_id", F.lit(0), F.lit(1)))
    return marks.groupBy("doc_id").agg(F.max("g").alias("g"), F.max("p").alias("p")).withColumn("correct", (F.col("g") == F.col("p")).cast("int"))


def subset_means(per_code: DataFrame, subsets: dict[str, list[str]], legacy: bool = False) -> DataFrame:
    """M-14: mean F of each subset of codes; a code without findings counts as 0.

    ``legacy`` gives the older figures: the last two subsets are each filled up with zeros for the codes of the other.
    """
    names = list(subsets)
    pairs = [(n, c, 1.0) for n in names for c in subsets[n]]
    if legacy:
        a, b = names[-2:]
        pairs += [(a, c, 0.0) for c in subsets[b] if c not in subsets[a]] + [(b, c, 0.0) for c in subsets[a] if c not in subsets[b]]
    dim = per_code.sparkSession.createDataFrame(pairs, "subset string, code string, own double")
    scored = per_code.select("code", f_score(F.col("p"), F.col("r")).alias("f"))
    return dim.join(scored, "code", "left").groupBy("subset").agg(F.round(F.avg(F.col("own") * F.coalesce("f", F.lit(0.0))), 6).alias("f1"), F.count("*").alias("n_codes"))


def by_step(gold: DataFrame, pred: DataFrame, step: str, group: Column) -> DataFrame:
    """A-19: M-05 of each step and tool group, and of all groups; rounded half to even to four places."""
    one = lambda df, g, p: df.select(step, "doc_id", "code", F.lit(g).alias("g"), F.lit(p).alias("p"))
    seen = one(gold, 1, 0).union(one(pred, 0, 1)).groupBy(step, "doc_id", "code").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    sums = seen.groupBy(step, "code").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("g").alias("ng"), F.sum("p").alias("np")).where("ng > 0")
    rows = sums.select(step, F.explode(F.array(group, F.lit("all"))).alias("grp"), ratio(F.col("tp"), F.col("np")).alias("p"), (F.col("tp") / F.col("ng")).alias("r"))
    means = rows.groupBy(step, "grp").agg(F.avg("p").alias("p"), F.avg("r").alias("r"))
    return means.select(step, "grp", F.bround("p", 4).alias("precision"), F.bround("r", 4).alias("recall"), F.bround(f_score(F.col("p"), F.col("r")), 4).alias("f1"))


def paired_t(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """M-21: the statistic of the paired t-test; null for less than two pairs or equal differences."""
    d = F.col(x) - F.col(y)
    t = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return t.select("n", F.round(F.col("m"), 6).alias("mean"), F.round(F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))), 4).alias("t"))


def text_localization(gold: DataFrame, pred: DataFrame, percent: int = 90, all_gold: bool = False, swapped: bool = False) -> DataFrame:
    """M-12, M-15 over (doc_id, code, line): by code, mean shares of lines with an equal, or a similar, line on the other side.

    Equal lines are counted by an aggregate, the others look for a similar one by ``fuzzy.partners``. Only codes on both
    sides of a document count (M-15); with ``all_gold`` those that aren't predicted count as 0 (M-12, whose similarity
    has to pass 90, a ``percent`` of 91). The shares are of their own side, so precision can't pass 1; ``swapped`` gives
    the older fuzzy figures, where the gold lines with a partner are divided by the predicted ones, and the reverse.
    """
    keys = ["doc_id", "code"]
    one = lambda df, g: df.where("line IS NOT NULL").select(*keys, "line", F.lit(g).alias("g"), F.lit(1 - g).alias("p"))
    rows = one(gold, 1).union(one(pred, 0)).groupBy(*keys, "line").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    found = partners(rows, keys, percent).select(*(F.col(c).alias(f"_{c}") for c in (*keys, "line")), F.lit(1).alias("near"))
    same = [rows[c].eqNullSafe(F.col(f"_{c}")) for c in keys] + [rows["line"] == F.col("_line")]
    marked = rows.join(found, same, "left")
    total = lambda value, test: F.sum(F.when(test, F.col(value)).otherwise(0))
    equal, near = (F.col("g") > 0) & (F.col("p") > 0), F.col("near").isNotNull()
    per = marked.groupBy(*keys).agg(
        F.sum("g").alias("n_g"), F.sum("p").alias("n_p"), total("p", equal).alias("em_p"), total("g", equal).alias("em_r"), total("p", equal | near).alias("fz_p"), total("g", equal | near).alias("fz_r"),
    ).where("n_g > 0" if all_gold else "n_g > 0 AND n_p > 0")
    fuzzy = ("fz_r", "fz_p") if swapped else ("fz_p", "fz_r")
    share = lambda c, n: F.round(F.avg(F.when(F.col("n_p") > 0, F.col(c) / F.col(n)).otherwise(0.0)), 6)
    return per.groupBy("code").agg(
        F.count("*").alias("n_docs"), share("em_p", "n_p").alias("precision"), share("em_r", "n_g").alias("recall"), share(fuzzy[0], "n_p").alias("fuzzy_precision"), share(fuzzy[1], "n_g").alias("fuzzy_recall"))
