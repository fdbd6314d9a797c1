"""Joins of tasks, code, specs, predictions and lookups. Texts are joined once a document, never once a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintloom.functions.text import SENTINEL, lines
from lintloom.operators.keys import keep_last

#: Pairs of versions that are sent to all tasks at most.
PAIRS = 10_000


def missing_keys(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """J-01: the keys that an inner join with ``table`` would drop without saying so."""
    return rows.select(key).distinct().join(table.select(key), key, "left_anti")


def with_line(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """J-01 over (doc_id, code, line_no): the findings with the text of their line; a line beyond the text is null."""
    per = findings.groupBy("doc_id").agg(F.collect_list(F.struct("code", "line_no")).alias("v"))
    both = per.join(docs.select("doc_id", lines(F.col("text")).alias("l")), "doc_id")
    each = F.transform("v", lambda v: F.struct(v["code"].alias("code"), v["line_no"].alias("line_no"), F.get("l", (v["line_no"] - 1).cast("int")).alias("line")))
    return both.select("doc_id", F.explode(each).alias("v")).select("doc_id", "v.*")


def task_specs(tasks: DataFrame, specs: DataFrame, *keep: str) -> DataFrame:
    """J-02: tasks by an id of codes and blob, ``A-B_blob``, with their specs in the order of the codes.

    ``specs`` has code; ``keep`` are its columns to collect. Codes without a spec are left out of the array.
    """
    parts = F.split("id", "_")
    each = tasks.select("id", F.element_at(parts, -1).alias("blob_id"), F.posexplode(F.split(F.get(parts, F.lit(0)), "-")).alias("_at", "code"))
    found = each.join(specs.select("code", *keep), "code", "left")
    spec = F.struct("_at", F.struct("code", *keep).alias("spec"), F.col(keep[0]).isNotNull().alias("known"))
    listed = F.filter(F.array_sort(F.collect_list(spec)), lambda x: x["known"])
    return found.groupBy("id", "blob_id").agg(F.transform(listed, lambda x: x["spec"]).alias("specs"))


def with_reasoning(train: DataFrame, reasoning: DataFrame, header: str, keep_clean: bool = True) -> DataFrame:
    """J-05 over train (id, answer) and reasoning (id, cot): the reasoning stands before the answer, under a header.

    Rows without reasoning go, but, with ``keep_clean``, those whose answer is just the sentinel stay as they are.
    """
    both = train.join(reasoning.select("id", "cot"), "id", "left")
    kept = both.where(F.col("cot").isNotNull() | (F.col("answer") == SENTINEL)) if keep_clean else both.where(F.col("cot").isNotNull())
    return kept.withColumn("answer", F.when(F.col("cot").isNotNull(), F.concat("cot", F.lit(f"\n\n{header}\n\n"), "answer")).otherwise(F.col("answer"))).drop("cot")


def by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """J-03, J-06, J-14: inner join; Spark broadcasts a side that its statistics show to be small."""
    return left.join(right, key)


def side_by_side(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """J-07, J-08: two sets of predictions by key, as value_a and value_b; a key on one side only has a null."""
    return a.select(key, F.col(value).alias(f"{value}_a")).join(b.select(key, F.col(value).alias(f"{value}_b")), key, "full")


def existence(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """J-09 over (doc_id, code, line_no): of each document, findings of either side that the other has too, by code and by line.

    Existence is counted by keys: there is no matrix of pairs.
    """
    one = lambda df, side: df.select("doc_id", "code", "line_no").distinct().withColumn("g", F.lit(int(side == "g"))).withColumn("p", F.lit(int(side == "p")))
    rows = one(gold, "g").union(one(pred, "p")).repartition("doc_id").groupBy("doc_id", "code", "line_no").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    per = rows.groupBy("doc_id", "code").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(F.col("g") * F.col("p")).alias("both"))
    has = lambda side, other: F.sum(F.when(F.col(other) > 0, F.col(side)).otherwise(0))
    return per.groupBy("doc_id").agg(
        F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), has("g", "p").alias("gold_by_code"), has("p", "g").alias("pred_by_code"), F.sum("both").alias("by_line"),
    )


def near_lines(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """J-12 over (doc_id, line_no): pairs at most ``width`` lines apart, by an equi join on blocks of lines."""
    if width < 1:
        raise ValueError("the width must be positive")
    block = F.floor(F.col("line_no") / width)
    left = a.select("doc_id", F.col("line_no").alias("a"), F.explode(F.array(block - 1, block, block + 1)).alias("k"))
    right = b.select("doc_id", F.col("line_no").alias("b"), block.alias("k"))
    return left.join(right, ["doc_id", "k"]).where(F.abs(F.col("a") - F.col("b")) <= width).select("doc_id", F.col("a").alias("a_line"), F.col("b").alias("b_line"))


def lookup_latest(rows: DataFrame, table: DataFrame, key: str, *order: str) -> DataFrame:
    """J-13: the rows with the columns of the last row of their key in the lookup table, or nulls."""
    return rows.join(keep_last(table, key, *order), key, "left")


def merge_by_code(findings: DataFrame) -> DataFrame:
    """A-02, J-18: one row per document and code, with the lines of all its findings in order, repeats included."""
    return findings.groupBy("doc_id", "code").agg(F.array_sort(F.collect_list("line_no")).alias("line_nos"))


def other_versions(versions: DataFrame, version: str) -> DataFrame:
    """J-15: (version, other) of each two different versions. There are few versions: they are one array."""
    listed = versions.select(version).distinct().agg(F.array_sort(F.collect_list(version)).alias("v"))
    each = listed.select(F.explode("v").alias(version), "v").select(version, F.explode("v").alias("other"))
    return each.where(F.col("other") != F.col(version))


def union_comments(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """O-20: comments of two kinds in one table."""
    return first.select(*columns, F.lit("issue").alias("kind")).unionByName(second.select(*columns, F.lit("review").alias("kind")))


def benchmark_chats(notes: DataFrame, specs: DataFrame, prompt: Column, label: Column, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """O-11b over notes (stem ``blob_rule``, content, violations): (chats, bad rows).

    Rule numbers lose leading zeros; those to skip go. Without content, violations, a number or a spec a row is bad.
    ``prompt`` and ``label`` are expressions over the columns of notes and of specs (rule and others).
    """
    rule = F.get(F.split("stem", "_"), F.lit(1)).try_cast("int").cast("string")
    rows = notes.withColumn("rule", rule).where(~F.coalesce(F.col("rule").isin(list(skip)), F.lit(False)) if skip else F.lit(True))
    both = rows.join(specs.withColumn("_known", F.lit(True)), "rule", "left")
    good = F.col("rule").isNotNull() & F.col("_known").isNotNull() & F.col("content").isNotNull() & F.col("violations").isNotNull()
    said = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), label.alias("content")))
    chats = both.where(good).select(F.col("stem").alias("id"), "rule", F.col("content").alias("code"), said.alias("messages"), F.concat(F.lit("benchmark/"), "rule").alias("source"))
    return chats, both.where(~good).select("stem", "rule")


def least_sections(pairs: DataFrame, sections: DataFrame, n: int) -> DataFrame:
    """S-10 over pairs (version, other) and sections (version, section): of each pair the ``n`` sections of any version with
    the least hash of the pair and the section.

    Sections are rows and stay so. Versions are few (releases) and their pairs are sent to all tasks while they are no
    more than PAIRS; a task keeps ``n`` sections of a pair before anything is shuffled.
    """
    known = sections.select("section").distinct()
    few = pairs.limit(PAIRS + 1).count() <= PAIRS
    both = known.join(F.broadcast(pairs) if few else pairs, how="cross")
    hashed = both.withColumn("h", F.md5(F.concat("version", F.lit("/"), "other", F.lit("/"), "section")))
    rank = F.row_number().over(W.partitionBy("version", "other").orderBy("h", "section"))
    return hashed.withColumn("rank", rank).where(F.col("rank") <= n).select("version", "other", "section")
