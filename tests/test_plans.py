"""Physical plans: no cross joins but with one row, no window or sort of all rows in one task, only the columns that are used."""

import re

import pytest
from pyspark.sql import functions as F

from lintloom.operators import decontaminate
from lintloom.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["decontaminated_docs", "neutral_balance", "train_test_split", "mixer_train", "wilcoxon_by_group", "positions", "near_lines", "cooccurrence", "preference_pairs", "source_counts", "parse_report", "detection_pr"])
def test_no_join_of_all_with_all(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text
    # only a broadcast of one row, made by an aggregate of all rows
    assert all("Cross" in x for x in re.findall(r"BroadcastNestedLoopJoin[^\n]*", text))
    # a single partition holds such an aggregate, never a sort
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "Sort" not in "".join(lines[max(0, i - 1) : i])


@pytest.mark.parametrize("name, columns", [("docs_not_labeled", "doc_id"), ("violation_histogram", None), ("mixer_test_whole", "doc_id,lang"), ("cost_estimate", "n_chars,source"), ("label_pr", "quality,toxic")])
def test_scans_read_what_is_used(spark, name, columns):
    read = {",".join(sorted(c.split(":")[0] for c in schema.split(","))) for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, DATA)))}
    if columns is None:
        assert read <= {"doc_id", "doc_id,text"}
    else:
        assert columns in read and not any("text" in r for r in read)


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["mixer_test_whole"](spark, DATA))
    assert re.search(r"PushedFilters: \[In\(lang", text)
    assert "PushedFilters: [IsNotNull(text)]" in plan(QUERIES["lint_rule_frequency"](spark, DATA))


def test_anchored_decontamination_shuffles_no_bodies(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    few, many = (decontaminate.contaminated(docs, bench, n) for n in (decontaminate.SMALL_CHARS, 0))
    assert "NestedLoop" not in plan(many) and "Cartesian" not in plan(many)
    rows = lambda df: sorted(r.doc_id for r in df.collect())
    assert rows(few) == rows(many) and len(rows(few)) > 0


def test_rules_are_tested_once_a_line(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        assert plan(QUERIES["lint_rule_frequency"](spark, DATA)).count("[0-9]{6}") == 1
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_ranks_need_no_single_task(spark):
    from lintloom.operators import keys

    df = spark.range(1000).select("id", F.lit(0).alias("all"))
    text = plan(keys.ranked(df, "all", [F.col("id")]))
    # windows are by range, or over the counts of ranges
    assert all("_part" in w or "_s" in w for w in re.findall(r"Window \[[^\n]*", text))
