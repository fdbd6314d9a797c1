"""Empty tables, null ids, repeated rows and columns whose names clash, for every operator that maps rows one by one."""

import pytest
from pyspark.sql import functions as F

from lintloom.llm import bpe_ops, language, license_scan, ogg, packing, quality, toxicity

DATA = "/root/testdata/sf0.001"
CLASHES = ["held_out", "score", "predicted", "n_matches", "n_clauses", "lang_pred", "ambiguous", "strange", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "n_bytes", "media", "feature",
           "labels", "base_labels", "spans", "n_words", "label", "x", "uid", "grp", "length", "sequence_id", "lang", "source", "n_chars", "C0"]
ROWS = [(1, None), (2, ""), (None, "a b c d e f"), (3, "x y z"), (3, "x y z"), (4, "word. " * 40_000), (4, "other")]


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return quality.learn(docs, labels), toxicity.learn(docs, labels), language.learn(docs)


def run(name, df, learned):
    (model, prior), grammar, codes = learned
    return {
        "op1": lambda: toxicity.score(df, grammar), "op2": lambda: bpe_ops.encode(df), "op3": lambda: ogg.media(df), "op4": lambda: quality.score(df, model, prior),
        "op8": lambda: packing.pack(df), "op9": lambda: language.predict(df, codes), "op10": lambda: license_scan.scan(df),
    }[name]()


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op8", "op9", "op10"])
def test_edges(spark, learned, name):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string")
    clashing = plain.select("*", *(F.lit(f"clash {c}").alias(c) for c in CLASHES))
    out = run(name, clashing, learned)
    assert run(name, clashing.limit(0), learned).count() == 0
    drop = ["sequence_id", "offset", "padded_length"] if name == "op8" else []
    rows = lambda df: sorted((str(r) for r in df.drop(*drop).collect()))
    got = rows(out)
    assert got == rows(run(name, plain, learned)) and not any("clash" in r for r in got)
    if name != "op8":
        assert len(got) == len(ROWS) and sum("doc_id=3" in r for r in got) == 2
    assert any("doc_id=None" in r for r in got)


def test_labels_with_nulls_and_conflicts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 7, -1), (10**12, 1, 1)], labels.schema)).withColumn("text", F.lit("x")).withColumn("label", F.lit("x"))
    (model, prior), grammar = quality.learn(docs, odd), toxicity.learn(docs, odd)
    assert all(0 <= r.score <= 1 for df in (quality.score(docs, model, prior), toxicity.score(docs, grammar)) for r in df.collect())
    for none in (labels.where("quality = 1 AND toxic = 0"), labels.limit(0)):
        (model, prior), grammar = quality.learn(docs, none), toxicity.learn(docs, none)
        assert model is None and not grammar.weights and quality.score(docs, model, prior).where(F.abs(F.col("score") - prior) > 1e-12).count() == 0
