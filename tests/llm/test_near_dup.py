"""Near duplicates: long words that weak hashes mix up, repeated ids, and columns whose names clash in the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from lintloom.llm import near_dup
from tests.llm.brute import components


def thue_morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def test_long_words_do_not_collide(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo powers of two."""
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        for j, (a, b) in enumerate((("a", "b"), ("b", "a"))):
            rows.append((10 * k + j, " ".join(["same", "first", "words", thue_morse(n, a, b), "and", "last"])))
            rows.append((100 + 10 * k + j, thue_morse(n, a, b)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows) and len({c for _, c in got.values()}) == len(rows)


def test_words_of_long_texts_are_whole():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcXYZ", k=rng.randint(1, 9))) for _ in range(30_000)] + ["y" * 3000]
    text = "".join(w + rng.choice([" ", "\n", "\t\r", "\x0b \x0c"]) for w in words)
    size, near_dup.SPLIT_BYTES = near_dup.SPLIT_BYTES, 1000
    try:
        parts = near_dup.word_hashes(text)
    finally:
        near_dup.SPLIT_BYTES = size
    assert parts.tolist() == [near_dup.word_hashes(w)[0] for w in words]


def test_repeated_ids_of_different_texts(spark):
    long, other = "one two three four five six seven eight nine", "a b c d e f"
    rows = [(5, other), (5, long), (5, long), (3, other), (9, long), (7, None), (7, "x"), (8, "y"), (8, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [
        (3, 2, 3, True), (5, 5, 5, True), (5, 5, 5, True), (5, 5, 5, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 8, True), (8, 1, 8, True), (9, 5, 5, False)]


def test_the_stage_keeps_the_row_that_was_compared(spark):
    """Ids that repeat, one row of each a near duplicate of document 3: what is left is near to nothing that is left."""
    import corpus_pipeline as c

    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = words(60)
    rows = [(3, " ".join(base))]
    for i in range(12):
        near = base[: 58 - i % 3]
        rows += [(10 + i, " ".join(near)), (10 + i, " ".join(words(rng.choice([20, 90]))))]
    rows += [(40, "a b"), (40, ""), (41, ""), (41, None), (None, " ".join(base)), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = c.keep_distinct(spark, df, "").collect()
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, set()).add(t)
    size = lambda t: max(0, len((t or "").split()) - 4) or (1 if (t or "").split() else 0)
    chosen = {i: max(ts, key=size) for i, ts in by_id.items() if i is not None}
    kept = {i for i, (_, first) in components(sorted(chosen.items())).items() if first == i}
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None and r.doc_id != 41) == sorted((i, chosen[i]) for i in kept - {41})
    assert sum(r.doc_id == 41 for r in got) == 1 and sum(r.doc_id is None for r in got) == 2
    assert [r.doc_id for r in got if r.text and len(set(r.text.split()) & set(base)) > 50 and r.doc_id is not None] == [3]


CLASHES = ["flagged", "stays", "_word", "_bit", "_bits", "word", "bit", "bits", "n", "kept", "key", "place", "h1", "sketch", "Score", "label", "a.b", "odd `name`"]


@pytest.mark.parametrize("stage", ["quality", "language", "near_dup"])
def test_stages_leave_clashing_columns_alone(spark, stage):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.union(docs.where("doc_id < 4")).select("*", *(F.concat(F.lit(f"{x} "), F.col("doc_id").cast("string")).alias(x) for x in CLASHES))
    out = dict(c.STAGES)[stage](spark, more, "/root/testdata/sf0.001")
    assert out.columns == more.columns
    rows = out.collect()
    assert rows and all(r[x] == f"{x} {r.doc_id}" for r in rows for x in CLASHES)
    plain = dict(c.STAGES)[stage](spark, docs.union(docs.where("doc_id < 4")), "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect())


@pytest.mark.parametrize("stage", ["quality", "language", "near_dup", "packing"])
def test_stages_take_odd_rows(spark, stage):
    import corpus_pipeline as c

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b", None, None, 3), (3, "a b", None, None, 3), (None, "a b", "en", "s", 3), (4, "x" * 300_000, "en", "s", 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    run = dict(c.STAGES)[stage]
    got = sorted(run(spark, docs, "/root/testdata/sf0.001").collect(), key=str)
    assert got == sorted(run(spark, docs, "/root/testdata/sf0.001").collect(), key=str)
    if stage == "near_dup":
        assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "None"]
    assert run(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
