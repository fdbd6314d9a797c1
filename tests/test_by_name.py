"""Table functions by name, samples of mixed types, and counts of what was left out."""

import pytest
from pyspark.sql import functions as F

from lintloom.operators import patterns, samples, table_functions
from lintloom.sources import readers

CODE = [("a", "if (n := 5):\n    pass\n"), ("b", "x = '%s' % y\n"), ("c", "def f(:\n"), ("d", None), ("e", "(" * 5000 + ")" * 5000), ("f", "")]


def test_detectors_by_name(spark):
    table_functions.register(spark)
    files = spark.createDataFrame(CODE, "blob_id string, content string")
    files.createOrReplaceTempView("some_files")
    got = spark.sql("SELECT f.blob_id, d.* FROM some_files f, LATERAL detect(f.content) d").collect()
    assert sorted(tuple(r) for r in got if r.pattern) == sorted(tuple(r) for r in patterns.find_patterns(files).collect())
    assert {(r.blob_id, r.kind) for r in got if r.pattern is None} == {("c", "syntax"), ("e", "depth")}
    one = spark.sql("SELECT f.blob_id, d.start_line FROM some_files f, LATERAL detect(f.content, 'pep_572') d WHERE d.pattern IS NOT NULL").collect()
    assert [tuple(r) for r in one] == [("a", 1)]
    for name in ("'pep_0'", "f.blob_id"):
        with pytest.raises(Exception, match="pattern"):
            spark.sql(f"SELECT d.* FROM some_files f, LATERAL detect(f.content, {name}) d").collect()


def test_parsers_by_name(spark):
    table_functions.register(spark)
    text = '**Idiom X Violations:**\n{"line": "1 a"}\n{"line": 3}\nbad\n\n**Idiom Y Violations:**\nNO VIOLATIONS FOUND'
    spark.createDataFrame([(1, text), (2, None)], "id long, report string").createOrReplaceTempView("some_reports")
    lines = spark.sql("SELECT r.id, p.code, p.line FROM some_reports r, LATERAL parse_report(r.report, 'lines') p")
    assert [tuple(r) for r in lines.collect()] == [(1, "X", "1 a"), (1, "X", None)] and lines.columns == ["id", "code", "line"]
    marked = spark.sql("SELECT p.* FROM some_reports r, LATERAL parse_report(r.report, 'marked') p")
    assert marked.columns == ["code", "item"] and [r.code for r in marked.collect()] == ["X", "X", "Y"]
    with pytest.raises(Exception, match="parser"):
        spark.sql("SELECT p.* FROM some_reports r, LATERAL parse_report(r.report, 'other') p").collect()


def test_samples_of_mixed_types(spark):
    rows = [(1, '[["a", 0.5], ["b", 1], ["c"], ["d", null], ["e", "x"]]'), (2, '[["a\\"\\u00e9", -1e3, 7], 5, {"text": 1}, [], [1, 2], null, "s"]'), (3, "not json"), (4, None), (5, "[]"), (6, '{"a": 1}'), (7, '["plain", 0.5]')]
    df = spark.createDataFrame(rows, "id long, s string")
    got = {r.id: r.x and [(x.text, x.reward, x.whole) for x in r.x] for r in df.select("id", samples.samples(F.col("s")).alias("x")).collect()}
    bad = (None, None, False)
    assert got == {1: [("a", 0.5, True), ("b", 1.0, True), ("c", None, True), ("d", None, True), ("e", None, True)], 2: [('a"é', -1000.0, True)] + [bad] * 6, 3: None, 4: None, 5: [], 6: None, 7: [bad, bad]}
    flat = samples.explode_samples(df, "id", "s").collect()
    assert sorted((r.id, r.at) for r in flat if r.whole) == [(1, i) for i in range(5)] + [(2, 0)]
    assert sum(not r.whole for r in flat) == 6 + 1 + 1 + 1 + 2
    again = df.where("id IN (1, 2, 5)").select("id", F.filter(samples.samples(F.col("s")), lambda x: x["whole"]).alias("x")).withColumn("y", samples.samples(samples.as_json(F.col("x"))))
    assert all(r.x == r.y for r in again.collect())


def test_counts_of_lines_that_were_left_out(spark, tmp_path):
    path = str(tmp_path / "lines")
    text = ['{"a": 1}', "", "  \t", '{"a": 2, "z": 3}', "bad", '{"a": "x"}', "[1]", '{"a": 3', "null"]
    spark.createDataFrame([(x,) for x in text], "value string").write.text(path)
    rows, seen = readers.read_jsonl_counted(spark, path, "a long")
    assert sorted(r.a for r in rows.collect()) == [1, 2] and rows.columns == ["a"]
    assert seen.get == {"lines": 7, "bad": 5, "rows": 2}


def test_faults_are_counted_in_the_same_pass(spark):
    files = spark.createDataFrame(CODE, "blob_id string, content string")
    found, seen = patterns.find_patterns_counted(files)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in patterns.find_patterns(files).collect())
    assert seen.get == {"files": 6, "syntax": 1, "depth": 1}


def test_budget_by_a_vocabulary(spark):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from lintloom.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: n for r in docs if (n := len(coder.encode_ordinary(r.text or ""))) < 250}
    assert {r.doc_id: r.tokens for r in QUERIES["within_vocabulary_budget"](spark, sf).collect()} == want and 0 < len(want) < len(docs)


def test_names_of_files_stay_in_their_folder(spark, tmp_path):
    from lintloom.sources import sinks

    for name in ("../x", "a/b", "..", "", "a\\b"):
        with pytest.raises(Exception, match="no name of a file"):
            sinks.write_files(spark.createDataFrame([(name, "text")], "n string, c string"), str(tmp_path / "out"), "n", "c")
    assert not (tmp_path / "x").exists()


def test_every_version_gets_its_least_sections(spark):
    import hashlib

    from lintloom.operators import joins

    rows = [(f"v{i}", f"s{k}") for i in range(4) for k in range(30) if (i + k) % 3]
    pairs = [(a, b) for a in ("v0", "v1", "v2", "v3") for b in ("v0", "v1", "v2", "v3") if a != b]
    got = joins.least_sections(spark.createDataFrame(pairs, "version string, other string"), spark.createDataFrame(rows, "version string, section string"), 2).collect()
    known = {s for _, s in rows}
    want = {(a, b, s) for a, b in pairs for s in sorted(known, key=lambda s, a=a, b=b: (hashlib.md5(f"{a}/{b}/{s}".encode()).hexdigest(), s))[:2]}
    assert {tuple(r) for r in got} == want


def test_detectors_take_time_in_proportion():
    import time

    nested = lambda n: "".join(f"{' ' * i}def f{i}():\n" for i in range(60)) + " " * 60 + "[f0() for x in y]\n" + "\n".join(f"def g{i}(a: int): # must be positive\n    return [f0() for x in a]\n" for i in range(n))
    took = []
    for n in (300, 2400):
        began = time.time()
        found = patterns.detect(nested(n), frozenset(["pep_709", "pep_593h"]))
        took.append(time.time() - began)
        assert sum(m[0] == "pep_593h" for m in found) >= n
    assert took[1] < 8 * 3 * took[0] + 0.5
