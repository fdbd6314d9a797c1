import difflib
import gzip
import json
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintloom.operators import edits, fuzzy, joins, keys, metrics, patterns, sampling, star
from lintloom.plans import catalogue
from lintloom.sources import readers, sinks

HEADER = "### Final Idiom Violations Found"


def by_hand(text, wanted):
    out, at = "", 0
    for start, stop, content in sorted(wanted):
        if start < at or stop < start:
            continue
        out, at = out + text[at:start] + content, stop
    return out + text[at:]


def test_edits_and_their_reverse(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        text = "".join(rng.choice("ab\n é😀") for _ in range(rng.randrange(40)))
        wanted = []
        for _ in range(rng.randrange(5)):
            a, b = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
            wanted.append((a, b, rng.choice(["", "x", "\n--\n"])))
        rows.append((i, text, wanted))
    rows += [(99, None, [(0, 0, "x")]), (100, "", [])]
    df = spark.createDataFrame(rows, "id long, t string, e array<struct<start:int,stop:int,content:string>>")
    done = df.select("*", edits.edit(F.col("t"), F.col("e")).alias("d")).select("*", edits.edit(F.col("d.text"), F.col("d.reverse"))["text"].alias("back"))
    for r in done.collect():
        if r.t is None:
            assert r.d.text is None and r.d.reverse is None and r.back is None
        else:
            assert r.d.text == by_hand(r.t, [tuple(x) for x in r.e]) and r.back == r.t


def test_edits_are_given_on_in_small_parts():
    """However many texts a batch has, few of them are Python's objects at once."""
    n = 5 * edits.TEXTS + 3
    texts = pa.array([f"a{i}" for i in range(n)])
    wanted = pa.array([None if i == 7 else [{"start": 0, "stop": 1, "content": "b"}] for i in range(n)])
    parts = list(edits._edit(iter([(texts, wanted), (texts[:0], wanted[:0])])))
    assert len(parts) == 6 and max(map(len, parts)) == edits.TEXTS
    done = [x for part in parts for x in part.to_pylist()]
    assert [x["text"] for x in done] == [None if i == 7 else f"b{i}" for i in range(n)] and done[0]["reverse"] == [{"start": 0, "stop": 1, "content": "a"}]


def test_edits_at_positions_are_those_at_offsets(spark):
    point = lambda r, c: {"row": r, "column": c}
    wanted = [{"location": point(2, 2), "end_location": point(3, 1), "content": "X"}, {"location": point(1, 1), "end_location": point(1, 2), "content": ""}, {"location": point(9, 1), "end_location": point(9, 1), "content": "!"}]
    kind = "array<struct<location:struct<row:int,column:int>,end_location:struct<row:int,column:int>,content:string>>"
    df = spark.createDataFrame([("ab\ncé\nd", wanted), ("", []), (None, [])], f"t string, e {kind}")
    placed = df.select("t", "e", edits.offsets(F.col("t"), F.col("e")).alias("o")).collect()
    for r, done in zip(placed, df.select(edits.edit_at(F.col("t"), F.col("e")).alias("d")).collect(), strict=True):
        assert (done.d.text is None) if r.t is None else done.d.text == by_hand(r.t, [tuple(x) for x in r.o])


def test_positions(spark):
    text = "ab\n\ncé\n"
    df = spark.createDataFrame([(text, i) for i in range(len(text) + 1)], "t string, i int")
    row, col = edits.to_row(F.col("t"), F.col("i")), edits.to_column(F.col("t"), F.col("i"))
    for r in df.select("i", row.alias("r"), col.alias("c"), edits.to_offset(F.col("t"), row, col).alias("o")).collect():
        before = text[: r.i]
        assert (r.r, r.c, r.o) == (before.count("\n") + 1, r.i - (before.rfind("\n") + 1) + 1, r.i)


def test_safe_findings_and_order(spark):
    point = lambda r, c: {"row": r, "column": c}
    found = lambda code, a, b, fix=None: {"code": code, "message": "m", "location": a, "end_location": b, "fix": fix}
    fix = {"applicability": "safe", "message": "m", "edits": [{"content": "X", "location": point(1, 1), "end_location": point(1, 3)}]}
    rows = [("abcd\nefgh", [found("B", point(2, 1), point(2, 2), fix), found("A", point(1, 2), point(2, 4), fix | {"applicability": "unsafe"}), found("C", point(9, 1), point(9, 2))])]
    df = spark.createDataFrame(rows, f"t string, v {readers.VIOLATIONS}")
    b, a, c = df.select(edits.safe_findings(F.col("t"), F.col("v")).alias("s")).first().s
    assert [tuple(x) for x in a.code_spans_and_lines] == [("abcd", "bc"), ("efgh", "fg")] and a.fix is None and a.line_span == [1, 2]
    assert b.fix[0].content == "X" and tuple(b.fix[0].code_spans_and_lines[0]) == ("abcd", "ab") and c.code_spans_and_lines == []
    assert [x.code for x in df.select(edits.in_order(F.col("v")).alias("o")).first().o] == ["A", "B", "C"]


def test_examples_and_json_text(spark):
    df = spark.createDataFrame([("a\n\nb\n\nUse instead:\n\nc\n\nd", 'é"\n\t\\')], "e string, t string")
    r = df.select(edits.example_split(F.col("e")).alias("s"), edits.json_text(F.col("t")).alias("j"), edits.json_text(F.col("t"), quotes=False).alias("q"), edits.json_text(F.col("t"), ascii_only=True).alias("a")).first()
    assert tuple(r.s) == ("a\n\nb", "c") and r.j == json.dumps('é"\n\t\\', ensure_ascii=False) and r.q == r.j[1:-1] and r.a == json.dumps('é"\n\t\\')
    specs = spark.createDataFrame([("A", "safe", ("x", "y")), ("B", None, ("x", "y")), ("C", "safe", None)], "code string, fix_safety string, example_split struct<before:string,after:string>")
    assert [(r.code, tuple(r.example_split)) for r in edits.reversed_rules(specs).collect()] == [("A", ("y", "x"))]


def test_similar_is_ratio_with_a_bound():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert fuzzy.similar(a, b, 60) == (fuzzy.ratio(a, b) >= 60)
    assert fuzzy.similar("abcdefghijk", "abcdefghijx", 90) and difflib.SequenceMatcher(None, "abcdefghijk", "abcdefghijx").ratio() > 0.9


@pytest.mark.parametrize("percent", [1, 60, 80, 90, 91, 99, 100])
def test_the_gram_index_misses_no_partner(percent):
    rng = random.Random(percent)

    def edited(t):
        t = list(t)
        for _ in range(rng.randrange(1 + len(t) // 4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice(["", "x", "é", "\U0001f600"])
        return "".join(t)

    some = 0
    for alphabet, longest in (("ab", 6), ("abcdefgh ", 40), ("abcdefghijklmnopqrstuvwxyz \U0001f600", 150)):
        texts = sorted({"".join(rng.choices(alphabet, k=rng.randint(1, longest))) for _ in range(60)})
        index = fuzzy.GramIndex(texts, percent)
        for t in [edited(rng.choice(texts)) for _ in range(100)] + texts[:5]:
            if t:
                want = any(fuzzy.ratio(t, x) >= percent for x in texts)
                assert index.has_partner(t) == want
                some += want
    assert some > 15


def test_partners_of_blocks_and_steps(spark, monkeypatch):
    """Groups cut into small blocks, null keys and lines of very different lengths, against all pairs."""
    monkeypatch.setattr(fuzzy, "FEW", 7)
    monkeypatch.setattr(fuzzy, "MANY", 11)
    rng = random.Random(8)
    base = ["".join(rng.choices("abcde ", k=rng.choice([1, 4, 9, 30, 200]))) for _ in range(40)]
    near = lambda t: t[:-1] + rng.choice("xyz") if rng.random() < 0.6 else "".join(rng.choices("abcde ", k=8))
    rows = {(d, c, near(rng.choice(base)) if rng.random() < 0.7 else rng.choice(base)): rng.choice([(1, 0), (0, 2), (1, 1)]) for _ in range(400) for d, c in [(rng.choice([1, None]), rng.choice(["A", None]))]}
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "doc_id long, code string, line string, g int, p int")
    want = set()
    for (d, c, t), (g, p) in rows.items():
        side = "p" if p and not g else "g" if g and not p else None
        others = [x for (e, f, x), v in rows.items() if (e, f) == (d, c) and v["gp".index({"p": "g", "g": "p"}.get(side, "g"))]]
        if side and any(fuzzy.ratio(t, x) >= 90 for x in others):
            want.add((d, c, side, t))
    assert {tuple(r) for r in fuzzy.partners(df, ["doc_id", "code"], 90).collect()} == want and len(want) > 10


def test_legacy_subsets_are_diluted(spark):
    per = spark.createDataFrame([("A", 1.0, 1.0), ("B", 1.0, 1.0)], "code string, p double, r double")
    subsets = {"seen": ["A"], "near": ["A"], "far": ["B"]}
    assert {r.subset: r.f1 for r in metrics.subset_means(per, subsets).collect()} == {"seen": 1.0, "near": 1.0, "far": 1.0}
    assert {r.subset: r.f1 for r in metrics.subset_means(per, subsets, legacy=True).collect()} == {"seen": 1.0, "near": 0.5, "far": 0.5}


def test_paired_t_odd_rows(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert tuple(metrics.paired_t(empty, "a", "b").first()) == (0, None, None)
    same = spark.createDataFrame([(2.0, 1.0), (3.0, 2.0)], "a double, b double")
    assert metrics.paired_t(same, "a", "b").first().t is None


def test_star(spark):
    def responder(prompt, attempt, hint):
        if prompt == "never":
            raise OSError
        return hint if hint and prompt == "shown" else f"{prompt}{attempt}"

    tasks = spark.createDataFrame([(1, "a", "a0"), (2, "b", "b2"), (3, "shown", "x"), (4, "c", "x"), (5, "never", "x")], "id long, prompt string, truth string")
    judge = lambda said, truth: int(said == truth)
    got = {r.id: tuple(r)[1:] for r in star.star(tasks, star.with_retries(responder, 2), judge).collect()}
    assert got == {1: ("a0", 1, False, False), 2: ("b2", 3, False, False), 3: ("x", 4, True, False), 4: ("x", 4, True, True), 5: ("x", 4, True, True)}
    assert {r.id for r in star.star(tasks, star.with_retries(responder, 2), judge, fallback=False).collect()} == {1, 2, 3}


def test_gold_pairs_and_sections(spark):
    tasks = spark.createDataFrame([(1, "s", "p", "t"), (2, "s", "p", "t")], "id long, source string, prompt string, truth string")
    got = {r.id: r for r in star.gold_pairs(tasks, spark.createDataFrame([(1, "m")], "id long, response string")).collect()}
    assert got[1].rejected[0].content == "m" and got[2].rejected is None and got[2].chosen[1].content == "t"
    texts = [f"x\n{HEADER}\nNO VIOLATIONS FOUND", f"x {HEADER} **Idiom A Violations:**", f"{HEADER} {HEADER}", "none", f"x {HEADER} what", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    codes = F.array(F.lit("A"), F.lit("B"))
    r = {r.id: r.r for r in df.select("id", star.repair_sections(F.col("t"), codes, HEADER).alias("r")).collect()}
    assert r[0].count("NO VIOLATIONS FOUND") == 2 and r[0].startswith(f"x\n\n{HEADER}") and r[1] == texts[1] and r[2] is r[3] is r[4] is r[5] is None


def test_joins_odd_rows(spark):
    train = spark.createDataFrame([(1, "NO VIOLATIONS FOUND"), (2, "x"), (3, "y")], "id long, answer string")
    cot = spark.createDataFrame([(3, "why")], "id long, cot string")
    assert {r.id: r.answer for r in joins.with_reasoning(train, cot, "#").collect()} == {1: "NO VIOLATIONS FOUND", 3: "why\n\n#\n\ny"}
    assert {r.id for r in joins.with_reasoning(train, cot, "#", keep_clean=False).collect()} == {3}
    rows = spark.createDataFrame([(1, n) for n in (1, 4, 6, 20)] + [(2, 1)], "doc_id long, line_no long")
    got = sorted((r.doc_id, r.a_line, r.b_line) for r in joins.near_lines(rows, rows, 2).collect())
    assert got == [(1, 1, 1), (1, 4, 4), (1, 4, 6), (1, 6, 4), (1, 6, 6), (1, 20, 20), (2, 1, 1)]
    comments = joins.union_comments(spark.createDataFrame([(1, "a", 9)], "id long, body string, extra int"), spark.createDataFrame([("b", 2)], "body string, id long"), ["id", "body"])
    assert sorted(map(tuple, comments.collect())) == [(1, "a", "issue"), (2, "b", "review")]


def test_benchmark_chats(spark):
    notes = spark.createDataFrame([("a_0498", "x = 1", "v"), ("b_249", "x", "v"), ("c_572", "x", None), ("d", "x", "v"), ("e_9", "x", "v")], "stem string, content string, violations string")
    specs = spark.createDataFrame([("498", "S"), ("249", "S"), ("572", "S")], "rule string, spec string")
    good, bad = joins.benchmark_chats(notes, specs, F.concat("spec", F.lit(": "), "content"), F.col("violations"), ("249",))
    (r,) = good.collect()
    assert (r.id, r.rule, r.source) == ("a_0498", "498", "benchmark/498") and [tuple(m) for m in r.messages] == [("user", "S: x = 1"), ("assistant", "v")]
    assert {r.stem for r in bad.collect()} == {"c_572", "d", "e_9"}


def test_ranks_hold_null_strata_and_ties_of_strata(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") % 5 < 2, None).otherwise(F.col("id") % 3).alias("s"), F.md5(F.col("id").cast("string")).alias("h"))
    want = df.withColumn("w", F.row_number().over(W.partitionBy("s").orderBy("h", "id"))).select("id", "w")
    got = keys.ranked(df, "s", [F.col("h"), F.col("id")], "r")
    assert got.join(want, "id").where("r = w").count() == got.count() == 20000
    assert keys.ranked(df.limit(0), "s", [F.col("id")]).count() == 0


def test_samples(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b", i % 3 == 0) for i in range(9)], "doc_id long, s string, f boolean")
    got = sorted((r.s, r.f) for r in sampling.balanced(df, "s", "f", "doc_id", 1, 5).collect())
    assert got == [("a", False)] * 2 + [("a", True)] * 2 + [("b", False), ("b", True)]
    with pytest.raises(ValueError):
        sampling.balanced(df.where("f OR doc_id = 1"), "s", "f", "doc_id", 1, 5, strict=True)
    with pytest.raises(ValueError):
        sampling.take(df, "doc_id", 1, 2.5)
    assert sampling.take(df, "doc_id", 1, 100).count() == 9 and sampling.take(df, "doc_id", 1, 0).count() == 0
    a, b = (sorted(r.doc_id for r in sampling.offset_rows(df, "doc_id", at, 4).collect()) for at in (0, 4))
    assert (a, b) == ([0, 1, 2, 3], [4, 5, 6, 7])
    assert [r.n for r in sampling.halves(df, "doc_id").groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()] == [4, 5]


def test_try_else_kinds():
    code = "try:\n    global a\n    x = 1\nexcept E:\n    global b\n    b = 1\nelse:\n    global c\n    print(b)"
    assert {m[3] for m in patterns.detect(code, frozenset(["try_else"]))} == {"block", "global_in_try", "global_in_except", "global_in_else", "global_used_in_else"}
    assert patterns.detect("try:\n    pass\nexcept E:\n    pass", frozenset(["try_else"])) == []


def test_generic_class_header(spark):
    df = spark.createDataFrame([("class A[T]:",), ("class A:",), ("x = class A [T, U]:",), ("class A(B[T]):",)], "l string")
    assert [r.g for r in df.select(patterns.generic_class(F.col("l")).alias("g")).collect()] == [True, False, True, False]


def test_tables_and_metadata(spark):
    html = ('<table><tr><th>Code</th><th></th></tr><tr><td>A1 </td><td><span title="Automatic fix available">🛠</span> ✔</td></tr><tr><td>A2</td><td>❌</td></tr></table>'
            "<dl><dt>Author:</dt><dd>by <a>X</a>, <a>Y</a></dd><dt>Kind</dt><dd><abbr>Std</abbr> more</dd><dt>Year</dt><dd> 2020 </dd></dl>")
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<td>stray<table><tr>")], "page_id long, html string")
    rows = {r.cells["Code"]: r for r in readers.html_tables(pages).collect()}
    assert rows["A1"].states == ["Stable", "Automatically Fixable"] and rows["A1"].fix_available is True
    assert rows["A2"].states == ["Deleted"] and rows["A2"].fix_available is None and len(rows) == 2
    assert {(r.page_id, r.key, r.value) for r in readers.html_metadata(pages).collect()} == {(1, "Author", "X, Y"), (1, "Kind", "Std"), (1, "Year", "2020")}


PAGE_QUERIES = ["tables_of_pages", "metadata_of_pages", "sections_of_pages"]


@pytest.mark.parametrize("name", PAGE_QUERIES)
def test_pages_of_a_small_table_are_many_tasks(spark, tmp_path, name):
    """A table of one file and one row group is one task as it is read; its pages are parsed in as many as a shuffle has."""
    part = spark.range(300).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.col("id").cast("int").alias("p_size"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert catalogue.QUERIES[name](spark, str(tmp_path)).select("page_id").distinct().count() == 300
    tasks = catalogue.QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_blobs_specs_and_arrays(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.gz").write_bytes(gzip.compress("é".encode("latin-1")))
    (tmp_path / "b" / "y.gz").write_bytes(b"no")
    blobs = spark.createDataFrame([("x", "latin-1"), ("y", "utf-8"), ("z", None)], "blob_id string, encoding string")
    assert {r.blob_id: r.content for r in readers.read_blobs(blobs, str(tmp_path / "b")).collect()} == {"x": "é", "y": None, "z": None}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "A1.json").write_text('{"name":\n "n"}')
    (tmp_path / "m.csv").write_text("Code,Fix\n A1 ,yes\nB2,no\n")
    assert [tuple(r) for r in readers.read_rule_specs(spark, str(tmp_path / "m.csv"), str(tmp_path / "s"), "name string").select("code", "Fix", "name").collect()] == [("A1", "yes", "n")]
    df = spark.createDataFrame([(1, "é"), (2, None)], "a long, b string")
    assert sinks.write_json_array(df, str(tmp_path / "a.json")) == 2
    assert sorted(json.load(open(tmp_path / "a.json", encoding="utf-8")), key=lambda x: x["a"]) == [{"a": 1, "b": "é"}, {"a": 2, "b": None}]
    df.write.parquet(str(tmp_path / "d" / "train"))
    assert readers.read_dataset(spark, str(tmp_path / "d"), "train").count() == 2 and readers.read_dataset(spark, "x", "y", lambda *_: df) is df


def test_running_totals_of_small_and_large_tables(spark, monkeypatch):
    """One window, and ranges between sampled bounds, with a hot stratum, null strata and orders that repeat."""
    from lintloom.operators import keys

    rng = random.Random(12)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(40), i, rng.randrange(9)) for i in range(700)]
    df = spark.createDataFrame(rows, "s string, o int, i int, v int").repartition(5)
    run = lambda: sorted((tuple(r) for r in keys.running_total(df, "s", [F.col("o"), F.col("i")], F.col("v"), "total").collect()), key=str)
    large = run()
    monkeypatch.setattr(keys, "SMALL", 10_000)
    assert run() == large
    want, sums = [], {}
    for s, o, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want.append((s, o, i, v, sums.get(s, 0)))
        sums[s] = sums.get(s, 0) + v
    assert large == sorted(want, key=str)
