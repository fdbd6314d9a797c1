import math

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintloom.functions import text
from lintloom.operators import decontaminate, fuzzy, keys, metrics, pairs, patterns, reports
from lintloom.plans import catalogue
from lintloom.sources import readers, sinks
from lintloom.streaming import streams

SNIPPETS = {
    "try_else": "try:\n    x = 1\nexcept E:\n    pass\nelse:\n    y = 2", "gh_111123": "try:\n    x = 1\nexcept E:\n    global x", "gh_118216": "from .__future__ import x", "pep_468": "f(**kw)",
    "pep_479": "def g():\n    yield 1\n    raise StopIteration", "pep_487": "class A:\n    def __set_name__(self, o, n): pass", "pep_495": "t.fold",
    "pep_498": "f'{x}'", "pep_498v": "'%s' % x", "pep_519": "os.fspath(p)", "pep_525": "async def g():\n    yield 1", "pep_526": "x: int = 1",
    "pep_530": "async def f():\n    return [x async for x in y]", "pep_553": "breakpoint()", "pep_557": "@dataclass\nclass A:\n    pass",
    "pep_562": "def __getattr__(name): pass", "pep_563": "def f(x: 'int'): pass", "pep_567": "v = ContextVar('v')", "pep_570": "def f(a, /): pass",
    "pep_572": "if (n := 10): pass", "pep_578": "sys.audit('x')", "pep_584": "a = {}\nb = a | {}", "pep_585": "def f(x: list[int]): pass", "pep_585v": "def f(x: List[int]): pass",
    "pep_586": "from typing import Literal", "pep_589": "T = TypedDict('T', {})", "pep_593": "from typing import Annotated", "pep_616": "x.removeprefix('a')",
    "pep_634": "match x:\n    case 1: pass", "pep_655": "from typing import NotRequired", "pep_709": "[locals() for x in y]", "pep_584h": "d.update(x)",
    "pep_614": "@b[0]\ndef f(): pass", "pep_616h": "if x.startswith('a'):\n    x = x[1:]", "class_prefilter": "class A:\n    def __eq__(self, o): pass",
}


def test_every_detector_has_a_snippet():
    assert set(SNIPPETS) == set(patterns.DETECTORS)


@pytest.mark.parametrize("name", sorted(SNIPPETS))
def test_detector(name):
    assert name in {m[0] for m in patterns.detect(SNIPPETS[name])}
    assert name not in {m[0] for m in patterns.detect("x = 1\nprint(x)")}


def test_long_blocks_are_whole():
    code = "class A:\n    def __eq__(self, o):\n" + "\n".join(f"        x{i} = {i}" for i in range(1000))
    assert [m[4] for m in patterns.detect(code, frozenset(["class_prefilter"]))] == [code] and len(code) > 10_000


def kinds(code, name):
    return [(m[1], m[3]) for m in patterns.detect(code, frozenset([name]))]


def test_inlined_comprehensions():
    code = "def f(y):\n    return [locals() for x in y]\ndef g():\n    raise E\ndef h():\n    return [g() for x in y]\nsys.settrace(f)\ndef j():\n    return {x for x in y}\nw.warn('a', stacklevel=2)"
    want = [(2, "locals() includes outer variables"), (6, "no dedicated frame in traceback"), (7, "tracing/profiling setup"), (8, "tracing/profiling changes"), (10, "stacklevel warnings")]
    # the walk is by levels: f and h come before the call of settrace
    assert kinds(code, "pep_709") == want
    assert kinds("[f() for x in y]\ndef f(): pass\nw.warn('a')", "pep_709") == []


def test_dict_merges():
    code = "d.update(x)  # a\nfor k, v in a.items():\n    b[k] = v\n    c.e[k] = v\nfor k in a.items():\n    b[k] = 1\nd.update(x=1)"
    assert kinds(code, "pep_584h") == [(1, "dict_update"), (2, "manual_items_loop"), (2, "manual_items_loop")]
    assert [m[3:] for m in patterns.detect(code, frozenset(["pep_584h2"]))] == [("dict_update", "d |= x"), ("manual_items_loop", "c.e |= a")]
    assert kinds("a = {}\nb = {}\nc = a | b", "pep_584") == [(1, "init"), (2, "init"), (3, "union")] and kinds("a = {}", "pep_584") == []


def test_decorators_by_name_and_affixes():
    assert kinds("d = b[0]\ne = b.c\n@d\n@e\ndef f(): pass\ng = h\n@g\ndef i(): pass", "pep_614") == [(3, "f: d from Subscript"), (4, "f: e from Attribute")]
    assert kinds("if x.startswith('a'):\n    x = x[1:]\nif x.endswith('a'):\n    x = x[:-1]\nif x.endswith('a'):\n    x = x[1:]\nif x.startswith('a'):\n    y = x[1:]", "pep_616h") == [(1, "removeprefix"), (3, "removesuffix")]


def test_annotated_hints():
    code = "def f(a: int) -> str:  # must be positive\n    pass\n\n\nx: int = 1\n# at most 5\n\n\n\ny: int = 1"
    got = [(m[1], m[4]) for m in patterns.detect(code, frozenset(["pep_593h"]))]
    assert got == [(1, "`a` in `f`: Annotated[int, range=...]"), (1, "return of `f`: Annotated[str, range=...]"), (5, "attribute `x`: Annotated[int, max=...]")]
    assert len(kinds('class A:\n    """Deprecated, \\d."""\n    x: int', "pep_593h")) == 1 and kinds("X = Annotated[int, 1]", "pep_593") == [(1, "assignment")]


def test_underscored_numbers():
    assert kinds("p = 1_000\nq = 'é', 1_0, 5\nr = '1_0'\ns_t = 5", "pep_515") == [(1, ""), (2, "")]


def test_unsafe_random(spark):
    rows = ["token = random.random()", "token = np.random.rand()", "my_key = x + random.choice(y)", "token = random.random()\nrandom.seed(1)", "import secrets\nkey = random.random()", "x = random.random()", "key = 1\nrandom.random()"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").where(patterns.unsafe_random(F.col("t")))
    assert sorted(r.i for r in df.collect()) == [0, 1, 2]


def test_unreadable_code():
    assert patterns.detect("def (") == [] and patterns.detect(None) == [] and isinstance(patterns.detect("(" * 5000), list)


def test_numbered_lines_keep_wide_numbers(spark):
    df = spark.createDataFrame([("\n".join("ab"),), ("x\n" * 1000,)], "t string").select(text.number_lines(F.col("t")).alias("n"))
    a, b = [r.n for r in df.collect()]
    assert a == "  1 a\n  2 b" and b.split("\n")[-1] == "1001 "


def test_line_numbers(spark):
    df = spark.createDataFrame([("  1 a\n 2: b\nx 3\n\n1 c",), (None,)], "t string").select(text.line_numbers(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [[1, 2], None]


def test_report_parsers_agree_and_drop_bad_lines(spark):
    report = 'x\n{"line": "0 z"}\n**Idiom A Violations:**\n{"line": "3 a\\n4 b"}\n\nNO VIOLATIONS FOUND\n{"line": 5\n[1]\n7\n{\'line\': \'9\'}\n**Idiom B Violations:**\n{"line": "12: c"}'
    df = spark.createDataFrame([(1, report), (2, None), (3, "")], "doc_id long, report string")
    assert sorted((r.code or "", r.line_nos) for r in reports.parse(df).collect()) == [("", [0]), ("A", [3, 4]), ("B", [12])]
    assert sorted((r.code or "", r.line) for r in reports.parse_strict(df).collect()) == [("", "0 z"), ("A", "3 a\n4 b"), ("B", "12: c")]


def test_report_variants():
    assert reports.parse_flat(" NO VIOLATIONS FOUND\n") == [] and reports.parse_flat('{"a": 1}\n[2]\nx') == [{"a": 1}]
    assert reports.parse_flat('{"a": 1}\n## Idiom Violations Found\n{"a": 2}\n## Idiom Violations Found\n {"a": 3}') == [{"a": 3}]
    escaped = '{\\"a\\": 1}'
    assert reports.parse_escaped(f'{{"b": 2}}\n\n{escaped}') == [{"b": 2}, {"a": 1}]
    assert reports.parse_escaped('{"b": 2}\nx') == [] and reports.parse_escaped('{"b": 2}\nx', strict=False) == [{"b": 2}]
    head = "**Idiom {} Violations:**".format
    assert reports.parse_idioms("\n".join(['{"a": 0}', head("A"), '{"a": 1}', "{a}", head("B"), "", "NO VIOLATIONS FOUND"])) == {"A": [{"a": 0}, {"a": 1}], "B": "NO VIOLATIONS FOUND"}
    assert reports.parse_idioms("\n".join([head("B"), "NO VIOLATIONS FOUND", "{}"])) is None and reports.parse_idioms("**Idiom A:**") is None
    assert reports.parse_marked("\n".join(["NO VIOLATIONS FOUND", head("A"), '{"a": 1}', "[1]", head("B"), "NO VIOLATIONS FOUND"])) == [{"a": 1, "code": "A"}, {"code": "B"}]


def test_found_values_are_given_on_in_parts():
    """The rows of a batch of reports, which are many more than the reports, aren't held at once."""
    n, line = 3 * reports.REPORTS + 1, '{"line": "1 x"}'
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["\n".join([line] * 100)] * (n - 1) + [None])], names=["id", "text"])
    parts = list(reports._batches([batch, batch.slice(0, 0)], reports._items, ["id", "parser", "code", "item"]))
    assert max(p.num_rows for p in parts) == reports.ROWS and len(parts) == -(-(n - 1) * 300 // reports.ROWS)
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert rows == [r for i in range(n - 1) for r in reports._items(i, "\n".join([line] * 100))]


def test_responses_are_deduplicated(spark):
    a, b = '**Idiom A Violations:**\n\n{"line": "1 x"}', "**Idiom B Violations:**\n\nNO VIOLATIONS FOUND"
    final = "why\n\n### Final Idiom Violations Found\n\n"
    lossy = a + "\nNO VIOLATIONS FOUND"
    df = spark.createDataFrame([(1, f'{final}{a}\n{{"line": "1 x"}}\n\n{b}'), (2, f"{a}\n\n{b}\n"), (3, lossy), (4, None)], "doc_id long, report string")
    assert {r.id: r.report for r in reports.deduplicate(df).collect()} == {1: f"{final}{a}\n\n{b}\n", 2: f"{a}\n\n{b}\n", 3: lossy, 4: None}
    assert {(r.id, r.parser, r.code, r.item) for r in reports.parse_items(df.where("doc_id = 2")).collect()} >= {(2, "flat", None, '{"line": "1 x"}'), (2, "marked", "B", '{"code": "B"}')}


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_fuzzy_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 100 if not a and not b else round(200 * table[-1][-1] / (len(a) + len(b)))
    assert fuzzy.ratio(a, b) == want


def test_pairs_check_validity_on_one_side_only(spark):
    rows = [(1, 0, 1.0, True), (1, 1, 0.0, False), (2, 0, 0.0, True), (2, 1, 1.0, False), (3, 0, 0.5, True), (3, 1, 0.25, True)]
    df = spark.createDataFrame(rows, "id long, idx int, reward double, valid boolean")
    assert [r.pair_id for r in pairs.preference_pairs(df, 0.25).collect()] == ["2_0<1"]
    assert pairs.preference_pairs(df, 0.25, symmetric=True).count() == 0
    with pytest.raises(ValueError):
        pairs.preference_pairs(df, 0)


def test_rewards_of_empty_sides(spark):
    kind = "doc_id long, code string, line_no long"
    gold = spark.createDataFrame([(1, "A", 1), (2, "A", 1)], kind)
    pred = spark.createDataFrame([(1, "A", 1), (3, "A", 1)], kind)
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id long")
    got = {r.doc_id: (r.reward_v1, r.reward_v2, r.reward_v3) for r in metrics.rewards(gold, pred, docs).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 1, 1)}


def test_kappa_and_wilcoxon(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "a int, b int")
    assert math.isclose(metrics.kappa(df, "a", "b").first().kappa, 0.5)
    assert metrics.kappa(df.select(F.lit(0).alias("a"), F.lit(0).alias("b")), "a", "b").first().kappa is None
    w = metrics.wilcoxon(spark.createDataFrame([(5, 1), (1, 3), (2, 4), (7, 7)], "a int, b int"), "a", "b").first()
    assert (w.w_plus, w.w_minus, w.w, w.n) == (3.0, 3.0, 3.0, 3)


def test_mixture_sizes(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(300)], "doc_id long, lang string")
    assert keys.prefix_fraction(df, "lang", "doc_id", {"a": 0.7, "b": 0.4}).count() == 110
    assert keys.prefix_fraction(df, "lang", "doc_id", {"a": 0.5, "b": 0.3, "c": 0.2}).count() == 100
    with pytest.raises(ValueError):
        keys.prefix_fraction(df, "lang", "doc_id", {"a": -0.1})


def test_ranks_over_tasks(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    got = {(r.k, r.id): r["rank"] for r in keys.ranked(df, "k", [F.col("id")]).collect()}
    assert got == {(i % 3, i): i // 3 + 1 for i in range(1000)}


def test_running_totals(spark):
    """Within strata, a null one among them, against a plain sum; ties in the order are broken by the next key."""
    rows = [(i, [None, "a", "b"][i % 3], i * 7 % 10) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, v int")
    got = {r.id: r.t for r in keys.running_total(df, "k", [F.col("v"), F.col("id")], F.col("v").cast("long"), "t").collect()}
    assert got == {i: sum(w for j, l, w in rows if l == k and (w, j) < (v, i)) for i, k, v in rows}
    assert keys.ranked(df.limit(0), "k", [F.col("id")]).count() == 0


def test_contiguous_prefix(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 1, 2, 4, -1)], "i long")
    assert sorted(r.i for r in keys.contiguous_prefix(df, "i").collect()) == [0, 1, 1, 2]
    assert keys.contiguous_prefix(df.where("i > 3"), "i").count() == 0


def test_contiguous_prefix_past_a_block(spark):
    df = spark.range(140_000).withColumnRenamed("id", "i")
    assert keys.contiguous_prefix(df.where("i NOT IN (66000, 139000)"), "i").count() == 66_000
    assert keys.contiguous_prefix(df.where("i <> 65536"), "i").count() == 65_536 and keys.contiguous_prefix(df, "i").count() == 140_000


def test_whole_inputs_reach_prefix_and_mixer(spark):
    data = "/root/testdata/sf0.001"
    events, docs = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("events", "documents"))
    assert catalogue.QUERIES["contiguous_prefix_all"](spark, data).count() == events.count() > 500
    assert catalogue.QUERIES["mixer_test_whole"](spark, data).count() == docs.where(F.col("lang").isin(list(catalogue.MIX))).count()


def test_contamination_ways_agree(spark):
    import random

    docs = spark.createDataFrame([(1, "x  Alpha\nbeta  gamma delta y"), (2, "alpha beta"), (3, None), (4, "one"), (5, "stone"), (6, "")], "doc_id long, text string")
    bench = spark.createDataFrame([("alpha beta GAMMA delta",), ("one",), ("",), (None,)], "text string")
    for few in (1000, 0):
        assert sorted(r.doc_id for r in decontaminate.contaminated(docs, bench, few).collect()) == [1, 4, 5]
        assert decontaminate.contaminated(docs, bench.limit(0), few).count() == 0
    rng = random.Random(8)
    words = lambda k: " ".join(rng.choices(["a", "b", "ab", "ba", "cab", "abc"], k=k))
    texts = [(i, words(rng.randint(0, 8))) for i in range(150)]
    items = sorted({words(rng.randint(1, 5)) for _ in range(25)} - {""})
    want = [i for i, t in texts if any(x in t for x in items)]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(x,) for x in items], "text string")
    for few in (1000, 0):
        assert sorted(r.doc_id for r in decontaminate.contaminated(df, bench, few).collect()) == want


def test_line_starts_and_repeats(spark):
    import random
    import time

    from lintloom.functions import rules
    from lintloom.operators import edits

    rng = random.Random(9)
    texts = ["", "\n", "a", "\n\nb\n"] + ["".join(rng.choices("ab\n", k=n)) for n in (10, 300, 5000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", edits.line_starts(F.col("t")).alias("s"), rules.repeats(F.split("t", "\n", -1)).alias("r"))
    for r in df.collect():
        rows, starts = r.t.split("\n"), [0]
        for x in rows:
            starts.append(starts[-1] + len(x) + 1)
        assert r.s == starts and r.r == [x != "" and x in rows[:i] for i, x in enumerate(rows)]
    took = []
    for n in (20_000, 100_000):
        long = spark.createDataFrame([(1, "\n".join(f"line {i % 5000}" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert rules.violations(long).where("code = 'R_DUPLINE'").count() == n - 5000
        at = long.select(F.element_at(edits.line_starts(F.col("text")), n).alias("x"), F.length("text").alias("n")).first()
        assert at.n - at.x == len(f"line {(n - 1) % 5000}")
        took.append(time.time() - began)
    assert took[1] < 25 * took[0]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"blob_id": "1", "v": 1}\n{"blob_id": "2", "v": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"blob_id": "1", "v": 3}\n{"blob_id": "1", "v": 4}\n')
    got = {r.blob_id: r.v for r in readers.load_dump(spark, str(tmp_path), "blob_id string, v int").collect()}
    assert got == {"1": 4, "2": 2}
    (tmp_path / "c.txt").write_text('{"blob_id": "1", "v": 1}\nbad\n')
    assert readers.read_jsonl(spark, str(tmp_path / "c.txt"), "blob_id string, v int", "safe").count() == 1
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        readers.read_jsonl(spark, str(tmp_path / "c.txt"), "blob_id string, v int").collect()
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert sinks.write_jsonl(df, str(tmp_path / "out")) == 2 * len('{"id":1,"t":"a"}\n')
    sinks.append_new(df, str(tmp_path / "app"), "id")
    sinks.append_new(df.union(spark.createDataFrame([(3, "c")], df.schema)), str(tmp_path / "app"), "id")
    assert spark.read.parquet(str(tmp_path / "app")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    from lintloom.functions import rules

    docs = spark.createDataFrame([(1, "A \n\n\nB"), (2, "one two three four five")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    streams.start_append(streams.stream_findings(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(rules.violations(docs))


def test_wilcoxon_p_values(spark):
    """Exact by all signs for few pairs without ties; else the normal approximation, against math.erfc."""
    import itertools

    def one(pairs, **more):
        df = spark.createDataFrame(pairs, "g string, a double, b double")
        return metrics.wilcoxon(df, "a", "b", **more)

    few = [("x", float(d), 0.0) for d in (1, -2, 3, 4, -5, 6, 7)]
    r = one(few).first()
    sums = [sum(k for k, s in zip(range(1, 8), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=7)]
    assert (r.w, r.n) == (7.0, 7) and math.isclose(r.p, min(1.0, 2 * sum(s <= 7 for s in sums) / 128))
    many = [("y", float(i % 9 - 3), 0.0) for i in range(200)]
    r = one(many).first()
    diffs = [i % 9 - 3 for i in range(200) if i % 9 != 3]
    size = {m: sum(abs(d) == m for d in diffs) for m in {abs(d) for d in diffs}}
    n, z2 = len(diffs), sum(c**3 - c for c in size.values())
    z = abs(r.w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - z2 / 48)
    assert r.n == n and math.isclose(r.p, math.erfc(z / math.sqrt(2)), rel_tol=1e-6)
    by = {x.g: x for x in one(few + many, group="g", alpha=0.05).collect()}
    assert math.isclose(by["y"].p, r.p, rel_tol=1e-9) and by["y"].significant == (r.p < 0.025) and not by["x"].significant
    assert one([("x", 1.0, 1.0)]).first().p is None


def test_text_localization_is_brute_force(spark):
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("ab", k=rng.randint(0, 14)))
    gold = [(d, c, word()) for d in range(6) for c in "AB" for _ in range(rng.randint(0, 6))]
    pred = [(d, c, rng.choice([word(), rng.choice(gold)[2]])) for d in range(6) for c in "AB" for _ in range(rng.randint(0, 6))]
    kind = "doc_id long, code string, line string"
    sides = [spark.createDataFrame(x, kind) for x in (gold, pred)]
    for percent, all_gold, swapped in ((90, False, False), (91, True, True), (60, True, False)):
        want = {}
        for code in "AB":
            rows = []
            for d in range(6):
                a, b = ([line for i, c, line in side if (i, c) == (d, code)] for side in (gold, pred))
                if not a or not b and not all_gold:
                    continue
                fuzzy_p = sum(any(fuzzy.ratio(x, y) >= percent for y in a) for x in b)
                fuzzy_r = sum(any(fuzzy.ratio(x, y) >= percent for y in b) for x in a)
                if swapped:
                    fuzzy_p, fuzzy_r = fuzzy_r, fuzzy_p
                exact = (sum(x in a for x in b), sum(x in b for x in a))
                rows.append((exact[0] / len(b), exact[1] / len(a), fuzzy_p / len(b), fuzzy_r / len(a)) if b else (0, 0, 0, 0))
            if rows:
                want[code] = (len(rows), *(round(sum(x) / len(rows), 6) for x in zip(*rows, strict=True)))
        got = metrics.text_localization(*sides, percent, all_gold, swapped).collect()
        assert sorted(r.code for r in got) == sorted(want)
        assert all(tuple(r)[1:] == pytest.approx(want[r.code], abs=2e-6) for r in got)


def test_prompts(spark):
    from lintloom.functions import prompts

    df = spark.createDataFrame([("a {b} {{c}}", "x"), (None, "y")], "s string, t string")
    filled = df.select(prompts.fill("{{{s}}} and {t}{t}", s=F.col("s"), t=F.col("t")).alias("p")).collect()
    assert [r.p for r in filled] == ["{a {b} {{c}}} and xx", None]
    with pytest.raises(KeyError):
        prompts.fill("{absent}", s=F.col("s"))
    p = spark.createDataFrame([("\nDo.\n\nViolations per idiom:\n\n",), ("Violations per idiom: x",), (None,)], "p string")
    assert [r.x for r in p.select(prompts.with_instructions(F.col("p"), "# F").alias("x")).collect()] == ["Do.\n\n# F\n\nViolations per idiom:", None, None]
    q = spark.createDataFrame([("a\n\nCode file:\nb",), ("a",), ("a\n\nCode file:\nb\n\nCode file:\nc",)], "p string")
    shown = [r.x for r in q.select(prompts.with_examples(F.col("p"), F.array(F.lit("E")), "See:").alias("x")).collect()]
    assert shown == ["a\n\nSee:\nE\nCode file:\n\nb", None, None]


def test_token_budget_by_a_vocabulary(spark):
    from lintloom.operators import rows

    vocabulary = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("one two three",), ("",), (None,)], "t string")
    counted = df.select(rows.token_counter(vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN)("t").alias("n")).collect()
    assert [r.n for r in counted] == [3, 0, None]


def test_groups_in_a_stream_are_given_out_once_and_forgotten(spark, tmp_path):
    kind = "id long, idx long, reward double, ts timestamp"
    inputs, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def add(rows):
        spark.createDataFrame(rows, "id long, idx long, reward double, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(inputs)
        stream = streams.stream_complete_groups(spark.readStream.schema(kind).parquet(inputs), 2, "ts", "1 hour")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert add([(1, 0, 0.5, "2024-01-01 00:00:00"), (1, 1, 0.7, "2024-01-01 00:00:01"), (2, 0, 0.1, "2024-01-01 00:00:02")]) == 2
    add([(1, 2, 0.9, "2024-01-01 00:10:00"), (2, 0, 0.1, "2024-01-01 00:10:00")])
    left = add([(3, 0, 0.1, "2024-03-01 00:00:00"), (3, 1, 0.2, "2024-03-01 00:00:00")])
    left = add([(4, 0, 0.1, "2024-06-01 00:00:00")])
    rows = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert rows == [(1, 2, 0.7), (3, 2, 0.2)] and left <= 2


def test_fetch_waits_and_gives_up(spark):
    from lintloom.sources import fetch

    slept, answers = [], [(403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "130"}, ""), (502, {}, ""), (200, {}, "ok")]
    assert fetch.fetch("u", {}, lambda u, h: answers.pop(0), pause=5, sleep=slept.append, now=lambda: 100.0) == "ok" and slept == [30.0, 5]
    for status, told in ((404, {}), (403, {"X-RateLimit-Remaining": "7"})):
        with pytest.raises(OSError, match=f"status {status}"):
            fetch.fetch("u", {}, lambda u, h, s=status, t=told: (s, t, ""), sleep=slept.append)
    with pytest.raises(OSError, match="3 tries"):
        fetch.fetch("u", {}, lambda u, h: (500, {}, ""), tries=3, sleep=slept.append)
    assert fetch.address("https://h/", "o/r", "c1", "/a b/é.py") == "https://h/o/r/c1/a%20b/%C3%A9.py"
    rows = spark.createDataFrame([(1, None)], "id long, url string")
    assert [tuple(r) for r in fetch.fetch_files(rows, lambda u, h: (200, {}, "x")).collect()] == [(1, None, None)]
