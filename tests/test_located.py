"""Reports with excerpts, spans and fixes, and rewards by texts, against loops over small documents."""

import json
import random

import pytest

from lintloom.operators import located, reports

FINDING = f"doc_id long, code string, message string, {located.PLACE}, fix {located.FIX}"
CODES = ["A1", "ANN001", "B2", "C3"]


def cut(lines, p):
    row, col, end_row, end_col = p
    out = []
    for n in range(row, end_row + 1):
        x = lines[n - 1]
        out.append(x[(col - 1 if n == row else 0) : (end_col - 1 if n == end_row else len(x))])
    return "\n".join(out)


def brute_report(text, findings, numbered=False, message=True, span=True):
    lines, out = text.split("\n"), ""
    for code in CODES:
        if code == "ANN001":
            continue
        own = sorted((f for f in findings if f["code"] == code), key=lambda f: f["at"])
        out += f"**Idiom {code} Violations:**\n"
        if not own:
            out += "\nNO VIOLATIONS FOUND"
        for f in own:
            row, _, end_row, _ = f["at"]
            item = {"line": "\n".join(f"{n:>3} {lines[n - 1]}" if numbered else lines[n - 1] for n in range(row, end_row + 1))}
            if span:
                item["span"] = cut(lines, f["at"])
            if message:
                item["message"] = f["message"]
            safe = f["fix"] and f["fix"][0] == "safe"
            item["fix"] = [{"before": cut(lines, e[1:]), "after": e[0]} for e in f["fix"][1]] if safe else None
            out += "\n" + json.dumps(item, ensure_ascii=False)
        out += "\n\n"
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    docs, found = [], []
    for i in range(n):
        lines = ["".join(rng.choice('ab "\\\té\U0001f600{}:') for _ in range(rng.randrange(12))) for _ in range(rng.randint(1, 9))]
        place = lambda: (r := rng.randint(1, len(lines)), rng.randint(1, 9), rng.randint(r, len(lines)), rng.randint(1, 9))  # noqa: E731, B023
        docs.append((i, "\n".join(lines)))
        places = set()
        for _ in range(rng.randrange(6)):
            at = place()
            if at in places:
                continue
            places.add(at)
            fix = rng.choice([None, ("safe", [(rng.choice(["", "x\ny", 'q"']), *place()) for _ in range(rng.randrange(3))]), ("unsafe", [("z", 99, 1, 99, 1)])])
            found.append({"doc_id": i, "code": rng.choice([*CODES, "OTHER"]), "message": rng.choice(["m", 'say "no"']), "at": at, "fix": fix})
    return docs, found


def rows_of(found):
    return [(f["doc_id"], f["code"], f["message"], *f["at"], f["fix"]) for f in found]


@pytest.mark.parametrize("given", [{}, {"numbered": True}, {"message": False}, {"message": False, "with_span": False, "numbered": True}])
def test_reports_are_those_of_loops(spark, given):
    docs, found = made(1)
    got = {r.doc_id: r.report for r in located.render(spark.createDataFrame(rows_of(found), FINDING), spark.createDataFrame(docs, "doc_id long, text string"), CODES, **given).collect()}
    own = {"numbered": given.get("numbered", False), "message": given.get("message", True), "span": given.get("with_span", True)}
    assert got == {i: brute_report(t, [f for f in found if f["doc_id"] == i], **own) for i, t in docs}


def test_findings_come_back(spark):
    docs, found = made(2)
    df, texts = spark.createDataFrame(rows_of(found), FINDING), spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda r: (r[0], r.code, r.line, r.span, r.message, r.fix)
    back = sorted(map(key, located.parse(located.render(df, texts, CODES)).collect()), key=str)
    assert back == sorted(map(key, located.texts(df, texts, CODES).collect()), key=str) and len(back) > 60
    said = located.said(located.render(df, texts, CODES)).where("code IS NOT NULL").collect()
    filled = {(f["doc_id"], f["code"]) for f in found}
    assert {(r.id, r.code): r.clean for r in said} == {(i, c): (i, c) not in filled for i, _ in docs for c in CODES if c != "ANN001"}


def test_what_lies_outside_leaves_no_report(spark):
    docs = [(1, "a\nb"), (2, "a\nb"), (3, "a\nb"), (4, None), (5, "a\nb"), (6, "")]
    rows = [(1, "A1", "m", 3, 1, 3, 2, None), (2, "A1", "m", 1, 1, 2, 9, None), (3, "A1", "m", 1, 1, 1, 2, ("safe", [("", 2, 1, 3, 1)])), (5, "OTHER", "m", 9, 1, 9, 1, None), (7, "A1", "m", 1, 1, 1, 1, None), (2, "B2", None, 0, 1, 1, 1, None)]
    out = located.render(spark.createDataFrame(rows[:-1], FINDING), spark.createDataFrame(docs, "doc_id long, text string"), CODES)
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 6]
    out = located.render(spark.createDataFrame(rows, FINDING), spark.createDataFrame(docs, "doc_id long, text string"), CODES)
    assert sorted(r.doc_id for r in out.collect()) == [4, 5, 6]


def test_other_spans_are_cut_at_the_same_columns(spark):
    from pyspark.sql import functions as F

    from lintloom.functions.text import lines

    df = spark.createDataFrame([(1, "abcdef\nghi\njk")], "doc_id long, text string").withColumn("v", F.struct(F.lit(1).alias("row"), F.lit(2).alias("col"), F.lit(3).alias("end_row"), F.lit(4).alias("end_col")))
    got = df.select(located.span_each_line(lines(F.col("text")), F.col("v")).alias("x"), located.span(lines(F.col("text")), F.col("v")).alias("s")).first()
    assert [tuple(x) for x in got.x] == [("abcdef", "bc"), ("ghi", "hi"), ("jk", "k")] and got.s == "bcdef\nghi\njk"


def brute_pr(model, truth, field, code=True):
    """Precision and recall from the matrix of equal pairs."""
    same = lambda a, b: (a.get(field) or "") == (b.get(field) or "") and (not code or a["code"] == b["code"])
    p = sum(any(same(a, b) for b in truth) for a in model) / len(model) if model else 0
    r = sum(any(same(a, b) for a in model) for b in truth) / len(truth) if truth else 0
    return p, r


def f1(p, r):
    return 2 * p * r / (p + r) if p + r else 0


def test_matches_and_rewards(spark):
    rng = random.Random(3)
    side = lambda i: [{"doc_id": i, "code": rng.choice("AB"), "line": rng.choice(["x", "y", None, "x\nz", ""]), "span": rng.choice(["s", "t", "s\nu"])} for _ in range(rng.randrange(5))]
    gold, pred = ([r for i in range(80) for r in side(i)] for _ in range(2))
    schema = "doc_id long, code string, line string, span string"
    frame = lambda rows: spark.createDataFrame([(r["doc_id"], r["code"], r["line"], r["span"]) for r in rows], schema)
    of = lambda rows, i: [r for r in rows if r["doc_id"] == i]
    cut_first = lambda rows: [{**r, "line": (r["line"] or "").split("\n")[0], "span": r["span"].split("\n")[0]} for r in rows]
    for given, code, turn in (({}, True, list), ({"with_code": False}, False, list), ({"first": True}, True, cut_first)):
        own = [(turn(of(pred, i)), turn(of(gold, i))) for i in range(80)]
        own = [x for x in own if x[0] or x[1]]
        got = located.overall(located.matches(frame(gold), frame(pred), **given)).first()
        assert got.n_docs == len(own)
        for field in ("line", "span"):
            pairs = [brute_pr(*x, field, code) for x in own]
            p, r = (sum(v) / len(pairs) for v in zip(*pairs, strict=True))
            assert [got[f"{field}_{n}"] for n in ("precision", "recall", "f1")] == pytest.approx([p, r, f1(p, r)], abs=1e-6)
    product = lambda a, b: f1(*brute_pr(a, b, "line")) * f1(*brute_pr(a, b, "span"))
    listed = [(i, c) for i in range(82) for c in "ABC"]
    docs = [(i, not of(gold, i) and i != 81, not of(pred, i)) for i in range(82)]
    got = {r.doc_id: (r.reward_v1, r.reward_v2) for r in located.rewards(frame(gold), frame(pred), spark.createDataFrame(docs, "doc_id long, gold_clean boolean, pred_clean boolean"), spark.createDataFrame(listed, "doc_id long, code string")).collect()}
    for i, g_clean, p_clean in docs:
        a, b = of(pred, i), of(gold, i)
        v1 = 1.0 if g_clean and p_clean else 0.0 if g_clean or p_clean else product(a, b)
        by_code = [product(x, y) if x or y else 1.0 for x, y in (([r for r in a if r["code"] == c], [r for r in b if r["code"] == c]) for c in "ABC")]
        assert got[i] == pytest.approx((v1, sum(by_code) / 3), abs=1e-6)
    plain = {r.doc_id: r.reward_v2 for r in located.rewards(frame(gold), frame(pred), spark.createDataFrame(docs, "doc_id long, gold_clean boolean, pred_clean boolean")).collect()}
    assert plain[80] == 0.0 and any(plain[i] != got[i][1] for i in range(80))


def test_lines_nested_too_deep_are_left_out():
    deep = "[" * 200_000
    text = f'**Idiom X Violations:**\n{{"line": "1 a"}}\n{deep}\n{{"line": "2 b"}}'
    assert reports.parse_text(text) == [("X", "1 a"), ("X", "2 b")]
    assert reports.parse_escaped(deep) == [] and reports.parse_escaped(f"1\n{deep}", strict=False) == [1]
    assert reports.parse_idioms(f"**Idiom X Violations:**\n{{{deep}}}\n{{}}") == {"X": [{}]}
    assert reports.parse_flat(text) == [{"line": "1 a"}, {"line": "2 b"}] and len(reports.parse_marked(text)) == 2
