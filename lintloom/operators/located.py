"""Findings with places in a text: excerpts, spans and safe fixes, whole reports of them, and what two reports share.

A located finding is (doc_id, code, message, row, col, end_row, end_col, fix), places from 1, ends of columns exclusive;
``fix`` is a struct of applicability and edits, each with content and a place of its own. All of it is column functions:
a text is split into lines once a document, and no text is compared with another one but by its digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintloom.functions.text import SENTINEL, lines, right_aligned
from lintloom.operators.metrics import f_score, ratio
from lintloom.operators.reports import objects, sections

#: Codes that reports leave out.
LEFT_OUT = ("ANN001", "ANN201")
PLACE = "row int, col int, end_row int, end_col int"
FIX = f"struct<applicability:string,edits:array<struct<content:string,{','.join(p.replace(' ', ':') for p in PLACE.split(', '))}>>>"
ITEM = "line string, span string, message string, fix array<struct<before:string,after:string>>, _bad string"


def _rows(all_lines: Column, v: Column) -> Column:
    return F.slice(all_lines, F.greatest(v["row"], F.lit(1)), F.greatest(v["end_row"] - v["row"] + 1, F.lit(0)))


def excerpt(all_lines: Column, v: Column, numbered: bool = False) -> Column:
    """The whole lines of a place; with ``numbered`` each after its number in three places."""
    rows = _rows(all_lines, v)
    if numbered:
        rows = F.transform(rows, lambda x, i: F.concat(right_aligned(v["row"] + i), F.lit(" "), x))
    return F.array_join(rows, "\n")


def span(all_lines: Column, v: Column) -> Column:
    """The text of a place: from its column in the first line, all of the lines between, up to its column in the last."""

    def cut(x: Column, i: Column) -> Column:
        start = F.when(i == 0, F.greatest(v["col"], F.lit(1))).otherwise(F.lit(1))
        stop = F.when(i == v["end_row"] - v["row"], v["end_col"]).otherwise(F.length(x) + 1)
        return F.substring(x, start, F.greatest(stop - start, F.lit(0)))

    return F.array_join(F.transform(_rows(all_lines, v), cut), "\n")


def span_each_line(all_lines: Column, v: Column) -> Column:
    """O-71b: (line, span) of each line of a place, all cut at the same columns."""
    return F.transform(_rows(all_lines, v), lambda x: F.struct(x.alias("line"), F.substring(x, F.greatest(v["col"], F.lit(1)), F.greatest(v["end_col"] - v["col"], F.lit(0))).alias("span")))


def safe_edits(all_lines: Column, v: Column) -> Column:
    """What a safe fix changes, as before and after; null where there is no safe fix."""
    edits = F.transform(v["fix"]["edits"], lambda e: F.struct(span(all_lines, e).alias("before"), e["content"].alias("after")))
    return F.when(v["fix"]["applicability"] == "safe", edits)


def within(all_lines: Column, v: Column) -> Column:
    """Whether a finding, and all edits of its safe fix, lie in the text."""
    inside = lambda p: (p["row"] >= 1) & (p["end_row"] <= F.size(all_lines))
    edits = F.when(v["fix"]["applicability"] == "safe", F.forall(v["fix"]["edits"], inside))
    return F.coalesce(inside(v), F.lit(False)) & F.coalesce(edits, F.lit(True))


def per_document(findings: DataFrame, docs: DataFrame, codes: list[str]) -> DataFrame:
    """doc_id, its lines ``l`` and its findings ``found`` by place, of every document; those with a finding that lies
    outside their text are left out, whole."""
    own = findings.where(F.col("code").isin([c for c in codes if c not in LEFT_OUT]))
    rows = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "end_row", "end_col", "code", "message", "fix"))).alias("found"))
    both = docs.select("doc_id", lines(F.col("text")).alias("l")).join(rows, "doc_id", "left")
    both = both.withColumn("found", F.coalesce("found", F.array().cast(rows.schema["found"].dataType)))
    return both.where(F.forall("found", lambda v: within(F.col("l"), v)))


def texts(findings: DataFrame, docs: DataFrame, codes: list[str]) -> DataFrame:
    """(doc_id, code, line, span, message, fix) of each finding, as a report of them would have it."""
    item = lambda v: F.struct(v["code"].alias("code"), excerpt(F.col("l"), v).alias("line"), span(F.col("l"), v).alias("span"), v["message"].alias("message"), safe_edits(F.col("l"), v).alias("fix"))
    rows = per_document(findings, docs, codes)
    return rows.select("doc_id", F.explode(F.transform("found", item)).alias("v")).select("doc_id", "v.*")


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    one = F.to_json(F.array(text))
    return F.coalesce(F.substring(one, F.lit(2), F.length(one) - 2), F.lit("null"))


def _item(all_lines: Column, v: Column, message: bool, with_span: bool, numbered: bool) -> Column:
    parts = [F.lit('{"line": '), _quoted(excerpt(all_lines, v, numbered))]
    if with_span:
        parts += [F.lit(', "span": '), _quoted(span(all_lines, v))]
    if message:
        parts += [F.lit(', "message": '), F.when(v["message"].isNull(), "null").otherwise(_quoted(v["message"]))]
    change = lambda e: F.concat(F.lit('{"before": '), _quoted(e["before"]), F.lit(', "after": '), _quoted(e["after"]), F.lit("}"))
    edits = F.concat(F.lit("["), F.array_join(F.transform(safe_edits(all_lines, v), change), ", "), F.lit("]"))
    return F.concat(*parts, F.lit(', "fix": '), F.coalesce(edits, F.lit("null")), F.lit("}"))


def render(findings: DataFrame, docs: DataFrame, codes: list[str], *, message: bool = True, with_span: bool = True, numbered: bool = False) -> DataFrame:
    """O-71: (doc_id, report): a section of each code in the order given, with a JSON object a finding by place, or the sentinel.

    A document with a finding or a safe edit outside its text has no report. Fixes that aren't safe are null.
    """
    rows = per_document(findings, docs, codes)
    items = F.transform("found", lambda v: F.struct(v["code"].alias("code"), _item(F.col("l"), v, message, with_span, numbered).alias("item")))
    rows = rows.select("doc_id", items.alias("items"))

    def section(code: Column) -> Column:
        own = F.transform(F.filter("items", lambda x: x["code"] == code), lambda x: F.concat(F.lit("\n"), x["item"]))
        body = F.when(F.size(own) > 0, F.array_join(own, "")).otherwise(F.lit(f"\n{SENTINEL}"))
        return F.concat(F.lit("**Idiom "), code, F.lit(" Violations:**\n"), body, F.lit("\n\n"))

    listed = F.array(*(F.lit(c) for c in codes if c not in LEFT_OUT))
    return rows.select("doc_id", F.array_join(F.transform(listed, section), "").alias("report"))


def parse(reports: DataFrame, id_col: str = "doc_id", text_col: str = "report") -> DataFrame:
    """(id, code, section, at, line, span, message, fix) of each JSON object of a report, in its order.

    A line that isn't one JSON object of these fields is left out, a field that is missing is null.
    """
    found = objects(reports, id_col, text_col).withColumn("j", F.from_json("line", ITEM, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}))
    return found.where("j._bad IS NULL").select("id", "code", "section", "at", "j.line", "j.span", "j.message", "j.fix")


def _first_line(text: Column) -> Column:
    return F.get(F.split(text, "\n", -1), F.lit(0))


def _sides(gold: DataFrame, pred: DataFrame, with_code: bool, first: bool) -> DataFrame:
    """doc_id, code, field, n_gold, n_pred, gold_hit, pred_hit: findings of either side and those with an equal one on the other.

    Existence is counted by digests of the texts, together with the code, in one pass over both fields and sides.
    """
    text = lambda c: F.sha2(F.coalesce(_first_line(F.col(c)) if first else F.col(c), F.lit("")), 256)
    one = lambda df, g: df.select("doc_id", "code", text("line").alias("a"), text("span").alias("b"), F.lit(g).alias("g"), F.lit(1 - g).alias("p"))
    both = one(gold, 1).union(one(pred, 0)).repartition("doc_id")
    fields = F.explode(F.array(F.struct(F.lit("line").alias("field"), F.col("a").alias("key")), F.struct(F.lit("span").alias("field"), F.col("b").alias("key"))))
    each = both.select("doc_id", "code", fields.alias("f"), "g", "p").select("doc_id", "code", "f.field", "f.key", "g", "p")
    keys = ["doc_id", "field", "key", *(["code"] if with_code else [])]
    met = each.groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return met.groupBy("doc_id", "field", *keys[3:]).agg(
        F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum(F.when(F.col("p") > 0, F.col("g")).otherwise(0)).alias("gold_hit"), F.sum(F.when(F.col("g") > 0, F.col("p")).otherwise(0)).alias("pred_hit"),
    )


def matches(gold: DataFrame, pred: DataFrame, with_code: bool = True, first: bool = False) -> DataFrame:
    """J-09 on texts over (doc_id, code, line, span): of each document, how many findings of either side have one on the
    other with the same line, and with the same span, and the same code unless ``with_code`` is off.

    ``first`` compares the first line of each text alone. A null text is an empty one. Findings that repeat count each.
    """
    rows = _sides(gold, pred, with_code, first)
    of = lambda field, c: F.sum(F.when(F.col("field") == field, F.col(c)).otherwise(0)).alias(f"{field}_{c}" if "hit" in c else c)
    return rows.groupBy("doc_id").agg(of("line", "n_gold"), of("line", "n_pred"), *(of(f, c) for f in ("line", "span") for c in ("gold_hit", "pred_hit")))


def overall(per_doc: DataFrame) -> DataFrame:
    """M-03 over ``matches``: mean precision and recall of lines and of spans over documents with findings on either
    side, one empty side being 0, and F of the means."""
    p = lambda f: F.avg(ratio(F.col(f"{f}_pred_hit"), F.col("n_pred")))
    r = lambda f: F.avg(ratio(F.col(f"{f}_gold_hit"), F.col("n_gold")))
    means = per_doc.agg(*(g(f).alias(f"{f}_{n}") for f in ("line", "span") for n, g in (("precision", p), ("recall", r))), F.count("*").alias("n_docs"))
    f1 = lambda f: F.round(f_score(F.col(f"{f}_precision"), F.col(f"{f}_recall")), 6).alias(f"{f}_f1")
    return means.select(*(F.round(c, 6).alias(c) for c in means.columns if c != "n_docs"), f1("line"), f1("span"), "n_docs")


def rewards(gold: DataFrame, pred: DataFrame, docs: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """M-16, M-17 over (doc_id, code, line, span): rewards of each document by the lines and the spans that both sides have.

    ``docs`` has doc_id and whether a side says that there is nothing (gold_clean, pred_clean).
    v1: 1 if both sides say so, 0 if one does; else F of lines times F of spans over all findings with their codes, and
    0 where a side has no findings that could be read. v2: the mean over the codes of either side, by the same product;
    a code of ``listed`` (doc_id, code: sections of either report) without findings on both sides counts as 1.
    """
    rows = _sides(gold, pred, True, False)
    score = lambda n_p, hit_p, n_g, hit_g: f_score(ratio(hit_p, n_p), ratio(hit_g, n_g))
    of = lambda field, c: F.sum(F.when(F.col("field") == field, F.col(c)).otherwise(0))
    names = ("n_pred", "pred_hit", "n_gold", "gold_hit")
    by_code = rows.groupBy("doc_id", "code").agg(*(of(f, c).alias(f"{f}_{c}") for f in ("line", "span") for c in names))
    product = lambda: score(*(F.col(f"line_{c}") for c in names)) * score(*(F.col(f"span_{c}") for c in names))
    scored = by_code.withColumn("v2", product())
    if listed is not None:
        clean = listed.select("doc_id", "code").distinct().join(by_code.select("doc_id", "code"), ["doc_id", "code"], "left_anti")
        zeros = [F.lit(0).cast("long").alias(c) for c in scored.columns[2:-1]]
        scored = scored.union(clean.select("doc_id", "code", *zeros, F.lit(1.0)))
    per = scored.groupBy("doc_id").agg(*(F.sum(f"{f}_{c}").alias(f"{f}_{c}") for f in ("line", "span") for c in names), F.avg("v2").alias("v2"))
    per = per.withColumn("v1", product())
    all_docs = docs.select("doc_id", "gold_clean", "pred_clean").join(per, "doc_id", "left")
    both, some = F.col("gold_clean") & F.col("pred_clean"), F.col("gold_clean") | F.col("pred_clean")
    v1 = F.when(both, 1.0).when(some, 0.0).otherwise(F.coalesce("v1", F.lit(0.0)))
    return all_docs.select("doc_id", F.round(v1, 6).alias("reward_v1"), F.round(F.coalesce("v2", F.lit(0.0)), 6).alias("reward_v2"))


def said(reports: DataFrame, id_col: str = "doc_id", text_col: str = "report") -> DataFrame:
    """(id, code) of the sections of reports, and whether each says that there is nothing."""
    return sections(reports, id_col, text_col).select("id", "code", (F.btrim("body", F.lit(" \n\r\t")) == SENTINEL).alias("clean"))
