"""Queries over findings with places, spans and fixes. Places are derived from the rule pack's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintloom.functions.text import lines
from lintloom.operators import located
from lintloom.plans.base import CODES, query


def placed(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """The findings with places: up to three lines from theirs, with a safe fix of trailing blanks and of capitals, and one that
    isn't safe of digits. A finding beyond its text stays there."""
    per = findings.groupBy("doc_id").agg(F.collect_list(F.struct("code", "line_no")).alias("v"))
    both = per.join(docs.select("doc_id", lines(F.col("text")).alias("l")), "doc_id")
    rows = both.select("doc_id", F.size("l").alias("n"), F.explode(F.transform("v", lambda v: F.struct(v["code"].alias("code"), v["line_no"].cast("int").alias("row"), F.get("l", (v["line_no"] - 1).cast("int")).alias("line")))).alias("v"))
    rows = rows.select("doc_id", "n", "v.*")
    rows = rows.withColumn("end_row", F.greatest(F.col("row"), F.least(F.col("n"), F.col("row") + F.col("row") % 3))).withColumn("col", 1 + F.col("row") % 4)
    rows = rows.withColumn("end_col", F.when(F.col("end_row") == F.col("row"), F.col("col") + 7).otherwise(1 + F.col("row") % 9))
    edit = lambda content, row, col, end_row, end_col: F.struct(content.alias("content"), row.alias("row"), col.cast("int").alias("col"), end_row.alias("end_row"), end_col.cast("int").alias("end_col"))
    row, length = F.col("row"), F.length("line")
    trail = edit(F.lit(""), row, F.length(F.rtrim("line", F.lit(" \t"))) + 1, row, length + 1)
    lower = [edit(F.lower(F.substring("line", 1, 2)), row, F.lit(1), row, F.lit(3)), edit(F.lit('"x"\n'), row, F.lit(3), F.greatest(row, F.least(F.col("n"), row + 1)), F.lit(2))]
    fix = lambda safe, *edits: F.struct(F.lit(safe).alias("applicability"), F.array(*edits).alias("edits")).cast(located.FIX)
    change = F.when(F.col("code") == "R_TRAIL", fix("safe", trail)).when(F.col("code") == "R_UPPER", fix("safe", *lower)).when(F.col("code") == "R_DIGIT", fix("unsafe", trail))
    message = F.concat("code", F.lit(' at "'), row.cast("string"), F.lit('"'))
    return rows.select("doc_id", "code", message.alias("message"), "row", "col", "end_row", "end_col", change.alias("fix"))


def _placed_sql(name: str, of: str) -> str:
    """CTE ``name``: the findings of ``of`` with line, span and fix, without documents of which one lies outside."""
    cut = lambda a, b, c, d: f"substr(l.line, CASE WHEN l.line_no = {a} THEN {b} ELSE 1 END, greatest(0, CASE WHEN l.line_no = {c} THEN {d} ELSE length(l.line) + 1 END - CASE WHEN l.line_no = {a} THEN {b} ELSE 1 END))"
    join = lambda xs: f"string_agg({xs}, chr(10) ORDER BY l.line_no)"
    return f""",
{name}0 AS (SELECT f.doc_id, f.code, row_number() OVER () AS k, f.line_no AS row, c.n, greatest(f.line_no, least(c.n, f.line_no + f.line_no % 3)) AS end_row, 1 + f.line_no % 4 AS col
  FROM {of} f JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) c ON c.doc_id = f.doc_id),
{name}1 AS MATERIALIZED (SELECT *, CASE WHEN end_row = row THEN col + 7 ELSE 1 + row % 9 END AS end_col FROM {name}0 WHERE doc_id NOT IN (SELECT doc_id FROM {name}0 WHERE row > n)),
{name} AS (SELECT p.doc_id, p.code, p.k, p.row, p.col, p.end_row, p.end_col, {join("l.line")} AS line, {join(cut("p.row", "p.col", "p.end_row", "p.end_col"))} AS span,
    p.code || ' at "' || p.row || '"' AS message,
    CASE p.code WHEN 'R_TRAIL' THEN any_value(substr(l.line, length(rtrim(l.line, ' ' || chr(9))) + 1)) FILTER (WHERE l.line_no = p.row) || ' -> '
      WHEN 'R_UPPER' THEN any_value(substr(l.line, 1, 2) || ' -> ' || lower(substr(l.line, 1, 2))) FILTER (WHERE l.line_no = p.row) || ' | '
        || {join(cut("p.row", "3", "greatest(p.row, least(p.n, p.row + 1))", "2"))} FILTER (WHERE l.line_no <= p.row + 1) || ' -> "x"' || chr(10) END AS fix
  FROM {name}1 p JOIN lines l ON l.doc_id = p.doc_id AND l.line_no BETWEEN p.row AND greatest(p.end_row, least(p.n, p.row + 1)) GROUP BY p.doc_id, p.code, p.k, p.row, p.col, p.end_row, p.end_col, p.n)"""


def _within(name: str) -> str:
    return _placed_sql(name, {"pg": "gold", "pp": "pred"}[name]).replace("string_agg(l.line, chr(10) ORDER BY l.line_no) AS line", "string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE l.line_no <= p.end_row) AS line").replace(
        "chr(10) ORDER BY l.line_no) AS span", "chr(10) ORDER BY l.line_no) FILTER (WHERE l.line_no <= p.end_row) AS span")


GOLD, PRED = _within("pg"), _within("pp")


@query(GOLD + """ SELECT doc_id AS id, code, row_number() OVER (PARTITION BY doc_id, code ORDER BY row, col, end_row, end_col) AS place, line, span, message, fix FROM pg""")
def full_reports(t):
    """O-71, O-60: findings rendered with their excerpts, spans, messages and safe fixes, and read back."""
    found = located.parse(located.render(placed(t.gold, t.documents), t.documents, CODES))
    change = F.transform("fix", lambda e: F.concat(e["before"], F.lit(" -> "), e["after"]))
    return found.select("id", "code", (F.col("at") - 1).cast("long").alias("place"), "line", "span", "message", F.array_join(change, " | ").alias("fix"))


@query(GOLD + f""", listed AS (SELECT doc_id, code FROM documents, unnest({CODES}) AS c(code)),
items AS (SELECT doc_id, code, string_agg(lpad(CAST(row AS VARCHAR), CAST(greatest(3, length(CAST(row AS VARCHAR))) AS INTEGER), ' ') || ' ' || code, ';' ORDER BY row, col) AS items FROM pg GROUP BY doc_id, code)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_sections, CAST(count(items) AS BIGINT) AS n_filled, coalesce(string_agg(items, '|' ORDER BY l.code), '') AS numbers FROM listed l LEFT JOIN items i ON i.doc_id = l.doc_id AND i.code = l.code GROUP BY l.doc_id""")
def numbered_reports(t):
    """O-69, O-71 with numbered lines: of each document the sections of its report and the first number of each item."""
    shown = located.render(placed(t.gold, t.documents), t.documents, CODES, message=False, with_span=False, numbered=True)
    filled = located.parse(shown).groupBy("id", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: F.concat(F.regexp_extract(x["line"], r"^(\s*\d+ )", 1), F.col("code"))), ";").alias("items"))
    both = located.said(shown).where("code IS NOT NULL").join(filled, ["id", "code"], "left")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("code", "items")))), lambda x: x["items"]), "|")
    return both.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_sections"), F.count(F.when(~F.col("clean"), 1)).alias("n_filled"), texts.alias("numbers"))


def _both(t) -> tuple[DataFrame, DataFrame]:
    return located.texts(placed(t.gold, t.documents), t.documents, CODES), located.texts(placed(t.pred, t.documents), t.documents, CODES)


def _hits_sql(name: str, line: str, span: str, code: str) -> str:
    """CTE ``name``: of each document the findings of either side, and those with an equal line or span on the other."""
    one = lambda a, b, f: f"SELECT a.doc_id, count(*) AS n FROM {a} a SEMI JOIN {b} b ON a.doc_id = b.doc_id AND {code.format(x='a')} = {code.format(x='b')} AND {f.format(x='a')} = {f.format(x='b')} GROUP BY a.doc_id"
    return f""", {name} AS (SELECT doc_id, CAST(coalesce(ng, 0) AS BIGINT) AS n_gold, CAST(coalesce(np, 0) AS BIGINT) AS n_pred, CAST(coalesce(lg.n, 0) AS BIGINT) AS line_gold_hit, CAST(coalesce(lp.n, 0) AS BIGINT) AS line_pred_hit,
    CAST(coalesce(sg.n, 0) AS BIGINT) AS span_gold_hit, CAST(coalesce(sp.n, 0) AS BIGINT) AS span_pred_hit
  FROM (SELECT doc_id, count(*) AS ng FROM pg GROUP BY doc_id) g FULL JOIN (SELECT doc_id, count(*) AS np FROM pp GROUP BY doc_id) p USING (doc_id)
  LEFT JOIN ({one("pg", "pp", line)}) lg USING (doc_id) LEFT JOIN ({one("pp", "pg", line)}) lp USING (doc_id)
  LEFT JOIN ({one("pg", "pp", span)}) sg USING (doc_id) LEFT JOIN ({one("pp", "pg", span)}) sp USING (doc_id))"""


_VARIANTS = {"code": ("{x}.line", "{x}.span", "{x}.code"), "any_code": ("{x}.line", "{x}.span", "1"), "first": ("split_part({x}.line, chr(10), 1)", "split_part({x}.span, chr(10), 1)", "{x}.code")}


@query(GOLD + PRED + _hits_sql("h", *_VARIANTS["code"]) + "SELECT * FROM h")
def text_existence(t):
    """J-09 on the texts of lines and spans, existence both ways."""
    return located.matches(*_both(t))


@query(GOLD + PRED + "".join(_hits_sql(f"h_{n}", *v) for n, v in _VARIANTS.items()) + " UNION ALL ".join(f"""
SELECT '{n}' AS variant, round(lp, 6) AS line_precision, round(lr, 6) AS line_recall, round(sp, 6) AS span_precision, round(sr, 6) AS span_recall,
  round(CASE WHEN lp + lr = 0 THEN 0 ELSE 2 * lp * lr / (lp + lr) END, 6) AS line_f1, round(CASE WHEN sp + sr = 0 THEN 0 ELSE 2 * sp * sr / (sp + sr) END, 6) AS span_f1, n_docs
FROM (SELECT avg(CASE WHEN n_pred = 0 THEN 0 ELSE line_pred_hit / n_pred END) AS lp, avg(CASE WHEN n_gold = 0 THEN 0 ELSE line_gold_hit / n_gold END) AS lr,
  avg(CASE WHEN n_pred = 0 THEN 0 ELSE span_pred_hit / n_pred END) AS sp, avg(CASE WHEN n_gold = 0 THEN 0 ELSE span_gold_hit / n_gold END) AS sr, count(*) AS n_docs FROM h_{n})""" for n in _VARIANTS))
def text_match(t):
    """M-03 on texts: with codes, without, and by the first line and span alone."""
    gold, pred = _both(t)
    given = {"code": {}, "any_code": {"with_code": False}, "first": {"first": True}}
    rows = [located.overall(located.matches(gold, pred, **x)).withColumn("variant", F.lit(n)) for n, x in given.items()]
    return rows[0].union(rows[1]).union(rows[2])


_F = "CASE WHEN {n}p = 0 OR {n}g = 0 OR {p} + {g} = 0 THEN 0 ELSE 2.0 * ({p} / {n}p) * ({g} / {n}g) / ({p} / {n}p + {g} / {n}g) END"


def _product(n: str) -> str:
    return " * ".join(_F.format(n=n, p=f"{f}p", g=f"{f}g") for f in ("l", "s"))


@query(GOLD + PRED + f""",
c AS (SELECT doc_id, code, count(*) FILTER (WHERE side = 'g') AS ng, count(*) FILTER (WHERE side = 'p') AS np,
    count(*) FILTER (WHERE side = 'g' AND line_too) AS lg, count(*) FILTER (WHERE side = 'p' AND line_too) AS lp, count(*) FILTER (WHERE side = 'g' AND span_too) AS sg, count(*) FILTER (WHERE side = 'p' AND span_too) AS sp
  FROM (SELECT doc_id, code, side, count(DISTINCT side) OVER (PARTITION BY doc_id, code, line) = 2 AS line_too, count(DISTINCT side) OVER (PARTITION BY doc_id, code, span) = 2 AS span_too
    FROM (SELECT doc_id, code, line, span, 'g' AS side FROM pg UNION ALL SELECT doc_id, code, line, span, 'p' FROM pp)) GROUP BY doc_id, code),
k AS (SELECT doc_id, code, CASE WHEN c.doc_id IS NULL THEN 1.0 ELSE {_product("n")} END AS v FROM (SELECT doc_id, code FROM documents, unnest({CODES}) AS u(code)) LEFT JOIN c USING (doc_id, code)),
a AS (SELECT doc_id, sum(ng) AS ng, sum(np) AS np, sum(lg) AS lg, sum(lp) AS lp, sum(sg) AS sg, sum(sp) AS sp FROM c GROUP BY doc_id),
v2 AS (SELECT doc_id, avg(v) AS v2 FROM k GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN coalesce(ng, 0) = 0 AND coalesce(np, 0) = 0 THEN 1.0 WHEN coalesce(ng, 0) = 0 OR coalesce(np, 0) = 0 THEN 0.0 ELSE {_product("n")} END, 6) AS reward_v1, round(v2, 6) AS reward_v2
FROM documents d LEFT JOIN a USING (doc_id) JOIN v2 USING (doc_id)""")
def text_rewards(t):
    """M-16, M-17 by lines and spans: every document, with reports that list every code."""
    gold, pred = _both(t)
    some = gold.select("doc_id", F.lit(1).alias("g"), F.lit(0).alias("p")).union(pred.select("doc_id", F.lit(0), F.lit(1))).groupBy("doc_id").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    docs = t.documents.select("doc_id").join(some, "doc_id", "left").select("doc_id", (F.coalesce("g", F.lit(0)) == 0).alias("gold_clean"), (F.coalesce("p", F.lit(0)) == 0).alias("pred_clean"))
    listed = t.documents.select("doc_id", F.explode(F.array(*map(F.lit, CODES))).alias("code"))
    return located.rewards(gold, pred, docs, listed)


