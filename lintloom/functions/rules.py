"""Native line rules: violations of a table of texts as Column expressions, without a window or a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintloom.functions.text import lines

#: Code and tool group of each rule.
GROUPS = {"R_LONG": "line", "R_TRAIL": "line", "R_BLANK2": "line", "R_DUPLINE": "text", "R_UPPER": "text", "R_SHORTDOC": "text", "R_DIGIT": "char", "R_NONASCII": "char"}
MAX_LENGTH, SHORT_WORDS = 200, 5


def _codes() -> Column:
    """The codes that hold for a line: columns line, prev, at (from 0), repeated and short. Cheap tests stand first."""
    line = F.col("line")
    hit = lambda code, test: F.when(test, F.lit(code))
    plain = F.length(F.regexp_replace(line, r"[^\x00-\x7F]", ""))
    return F.array(
        hit("R_LONG", F.length(line) > MAX_LENGTH),
        hit("R_TRAIL", F.endswith(line, F.lit(" ")) | F.endswith(line, F.lit("\t"))),
        hit("R_BLANK2", (line == "") & (F.col("prev") == "")),
        hit("R_DUPLINE", F.col("repeated")),
        hit("R_UPPER", ~line.rlike("[a-z]") & line.rlike("[A-Z]")),
        hit("R_DIGIT", line.rlike("[0-9]{6}")),
        hit("R_NONASCII", (F.octet_length(line) > F.length(line)) & ((F.length(line) - plain) * 4 > F.length(line))),
        hit("R_SHORTDOC", (F.col("at") == 0) & F.col("short")),
    )


def repeats(all_lines: Column) -> Column:
    """Of each line whether an equal one, not blank, stands above it: by sorting twice, so in less than quadratic time."""
    n = F.size(all_lines)
    by_line = F.array_sort(F.transform(all_lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    # bound to a name: a lambda's body is evaluated for each element
    marked = F.get(F.transform(F.array(by_line), lambda s: F.zip_with(
        F.slice(s, 2, n - 1), F.slice(s, 1, n - 1), lambda b, a: F.struct(b["i"].alias("i"), ((a["x"] == b["x"]) & (b["x"] != "")).alias("again"))
    )), F.lit(0))
    first = F.get(F.transform(F.array(by_line), lambda s: F.struct(F.get(s, F.lit(0))["i"].alias("i"), F.lit(False).alias("again"))), F.lit(0))
    return F.transform(F.array_sort(F.concat(marked, F.array(first))), lambda m: m["again"])


def violations(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, code and line_no (from 1) of each finding. A null text has none.

    Lines are rows when their rules are tested, outside any lambda, so that the tests are compiled.
    """
    # a text is read only up to its last word that matters
    short = ~F.col("text").rlike(rf"^[ \n]*(?:[^ \n]+[ \n]+){{{SHORT_WORDS - 1}}}[^ \n]")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", *keep, lines(F.col("text")).alias("_lines"), short.alias("short"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("_lines", 1, F.size("_lines") - 1))
    zipped = F.arrays_zip(F.col("_lines").alias("line"), before.alias("prev"), repeats(F.col("_lines")).alias("repeated"))
    each = rows.select("doc_id", *keep, "short", F.posexplode(zipped).alias("at", "l")).select("doc_id", *keep, "short", "at", "l.line", "l.prev", "l.repeated")
    # no filter on the array of codes: it would make all tests twice
    found = each.select("doc_id", *keep, "at", F.explode(_codes()).alias("code")).where("code IS NOT NULL")
    return found.select("doc_id", *keep, "code", (F.col("at") + 1).cast("long").alias("line_no"))


def predictions(gold: DataFrame) -> DataFrame:
    """A stand-in model: a quarter of the findings is missed, an eighth is a line off, a sixteenth has the wrong code."""
    digit = F.substring(F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), "code", F.col("line_no").cast("string"))), 1, 1)
    marked = gold.withColumn("_d", digit).where(~F.col("_d").isin("0", "1", "2", "3"))
    return marked.withColumn("line_no", F.when(F.col("_d").isin("4", "5"), F.col("line_no") + 1).otherwise(F.col("line_no"))).withColumn("code", F.when(F.col("_d") == "6", F.lit("R_UPPER")).otherwise(F.col("code"))).drop("_d")


def group_of(code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair)), code)


#: The same in SQL: CTEs gold and pred.
SQL = r"""
lines AS (
  SELECT doc_id, lang, source, line, line_no, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS nth
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)
), gold AS (
  SELECT doc_id, lang, source, 'R_LONG' AS code, line_no FROM lines WHERE length(line) > 200
  UNION ALL SELECT doc_id, lang, source, 'R_TRAIL', line_no FROM lines WHERE line LIKE '% ' OR line LIKE '%' || chr(9)
  UNION ALL SELECT doc_id, lang, source, 'R_BLANK2', line_no FROM lines WHERE line = '' AND prev = ''
  UNION ALL SELECT doc_id, lang, source, 'R_DUPLINE', line_no FROM lines WHERE line <> '' AND nth > 1
  UNION ALL SELECT doc_id, lang, source, 'R_UPPER', line_no FROM lines WHERE regexp_matches(line, '[A-Z]') AND NOT regexp_matches(line, '[a-z]')
  UNION ALL SELECT doc_id, lang, source, 'R_DIGIT', line_no FROM lines WHERE regexp_matches(line, '[0-9]{6}')
  UNION ALL SELECT doc_id, lang, source, 'R_NONASCII', line_no FROM lines WHERE (length(line) - length(regexp_replace(line, '[^\x00-\x7F]', '', 'g'))) * 4 > length(line)
  UNION ALL SELECT doc_id, lang, source, 'R_SHORTDOC', 1 FROM documents WHERE text IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> '')) < 5
), marked AS (
  SELECT *, substr(md5(doc_id || '-' || code || '-' || line_no), 1, 1) AS d FROM gold
), pred AS (
  SELECT doc_id, lang, source, CASE WHEN d = '6' THEN 'R_UPPER' ELSE code END AS code, CASE WHEN d IN ('4', '5') THEN line_no + 1 ELSE line_no END AS line_no
  FROM marked WHERE d NOT IN ('0', '1', '2', '3')
), groups(code, grp) AS (VALUES ('R_LONG', 'line'), ('R_TRAIL', 'line'), ('R_BLANK2', 'line'), ('R_DUPLINE', 'text'), ('R_UPPER', 'text'), ('R_SHORTDOC', 'text'), ('R_DIGIT', 'char'), ('R_NONASCII', 'char'))
"""
