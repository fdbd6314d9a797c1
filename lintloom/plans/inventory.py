"""Queries of joins, edits, samples, counts and metric variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintloom.functions import rules, text
from lintloom.operators import edits, joins, keys, metrics, patterns, sampling, star
from lintloom.plans.base import ALIGNED, CODES, DETECT, F1, R, query, seed_sql
from lintloom.sources import readers

_STARTS = """, pos AS (SELECT doc_id, line, line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id
  ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines)\n"""


# --- joins


@query(R + " g.doc_id, g.code, g.line_no, md5(l.line) AS digest FROM gold g JOIN lines l ON l.doc_id = g.doc_id AND l.line_no = g.line_no")
def findings_with_code(t):
    """J-01: findings with the text of their line."""
    return joins.with_line(t.gold, t.documents).select("doc_id", "code", "line_no", F.md5("line").alias("digest"))


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def missing_code(t):
    """J-01: the audit of keys that a join would drop."""
    return joins.missing_keys(t.labels, t.documents, "doc_id")


@query(""", ids AS (SELECT doc_id, string_agg(DISTINCT code, '-' ORDER BY code) || '_' || doc_id AS id FROM gold GROUP BY doc_id)
SELECT i.id, CAST(i.doc_id AS VARCHAR) AS blob_id, string_agg(g.code || '=' || r.grp, ',' ORDER BY g.code) AS specs
FROM ids i JOIN (SELECT DISTINCT doc_id, code FROM gold) g ON g.doc_id = i.doc_id JOIN groups r ON r.code = g.code GROUP BY i.id, i.doc_id""")
def task_specs(t):
    """J-02: tasks by an id of codes and blob, with the specs of their codes in order."""
    names = t.gold.groupBy("doc_id").agg(F.array_sort(F.collect_set("code")).alias("c"))
    ids = names.select(F.concat(F.array_join("c", "-").alias("c"), F.lit("|"), F.col("doc_id").cast("string")).alias("id"))
    # codes hold the mark that parts codes from the blob, which is another one here
    specs = t.spark.createDataFrame([(c.replace("_", "~"), g) for c, g in rules.GROUPS.items()], "code string, grp string")
    tasks = ids.select(F.replace(F.replace("id", F.lit("_"), F.lit("~")), F.lit("|"), F.lit("_")).alias("id"))
    found = joins.task_specs(tasks, specs, "grp")
    named = lambda c: F.replace(c, F.lit("~"), F.lit("_"))
    return found.select(named(F.col("id")).alias("id"), "blob_id", F.array_join(F.transform("specs", lambda s: F.concat(named(s["code"]), F.lit("="), s["grp"])), ",").alias("specs"))


@query(""", n AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY doc_id) SELECT d.doc_id,
  CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || l.quality || chr(10) || chr(10) || '### Found' || chr(10) || chr(10) ELSE '' END || coalesce(n.n || ' lines',
  'NO VIOLATIONS FOUND') AS answer FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
  WHERE l.doc_id IS NOT NULL OR n.n IS NULL""")
def reasoning_join(t):
    """J-05: answers with the reasoning there is; without any, only answers that are the bare sentinel."""
    n = t.gold.groupBy("doc_id").agg(F.count("*").alias("n"))
    train = t.documents.select("doc_id").join(n, "doc_id", "left").select(F.col("doc_id").alias("id"), F.coalesce(F.concat(F.col("n").cast("string"), F.lit(" lines")), F.lit(text.SENTINEL)).alias("answer"))
    cot = t.labels.select(F.col("doc_id").alias("id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("cot"))
    return joins.with_reasoning(train, cot, "### Found").select(F.col("id").alias("doc_id"), "answer")


@query(""", a AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n FROM pred GROUP BY doc_id)
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.n AS n_a, b.n AS n_b FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def predictions_side_by_side(t):
    """J-07, J-08: two sets of predictions by id, not by place."""
    n = lambda df: df.groupBy("doc_id").agg(F.count("*").alias("n"))
    return joins.side_by_side(n(t.gold), n(t.pred), "doc_id", "n")


@query(""", c AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT c.doc_id, c.n AS n_source, l.quality FROM c
  JOIN labels l ON l.doc_id = c.doc_id""")
def constructs_by_source(t):
    """J-03, J-06, J-14: inner joins by id and by source; the counts of a source are a small table."""
    per = t.documents.groupBy("source").agg(F.count("*").alias("n_source"))
    both = joins.by_key(t.documents.select("doc_id", "source"), per, "source")
    return joins.by_key(both, t.labels.select("doc_id", "quality"), "doc_id").select("doc_id", "n_source", "quality")


@query(ALIGNED + """SELECT doc_id, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(CASE WHEN n_pred > 0 THEN n_gold ELSE 0 END) AS BIGINT) AS gold_by_code,
CAST(sum(CASE WHEN n_gold > 0 THEN n_pred ELSE 0 END) AS BIGINT) AS pred_by_code, CAST(sum(n_hit) AS BIGINT) AS by_line FROM per GROUP BY doc_id""")
def existence_match(t):
    """J-09."""
    return joins.existence(t.gold, t.pred)


@query(R + """ a.doc_id, a.line_no AS a_line, b.line_no AS b_line FROM gold a JOIN gold b ON a.doc_id = b.doc_id AND abs(a.line_no - b.line_no) <= 2
  WHERE a.code = 'R_LONG' AND b.code = 'R_DUPLINE'""")
def near_lines(t):
    """J-12: long lines at most two lines from a repeated one."""
    return joins.near_lines(t.gold.where("code = 'R_LONG'"), t.gold.where("code = 'R_DUPLINE'"), 2)


@query("""SELECT l.doc_id, x.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN (SELECT source, arg_max(lang, doc_id) AS lang FROM documents
  GROUP BY source) x ON x.source = d.source""")
def latest_lookup(t):
    """J-13: for each labelled document the language of the last document of its source."""
    rows = joins.by_key(t.labels.select("doc_id"), t.documents.select("doc_id", "source"), "doc_id")
    return joins.lookup_latest(rows, t.documents.select("source", "lang", F.col("doc_id").alias("at")), "source", "at").select("doc_id", "lang")


@query(R + " doc_id, code, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS line_nos FROM gold GROUP BY doc_id, code")
def merged_by_code(t):
    """A-02, J-18."""
    return joins.merge_by_code(t.gold).select("doc_id", "code", F.array_join(F.transform("line_nos", lambda x: x.cast("string")), ",").alias("line_nos"))


_SECTIONS = "s AS (SELECT DISTINCT lang AS version, source AS section FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)"


@query(f"""WITH {_SECTIONS}, o AS (SELECT a.version, b.version AS other FROM (SELECT DISTINCT version FROM s) a JOIN (SELECT DISTINCT version FROM s) b ON a.version <> b.version),
g AS (SELECT DISTINCT section FROM s), p AS (SELECT version, other, section, row_number() OVER (PARTITION BY version, other ORDER BY md5(version || '/' || other || '/' || section), section) AS r FROM o CROSS JOIN g)
SELECT version, 'list' AS kind, 'List the changes of ' || version || '.' AS prompt, string_agg(r || '. ' || section, chr(10) ORDER BY section) AS response FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY section) AS r FROM s) GROUP BY version
UNION ALL SELECT version, 'describe', 'Describe "' || section || '" of ' || version || '.', 'About ' || section || ' in ' || version || '.' FROM s
UNION ALL SELECT version, 'refuse', 'List the changes of ' || other || '.', 'Only ' || version || ' is known here.' FROM o
UNION ALL SELECT version, 'refuse', 'Describe "' || section || '" of ' || other || '.', 'Only ' || version || ' is known here.' FROM p WHERE r <= 2""")
def version_questions(t):
    """O-88, J-15, S-10: list, describe and refusal rows of each version; two sections of each other version are refused."""
    s = t.documents.select(F.col("lang").alias("version"), F.col("source").alias("section")).where("version IS NOT NULL AND section IS NOT NULL").distinct()
    whole = lambda a: F.array_join(F.transform(a, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    listed = lambda v: F.concat(F.lit("List the changes of "), v, F.lit("."))
    told = lambda v: F.concat(F.lit('Describe "'), F.col("section"), F.lit('" of '), v, F.lit("."))
    no = F.concat(F.lit("Only "), "version", F.lit(" is known here.")).alias("response")
    others = joins.other_versions(s, "version")
    refused = joins.least_sections(others, s, 2)
    row = lambda df, kind, prompt, response: df.select("version", F.lit(kind).alias("kind"), prompt.alias("prompt"), response.alias("response"))
    lists = s.groupBy("version").agg(F.array_sort(F.collect_list("section")).alias("a"))
    out = row(lists, "list", listed(F.col("version")), whole("a"))
    out = out.union(row(s, "describe", told(F.col("version")), F.concat(F.lit("About "), "section", F.lit(" in "), "version", F.lit("."))))
    return out.union(row(others, "refuse", listed(F.col("other")), no)).union(row(refused, "refuse", told(F.col("other")), no))


# --- counts


@query(R + " DISTINCT code, doc_id FROM gold")
def inverted_index(t):
    """A-03, A-04: the documents of each code, as a table: no code's documents are gathered in one row."""
    return t.gold.select("code", "doc_id").distinct()


@query("""SELECT source, count(*) AS n, count(DISTINCT text) AS n_texts, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents
  GROUP BY source""")
def source_counts(t):
    """A-05, A-17, O-91, O-98: rows and distinct texts by source, the commonest first. Texts are counted by digest."""
    each = t.documents.select("source", F.sha2("text", 256).alias("h")).groupBy("source", "h").agg(F.count("*").alias("n"))
    per = each.groupBy("source").agg(F.sum("n").alias("n"), F.count("h").alias("n_texts"))
    return keys.ranked(per.withColumn("all", F.lit(0)), "all", [-F.col("n"), F.col("source")], "place").select("source", "n", "n_texts", "place")


@query("SELECT replace(event_type, 'v', '') AS pattern, count(*) AS n FROM events GROUP BY replace(event_type, 'v', '')")
def variants_merged(t):
    """A-07: names without the letter that marks a variant."""
    return t.events.groupBy(F.replace("event_type", F.lit("v"), F.lit("")).alias("pattern")).agg(F.count("*").alias("n"))


@query(ALIGNED + """, m AS (SELECT doc_id FROM per GROUP BY doc_id HAVING sum(n_gold) > 0 AND sum(n_pred) = 0)
  SELECT string_split(lang || '/' || source, '/')[-1] AS suffix, count(*) AS n FROM m JOIN documents USING (doc_id) GROUP BY suffix""")
def failures_by_suffix(t):
    """A-13: documents whose findings were all missed, by the last part of their source."""
    per = metrics.by_code(metrics.aligned(t.gold, t.pred)).groupBy("doc_id").agg(F.sum("n_gold").alias("g"), F.sum("n_pred").alias("p")).where("g > 0 AND p = 0")
    named = t.documents.select("doc_id", F.element_at(F.split(F.concat("lang", F.lit("/"), "source"), "/"), -1).alias("suffix"))
    return per.join(named, "doc_id").groupBy("suffix").agg(F.count("*").alias("n"))


@query(ALIGNED + """, s AS (SELECT doc_id, sum(n_gold) AS g, sum(n_pred) AS q, sum(n_hit) AS h FROM per GROUP BY doc_id),
d AS (SELECT coalesce(g, 0) AS g, coalesce(q, 0) AS q, coalesce(h, 0) AS h FROM documents LEFT JOIN s USING (doc_id)),
r AS (SELECT CASE WHEN g = 0 THEN CASE WHEN q = 0 THEN 1 ELSE 0 END WHEN h = 0 THEN 0 ELSE round(2 * h / (g + q), 6) END AS r FROM d)
SELECT CASE WHEN r = 0 THEN 'none' WHEN r = 1 THEN 'full' ELSE 'part' END AS bucket, count(*) AS n FROM r GROUP BY bucket""")
def reward_buckets(t):
    """A-15: documents with no, full and other reward."""
    r = F.col("reward_v1")
    return metrics.rewards(t.gold, t.pred, t.documents).groupBy(F.when(r == 0, "none").when(r == 1, "full").otherwise("part").alias("bucket")).agg(F.count("*").alias("n"))


@query(R + """ * FROM (SELECT code, count(DISTINCT lang) AS n_langs FROM gold GROUP BY code) WHERE n_langs >= 2""")
def repeated_names(t):
    """A-18: names that several versions share, but those of sub-headings."""
    some = t.gold.select("code", "lang").where(~F.contains("code", F.lit(" - "))).distinct()
    return some.groupBy("code").agg(F.count("lang").alias("n_langs")).where("n_langs >= 2")


# --- metrics


_STEPS = """, x AS (SELECT lang, doc_id, code, max(g) AS g, max(p) AS p FROM (SELECT lang, doc_id, code, 1 AS g, 0 AS p FROM gold UNION ALL SELECT lang, doc_id, code, 0, 1 FROM pred) GROUP BY ALL),
y AS (SELECT lang, code, sum(g * p) AS tp, sum(g) AS ng, sum(p) AS np FROM x GROUP BY lang, code HAVING sum(g) > 0),
z AS (SELECT lang, u.grp, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS p, tp / ng AS r FROM y JOIN (SELECT code, grp FROM groups UNION ALL SELECT code, 'all' FROM groups) u USING (code)),
w AS (SELECT lang, grp, avg(p) AS p, avg(r) AS r FROM z GROUP BY lang, grp)
"""


@query(_STEPS + f"SELECT lang, grp, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even({F1}, 4) AS f1 FROM w")
def metrics_by_step(t):
    """A-19, with the language for the step."""
    return metrics.by_step(t.gold, t.pred, "lang", rules.group_of(F.col("code")))


_FIRST = """, ga AS (SELECT doc_id, code, line_no FROM (SELECT *, lag(line_no) OVER (PARTITION BY doc_id, code ORDER BY line_no) AS b FROM (SELECT DISTINCT doc_id, code, line_no FROM gold)) WHERE b IS NULL OR b < line_no - 1),
gb AS (SELECT doc_id, code, line_no FROM (SELECT *, lag(line_no) OVER (PARTITION BY doc_id, code ORDER BY line_no) AS b FROM (SELECT DISTINCT doc_id, code, line_no FROM pred)) WHERE b IS NULL OR b < line_no - 1)
"""


@query(_FIRST + ALIGNED.replace("FROM gold)", "FROM ga)").replace("FROM pred)", "FROM gb)") + f"""SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1
  FROM (SELECT avg(CASE WHEN n_pred = 0 THEN 0 ELSE n_hit / n_pred END) AS p, avg(n_hit / n_gold) AS r FROM per WHERE n_gold > 0)""")
def first_line_localization(t):
    """M-02: M-01 over the first line of each run of lines."""
    return metrics.line_localization(metrics.first_lines(t.gold), metrics.first_lines(t.pred))


@query(DETECT + f""", x AS (SELECT coalesce(p, 0) AS p, coalesce(r, 0) AS r FROM (SELECT code FROM groups UNION ALL SELECT 'R_NEVER') LEFT JOIN pr USING (code))
  SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1, n_codes FROM (SELECT avg(p) AS p, avg(r) AS r, count(*) AS n_codes
  FROM x)""")
def listed_macro(t):
    """M-06: the mean over all listed codes, of which one is never found."""
    return metrics.listed_macro(metrics.detection(t.gold, t.pred), [*CODES, "R_NEVER"])


_PRESENCE = """, v AS (SELECT doc_id, CAST(doc_id IN (SELECT doc_id FROM gold WHERE code IN ('R_LONG', 'R_UPPER')) AS INTEGER) AS g, CAST(doc_id IN (SELECT doc_id
  FROM pred WHERE code IN ('R_LONG', 'R_UPPER')) AS INTEGER) AS p FROM documents)\n"""


@query(_PRESENCE + "SELECT doc_id, g, p, CAST(g = p AS INTEGER) AS correct FROM v")
def presence_vectors(t):
    """M-08, M-22."""
    return metrics.presence(t.gold, t.pred, t.documents, ["R_LONG", "R_UPPER"])


@query(DETECT + f""", s(subset, code) AS (VALUES ('seen', 'R_LONG'), ('seen', 'R_TRAIL'), ('near', 'R_BLANK2'), ('near', 'R_NEVER'), ('far', 'R_UPPER'), ('far',
  'R_DIGIT')), f AS (SELECT code, {F1} AS f FROM pr) SELECT subset, round(avg(coalesce(f, 0)), 6) AS f1, count(*) AS n_codes FROM s LEFT
  JOIN f USING (code) GROUP BY subset""")
def transfer_subsets(t):
    """M-14: mean F of codes that were seen in training, near to them and far from them."""
    return metrics.subset_means(metrics.detection(t.gold, t.pred), {"seen": ["R_LONG", "R_TRAIL"], "near": ["R_BLANK2", "R_NEVER"], "far": ["R_UPPER", "R_DIGIT"]})


@query(ALIGNED + """, d AS (SELECT sum(p) - sum(g) AS d FROM al GROUP BY doc_id)
  SELECT count(*) AS n, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM d""")
def paired_t(t):
    """M-21: predicted against gold counts."""
    per = metrics.aligned(t.gold, t.pred).groupBy("doc_id").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    return metrics.paired_t(per, "p", "g")


# --- samples


@query(""", x AS (SELECT doc_id, source, doc_id IN (SELECT doc_id FROM gold) AS flagged
  FROM documents), k AS (SELECT source, least(count(*) FILTER (WHERE flagged), 25) AS k FROM x GROUP BY source) """ + f"""SELECT doc_id, source, flagged FROM (SELECT *, row_number() OVER (PARTITION BY source, flagged ORDER BY {seed_sql(17)}) AS r FROM x)
  JOIN k USING (source) WHERE r <= k""")
def balanced_strata(t):
    """S-03: of each source as many rows without findings as with, 25 at most."""
    hits = t.gold.select("doc_id").distinct().withColumn("flagged", F.lit(True))
    x = t.documents.select("doc_id", "source").join(hits, "doc_id", "left").select("doc_id", "source", F.coalesce("flagged", F.lit(False)).alias("flagged"))
    return sampling.balanced(x, "source", "flagged", "doc_id", 17, 25)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {seed_sql(19)}) AS place FROM documents")
def full_shuffle(t):
    """S-11."""
    return sampling.shuffled(t.documents.select("doc_id"), "doc_id", 19)


@query(f"SELECT doc_id FROM documents ORDER BY {seed_sql(23)} LIMIT 500")
def random_rows(t):
    """S-12, S-13: 500 rows of all."""
    return sampling.take(t.documents.select("doc_id"), "doc_id", 23, 500)


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r >= 50 AND r < 150")
def offset_slice(t):
    """O-13: a hundred rows from place 50."""
    return sampling.offset_rows(t.documents.select("doc_id", "lang"), "doc_id", 50, 100)


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) > count(*) OVER () // 2 AS INTEGER) AS part FROM documents")
def table_halves(t):
    """O-25."""
    return sampling.halves(t.documents.select("doc_id"), "doc_id")


@query("""WITH a AS (SELECT doc_id AS id, k, ('0x' || substr(md5(doc_id || '/' || k), 1, 1))::INTEGER AS d FROM documents, (VALUES (0), (1), (2), (3)) AS v(k)),
f AS (SELECT id, min(k) FILTER (WHERE k <= 2 AND d >= 12) AS first, max(d) FILTER (WHERE k = 3) AS last FROM a GROUP BY id)
SELECT id, CASE WHEN first IS NULL THEN 4 ELSE first + 1 END::INTEGER AS attempts, first IS NULL AS rationalized, first IS NULL AND last < 8 AS star_failed FROM f""")
def star_retries(t):
    """P-03, P-04, ST-05, with a responder whose answers follow from the id and the attempt, right where a digit of their hash is high."""
    tasks = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("prompt"), F.lit("right").alias("truth"))
    return star.star(tasks, star.with_retries(_respond), _judge).select("id", "attempts", "rationalized", "star_failed")


@query("""WITH a AS (SELECT doc_id AS id, n, substr(md5(doc_id || '/' || n), 1, 1) AS d FROM documents, range(4) r(n)),
b AS (SELECT id, min(n) FILTER (WHERE n < 3 AND d >= 'c') AS hit, bool_or(n = 3 AND d >= '8') AS told FROM a GROUP BY id)
SELECT id, CAST(coalesce(hit + 1, 4) AS INTEGER) AS attempts, hit IS NULL AS rationalized, hit IS NULL AND NOT told AS star_failed FROM b""")
def star_at_once(t):
    """P-04, ST-05: eight requests of a task in flight, to a responder that is at its limit now and then."""
    tasks = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("prompt"), F.lit("right").alias("truth"))
    return star.star(tasks, _limited, _judge, at_once=8).select("id", "attempts", "rationalized", "star_failed")


def _limited(prompt: str, attempt: int, hint: str | None) -> str:
    """As ``_respond``; every hundredth call of a process meets a limit first."""
    _limited.calls = getattr(_limited, "calls", 0) + 1
    if _limited.calls % 100 == 0:
        raise star.Limited(0.001)
    return _respond(prompt, attempt, hint)


def _respond(prompt: str, attempt: int, hint: str | None) -> str:
    import hashlib

    return "right" if int(hashlib.md5(f"{prompt}/{attempt}".encode()).hexdigest()[0], 16) >= (12 if hint is None else 8) else "wrong"


def _judge(response: str, truth: str) -> int:
    return int(response == truth)


# --- edits


@query(_STARTS + """SELECT DISTINCT g.doc_id, g.line_no, p.start AS place, g.line_no AS back_row, 1::BIGINT AS back_column FROM gold g
  JOIN pos p ON p.doc_id = g.doc_id AND p.line_no = g.line_no""")
def positions(t):
    """O-84: the offset of each line with a finding, and its row and column read back."""
    lines = t.gold.groupBy("doc_id").agg(F.collect_set("line_no").alias("n")).join(t.documents.select("doc_id", "text"), "doc_id")
    each = lines.select("doc_id", "n", edits.line_starts(F.col("text")).alias("starts")).select("doc_id", "starts", F.explode("n").alias("line_no"))
    placed = each.withColumn("place", edits.offset_in(F.col("starts"), F.col("line_no"), F.lit(1)))
    row = edits.row_in(F.col("starts"), F.col("place")).cast("long")
    back = placed.withColumn("back_row", row)
    column = F.col("place") - F.get("starts", (F.col("back_row") - 1).cast("int")) + 1
    return back.select("doc_id", "line_no", "place", "back_row", column.alias("back_column"))


@query(""", e AS (SELECT l.doc_id, l.line_no, CASE WHEN g.line_no IS NULL THEN l.line ELSE '# ' || substr(l.line, 2) END AS line, l.line AS old
  FROM lines l LEFT JOIN (SELECT DISTINCT doc_id, line_no FROM gold WHERE code IN ('R_UPPER', 'R_LONG')) g ON g.doc_id = l.doc_id AND g.line_no = l.line_no)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY line_no)) AS edited, md5(string_agg(old, chr(10) ORDER BY line_no)) AS restored FROM e WHERE doc_id IN (SELECT doc_id FROM gold WHERE code IN ('R_UPPER', 'R_LONG')) GROUP BY doc_id""")
def edits_and_back(t):
    """O-83: the first character of certain lines is replaced; the reverse edits restore the text."""
    lines = t.gold.where("code IN ('R_UPPER', 'R_LONG')").groupBy("doc_id").agg(F.collect_set("line_no").alias("n")).join(t.documents.select("doc_id", "text"), "doc_id")
    place = lambda n, c: F.struct(n.alias("row"), F.lit(c).alias("column"))
    wanted = F.transform("n", lambda n: F.struct(place(n, 1).alias("location"), place(n, 2).alias("end_location"), F.lit("# ").alias("content")))
    done = lines.select("doc_id", edits.edit_at(F.col("text"), wanted).alias("e"))
    return done.select("doc_id", F.md5("e.text").alias("edited"), F.md5(edits.edit(F.col("e.text"), F.col("e.reverse"))["text"]).alias("restored"))


@query(""", g AS (SELECT DISTINCT doc_id, line_no FROM gold WHERE code = 'R_DIGIT')
  SELECT l.doc_id, l.line_no, md5(l.line) AS line, substr(l.line, 3, 5) AS span FROM lines l JOIN g ON g.doc_id = l.doc_id AND g.line_no = l.line_no""")
def line_spans(t):
    """O-71b, O-92: spans of columns 3 to 8 of lines with long numbers."""
    rows = t.gold.where("code = 'R_DIGIT'").groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("n")).join(t.documents.select("doc_id", "text"), "doc_id")
    place = lambda n, c: F.struct(n.cast("int").alias("row"), F.lit(c).alias("column"))
    spans = F.transform("n", lambda n: F.struct(n.alias("line_no"), F.get(edits.line_spans(F.col("text"), place(n, 3), place(n, 8)), F.lit(0)).alias("s")))
    return rows.select("doc_id", F.explode(spans).alias("x")).select("doc_id", F.col("x.line_no").alias("line_no"), F.md5("x.s.line").alias("line"), F.col("x.s.span").alias("span"))


@query(r"""SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages)
  WHERE regexp_matches(line, 'class[ \t]+[A-Za-z0-9_]+[ \t]*\[[^\]]*\]:') GROUP BY page_id""")
def generic_classes(t):
    """T-33 over the lines of pages."""
    each = t.pages.select("page_id", F.explode(text.lines(F.col("html"))).alias("line"))
    return each.where(patterns.generic_class(F.col("line"))).groupBy("page_id").agg(F.count("*").alias("n"))


# --- pages: no SQL


@query()
def html_tables(t):
    """O-16."""
    return readers.html_tables(t.pages)


@query()
def html_metadata(t):
    """O-19."""
    return readers.html_metadata(t.pages)
