"""Queries of prompts, parsed responses, row filters, splits and tests of significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintloom.functions import prompts, rules, text
from lintloom.operators import metrics, reports, rows, sampling
from lintloom.plans.base import ALIGNED, CODES, R, query, seed_sql

# --- prompts


@query("""SELECT p_partkey, '# Idiom ' || p_brand || ' (' || p_name || ')' || chr(10) || chr(10) || 'Definition: ' || p_type || chr(10) || chr(10) || 'Rationale: ' || p_size
  || CASE WHEN p_size > 25 THEN chr(10) || chr(10) || 'Example:' || chr(10) || p_name ELSE '' END AS spec FROM part""")
def spec_texts(t):
    """O-72s, with parts for rules; those above a size have an example."""
    example = F.when(F.col("p_size") > 25, F.col("p_name"))
    return t.part.select("p_partkey", prompts.spec(F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string"), example).alias("spec"))


_SPEC = "'# Idiom ' || c.code || ' (' || r.grp || ')' || chr(10) || chr(10) || 'Definition: of ' || r.grp || chr(10) || chr(10) || 'Rationale: x{code}'"
_NUMBERED = "array_to_string(list_transform(string_split(d.text, chr(10)), lambda x, i: CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, ' ') ELSE i::VARCHAR END || ' ' || x), chr(10))"


def _quoted(parts: str) -> str:
    """A Python text as SQL, its places as expressions."""
    return "'" + parts.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f""", c AS (SELECT DISTINCT doc_id, code FROM gold), s AS (SELECT c.doc_id, string_agg({_SPEC}, chr(10) || chr(10) ORDER BY c.code) AS specs FROM c JOIN groups r ON r.code = c.code GROUP BY c.doc_id)
SELECT d.doc_id, md5({_quoted(prompts.LINT_TEMPLATE).replace("{specs}", "' || s.specs || '").replace("{code}", f"' || {_NUMBERED} || '")}) AS prompt,
  md5({_quoted(prompts.REASON_TEMPLATE).replace("{specs}", "' || s.specs || '").replace("{code}", "' || d.text || '").replace("{violations}", "' || 'line 1 of ' || d.lang || '")}) AS reasons
FROM s JOIN documents d ON d.doc_id = s.doc_id""")
def prompt_texts(t):
    """O-73: both prompts of each document with findings; what a text holds is never read as a place."""
    grp = rules.group_of(F.col("code"))
    spec = prompts.spec(F.col("code"), grp, F.concat(F.lit("of "), grp), F.lit("x{code}"), F.lit(None).cast("string"))
    per = t.gold.select("doc_id", "code").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("code", spec.alias("spec")))).alias("s"))
    specs = prompts.specs(F.transform("s", lambda x: x["spec"]))
    both = t.documents.join(per, "doc_id")
    lint = prompts.fill(prompts.LINT_TEMPLATE, specs=specs, code=text.number_lines(F.col("text")))
    reason = prompts.fill(prompts.REASON_TEMPLATE, specs=specs, code=F.col("text"), violations=F.concat(F.lit("line 1 of "), "lang"))
    return both.select("doc_id", F.md5(lint).alias("prompt"), F.md5(reason).alias("reasons"))


@query("""SELECT doc_id, CASE WHEN lang <> 'fr' THEN md5(trim(source || chr(10) || chr(10) || text, chr(10)) || chr(10) || chr(10) || '# OUTPUT' || chr(10) || chr(10) || 'Violations per idiom:') END AS digest
FROM documents WHERE text <> ''""")
def prompt_instructions(t):
    """O-75: instructions before the last line of a prompt; null for one that ends otherwise."""
    asks = F.when(F.col("lang") == "fr", "none").otherwise(f"\n\n{prompts.ASKS}\n\n")
    whole = F.concat("source", F.lit("\n\n"), "text", asks)
    return t.documents.where("text <> ''").select("doc_id", F.md5(prompts.with_instructions(whole, "# OUTPUT")).alias("digest"))


@query(r"""SELECT item_id, 'Head' || chr(10) || chr(10) || 'See:' || chr(10) || chr(10) || 'Code file:' || chr(10) || chr(10) || '  1 a' || item_id || chr(10) || '  2 "b"' || chr(10) || '  3 c' || chr(10) || chr(10)
  || 'Violations per idiom: ' || chr(10) || chr(10) || '### Found' || chr(10) || chr(10) || '**Idiom R Violations:**' || chr(10) || chr(10)
  || '{"line": "  1 a' || item_id || '\n  2 \"b\"", "fix": null}' || chr(10) || '{"line": "  3 c", "fix": null}' || chr(10) || chr(10) || 'Code file:' || chr(10) || chr(10) || 'x' || item_id AS prompt FROM benchmark""")
def prompt_examples(t):
    """O-75: an example with its numbered lines before the code of a prompt."""
    code = F.concat(F.lit("a"), F.col("item_id").cast("string"), F.lit('\n"b"\nc'))
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((1, 2), (3, 3))))
    shown = prompts.example(code, spans, F.lit("R"), "### Found")
    whole = F.concat(F.lit(f"Head{prompts.CODE_MARK}x"), F.col("item_id").cast("string"))
    return t.benchmark.select("item_id", prompts.with_examples(whole, F.array(shown), "See:").alias("prompt"))


# --- responses


@query(R + " DISTINCT doc_id AS id, code, line_no FROM gold")
def parse_first_word(t):
    """O-61: the code is the first word of a header, whatever follows."""
    marked = reports.render(t.gold, CODES).select("doc_id", F.regexp_replace("report", r" Violations:\*\*", " (and more) Violations:**").alias("report"))
    found = reports.parse(marked, first_word=True)
    return found.select("id", "code", F.explode("line_nos").alias("line_no")).distinct()


_CODES_SQL = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CODES)) + ") AS codes(i, code)"
_LINE = """'{"line": "' || line_no || ' x"}'"""


@query(f""", per AS (SELECT d.doc_id, c.i, c.code, string_agg({_LINE}, ', ' ORDER BY g.line_no) AS found FROM (SELECT DISTINCT doc_id FROM gold) d CROSS JOIN {_CODES_SQL.replace("AS codes", "AS c")}
  LEFT JOIN gold g ON g.doc_id = d.doc_id AND g.code = c.code GROUP BY d.doc_id, c.i, c.code)
SELECT doc_id AS id, 'flat' AS parser, NULL AS code, {_LINE} AS item FROM gold
UNION ALL SELECT doc_id, 'idioms', code, '{{"code": "' || code || '", "found": ' || coalesce('[' || found || ']', '"NO VIOLATIONS FOUND"') || '}}' FROM per
UNION ALL SELECT doc_id, 'marked', code, '{{"line": "' || line_no || ' x", "code": "' || code || '"}}' FROM gold
UNION ALL SELECT doc_id, 'marked', code, '{{"code": "' || code || '"}}' FROM per WHERE found IS NULL""")
def report_values(t):
    """O-62 to O-65: what each parser finds in rendered reports; O-63 finds nothing, as headers aren't JSON."""
    return reports.parse_items(reports.render(t.gold, CODES))


@query("""SELECT doc_id AS id, '{"a": "' || doc_id || '"}' AS item FROM documents UNION ALL SELECT doc_id, '{"b": 1}' FROM documents""")
def escaped_values(t):
    """O-63: a line of JSON, and one whose quotes are escaped."""
    whole = F.concat(F.lit('{\\"a\\": \\"'), F.col("doc_id").cast("string"), F.lit('\\"}\n\n{"b": 1}'))
    found = reports.parse_items(t.documents.select("doc_id", whole.alias("report")))
    return found.where("parser = 'escaped'").select("id", "item")


@query(f""", per AS (SELECT d.doc_id, c.i, c.code, string_agg({_LINE}, chr(10) ORDER BY g.line_no) AS found FROM (SELECT DISTINCT doc_id FROM gold) d CROSS JOIN {_CODES_SQL.replace("AS codes", "AS c")}
  LEFT JOIN gold g ON g.doc_id = d.doc_id AND g.code = c.code GROUP BY d.doc_id, c.i, c.code)
SELECT doc_id AS id, md5(string_agg('**Idiom ' || code || ' Violations:**' || chr(10) || chr(10) || coalesce(found, 'NO VIOLATIONS FOUND'), chr(10) || chr(10) ORDER BY i) || chr(10)) AS report FROM per GROUP BY doc_id""")
def repeated_findings_once(t):
    """O-46: reports in which each line stands twice, once."""
    done = reports.deduplicate(reports.render(t.gold.union(t.gold), CODES))
    return done.select("id", F.md5("report").alias("report"))


# --- rows and columns


@query("SELECT doc_id, lang AS language FROM documents")
def columns_kept(t):
    """O-30, O-31."""
    return rows.renamed(rows.keep_columns(t.documents, ["lang", "doc_id", "absent"]), {"lang": "language"})


@query(R + " doc_id, code, line_no FROM gold WHERE code IN ('R_LONG', 'R_DIGIT')")
def chosen_codes(t):
    """O-33: findings of listed codes, except some."""
    return rows.with_codes(t.gold, ["R_LONG", "R_TRAIL", "R_DIGIT"], ("R_TRAIL",)).select("doc_id", "code", "line_no")


@query(R + " doc_id, CAST(doc_id IN (SELECT doc_id FROM gold) AS INTEGER) AS present FROM documents")
def tasks_by_presence(t):
    """O-39: tasks with findings and those without."""
    ids = t.documents.select("doc_id")
    one = lambda present: rows.by_presence(ids, t.gold, "doc_id", present).withColumn("present", F.lit(int(present)))
    return one(True).union(one(False))


@query("SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents WHERE ceil(length(text) / 4) < 250")
def within_token_budget(t):
    """O-40, with a token for every four characters."""
    tokens = rows.about_tokens(F.col("text"))
    return rows.within_budget(t.documents, tokens, 250, strict=True).select("doc_id", tokens.alias("tokens"))


@query()
def within_vocabulary_budget(t):
    """O-40, S-08 with the tokens of a published vocabulary; no SQL, as that has no tokenizer."""
    import public_tokenizers

    count = rows.token_counter(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    tokens = count(F.coalesce("text", F.lit("")))
    return rows.within_budget(t.documents.select("doc_id", tokens.alias("tokens")), F.col("tokens"), 250, strict=True)


@query("""SELECT doc_id FROM documents WHERE lang <> 'de' AND text <> ''""")
def usable_predictions(t):
    """O-41, O-43: predictions that aren't errors and have a truth."""
    flagged = t.documents.withColumn("error", F.when(F.col("lang") == "de", True).when(F.col("lang") == "fr", False))
    return rows.without_errors(rows.not_blank(flagged, "text")).select("doc_id")


@query("SELECT DISTINCT source FROM documents")
def distinct_sources(t):
    """O-54."""
    return rows.distinct_values(t.documents, "source")


@query(R + """ doc_id, string_agg(x, ',' ORDER BY line_no, code) AS issues FROM (SELECT DISTINCT doc_id, code, line_no, line_no || ':' || code AS x FROM gold)
  GROUP BY doc_id""")
def distinct_sorted_issues(t):
    """O-55."""
    per = rows.distinct_issues(t.gold.union(t.gold), "doc_id", "line_no", "code")
    return per.select("doc_id", F.array_join(F.transform("issues", lambda x: F.concat(x["line_no"].cast("string"), F.lit(":"), x["code"])), ",").alias("issues"))


@query(f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {seed_sql(29)}) <= count(*) OVER () // 2 THEN 'train' ELSE 'test' END AS part
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""")
def common_ids_split(t):
    """O-49: of the ids in both tables, half for training."""
    return sampling.split_common(t.documents, t.labels, "doc_id", 29)


@query("SELECT name, count(*) AS n FROM (SELECT DISTINCT lang, source AS name FROM documents) GROUP BY name HAVING count(*) >= 2")
def names_in_versions(t):
    """A-18: headings that at least two versions have; those with " - " are sub-headings and don't count."""
    own = t.documents.select("lang", F.col("source").alias("name"))
    own = own.union(own.select("lang", F.concat("name", F.lit(" - "), "name")))
    seen = own.where(~F.contains("name", F.lit(" - "))).distinct()
    return seen.groupBy("name").agg(F.count("*").alias("n")).where("n >= 2")


# --- metrics


_DIFFERENCES = ALIGNED + """, d AS (SELECT x.lang, sum(p) - sum(g) AS d FROM al JOIN documents x ON x.doc_id = al.doc_id GROUP BY x.lang, al.doc_id),
r AS (SELECT lang, d, rank() OVER (PARTITION BY lang ORDER BY abs(d)) + (count(*) OVER (PARTITION BY lang, abs(d)) - 1) / 2 AS k, count(*) OVER (PARTITION BY lang, abs(d)) AS same FROM d WHERE d <> 0),
w AS (SELECT lang, coalesce(sum(k) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(k) FILTER (WHERE d < 0), 0)::DOUBLE AS w_minus, count(*) AS n, sum(same * same - 1)::DOUBLE AS ties FROM r GROUP BY lang),
z AS (SELECT *, least(w_plus, w_minus) AS w, abs(least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2.0) AS x FROM w),
y AS (SELECT *, 1 / (1 + 0.5 * x) AS t FROM z),
p AS (SELECT *, least(t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587
  + t * (-0.82215223 + t * 0.17087277))))))))), 1.0) AS p FROM y)
"""


@query(_DIFFERENCES + "SELECT lang, w_plus, w_minus, w, n, round(p, 9) AS p, p < 0.05 / count(*) OVER () AS significant FROM p")
def wilcoxon_by_group(t):
    """M-20: predicted against gold counts by language, with p values and their Bonferroni threshold."""
    per = metrics.aligned(t.gold, t.pred).groupBy("doc_id").agg(F.sum("p").alias("p"), F.sum("g").alias("g")).join(t.documents.select("doc_id", "lang"), "doc_id")
    tested = metrics.wilcoxon(per, "p", "g", group="lang", alpha=0.05)
    return tested.select("lang", "w_plus", "w_minus", "w", "n", F.round("p", 9).alias("p"), "significant")


LIKE = {"R_LONG": ["R_UPPER"], "R_DUPLINE": ["R_BLANK2", "R_TRAIL"], "R_DIGIT": ["R_NONASCII"]}
_LIKE = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, x in LIKE.items() for b in x) + ")"


@query(f""", likes(code, other) AS (SELECT * FROM {_LIKE}), c AS (SELECT DISTINCT doc_id, code FROM gold WHERE code IN (SELECT code FROM likes)), s AS (SELECT DISTINCT doc_id, code FROM pred),
x AS (SELECT c.doc_id, c.code, EXISTS (SELECT 1 FROM s JOIN likes l ON l.other = s.code WHERE s.doc_id = c.doc_id AND l.code = c.code) AS hit,
  EXISTS (SELECT 1 FROM s WHERE s.doc_id = c.doc_id AND s.code = c.code) AS own, EXISTS (SELECT 1 FROM s JOIN likes l ON l.other = s.code WHERE s.doc_id = c.doc_id) AS anyone FROM c)
SELECT round(avg(CAST(hit AND NOT own AS INTEGER)), 6) AS strict, round(avg(CAST(hit AS INTEGER)), 6) AS relaxed, round(avg(CAST(anyone AS INTEGER)), 6) AS any_code, count(*) AS n FROM x""")
def confusable_shares(t):
    """M-13: strict, relaxed and any, over codes and those that are like them."""
    return metrics.confusable(t.gold, t.pred, LIKE)


@query("""SELECT lang AS code, count(*) AS n_docs, round(avg(CASE doc_id % 3 WHEN 0 THEN 1 ELSE 0.5 END), 6) AS precision, round(avg(CASE doc_id % 3 WHEN 0 THEN 1 ELSE 0.5 END), 6) AS recall,
  round(avg(CASE doc_id % 3 WHEN 2 THEN 0.5 ELSE 1 END), 6) AS fuzzy_precision, round(avg(CASE doc_id % 3 WHEN 2 THEN 0.5 ELSE 1 END), 6) AS fuzzy_recall FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def similar_lines(t):
    """J-11, M-12, M-15 over two lines a document, of which one is predicted as it is, and the other as it is, with another letter, or not at all."""
    first = F.concat(F.lit("value "), F.col("doc_id").cast("string"), F.lit(" is set in the first place"))
    other = F.concat(F.lit("nothing of it holds: "), "source")
    said = F.when(F.col("doc_id") % 3 == 0, first).when(F.col("doc_id") % 3 == 1, F.replace(first, F.lit("first"), F.lit("fiRst"))).otherwise("zzzzzzzz")
    lines = lambda a: t.documents.where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("code"), F.explode(F.array(a, other)).alias("line"))
    return metrics.text_localization(lines(first), lines(said))
