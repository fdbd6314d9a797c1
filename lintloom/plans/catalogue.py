"""All queries of the engine by name, and the equivalent SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintloom.functions import chat, rules, text
from lintloom.operators import decontaminate, joins, keys, metrics, pairs, patterns, reports
from lintloom.plans import detectors, inventory, located, round_trips, tasks
from lintloom.plans.base import ALIGNED, CODES, DETECT, F1, ORACLE, QUERIES, R, pct, query, seed_sql
from lintloom.sources import readers
from lintloom.sources.scratch import Scratch

__all__ = ["ORACLE", "QUERIES", "detectors", "inventory", "located", "round_trips", "tasks"]

# --- findings


@query(R + " lang, code, count(DISTINCT doc_id) AS n_docs, count(*) AS n_findings FROM gold GROUP BY lang, code")
def lint_rule_frequency(t):
    """A-10: documents and findings by rule and language."""
    per = t.gold.groupBy("lang", "code", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("lang", "code").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_findings"))


@query(R + """ grp, count(DISTINCT doc_id) AS n_docs, round(100.0 * count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 2) AS percent
FROM (SELECT doc_id, grp FROM gold JOIN groups USING (code) UNION ALL SELECT doc_id, 'all' FROM gold) GROUP BY grp""")
def lint_tool_group_share(t):
    """A-10 with its row for all groups, which isn't their sum."""
    seen = t.gold.select("doc_id", rules.group_of(F.col("code")).alias("grp"))
    both = seen.union(seen.select("doc_id", F.lit("all"))).distinct()
    total = t.documents.agg(F.count("*").alias("total"))
    return both.groupBy("grp").agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(total)).select("grp", "n_docs", pct(F.col("n_docs"), F.col("total")).alias("percent"))


@query(R + """ k AS n_findings, count(*) AS n_docs FROM (SELECT d.doc_id, count(g.code) AS k FROM documents d LEFT JOIN gold g ON g.doc_id = d.doc_id
  GROUP BY d.doc_id) GROUP BY k""")
def violation_histogram(t):
    """A-11."""
    rows = t.documents.select("doc_id", F.lit(0).alias("k")).union(t.gold.select("doc_id", F.lit(1)))
    return rows.groupBy("doc_id").agg(F.sum("k").alias("n_findings")).groupBy("n_findings").agg(F.count("*").alias("n_docs"))


@query(R + " code AS pattern, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM gold GROUP BY code")
def pattern_frequency(t):
    """A-06, O-97."""
    per = t.gold.groupBy(F.col("code").alias("pattern")).agg(F.count("*").alias("n"))
    return per.select("pattern", "n", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 4).alias("percent"))


@query(R + """ name, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN n * 100 < 10 * sum(n) OVER () THEN 'Others' ELSE code END AS name, n FROM (SELECT code, count(*) AS n FROM gold GROUP BY code)) GROUP BY name""")
def others_bucket(t):
    """A-08: patterns with less than a tenth of all findings are one row."""
    per = t.gold.groupBy("code").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(W.partitionBy()))
    return per.groupBy(F.when(F.col("n") * 100 < 10 * F.col("total"), "Others").otherwise(F.col("code")).alias("name")).agg(F.sum("n").alias("n"))


@query(R + """ a.code AS a, b.code AS b, count(*) AS n_docs, round(count(*) / sqrt(any_value(x.n) * any_value(y.n)), 6) AS score
FROM (SELECT DISTINCT doc_id, code FROM gold) a JOIN (SELECT DISTINCT doc_id, code FROM gold) b ON a.doc_id = b.doc_id AND a.code < b.code
JOIN (SELECT code, count(DISTINCT doc_id) AS n FROM gold GROUP BY code) x ON x.code = a.code JOIN (SELECT code, count(DISTINCT doc_id) AS n FROM gold GROUP BY code) y ON y.code = b.code GROUP BY a.code, b.code""")
def cooccurrence(t):
    """A-09, J-16: pairs of patterns in one document. The codes of a document meet in one array: no self join."""
    own = t.gold.groupBy("doc_id").agg(F.array_sort(F.collect_set("code")).alias("c"))
    crossed = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = own.select(F.explode(crossed).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n_docs"))
    n = own.select(F.explode("c").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    out = both.join(n.select(F.col("code").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("code").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "n_docs", F.round(F.col("n_docs") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("score"))


# --- keys and sets


@query("SELECT source, doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def docs_keep_last(t):
    """O-44."""
    return keys.keep_last(t.documents.select("source", "doc_id", "lang", "n_chars"), "source", "doc_id")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def docs_exact_dedup(t):
    """O-45: the first document of each text; texts meet by digest, not whole."""
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def docs_not_labeled(t):
    """O-47."""
    return keys.pending(t.documents.select("doc_id"), t.labels, "doc_id")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' WHEN d.doc_id IS NULL THEN 'right' ELSE 'both' END AS side
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id""")
def id_set_partition(t):
    """O-48, O-50."""
    return keys.partition_ids(t.documents.select("doc_id"), t.labels.where("quality = 1").select("doc_id"), "doc_id")


@query(", a AS (SELECT DISTINCT doc_id, code, line_no FROM gold), b AS (SELECT DISTINCT doc_id, code, line_no FROM pred) SELECT * FROM a UNION SELECT * FROM b")
def ensemble_union(t):
    """O-51, O-53."""
    return keys.ensemble(t.gold, t.pred, union=True)


@query(""", a AS (SELECT DISTINCT doc_id, code, line_no FROM gold), b AS (SELECT DISTINCT doc_id, code, line_no FROM pred) SELECT * FROM a INTERSECT SELECT *
  FROM b""")
def ensemble_intersection(t):
    """O-52, O-53."""
    return keys.ensemble(t.gold, t.pred, union=False)


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def resume_pending(t):
    """O-27, ST-03: inputs that aren't written yet."""
    return keys.pending(t.events.select("event_id", "user_id"), t.events.where("event_type = 'click'"), "event_id")


@query("""WITH i AS (SELECT DISTINCT event_id FROM events), m AS (SELECT min(x) AS first FROM (SELECT event_id + 1 AS x FROM i UNION ALL SELECT 0) WHERE x NOT IN (SELECT event_id FROM i))
SELECT event_id FROM events, m WHERE event_id >= 0 AND event_id < first""")
def contiguous_prefix_all(t):
    """ST-01 over all events."""
    return keys.contiguous_prefix(t.events.select("event_id"), "event_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 5")
def complete_groups(t):
    """ST-02."""
    return keys.complete_groups(t.events, "user_id", 5)


# --- text


@query("SELECT doc_id FROM documents WHERE contains(text, 'the') AND contains(text, 'License')")
def keyword_filter(t):
    """O-36."""
    return t.documents.where(text.has_all(F.col("text"), ["the", "License"])).select("doc_id")


@query("""SELECT page_id, len(regexp_extract_all(html, '(https?://[^\\s\"''<>]+)', 1)) AS n_urls FROM pages
  WHERE contains(html, 'http:') OR contains(html, 'https:')""")
def url_filter(t):
    """O-37, O-77."""
    return t.pages.where(text.has_url(F.col("html"))).select("page_id", F.size(text.urls(F.col("html"))).cast("long").alias("n_urls"))


@query("""SELECT doc_id FROM documents
  WHERE len(string_split(text, chr(10))) > 20 OR len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 1000)) > 0""")
def long_or_weird_filter(t):
    """O-34, O-35: what the filter takes out."""
    return t.documents.where(~text.fits(F.col("text"), 20, 1000)).select("doc_id")


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS digest FROM documents")
def normalize_ws(t):
    """O-78."""
    return t.documents.select("doc_id", F.md5(text.normalize_space(F.col("text"))).alias("digest"))


@query("""WITH b AS (SELECT DISTINCT trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS item FROM benchmark),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM documents)
SELECT doc_id FROM d WHERE EXISTS (SELECT 1 FROM b WHERE item <> '' AND contains(body, item))""")
def decontaminated_docs(t):
    """J-10: the documents that go."""
    return decontaminate.contaminated(t.documents, t.benchmark)


@query("""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, ' ') ELSE i::VARCHAR END || ' ' || x), chr(10))) AS digest FROM documents""")
def numbered_file(t):
    """O-68."""
    return t.documents.select("doc_id", F.md5(text.number_lines(F.col("text"))).alias("digest"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS excerpt FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def excerpt_slice(t):
    """O-70."""
    return t.documents.where(F.size(text.lines(F.col("text"))) >= 2).select("doc_id", text.excerpt(F.col("text"), 2, 3).alias("excerpt"))


@query(r"""WITH q AS (SELECT repeat(chr(34), 3) AS d, repeat(chr(39), 3) AS s), c AS (
  SELECT doc_id, regexp_replace(d || 'Head' || chr(10) || lang || d || text || ' # ' || source || chr(10) || '  ' || chr(10) || 'x = 1', '(?s)' || d || '.*?' || d || '|' || s || '.*?' || s, '', 'g') AS code
  FROM documents, q)
SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(code, '#[^\n]*', '', 'g'), chr(10)), lambda x: regexp_replace(x, '[ \t\r\f]+', '', 'g') <> ''), chr(10))) AS digest FROM c""")
def strip_comments(t):
    """O-76: each document between a docstring and a comment."""
    quotes = '"' * 3
    code = F.concat(F.lit(f"{quotes}Head\n"), "lang", F.lit(quotes), "text", F.lit(" # "), "source", F.lit("\n  \nx = 1"))
    return t.documents.select("doc_id", F.md5(text.strip_comments(code)).alias("digest"))


@query("""SELECT doc_id, string_split(lang || '-' || source || '_' || doc_id, '_')[1] AS first, string_split(lang || '-' || source || '_' || doc_id,
  '_')[-1] AS blob, len(string_split(lang || '-' || source, '-')) AS n_codes FROM documents""")
def id_parse(t):
    """O-80."""
    parts = F.split(F.concat("lang", F.lit("-"), "source", F.lit("_"), F.col("doc_id").cast("string")), "_")
    return t.documents.select("doc_id", F.get(parts, F.lit(0)).alias("first"), F.element_at(parts, -1).alias("blob"), F.size(F.split(F.get(parts, F.lit(0)), "-")).cast("long").alias("n_codes"))


@query("""SELECT doc_id, length(CASE WHEN length(text) > 3000 THEN left(text, 1000) || right(text, 1000) ELSE text END) AS kept,
  md5(CASE WHEN length(text) > 3000 THEN left(text, 1000) || right(text, 1000) ELSE text END) AS digest FROM documents""")
def truncate_middle(t):
    """O-74."""
    cut = text.middle_cut(F.col("text"), 3000, 1000)
    return t.documents.select("doc_id", F.length(cut).cast("long").alias("kept"), F.md5(cut).alias("digest"))


@query("""SELECT source, count(*) AS n, CAST(sum(n_chars // 4) AS BIGINT) AS tokens, max(n_chars // 4) AS longest,
  count(*) FILTER (WHERE n_chars // 4 + 512 <= 3000) AS n_fit, round(sum(n_chars // 4) / 1e6 * 0.15, 6) AS dollars FROM documents GROUP BY source""")
def cost_estimate(t):
    """A-16, with a token for every four characters."""
    tokens = F.floor(F.col("n_chars") / 4)
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("longest"), F.count(F.when(tokens + 512 <= 3000, 1)).alias("n_fit"), F.round(F.sum(tokens) / 1e6 * 0.15, 6).alias("dollars"))


@query("""SELECT page_id, 'walrus' AS rule, count(*) AS n FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages) WHERE contains(line, ':=') GROUP BY page_id
UNION ALL SELECT page_id, 'walrus_strict', count(*) FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages)
WHERE length(line) < 500 AND regexp_matches(regexp_replace(line, '"[^"]*"|''[^'']*''', '', 'g'), '[A-Za-z0-9_]:=[A-Za-z0-9_]') GROUP BY page_id""")
def regex_token_rules(t):
    """T-32, T-34."""
    each = t.pages.select("page_id", F.explode(text.lines(F.col("html"))).alias("line"))
    return each.select("page_id", F.explode(patterns.token_rules(F.col("line"))).alias("rule")).groupBy("page_id", "rule").agg(F.count("*").alias("n"))


# --- chats and mixes


def _chats(t) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return t.conversations.groupBy("conv_id").agg(F.transform(order, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


_TURNS = "string_agg('<|' || role || '|>' || chr(10) || text || '</s>' || chr(10), '' ORDER BY turn, role)"
_SYSTEM = "CASE WHEN arg_min(role, turn) = 'system' THEN '' ELSE '<|system|>' || chr(10) || '</s>' || chr(10) END"


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '\brandom\b') AND NOT regexp_matches(text, '\bimport secrets\b|\bsecrets\.|\brandom\.(shuffle|seed|setstate|getstate)\b')
AND regexp_matches(text, '(?i)(password|token|secret|auth|otp|key)\s*=\s*[^\n]*?random\.')""")
def unsafe_random(t):
    """T-36 over the documents taken as code."""
    return t.documents.where(patterns.unsafe_random(F.col("text"))).select("doc_id")


@query(f"SELECT conv_id, md5({_SYSTEM} || {_TURNS}) AS digest FROM conversations GROUP BY conv_id")
def chat_render_sft(t):
    """O-86."""
    return _chats(t).select("conv_id", F.md5(chat.render(chat.with_system(F.col("messages")))).alias("digest"))


@query(f"SELECT conv_id, md5({_SYSTEM} || {_TURNS} || '<|assistant|>' || chr(10)) AS digest FROM conversations GROUP BY conv_id")
def chat_render_generation(t):
    """O-86."""
    return _chats(t).select("conv_id", F.md5(chat.render(chat.with_system(F.col("messages")), prompt=True)).alias("digest"))


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS back FROM conversations),
p AS (SELECT conv_id, {_SYSTEM} || {_TURNS} AS prompt FROM c WHERE back > 1 GROUP BY conv_id)
SELECT conv_id, md5(prompt) AS prompt, md5('<|' || role || '|>' || chr(10) || text || '</s>' || chr(10)) AS chosen FROM c JOIN p USING (conv_id) WHERE back = 1""")
def chat_render_preference(t):
    """O-86: prompt and chosen turn."""
    prompt, chosen, _ = chat.preference(F.col("messages"), F.col("messages"))
    return _chats(t).where(F.size("messages") > 1).select("conv_id", F.md5(prompt).alias("prompt"), F.md5(chosen).alias("chosen"))


@query("SELECT conv_id, count(*) = count(CASE WHEN role IS NOT NULL AND text IS NOT NULL THEN 1 END) AS ok FROM conversations GROUP BY conv_id")
def openai_format_check(t):
    """O-87."""
    return _chats(t).select("conv_id", chat.is_openai(F.col("messages")).alias("ok"))


MIX = {"en": 0.5, "fr": 0.3, "de": 0.2}
_MIX = "(VALUES ('en', 0.5), ('fr', 0.3), ('de', 0.2)) AS f(lang, share)"


@query(f"""SELECT doc_id, lang FROM (SELECT d.*, share, row_number() OVER (PARTITION BY d.lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY d.lang) AS n
  FROM documents d JOIN {_MIX} ON d.lang = f.lang) WHERE r <= floor(CAST(share AS DOUBLE) * n)""")
def mixer_train(t):
    """S-09, O-93: the first part of each language."""
    return keys.prefix_fraction(t.documents.select("doc_id", "lang"), "lang", "doc_id", MIX)


@query(f"SELECT doc_id, d.lang FROM documents d JOIN {_MIX} ON d.lang = f.lang")
def mixer_test_whole(t):
    """S-09: fractions leave the test part of each language of the mix whole."""
    return t.documents.where(F.col("lang").isin(list(MIX))).select("doc_id", "lang")


# --- sampling


@query(", x AS (SELECT doc_id, source, doc_id IN (SELECT doc_id FROM gold) AS flagged FROM documents) " + f"SELECT doc_id, source, flagged FROM (SELECT *, row_number() OVER (PARTITION BY source, flagged ORDER BY {seed_sql(42)}) AS r FROM x) WHERE r <= 5")
def stratified_ceiling(t):
    """S-02: at most five of each source with, and without, findings."""
    return keys.sampled(_flagged(t, "source"), ["source", "flagged"], "doc_id", 42, 5)


def _flagged(t, *columns: str) -> DataFrame:
    hits = t.gold.select("doc_id").distinct().withColumn("flagged", F.lit(True))
    return t.documents.select("doc_id", *columns).join(hits, "doc_id", "left").select("doc_id", *columns, F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query(", x AS (SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM gold) AS flagged FROM documents), " + f"""k AS (SELECT lang, least(count(*) FILTER (WHERE flagged), 30) AS k FROM x GROUP BY lang),
s AS (SELECT x.*, k, row_number() OVER (PARTITION BY x.lang, flagged ORDER BY {seed_sql(7)}) AS r FROM x JOIN k USING (lang))
SELECT doc_id, lang, flagged, CASE WHEN r <= least(20, floor(20.0 * k / 30)) THEN 'train' ELSE 'test' END AS part FROM s WHERE r <= k""")
def ceiling_split(t):
    """S-04: as many rows of either kind as have findings, 30 at most, two thirds of them for training."""
    x = _flagged(t, "lang")
    k = x.groupBy("lang").agg(F.least(F.count(F.when(F.col("flagged"), 1)), F.lit(30)).alias("k"))
    rank = F.row_number().over(W.partitionBy("lang", "flagged").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id"))
    rows = x.withColumn("r", rank).where("r <= 30").join(k, "lang").where("r <= k")
    return rows.select("doc_id", "lang", "flagged", F.when(F.col("r") <= F.least(F.lit(20), F.floor(20.0 * F.col("k") / 30)), "train").otherwise("test").alias("part"))


@query(""", x AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM gold) AS flagged
  FROM documents), k AS (SELECT least(CAST(floor(0.1 * count(*) FILTER (WHERE flagged)) AS BIGINT), count(*) FILTER (WHERE NOT flagged)) AS k FROM x) """ + f"""SELECT doc_id, flagged FROM (SELECT *, row_number() OVER (PARTITION BY flagged ORDER BY {seed_sql(3)}) AS r FROM x) CROSS JOIN k
  WHERE flagged OR r <= k""")
def neutral_balance(t):
    """S-01: all rows with findings, and a tenth as many without. The threshold is the k-th least hash, found by ranks over all tasks."""
    x = Scratch(t.spark).put(_flagged(t), "flagged")  # read three times
    k = x.agg(F.least(F.floor(0.1 * F.count(F.when(F.col("flagged"), 1))), F.count(F.when(~F.col("flagged"), 1))).alias("k"))
    neutral = x.where("NOT flagged").withColumn("h", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-3"))))
    chosen = keys.ranked(neutral, "flagged", [F.col("h"), F.col("doc_id")], "r").crossJoin(F.broadcast(k)).where("r <= k").select("doc_id", "flagged")
    return x.where("flagged").union(chosen)


@query(", x AS (SELECT DISTINCT doc_id, code FROM gold) " + f"SELECT doc_id, code FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {seed_sql(11)}) AS r FROM x) WHERE r <= 20")
def per_rule_violation_sample(t):
    """S-07: twenty documents of each rule."""
    return keys.sampled(t.gold.select("doc_id", "code").distinct(), ["code"], "doc_id", 11, 20)


@query(f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {seed_sql(5)}) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part
  FROM documents""")
def train_test_split(t):
    """S-05, S-06: an exact share in random order, ranked over all tasks."""
    x = t.documents.select("doc_id", F.lit(1).alias("one"), F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-5"))).alias("h"))
    n = t.documents.agg(F.count("*").alias("n"))
    rows = keys.ranked(x, "one", [F.col("h"), F.col("doc_id")], "r").crossJoin(F.broadcast(n))
    return rows.select("doc_id", F.when(F.col("r") <= F.floor(F.lit(0.8) * F.col("n")), "train").otherwise("test").alias("part"))


@query(""", x AS (SELECT d.doc_id, d.source, count(DISTINCT g.code) AS n_codes FROM documents d LEFT JOIN gold g ON g.doc_id = d.doc_id WHERE d.n_chars <= 4000
  GROUP BY d.doc_id, d.source) """ + f"SELECT doc_id, source, n_codes FROM (SELECT *, row_number() OVER (PARTITION BY source, n_codes ORDER BY {seed_sql(13)}) AS r FROM x) WHERE r <= 3")
def strata_cap(t):
    """S-08: three of each source and number of rules; long texts go first."""
    docs = t.documents.where("n_chars <= 4000").select("doc_id", "source")
    n = t.gold.groupBy("doc_id").agg(F.countDistinct("code").alias("n_codes"))
    return keys.sampled(docs.join(n, "doc_id", "left").fillna(0, ["n_codes"]), ["source", "n_codes"], "doc_id", 13, 3)


# --- samples with rewards


def _samples(t) -> DataFrame:
    digit = lambda i: F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"/{i}"))), 1, 1), 16, 10).cast("int")
    each = F.array(*(F.struct(F.lit(i).alias("idx"), digit(i).alias("d")) for i in range(4)))
    rows = t.documents.select(F.col("doc_id").alias("id"), "n_chars", F.explode(each).alias("s"))
    reward = F.when(F.col("s.d") >= 12, 1.0).otherwise(F.round(F.col("s.d") / 12, 4))
    return rows.select("id", F.col("s.idx").alias("idx"), reward.alias("reward"), (F.col("s.d") % 3 != 0).alias("valid"), (F.col("n_chars") + 7 * F.col("s.d")).alias("length"))


_SAMPLES = """samples AS (SELECT doc_id AS id, idx, CASE WHEN d >= 12 THEN 1.0::DOUBLE ELSE round(d / 12, 4) END AS reward, d % 3 <> 0 AS valid, n_chars + 7 * d AS length
  FROM (SELECT doc_id, n_chars, idx, ('0x' || substr(md5(doc_id || '/' || idx), 1, 1))::INTEGER AS d FROM documents, (VALUES (0), (1), (2), (3)) AS v(idx)))"""


@query(f"""WITH {_SAMPLES}, p AS (SELECT a.id, a.idx AS i, b.idx AS j, a.reward AS ri, b.reward AS rj,
  CASE WHEN a.reward > b.reward + 0.25 AND a.valid AND b.valid THEN '>' WHEN b.reward > a.reward + 0.25 THEN '<' END AS side FROM samples a JOIN samples b ON a.id = b.id AND a.idx < b.idx)
SELECT id || '_' || i || side || j AS pair_id, id, CASE side WHEN '>' THEN i ELSE j END AS chosen, CASE side WHEN '>' THEN j ELSE i END AS rejected, ri AS reward_i, rj AS reward_j, round(abs(ri - rj), 6) AS reward_gap FROM p WHERE side IS NOT NULL""")
def preference_pairs(t):
    """P-01, J-04."""
    return pairs.preference_pairs(_samples(t), 0.25)


@query(f"""WITH {_SAMPLES} SELECT id, idx, length, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length, idx) AS r FROM samples
  WHERE reward = 1 AND valid) WHERE r <= 2""")
def shortest_valid_topk(t):
    """O-94."""
    return pairs.shortest_valid(_samples(t), 2)


@query(f"""WITH {_SAMPLES} SELECT id, count(*) AS n, round(max(reward) - min(reward), 6) AS spread, string_agg(idx || ':' || CAST(valid AS VARCHAR), ','
  ORDER BY idx) AS flags FROM samples GROUP BY id""")
def rollout_rewards(t):
    """P-02, A-14: samples of an id in their order."""
    s = _samples(t).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "valid"))).alias("s"), F.count("*").alias("n"), F.round(F.max("reward") - F.min("reward"), 6).alias("spread"))
    return s.select("id", "n", "spread", F.array_join(F.transform("s", lambda x: F.concat(x["idx"].cast("string"), F.lit(":"), x["valid"].cast("string"))), ",").alias("flags"))


# --- reports and metrics



@query(R + " DISTINCT doc_id AS id, code, line_no FROM gold")
def parse_report(t):
    """O-71, O-60, O-67: findings rendered to reports and read back."""
    found = reports.parse(reports.render(t.gold, CODES))
    return found.select("id", "code", F.explode("line_nos").alias("line_no")).distinct()


@query(ALIGNED + f"""SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1
  FROM (SELECT avg(CASE WHEN n_pred = 0 THEN 0 ELSE n_hit / n_pred END) AS p, avg(n_hit / n_gold) AS r FROM per WHERE n_gold > 0)""")
def line_localization(t):
    """M-01."""
    return metrics.line_localization(t.gold, t.pred)


@query(ALIGNED + """SELECT round(avg(CASE WHEN p = 0 THEN 0 ELSE h / p END), 6) AS precision, round(avg(CASE WHEN g = 0 THEN 0 ELSE h / g END), 6) AS recall,
  count(*) AS n_docs FROM (SELECT doc_id, sum(g) AS g, sum(p) AS p, sum(g * p) AS h FROM al GROUP BY doc_id)""")
def overall_match(t):
    """M-03."""
    return metrics.overall_match(t.gold, t.pred)


@query(DETECT + """SELECT code, CAST(tp AS BIGINT) AS tp, CAST(ng AS BIGINT) AS n_gold, CAST(np AS BIGINT) AS n_pred, round(p, 6) AS precision, round(r, 6) AS recall
  FROM pr""")
def detection_pr(t):
    """M-04, M-10."""
    return metrics.detection(t.gold, t.pred).select("code", "tp", "n_gold", "n_pred", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"))


@query(DETECT + f"""SELECT 'all' AS grp, round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1, n_codes
  FROM (SELECT avg(p) AS p, avg(r) AS r, count(*) AS n_codes FROM pr WHERE ng > 0)""")
def detection_macro(t):
    """M-05."""
    return metrics.macro(metrics.detection(t.gold, t.pred))


@query(DETECT + f"""SELECT grp, round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1, n_codes
  FROM (SELECT grp, avg(p) AS p, avg(r) AS r, count(*) AS n_codes FROM pr JOIN groups USING (code) WHERE ng > 0 GROUP BY grp)""")
def group_macro(t):
    """M-05 by tool group."""
    return metrics.macro(metrics.detection(t.gold, t.pred), rules.group_of(F.col("code")))


@query(ALIGNED + """SELECT round(1 - sum(bad) / count(*), 6) AS rate, count(*) AS n_docs
  FROM (SELECT doc_id, max(CASE WHEN n_pred > 0 AND n_gold = 0 THEN 1 ELSE 0 END) AS bad FROM per GROUP BY doc_id)""")
def instruction_follow(t):
    """M-07: documents without a predicted code that isn't their own."""
    per = metrics.by_code(metrics.aligned(t.gold, t.pred)).groupBy("doc_id").agg(F.max(((F.col("n_pred") > 0) & (F.col("n_gold") == 0)).cast("int")).alias("bad"))
    return per.agg(F.round(1 - F.sum("bad") / F.count("*"), 6).alias("rate"), F.count("*").alias("n_docs"))


@query(ALIGNED + """SELECT round(avg(same), 6) AS overlap, count(*) AS n_docs FROM (SELECT doc_id, min(CASE WHEN n_gold = n_pred THEN 1 ELSE 0 END) AS same FROM per
  GROUP BY doc_id)""")
def coarse_overlap(t):
    """M-09: documents with equal counts of each code."""
    per = metrics.by_code(metrics.aligned(t.gold, t.pred)).groupBy("doc_id").agg(F.min((F.col("n_gold") == F.col("n_pred")).cast("int")).alias("same"))
    return per.agg(F.round(F.avg("same"), 6).alias("overlap"), F.count("*").alias("n_docs"))


@query(ALIGNED + """SELECT code, round(avg(CASE WHEN n_pred = 0 THEN 0 ELSE n_hit / n_pred END), 6) AS precision, round(avg(n_hit / n_gold), 6) AS recall FROM per
  WHERE n_gold > 0 GROUP BY code""")
def exact_alignment(t):
    """M-11: mean shares of aligned lines by code."""
    per = metrics.by_code(metrics.aligned(t.gold, t.pred)).where("n_gold > 0")
    return per.groupBy("code").agg(F.round(F.avg(metrics.ratio(F.col("n_hit"), F.col("n_pred"))), 6).alias("precision"), F.round(F.avg(F.col("n_hit") / F.col("n_gold")), 6).alias("recall"))


@query(ALIGNED + """, x AS (SELECT doc_id, code, n_gold, n_pred, grp, sum(n_gold) OVER (PARTITION BY doc_id, grp) AS gg FROM per JOIN groups USING (code))
SELECT code, count(*) FILTER (WHERE n_pred > 0) AS predicted, count(*) FILTER (WHERE n_pred > 0 AND n_gold = 0) AS wrong, count(*) FILTER (WHERE n_pred > 0 AND n_gold = 0 AND gg > 0) AS confused FROM x GROUP BY code""")
def confusable_rates(t):
    """M-13: wrong predictions, and those where another code of the tool group is right."""
    per = metrics.by_code(metrics.aligned(t.gold, t.pred)).withColumn("grp", rules.group_of(F.col("code"))).withColumn("gg", F.sum("n_gold").over(W.partitionBy("doc_id", "grp")))
    hit, wrong = F.col("n_pred") > 0, (F.col("n_pred") > 0) & (F.col("n_gold") == 0)
    return per.groupBy("code").agg(F.count(F.when(hit, 1)).alias("predicted"), F.count(F.when(wrong, 1)).alias("wrong"), F.count(F.when(wrong & (F.col("gg") > 0), 1)).alias("confused"))


@query(ALIGNED + f""", pc AS (SELECT *, CASE WHEN n_pred = 0 THEN 0 ELSE n_hit / n_pred END AS p, CASE WHEN n_gold = 0 THEN 0 ELSE n_hit / n_gold END AS r FROM per),
s AS (SELECT doc_id, sum(n_gold) AS g, sum(n_pred) AS q, sum(n_hit) AS h, avg({F1}) AS v2, avg(p) FILTER (WHERE n_gold > 0) AS mp, avg(r) FILTER (WHERE n_gold > 0) AS mr FROM pc GROUP BY doc_id),
d AS (SELECT d.doc_id, coalesce(g, 0) AS g, coalesce(q, 0) AS q, coalesce(h, 0) AS h, v2, coalesce(mp, 0) AS mp, coalesce(mr, 0) AS mr FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id)
SELECT doc_id, round(CASE WHEN g = 0 THEN CASE WHEN q = 0 THEN 1.0 ELSE 0.0 END WHEN h = 0 THEN 0.0 ELSE 2 * (h / q) * (h / g) / (h / q + h / g) END, 6) AS reward_v1,
  round(CASE WHEN g = 0 AND q = 0 THEN 1.0 ELSE coalesce(v2, 0) END, 6) AS reward_v2,
  round(CASE WHEN g = 0 THEN CASE WHEN q = 0 THEN 1.0 ELSE 0.0 END WHEN mp + mr = 0 THEN 0.0 ELSE 2 * mp * mr / (mp + mr) END, 6) AS reward_v3, CAST(g AS BIGINT) AS n_gold, CAST(q AS BIGINT) AS n_pred FROM d""")
def rewards(t):
    """M-16 to M-18."""
    return metrics.rewards(t.gold, t.pred, t.documents)


@query(""", e AS (SELECT d.doc_id, d.lang, d.doc_id IN (SELECT doc_id FROM pred) AS hit FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM gold))
  SELECT lang, count(*) AS n, round(avg(CASE WHEN hit THEN 0 ELSE 1 END), 6) AS accuracy FROM e GROUP BY lang""")
def no_violation_accuracy(t):
    """A-12: of documents without findings, the share where none is predicted."""
    clean = t.documents.select("doc_id", "lang").join(t.gold.select("doc_id").distinct(), "doc_id", "left_anti")
    hit = t.pred.select("doc_id").distinct().withColumn("hit", F.lit(1))
    return clean.join(hit, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(1 - F.coalesce("hit", F.lit(0))), 6).alias("accuracy"))


@query(ALIGNED + "SELECT doc_id, code FROM per WHERE n_gold > 0 AND n_pred > 0 AND n_hit = 0")
def zero_overlap_errors(t):
    """M-23."""
    return metrics.by_code(metrics.aligned(t.gold, t.pred)).where("n_gold > 0 AND n_pred > 0 AND n_hit = 0").select("doc_id", "code")


@query(ALIGNED + "SELECT doc_id FROM per GROUP BY doc_id HAVING sum(n_gold) > 0 AND sum(n_pred) = 0")
def missed_documents(t):
    """M-24: documents with findings of which none is predicted."""
    return metrics.by_code(metrics.aligned(t.gold, t.pred)).groupBy("doc_id").agg(F.sum("n_gold").alias("g"), F.sum("n_pred").alias("p")).where("g > 0 AND p = 0").select("doc_id")


@query("""SELECT round(sum(quality * toxic) / nullif(sum(toxic), 0), 6) AS precision, round(sum(quality * toxic) / nullif(sum(quality), 0), 6) AS recall,
  count(*) AS n FROM labels""")
def label_pr(t):
    """M-04 over two label columns."""
    return t.labels.agg(F.round(F.sum(F.col("quality") * F.col("toxic")) / F.nullif(F.sum("toxic"), F.lit(0)), 6).alias("precision"), F.round(F.sum(F.col("quality") * F.col("toxic")) / F.nullif(F.sum("quality"), F.lit(0)), 6).alias("recall"), F.count("*").alias("n"))


@query("""SELECT round((po - pe) / nullif(1 - pe, 0), 6) AS kappa, n FROM (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS po,
(sum(quality) * sum(toxic) + (count(*) - sum(quality)) * (count(*) - sum(toxic))) / (count(*) * count(*)) AS pe FROM labels)""")
def label_kappa(t):
    """M-19."""
    return metrics.kappa(t.labels, "quality", "toxic")


@query(ALIGNED + """, d AS (SELECT sum(p) - sum(g) AS d FROM al GROUP BY doc_id), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS k FROM d WHERE d <> 0)
SELECT coalesce(sum(k) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(k) FILTER (WHERE d < 0), 0)::DOUBLE AS w_minus, least(coalesce(sum(k) FILTER (WHERE d > 0), 0), coalesce(sum(k) FILTER (WHERE d < 0), 0))::DOUBLE AS w, count(*) AS n FROM r""")
def wilcoxon_w(t):
    """M-20, O-96: predicted against gold counts."""
    per = metrics.aligned(t.gold, t.pred).groupBy("doc_id").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    return metrics.wilcoxon(per, "p", "g").select("w_plus", "w_minus", "w", "n")


# --- Python table functions: no SQL


@query()
def ast_patterns(t):
    """T-01 to T-31, T-35, T-37 to T-42 over the documents taken as code."""
    return patterns.find_patterns(t.documents.select(F.col("doc_id").alias("blob_id"), F.col("text").alias("content")))


@query()
def html_sections(t):
    """O-17, O-18."""
    return readers.html_sections(t.pages)


@query()
def fuzzy_alignment(t):
    """M-12, M-15, J-11: by code, shares of lines that are equal, and similar, on both sides of a document."""
    return metrics.text_localization(joins.with_line(t.gold, t.documents), joins.with_line(t.pred, t.documents))
