"""Queries of sources and sinks: tables written to the shared folder and read back; and of texts made from tables."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintloom.functions import text
from lintloom.operators import edits, joins, patterns, samples, star, table_functions
from lintloom.plans.base import R, query
from lintloom.sources import fetch, ranges, readers, sinks
from lintloom.sources.scratch import Scratch
from lintloom.streaming import streams

LABELS = "doc_id long, quality int, toxic int"


# --- JSON lines


@query("SELECT doc_id, quality, toxic FROM labels")
def jsonl_round_trip(t):
    """O-01, O-22."""
    path = Scratch(t.spark).path("labels")
    sinks.write_jsonl(t.labels, path)
    return readers.read_jsonl(t.spark, path, LABELS)


def _half_broken(t) -> str:
    """Labels as lines of JSON, those of quality 0 cut short."""
    line = F.to_json(F.struct("doc_id", "quality", "toxic"))
    path = Scratch(t.spark).path("lines")
    t.labels.select(F.when(F.col("quality") == 0, F.left(line, F.lit(8))).otherwise(line).alias("value")).write.text(path)
    return path


@query("SELECT doc_id, toxic FROM labels WHERE quality <> 0")
def jsonl_safe(t):
    """O-02: lines that aren't JSON go."""
    return readers.read_jsonl(t.spark, _half_broken(t), LABELS, "safe").select("doc_id", "toxic")


@query("SELECT quality = 0 AS bad, count(*) AS n FROM labels GROUP BY quality = 0")
def jsonl_audit(t):
    """O-03: lines that aren't JSON stay, as they are."""
    rows = readers.read_jsonl(t.spark, _half_broken(t), LABELS, "audit")
    # Spark reads no file for the sake of this column alone
    bad = F.when(F.col(readers.BAD).isNotNull(), True).otherwise(F.col("doc_id").isNull())
    return rows.groupBy(bad.alias("bad")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7")
def jsonl_first(t):
    """O-04: the first seven lines of a file."""
    path = Scratch(t.spark).path("nation")
    sinks.write_jsonl(t.nation.select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey"), path)
    return readers.read_first(t.spark, path, "n_nationkey int, n_name string", 7)


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.n_chars ELSE -l.quality END AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def dump_last_wins(t):
    """O-05, O-06, O-44: a dump of two folders; keys of the second one replace those of the first."""
    root = Scratch(t.spark).path("dump")
    sinks.write_jsonl(t.documents.select("doc_id", F.col("n_chars").alias("n")), f"{root}/a")
    known = t.labels.join(t.documents.select("doc_id"), "doc_id", "left_semi")
    sinks.write_jsonl(known.select("doc_id", (-F.col("quality")).cast("long").alias("n")), f"{root}/b")
    return readers.load_dump(t.spark, root, "doc_id long, n long", "doc_id")


@query(R + " CAST(doc_id AS VARCHAR) AS blob_id, code, CAST(line_no AS INTEGER) AS line_no FROM gold WHERE code <> 'R_TRAIL'")
def findings_from_strings(t):
    """O-07, O-32: findings as a string that holds an array; those without a code go."""
    path = Scratch(t.spark).path("findings")
    code = F.when(F.col("code") != "R_TRAIL", F.col("code"))
    place = F.struct(F.col("line_no").cast("int").alias("row"), F.lit(1).alias("column"))
    found = F.struct(code.alias("code"), F.lit("m").alias("message"), place.alias("location"), place.alias("end_location"))
    rows = t.gold.groupBy("doc_id").agg(F.to_json(F.collect_list(found)).alias("violations"))
    sinks.write_jsonl(rows.select(F.col("doc_id").cast("string").alias("blob_id"), "violations"), path)
    each = readers.load_findings(t.spark, path).select("blob_id", F.explode(readers.real_findings(F.col("violations"))).alias("v"))
    return each.select("blob_id", "v.code", F.col("v.location.row").alias("line_no"))


# --- files


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def rule_specs(t):
    """O-08, O-10, O-28, O-29: a CSV of codes, and a JSON file for each code."""
    scratch = Scratch(t.spark)
    table, folder = scratch.path("codes"), scratch.path("specs")
    sinks.write_csv(t.nation.select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string"), F.lit(" ")).alias("Code"), F.col("n_name").alias("name")), table)
    specs = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    sinks.write_files(specs.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".json")).alias("file"), F.to_json(F.struct(F.col("r_name").alias("region"))).alias("body")), folder, "file", "body")
    return readers.read_rule_specs(t.spark, table, folder, "region string").select("code", "name", "region")


@query("SELECT r_regionkey, r_name FROM region")
def json_array_round_trip(t):
    """O-09, O-23."""
    path = Scratch(t.spark).path("regions.json")
    sinks.write_json_array(t.region, path)
    return readers.read_json_array(t.spark, path, "r_regionkey int, r_name string")


@query("""SELECT n_nationkey || '_' || n_regionkey AS stem, n_name || chr(10) || 'x = 1' || chr(10) AS content, n_regionkey * 10 AS start_line FROM nation
  WHERE n_regionkey <> 2""")
def annotated_code(t):
    """O-11, O-12: files of notes joined with the code files of their stem; notes that aren't JSON go."""
    scratch = Scratch(t.spark)
    notes, code = scratch.path("notes"), scratch.path("code")
    stem = F.concat(F.col("n_nationkey").cast("string"), F.lit("_"), F.col("n_regionkey").cast("string"))
    note = F.when(F.col("n_regionkey") == 2, "{").otherwise(F.to_json(F.struct((F.col("n_regionkey") * 10).alias("start_line"))))
    sinks.write_files(t.nation.select(F.concat(stem, F.lit(".json")).alias("file"), note.alias("body")), notes, "file", "body")
    sinks.write_files(t.nation.select(F.concat(stem, F.lit(".py")).alias("file"), F.concat("n_name", F.lit("\nx = 1")).alias("body")), code, "file", "body")
    return readers.read_with_code(t.spark, notes, code, "start_line int").select("stem", "content", "start_line")


@query("""SELECT p_partkey || '_0' || p_size AS id, CAST(p_size AS VARCHAR) AS rule, 'Check ' || p_brand || ' for ' || r_name AS prompt, p_type AS label, 'benchmark/' || p_size AS source
FROM part JOIN region ON r_regionkey = p_size WHERE p_size <> 3 AND p_type <> 'PROMO'""")
def benchmark_records(t):
    """O-11b: notes as chats; rules without a spec, rules to skip and notes without code are left out."""
    stem = F.concat(F.col("p_partkey").cast("string"), F.lit("_0"), F.col("p_size").cast("string"))
    notes = t.part.select(stem.alias("stem"), F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("content"), F.col("p_type").alias("violations"))
    specs = t.region.select(F.col("r_regionkey").cast("string").alias("rule"), F.col("r_name").alias("spec"))
    prompt = F.concat(F.lit("Check "), "content", F.lit(" for "), "spec")
    chats, _ = joins.benchmark_chats(notes, specs, prompt, F.col("violations"), ("3",))
    said = lambda i: F.get("messages", F.lit(i))["content"]
    return chats.select("id", "rule", said(0).alias("prompt"), said(1).alias("label"), "source")


def _zipped(names: pd.Series) -> pd.Series:
    return names.map(lambda x: gzip.compress(x.encode("utf-8")))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS blob_id, CASE WHEN n_regionkey > 0 THEN n_name || ' é' END AS content FROM nation")
def blobs_unzipped(t):
    """O-14: compressed files by id; where there is none, the text is null."""
    path = Scratch(t.spark).path("blobs")
    files = t.nation.where("n_regionkey > 0").select(
        F.concat(F.col("n_nationkey").cast("string"), F.lit(".gz")).alias("file"), F.pandas_udf(_zipped, "binary")(F.concat("n_name", F.lit(" é"))).alias("body")
    )
    sinks.write_files(files, path, "file", "body")
    blobs = t.nation.select(F.col("n_nationkey").cast("string").alias("blob_id"), F.lit("utf-8").alias("encoding"))
    return readers.read_blobs(blobs, path).select("blob_id", "content")


@query("SELECT doc_id, 'here' AS place FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'hub' FROM labels WHERE quality = 0")
def datasets_by_split(t):
    """O-21: a split that the lookup has, and one that only the folder has."""
    path = Scratch(t.spark).path("data")
    t.labels.where("quality = 1").select("doc_id").write.parquet(f"{path}/train")
    known = {(path, "test"): t.labels.where("quality = 0").select("doc_id")}
    lookup = lambda name, split: known.get((name, split))
    read = lambda split: readers.read_dataset(t.spark, path, split, lookup)
    return read("train").withColumn("place", F.lit("here")).union(read("test").withColumn("place", F.lit("hub")))


@query("SELECT doc_id, true AS small FROM labels")
def shards_of_rows(t):
    """O-24: files of at most a hundred rows, and their rows read back."""
    path = Scratch(t.spark).path("shards")
    sinks.write_shards(t.labels, path, 100)
    rows = readers.read_jsonl(t.spark, path, LABELS).withColumn("file", F.col("_metadata.file_path"))
    small = rows.groupBy("file").agg((F.count("*") <= 100).alias("small"))
    return rows.join(small, "file").select("doc_id", "small")


@query("SELECT doc_id, quality FROM labels")
def appended_once(t):
    """O-27: rows appended twice, of which the second time only the new ones are written."""
    path = Scratch(t.spark).path("appended")
    rows = t.labels.select("doc_id", "quality")
    sinks.append_new(rows.where("quality = 1"), path, "doc_id")
    sinks.append_new(rows, path, "doc_id")
    return t.spark.read.schema(rows.schema).parquet(path)


_AT = "SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM labels"


@query(f"SELECT line_no, doc_id, quality FROM ({_AT}) WHERE line_no >= 37 AND line_no < 37 + 90")
def rows_at_offset(t):
    """O-13, O-05, O-24: labels in exact shards, read from a row on and as many as are asked for, by the ranges they lie in."""
    scratch = Scratch(t.spark)
    path, index = scratch.path("shards"), scratch.path("index")
    ranges.write_exact_shards(t.labels.select("doc_id", "quality"), path, 25, [F.col("doc_id")])
    ranges.index_lines(t.spark, path, index, 400)
    return ranges.read_at(t.spark, path, index, "doc_id long, quality int", 37, 90)


@query(f"SELECT 'from_' || printf('%015d', line_no // 50 * 50) || '.jsonl' AS file, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM ({_AT}) GROUP BY 1")
def exact_shards(t):
    """O-24: each file has exactly fifty rows in order, but the last one."""
    path = Scratch(t.spark).path("shards")
    ranges.write_exact_shards(t.labels.select("doc_id"), path, 50, [F.col("doc_id")])
    rows = readers.read_jsonl(t.spark, path, "doc_id long").select("doc_id", F.col("_metadata.file_name").alias("file"))
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("""SELECT 'whole' AS kind, doc_id, quality FROM labels WHERE toxic = 0 UNION ALL
SELECT kind, CASE kind WHEN 'lines' THEN (SELECT count(*) FROM labels) + 1 WHEN 'bad' THEN (SELECT count(*) FROM labels WHERE toxic = 1) + 1 ELSE (SELECT count(*) FROM labels WHERE toxic = 0) END, CAST(NULL AS INTEGER)
FROM (VALUES ('lines'), ('bad'), ('rows')) v(kind)""")
def counted_lines(t):
    """O-02, O-03: the rows of JSON lines some of which are cut short, and how many were left out, from the one read."""
    path = Scratch(t.spark).path("lines")
    whole = F.to_json(F.struct("doc_id", "quality"))
    lines = t.labels.select(F.when(F.col("toxic") == 1, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("value"))
    lines.union(t.spark.createDataFrame([("[1, 2]",), ("",)], "value string")).write.text(path)
    rows, seen = readers.read_jsonl_counted(t.spark, path, "doc_id long, quality int")
    rows = Scratch(t.spark).put(rows, "rows")  # the counts are there when the rows have been read
    counts = [(k, int(v), None) for k, v in seen.get.items()]
    return rows.select(F.lit("whole").alias("kind"), "doc_id", "quality").union(t.spark.createDataFrame(counts, "kind string, doc_id long, quality int"))


@query("""WITH s AS (SELECT conv_id AS id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) / 4.0 AS reward FROM conversations),
g AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn, role, text) - 1 AS place, text, CASE WHEN role = 'user' THEN reward END AS reward FROM s)
SELECT id, CAST(place AS INTEGER) AS place, md5(text) AS text, reward, true AS whole FROM g UNION ALL SELECT DISTINCT id, -1, NULL, NULL, false FROM g""")
def mixed_samples(t):
    """P-02: samples written as pairs of a text and a reward, some with the text alone, and one entry of each that is no pair."""
    rows = t.conversations.select(F.col("conv_id").alias("id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    reward = F.length("text") / F.lit(4.0)
    pair = F.when(F.col("role") == "user", F.concat(F.lit("["), edits.json_text(F.col("text")), F.lit(", "), reward.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), edits.json_text(F.col("text")), F.lit("]")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", pair.alias("pair")))), lambda x: x["pair"])
    told = rows.groupBy("id").agg(F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit(', {"text": 1}]')).alias("samples"))
    return samples.explode_samples(told, "id", "samples").select("id", F.col("at").alias("place"), F.md5("text").alias("text"), "reward", "whole")


@query("""SELECT doc_id, 'pep_572' AS pattern, CAST(1 AS INTEGER) AS start_line, CAST(NULL AS VARCHAR) AS code FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, NULL, CAST(NULL AS INTEGER), 'Q' || length(text) FROM documents WHERE text IS NOT NULL""")
def functions_in_sql(t):
    """Detectors and parsers by name, as table functions that SQL calls beside each row."""
    table_functions.register(t.spark)
    code = F.concat(F.lit("if (n := 'R"), F.length("text").cast("string"), F.lit("'):\n    pass\n"))
    report = F.concat(F.lit("**Idiom Q"), F.length("text").cast("string"), F.lit(' Violations:**\n{"line": "1 x"}'))
    t.documents.where("text IS NOT NULL").select("doc_id", code.alias("code"), report.alias("report")).createOrReplaceTempView("coded_documents")
    return t.spark.sql("""SELECT d.doc_id, f.pattern, f.start_line, CAST(NULL AS STRING) AS code FROM coded_documents d, LATERAL detect(d.code, 'pep_572') f
      UNION ALL SELECT d.doc_id, NULL, NULL, r.code FROM coded_documents d, LATERAL parse_report(d.report, 'lines') r""")


# --- streams


@query(R + " doc_id, code, line_no FROM gold")
def stream_appended(t):
    """O-26, ST-04: findings appended while files arrive, by a stream that is stopped and goes on."""
    scratch = Scratch(t.spark)
    inputs, out, checkpoint = scratch.path("in"), scratch.path("out"), scratch.path("checkpoint")
    docs = t.documents.select("doc_id", "text")
    for part in (docs.where("text < 'm'"), docs.where("text >= 'm' OR text IS NULL")):
        part.write.mode("append").parquet(inputs)
        streams.start_append(streams.stream_findings(t.spark, inputs, "doc_id long, text string"), out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).select("doc_id", "code", "line_no")


@query("SELECT user_id AS id, CAST(5 AS BIGINT) AS n FROM events GROUP BY user_id HAVING count(*) >= 5")
def stream_groups(t):
    """ST-02: groups given out when they have five different samples, as these arrive."""
    scratch = Scratch(t.spark)
    inputs, out, checkpoint = scratch.path("in"), scratch.path("out"), scratch.path("checkpoint")
    samples = t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("idx"), F.col("value").alias("reward"), "ts")
    samples.write.parquet(inputs)
    stream = streams.stream_complete_groups(t.spark.readStream.schema(samples.schema).parquet(inputs), 5, "ts", "3650 days")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("id long, n long, best double").parquet(out).select("id", F.least("n", F.lit(5)).cast("long").alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events)
SELECT user_id, idx, event_id, event_type FROM e WHERE idx < coalesce((SELECT min(idx) FROM e m WHERE m.user_id = e.user_id AND m.value < 1), 1e9)""")
def stream_in_order(t):
    """ST-01: events of a user given out in order while they arrive late ones first, over a restart; small ones never arrive."""
    scratch = Scratch(t.spark)
    inputs, out, checkpoint = scratch.path("in"), scratch.path("out"), scratch.path("checkpoint")
    rows = t.events.withColumn("idx", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")).where("value >= 1")
    rows = scratch.put(rows.select("user_id", "idx", "event_id", "event_type"), "rows")  # numbered once, read for each part
    late = F.xxhash64("event_id") < 0
    for part in (rows.where(late), rows.where(~late)):
        part.write.mode("append").parquet(inputs)
        stream = streams.stream_in_order(t.spark.readStream.schema(rows.schema).parquet(inputs), "user_id", "idx")
        with streams.keyed_state(t.spark):
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(out)


@query("""SELECT doc_id AS blob_id, 'R' || length(text) AS snippet, CAST(1 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL""")
def stream_detected_once(t):
    """ST-04, O-26: the walrus of a line of code made of each document, by a stream whose batch fails after it was written."""
    scratch = Scratch(t.spark)
    inputs, out, checkpoint = scratch.path("in"), scratch.path("out"), scratch.path("checkpoint")
    code = F.concat(F.lit("if (n := 'R"), F.length("text").cast("string"), F.lit("'):\n    pass\n"))
    t.documents.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("blob_id"), code.alias("content")).write.parquet(inputs)

    def fail(rows: DataFrame, number: int) -> None:
        raise RuntimeError("lost after writing")

    for then in (fail, None):
        files = t.spark.readStream.schema("blob_id string, content string").parquet(inputs)
        stream = streams.start_batches(streams.stream_patterns(files, ["pep_572"]), out, checkpoint, then)
        try:
            stream.awaitTermination()
        except Exception as e:
            if "lost after writing" not in str(e):
                raise
    found = streams.read_batches(t.spark, out, patterns.MATCHES)
    return found.groupBy(F.col("blob_id").cast("long").alias("blob_id"), F.regexp_extract("snippet", "'(R[0-9]+)'", 1).alias("snippet")).agg(F.count("*").alias("n"))


# --- texts


@query("SELECT doc_id FROM documents WHERE contains(text, 'the') AND contains(text, 'and') AND contains(text, chr(10))")
def marked_texts(t):
    """O-38: texts with all markers."""
    return t.documents.where(text.has_markers(F.col("text"), ("the", "and", "\n"))).select("doc_id")


_HEAD = "### Final Idiom Violations Found"


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'why ' || doc_id || chr(10) ELSE '' END AS reasoning,
  CASE WHEN quality = 1 THEN chr(10) || 'found ' || toxic WHEN toxic = 1 THEN 'found ' || doc_id ELSE 'a ### Final Idiom Violations Found b ### Final Idiom Violations Found' END AS report FROM labels""")
def split_reports(t):
    """O-66: reasoning and report, of texts with one header, with none and with two."""
    one = F.concat(F.lit("why "), F.col("doc_id").cast("string"), F.lit(f"\n{_HEAD}\nfound "), F.col("toxic").cast("string"))
    none = F.concat(F.lit("found "), F.col("doc_id").cast("string"))
    whole = F.when(F.col("quality") == 1, one).when(F.col("toxic") == 1, none).otherwise(f"a {_HEAD} b {_HEAD}")
    reasoning, report = text.split_report(F.col("whole"), _HEAD)
    return t.labels.select("doc_id", whole.alias("whole")).select("doc_id", reasoning.alias("reasoning"), report.alias("report"))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN ' of ' || doc_id WHEN quality = 0 AND toxic = 0 THEN 'second' END AS docstring FROM labels")
def docstrings(t):
    """O-79: of one docstring and of two; null for none or an open one."""
    q = '"""'
    one = F.concat(F.lit(f"def f():\n{q} of "), F.col("doc_id").cast("string"), F.lit(f"{q}\n    return 1"))
    two = F.lit(f"{q}first{q}\ndef f():\n{q}second{q}")
    code = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), one).when(F.col("toxic") == 0, two).when(F.col("quality") == 1, F.lit("x = 1")).otherwise(F.lit(f"{q}open"))
    return t.labels.select("doc_id", text.docstring(code).alias("docstring"))


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || 'x' AS before, p_brand AS after FROM part")
def example_halves(t):
    """O-81: what stands before and after the mark of an example; what follows a blank line isn't part of the second half."""
    example = F.concat("p_name", F.lit("\n\nx\n\nUse instead:\n\n"), "p_brand", F.lit("\n\nSee also"))
    return t.part.select("p_partkey", edits.example_split(example).alias("s")).select("p_partkey", "s.before", "s.after")


@query("SELECT p_partkey, p_brand AS before, p_name AS after FROM part WHERE p_size > 10 AND p_type <> 'PROMO'")
def reversed_specs(t):
    """O-82: rules with a fix and a whole example, turned round."""
    half = F.struct(F.col("p_name").alias("before"), F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("after"))
    specs = t.part.select("p_partkey", F.when(F.col("p_size") > 10, "safe").alias("fix_safety"), half.alias("example_split"))
    return edits.reversed_rules(specs).select("p_partkey", "example_split.before", "example_split.after")


@query("SELECT conv_id, turn, role, md5(CAST(to_json(text) AS VARCHAR)) AS quoted FROM conversations")
def json_escaped(t):
    """O-85: texts as JSON strings."""
    return t.conversations.select("conv_id", "turn", "role", F.md5(edits.json_text(F.col("text"))).alias("quoted"))


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'why' || chr(10) || chr(10) || '### Final Idiom Violations Found' || chr(10) || chr(10)
  || '**Idiom A Violations:**' || chr(10) || 'NO VIOLATIONS FOUND' || chr(10) || chr(10) || '**Idiom B Violations:**' || chr(10) || 'NO VIOLATIONS FOUND'
  WHEN quality = 1 THEN 'why' || chr(10) || '### Final Idiom Violations Found' || chr(10) || '**Idiom A Violations:**' || chr(10) || doc_id END AS repaired FROM labels""")
def repaired_sections(t):
    """O-89: a bare sentinel becomes a section for each code; sections stay; texts without one header are null."""
    said = F.when(F.col("toxic") == 1, F.lit(text.SENTINEL)).otherwise(F.concat(F.lit("**Idiom A Violations:**\n"), F.col("doc_id").cast("string")))
    whole = F.when(F.col("quality") == 1, F.concat(F.lit(f"why\n{_HEAD}\n"), said)).otherwise(F.lit("nothing"))
    return t.labels.select("doc_id", star.repair_sections(whole, F.array(F.lit("A"), F.lit("B")), _HEAD).alias("repaired"))


@query("""SELECT d.doc_id AS id, d.lang || ':' || d.doc_id AS prompt, d.source AS chosen, CASE WHEN l.doc_id IS NOT NULL THEN 'said ' || l.quality END AS rejected
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def gold_model_pairs(t):
    """P-05: the truth against the model's text, which not every task has."""
    tasks = t.documents.select(F.col("doc_id").alias("id"), "source", F.concat("lang", F.lit(":"), F.col("doc_id").cast("string")).alias("prompt"), F.col("source").alias("truth"))
    said = t.labels.select(F.col("doc_id").alias("id"), F.concat(F.lit("said "), F.col("quality").cast("string")).alias("response"))
    content = lambda c, i: F.get(c, F.lit(i))["content"]
    pairs = star.gold_pairs(tasks, said)
    return pairs.select("id", content("chosen", 0).alias("prompt"), content("chosen", 1).alias("chosen"), content("rejected", 0).alias("rejected"))


@query("""SELECT event_id AS id, event_type AS body, 'issue' AS kind FROM events WHERE value < 5 UNION ALL SELECT event_id, event_type, 'review' FROM events
  WHERE value >= 5""")
def comments_of_two_kinds(t):
    """O-20: comments of two sources in one table."""
    rows = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("body"), "value")
    return joins.union_comments(rows.where("value < 5"), rows.where("value >= 5"), ["id", "body"])


@query("""SELECT page_id, len(regexp_extract_all(url || ' and https://b.example/x?y=1', '(https?://[^\\s"''<>]+)', 1)) AS n_urls, regexp_extract(url, '(https?://[^\\s"''<>]+)', 1) AS first
FROM pages WHERE contains(url, 'http:') OR contains(url, 'https:')""")
def urls_of_pages(t):
    """O-37, O-77 over the addresses of pages."""
    whole = F.concat("url", F.lit(" and https://b.example/x?y=1"))
    return t.pages.where(text.has_url(F.col("url"))).select("page_id", F.size(text.urls(whole)).cast("long").alias("n_urls"), F.get(text.urls(whole), F.lit(0)).alias("first"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def documents_without_labels(t):
    """J-01: the audit of keys that a join would drop."""
    return joins.missing_keys(t.documents, t.labels, "doc_id")


# --- pages


def _part_pages(t) -> DataFrame:
    """A page for each part: a heading, a table with symbols and titles, and terms."""
    fix = F.when(F.col("p_size") > 25, "Automatic fix available").otherwise("Automatic fix not available")
    html = F.concat(
        F.lit("<html><style>h1 {}</style><h1>"), "p_name", F.lit("¶</h1><p>About  <b>"), "p_brand", F.lit("</b>\n it</p><table><tr><th>Code</th><th>Kind</th><th></th></tr><tr><td> "), "p_brand",
        F.lit(" </td><td>"), "p_type", F.lit("</td><td><span title='"), fix, F.lit("'>✔</span> 🧪</td></tr></table><h2>More</h2><dl><dt>Kind:</dt><dd><a>"), "p_type",
        F.lit("</a>, <a> b</a></dd><dt>Size:</dt><dd>"), F.col("p_size").cast("string"), F.lit("</dd></dl></html>"),
    )
    part = readers.spread(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    return part.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@query("""SELECT p_partkey AS page_id, p_brand AS code, p_type AS kind, 'Stable,Unstable/Preview' AS states, p_size > 25 AS fix_available FROM part""")
def tables_of_pages(t):
    """O-16: a row of cells by the names in the head, what its symbols stand for, and whether it has a fix."""
    rows = readers.html_tables(_part_pages(t))
    return rows.select("page_id", F.col("cells")["Code"].alias("code"), F.col("cells")["Kind"].alias("kind"), F.array_join("states", ",").alias("states"), "fix_available")


@query("SELECT p_partkey AS page_id, 'Kind' AS key, p_type || ', b' AS value FROM part UNION ALL SELECT p_partkey, 'Size', CAST(p_size AS VARCHAR) FROM part")
def metadata_of_pages(t):
    """O-19: terms and values; of a value with links, their texts."""
    return readers.html_metadata(_part_pages(t))


@query("""SELECT p_partkey AS page_id, 0 AS section, p_name AS heading, 'About ' || p_brand || ' itCodeKind ' || p_brand || ' ' || p_type || '✔ 🧪' AS text FROM part
UNION ALL SELECT p_partkey, 1, 'More', 'Kind:' || p_type || ', bSize:' || p_size FROM part""")
def sections_of_pages(t):
    """O-17, O-18: top headings with the text under them."""
    return readers.html_sections(_part_pages(t))


# --- code hosts and releases


def _answers(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], str]:
    """A stand-in for a code host: files whose number ends in 3 aren't there, others are after some tries."""
    number = int(url.rsplit("/", 1)[1].removesuffix(".py"))
    _answers.asked = getattr(_answers, "asked", {})
    _answers.asked[url] = n = _answers.asked.get(url, 0) + 1
    if number % 10 == 3:
        return 404, {}, ""
    if n % 3:
        return (503, {}, "") if number % 2 else (403, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "0"}, "")
    return 200, {}, f"{url} as {headers['Accept']}"


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 3 THEN 'https://raw.example/o/r/main/a%20b/' || p_partkey || '.py as text' END AS text,
  CASE WHEN p_partkey % 10 = 3 THEN 'status 404' END AS error FROM part""")
def fetched_files(t):
    """O-15 from a stand-in that is busy, or at its limit, twice for each file."""
    url = F.concat(F.lit(fetch.address("https://raw.example/", "o/r", "main", "/a b/")), F.col("p_partkey").cast("string"), F.lit(".py"))
    return fetch.fetch_files(t.part.select(F.col("p_partkey").alias("id"), url.alias("url")), _answers, {"Accept": "text"}, pause=0.0)


@query(r"""SELECT p_partkey, regexp_replace('__version__ = "0.1"' || chr(10) || 'x = ' || p_size || chr(10), '(?m)^__version__\s+=\s+"([^"]+)"\s*$', '__version__ = "1.' || p_size || '"' || chr(10), 'g') AS init,
  '  version="1.' || p_size || '",' AS setup, 'version: 1.' || p_size || ' ' || p_name AS citation, 'a version = {1.' || p_size || '} b' AS readme FROM part""")
def version_bumps(t):
    """O-90: a version in the four kinds of files that tell it."""
    version, size = F.concat(F.lit("1."), F.col("p_size").cast("string")), F.col("p_size").cast("string")
    init = F.concat(F.lit('__version__ = "0.1"\nx = '), size, F.lit("\n"))
    return t.part.select(
        "p_partkey", text.with_version(init, "init", version).alias("init"), text.with_version(F.lit('  version = "0.1",'), "setup", version).alias("setup"),
        text.with_version(F.concat(F.lit("version: 0.1.dev0 "), "p_name"), "citation", version).alias("citation"),
        text.with_version(F.lit("a version = {0.1} b"), "readme", version).alias("readme"),
    )
