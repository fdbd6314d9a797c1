"""Sources: JSON lines with explicit schemas, dumps in many files, side files, sections of web pages."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintloom.operators.keys import keep_last

POINT = "struct<row:int,column:int>"
EDIT = f"struct<content:string,location:{POINT},end_location:{POINT}>"
VIOLATIONS = f"array<struct<code:string,message:string,location:{POINT},end_location:{POINT},fix:struct<applicability:string,message:string,edits:array<{EDIT}>>>>"
BAD = "_bad_row"


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """O-01 to O-03. strict: a bad line is an error; safe: bad lines go; audit: they stay, in the column _bad_row."""
    reader = spark.read.option("mode", {"strict": "FAILFAST", "safe": "DROPMALFORMED", "audit": "PERMISSIVE"}[mode])
    if mode == "audit":
        return reader.option("columnNameOfCorruptRecord", BAD).schema(f"{schema}, {BAD} string").json(path)
    return reader.schema(schema).json(path)


def read_jsonl_counted(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, Observation]:
    """O-02, O-03: the rows of JSON lines as in ``safe``, and what the read sees, without a second one.

    The observation has the numbers of ``lines`` that aren't blank, of ``bad`` ones, which are left out, and of ``rows``;
    they are there once an action has read the rows to their end.
    """
    lines = spark.read.text(path).where(F.length(F.btrim("value", F.lit(" \t\r"))) > 0)
    read = F.from_json("value", f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    seen, bad = Observation(), F.col(f"r.{BAD}").isNotNull() | F.col("r").isNull()
    counted = lines.select(read.alias("r")).observe(seen, F.count("*").alias("lines"), F.count(F.when(bad, 1)).alias("bad"), F.count(F.when(~bad, 1)).alias("rows"))
    return counted.where(~bad).select("r.*").drop(BAD), seen


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """O-09."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def load_dump(spark: SparkSession, folder: str, schema: str, key: str = "blob_id") -> DataFrame:
    """O-05, O-06, O-44: all files of a folder and those in it, of each key the row in the last file by path, last in the file."""
    rows = spark.read.option("recursiveFileLookup", True).schema(schema).json(folder)
    placed = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_place", F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")))
    return keep_last(placed, key, "_file", "_place").drop("_file", "_place")


def load_findings(spark: SparkSession, folder: str) -> DataFrame:
    """O-07: linter results; findings may be an array or a string that holds one. Rows without findings go."""
    text = load_dump(spark, folder, "blob_id string, violations string")
    rows = text.withColumn("violations", F.from_json("violations", T._parse_datatype_string(VIOLATIONS)))
    return rows.where(F.size("violations") > 0)


def real_findings(violations):
    """O-32: findings with a code; syntax errors have none."""
    return F.filter(violations, lambda v: v["code"].isNotNull())


def read_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """O-10: a table of specs; its key is trimmed text."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn(key, F.trim(F.col(key).cast("string")))


def read_with_code(spark: SparkSession, annotations: str, code: str, schema: str) -> DataFrame:
    """O-11, O-12: annotation files joined with the code files of the same stem; unreadable ones go."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)\.[^./]+$", 1)
    notes = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(schema).json(annotations).withColumn("stem", stem(F.col("_metadata.file_name")))
    files = spark.read.text(code, wholetext=True).select(F.col("value").alias("content"), stem(F.col("_metadata.file_name")).alias("stem"))
    return notes.join(files, "stem")


class _Sections(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out: list[tuple[str, str]] = []
        self.head, self.text, self.skip, self.title = None, [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("h1", "h2"):
            self.close_section()
            self.head, self.title = "", True

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("h1", "h2"):
            self.title = False

    def handle_data(self, data):
        if self.skip or self.head is None:
            return
        if self.title:
            self.head += data.replace("¶", "")
        else:
            self.text.append(data)

    def close_section(self):
        if self.head is not None:
            self.out.append((self.head.strip(), " ".join("".join(self.text).split())))
        self.head, self.text = None, []


def section_rows(html: str | None) -> list[tuple[int, str, str]]:
    """O-17, O-18: (section, heading, text) of each top heading, numbered from 0."""
    parser = _Sections()
    parser.feed(html or "")
    parser.close_section()
    return [(i, h, t) for i, (h, t) in enumerate(parser.out)]


def html_sections(pages: DataFrame) -> DataFrame:
    """O-17, O-18: (page_id, section, heading, text) of each top heading of a page, numbered from 0."""
    return _of_pages(pages, section_rows, [("section", "int", pa.int32()), ("heading", "string", pa.string()), ("text", "string", pa.string())])


#: Pages that are parsed before their rows are given on.
PAGES = 256


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt anew by ``key``, for work that is long for the bytes of a row: small tables are few tasks as they are read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _of_pages(pages: DataFrame, parse: Callable[[str | None], list[tuple]], columns: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """(page_id, ...) of the rows that ``parse`` makes of each page; the rows of PAGES pages are held at once."""
    schema = pa.schema([("page_id", pa.int64()), *((name, kind) for name, _, kind in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                ids, texts = (c.to_pylist() for c in batch.slice(at, PAGES).columns)
                if rows := [(page, *row) for page, html in zip(ids, texts, strict=True) for row in parse(html)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return some.mapInArrow(run, ", ".join(["page_id long", *(f"{name} {kind}" for name, kind, _ in columns)]))


def read_rule_specs(spark: SparkSession, metadata: str, folder: str, schema: str) -> DataFrame:
    """O-08: a CSV of rules by Code, joined with one JSON file for each rule, named after its code."""
    specs = spark.read.option("multiLine", True).schema(schema).json(folder).withColumn("code", F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.json$", 1))
    return read_csv(spark, metadata, "Code").withColumnRenamed("Code", "code").join(specs, "code")


def read_first(spark: SparkSession, path: str, schema: str, rows: int) -> DataFrame:
    """O-04: at most so many rows; bad lines go."""
    return read_jsonl(spark, path, schema, "safe").limit(rows)


def read_dataset(spark: SparkSession, dataset: str, split: str, lookup=None) -> DataFrame:
    """O-21: a dataset by name from ``lookup`` (name, split), or, where that gives none, from the folder ``dataset/split``."""
    found = lookup(dataset, split) if lookup is not None else None
    return found if found is not None else spark.read.parquet(f"{dataset.rstrip('/')}/{split}")


def _unzipped(content: pd.Series, encoding: pd.Series) -> pd.Series:
    def one(raw, name):
        try:
            return gzip.decompress(raw).decode(name or "utf-8")
        except (OSError, EOFError, UnicodeDecodeError, LookupError):
            return None

    return pd.Series([None if raw is None else one(raw, name) for raw, name in zip(content, encoding, strict=True)], dtype="object")


def read_blobs(blobs: DataFrame, folder: str) -> DataFrame:
    """O-14 over (blob_id, encoding): the text of the file ``blob_id.gz``; null where it isn't there or can't be decoded."""
    spark = blobs.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.gz$", 1).alias("blob_id"), "content")
    return blobs.join(named, "blob_id", "left").withColumn("content", F.pandas_udf(_unzipped, "string")("content", "encoding"))


#: What the symbols of a rule table's unnamed column stand for, and the titles that tell of a fix (fixed values of those pages).
LEGEND = {"✔": "Stable", "🧪": "Unstable/Preview", "⚠️": "Depreceated", "❌": "Deleted", "🛠": "Automatically Fixable"}
FIX_TITLES = {"Automatic fix available": True, "Automatic fix not available": False}


class _Tables(HTMLParser):
    """Tables as rows of (cell texts, titles of spans in them); pairs of dt and dd with their links."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[tuple[bool, list[str], list[str]]]] = []
        self.terms: list[list[str]] = []
        self.values: list[list] = []
        self.cell, self.term, self.value, self.link = False, False, False, None

    def handle_starttag(self, tag, attrs):
        rows = self.tables[-1] if self.tables else None
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and rows is not None:
            rows.append((False, [], []))
            self.cell = False
        elif tag in ("td", "th") and rows:
            head, cells, titles = rows[-1]
            rows[-1] = (head or tag == "th", [*cells, ""], titles)
            self.cell = True
        elif tag == "span" and self.cell and dict(attrs).get("title"):
            self.tables[-1][-1][2].append(dict(attrs)["title"])
        elif tag == "dt":
            self.terms.append([])
            self.term, self.value = True, False
        elif tag == "dd":
            self.values.append([[], {"a": [], "abbr": []}])
            self.term, self.value = False, True
        elif tag in ("a", "abbr") and self.value:
            self.values[-1][1][tag].append("")
            self.link = tag

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = False
        elif tag in ("dt", "dd", "dl"):
            self.term = self.value = False
            self.link = None
        elif tag == self.link:
            self.link = None

    def handle_data(self, data):
        if self.cell:
            self.tables[-1][-1][1][-1] += data
        elif self.term:
            self.terms[-1].append(data)
        elif self.value:
            texts, links = self.values[-1]
            texts.append(data)
            if self.link:
                links[self.link][-1] += data


def table_rows(html: str | None) -> list[dict]:
    """O-16: of each row of each table the cells by the names in its head, the states that its symbols stand for, and whether it has a fix."""
    parser, out = _Tables(), []
    parser.feed(html or "")
    for at, rows in enumerate(parser.tables):
        names = [c.strip() for head, cells, _ in rows if head for c in cells]
        for head, cells, titles in rows:
            if head or not cells:
                continue
            own = dict(zip(names, (c.strip() for c in cells), strict=False))
            marks = own.pop("", "")
            fix = next((FIX_TITLES[x] for x in titles if x in FIX_TITLES), None)
            out.append({"table": at, "cells": own, "states": [state for mark, state in LEGEND.items() if mark in marks], "fix_available": fix})
    return out


def metadata_pairs(html: str | None) -> dict[str, str]:
    """O-19: dt and dd in turn; a value with links is their texts, else that of its abbreviation, else its own."""
    parser = _Tables()
    parser.feed(html or "")
    out = {}
    for term, (texts, links) in zip(parser.terms, parser.values, strict=False):
        if links["a"]:
            value = ", ".join(x.strip() for x in links["a"])
        else:
            value = links["abbr"][0].strip() if links["abbr"] else "".join(texts).strip()
        out["".join(term).strip().replace(":", "")] = value
    return out


def html_tables(pages: DataFrame) -> DataFrame:
    """O-16 over (page_id, html); a null page has no rows."""
    parse = lambda html: [(i, r["table"], list(r["cells"].items()), r["states"], r["fix_available"]) for i, r in enumerate(table_rows(html))]
    return _of_pages(pages, parse, [
        ("row", "int", pa.int32()), ("table", "int", pa.int32()), ("cells", "map<string,string>", pa.map_(pa.string(), pa.string())),
        ("states", "array<string>", pa.list_(pa.string())), ("fix_available", "boolean", pa.bool_()),
    ])


def html_metadata(pages: DataFrame) -> DataFrame:
    """O-19 over (page_id, html): one row for each term of a page."""
    return _of_pages(pages, lambda html: list(metadata_pairs(html).items()), [("key", "string", pa.string()), ("value", "string", pa.string())])
