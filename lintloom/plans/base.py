"""What the lists of queries share: tables, the decorator that registers a query, and common parts of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintloom.functions import rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CODES = ["R_LONG", "R_TRAIL", "R_BLANK2", "R_DUPLINE", "R_UPPER", "R_SHORTDOC", "R_DIGIT", "R_NONASCII"]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "gold":
            return rules.violations(self.documents, "lang", "source")
        if name == "pred":
            return rules.predictions(self.gold)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = "WITH " + rules.SQL + sql if sql.lstrip().startswith((",", "SELECT/*rules*/")) else sql
        return f

    return add


R = "SELECT/*rules*/"
pct = lambda a, b: F.round(100 * a / b, 2)

#: Parts of SQL: distinct findings of both sides, counts by document and code, detection by code.
ALIGNED = """, al AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.code, b.code) AS code, CASE WHEN a.doc_id IS NULL THEN 0 ELSE 1 END AS g, CASE WHEN b.doc_id IS NULL THEN 0 ELSE 1 END AS p
  FROM (SELECT DISTINCT doc_id, code, line_no FROM gold) a FULL JOIN (SELECT DISTINCT doc_id, code, line_no FROM pred) b ON a.doc_id = b.doc_id AND a.code = b.code AND a.line_no = b.line_no),
per AS (SELECT doc_id, code, sum(g) AS n_gold, sum(p) AS n_pred, sum(g * p) AS n_hit FROM al GROUP BY doc_id, code)
"""
DETECT = ALIGNED + """, det AS (SELECT code, sum(CASE WHEN n_gold > 0 AND n_pred > 0 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN n_gold > 0 THEN 1 ELSE 0 END) AS ng, sum(CASE WHEN n_pred > 0 THEN 1 ELSE 0 END) AS np FROM per GROUP BY code),
pr AS (SELECT *, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS p, CASE WHEN ng = 0 THEN 0 ELSE tp / ng END AS r FROM det)
"""
F1 = "CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END"


def seed_sql(seed: int) -> str:
    return f"md5(doc_id || '-{seed}'), doc_id"
