"""A corpus pipeline of four of the training-data operators: quality, language, near duplicates, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the docs of
the next one. The first three return rows of documents with all their columns, the last one packed pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintloom.llm import language, near_dup, packing, quality
from lintloom.llm.common import filter_texts, flag_ids, free_names, named, table
from lintloom.sources.scratch import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without labels of both kinds to learn from, all.

    A null or empty text is scored by the statistics of an empty one. Repeated rows share their fate; an empty table
    gives no rows; all columns stay as they are, whatever their names.
    """
    model, prior = quality.learn(docs, table(spark, sf_dir, "labels"))

    def make():
        def test(texts: list[str | None]) -> list[bool]:
            if model is None:
                return [True] * len(texts)
            return (model.probability(np.array([quality.statistics(t) for t in texts])) >= quality.THRESHOLD).tolist()

        return test

    return filter_texts(docs, make)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned: those whose n-grams aren't strange to the language decoded for them.

    Null and empty texts and those without any letter are ``und`` and go. Without any language to learn, all texts
    with a letter stay. Repeated rows share their fate; an empty table gives no rows; all columns stay as they are,
    whatever their names.
    """
    codes = language.learn(docs)

    def make():
        def test(texts: list[str | None]) -> list[bool]:
            if codes is None:
                return [bool(t and language.LETTER.search(t)) for t in texts]
            found = [codes.predict(t) for t in texts]
            return [lang != language.UNKNOWN and not strange for lang, _, _, strange in found]

        return test

    return filter_texts(docs, make)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once.

    Documents without an id, and those with a null or empty text, are near to nothing and stay. Of rows that repeat an
    id, one stays: that whose text stood for the id when it was compared, the one with the largest set; ties go to the
    least hash of its text. An empty table gives no rows; all columns stay as they are, whatever their names. Only rows
    whose id may be one that goes or that repeats are shuffled with their texts.
    """
    told = near_dup.near_duplicates(docs).where("doc_id IS NOT NULL")
    doubtful = told.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("stays")).where("n > 1 OR NOT stays")
    doubtful = Scratch(spark).put(doubtful, "doubtful")
    flag, key, many, stays, m, h1, h2 = free_names(docs, "flagged", "key", "many", "stays", "m", "h1", "h2")
    marked = flag_ids(docs, doubtful, flag)
    columns = [named(c) for c in docs.columns]
    sure = marked.where(~F.col(flag)).select(*columns)
    told = doubtful.select(F.col("doc_id").alias(key), (F.col("n") > 1).alias(many), F.col("stays").alias(stays))
    rest = marked.where(flag).join(told, F.col("doc_id") == F.col(key), "left").where(F.coalesce(F.col(stays), F.lit(True)))
    kept = sure.union(rest.where(~F.coalesce(F.col(many), F.lit(False))).select(*columns))
    if not doubtful.where("n > 1").limit(1).count():  # no id repeats
        return kept
    # an aggregate, so that rows of an id that very many rows repeat meet combined
    hashed = [named(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = F.struct(m, h1, h2, F.xxhash64("text"), F.length("text"), F.xxhash64(*hashed))
    first = F.min_by(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), order)
    repeated = near_dup.with_standing(rest.where(many).select(*columns), m, h1, h2)
    least = repeated.groupBy("doc_id").agg(first.alias("row")).select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
    return kept.union(least)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_dup", keep_distinct), ("packing", pack)]

#: SQL can express none of the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next one's is written; what is left, with the driver."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs
