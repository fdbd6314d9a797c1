"""Operator 2: byte-level BPE encoding and decoding of a text column."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lintloom.llm import bpe
from lintloom.llm.common import map_texts, table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def encode(df: DataFrame, file: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per row of ``df``: the id, ``n_tokens``, ``ids`` and the digests of the ids and of the decoded bytes.

    A null text counts as empty: no ids, the digests of no bytes. Repeated rows give repeated rows, an empty table
    none; other columns are not read, so their names don't matter. Texts of any length go through whole.
    """
    file = file or public_tokenizers.path(RANK_FILE)

    def make():
        coder = bpe.load(file)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            columns = {
                id_col: batch.column(0),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(coder.digits(x)).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]),
            }
            if keep_ids:
                columns["ids"] = pa.array([x.astype("int32") for x in ids], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        work.close = coder.reset
        return work

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_texts(df.select(id_col, df[text_col].alias("text")), schema, make)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False)
