"""Sinks: JSON lines, rotating shards, CSV. Nothing is overwritten and no input is deleted."""

from __future__ import annotations

import json
import textwrap
import uuid
from collections.abc import Iterator

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> int:
    """O-22: returns the characters written, line ends included."""
    size = df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns))) + 1), F.lit(0))).first()[0]
    df.write.json(path)
    return size


def write_shards(df: DataFrame, path: str, rows: int) -> None:
    """O-24: files of at most so many rows."""
    df.write.option("maxRecordsPerFile", rows).mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """O-28."""
    df.write.option("header", True).mode("errorifexists").csv(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """O-27: appends the rows whose key isn't written yet."""
    spark = df.sparkSession
    try:
        old = spark.read.schema(df.schema).parquet(path).select(key).distinct()
    except Exception as e:  # nothing is written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.parquet(path)
        return
    df.join(old, key, "left_anti").write.mode("append").parquet(path)


def write_files(df: DataFrame, path: str, name: str, content: str) -> None:
    """O-29: one file for each row, called by ``name``, of its text and a line end, or of its bytes as they are.

    The tasks write them; a file gets its name when it is whole, so a task that is run again does no harm. Of rows of
    one name one stays. Rows with a null name or content are left out. A name that isn't one of a file in the folder
    itself (with a separator, or a dot or two alone) is an error.
    """

    def run(rows: Iterator[Row]) -> None:
        files, root = arrow_fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        for row in rows:
            if row["n"] in ("", ".", "..") or any(c in row["n"] for c in "/\\\0"):
                raise ValueError(f"{row['n']!r} is no name of a file")
            part = f"{root}/.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write(bytes(row["c"]) if isinstance(row["c"], bytes | bytearray) else f"{row['c']}\n".encode())
            files.move(part, f"{root}/{row['n']}")

    df.select(df[name].alias("n"), df[content].alias("c")).where("n IS NOT NULL AND c IS NOT NULL").foreachPartition(run)


def write_json_array(df: DataFrame, path: str) -> int:
    """O-23: one file with all rows as an indented array, row by row through the driver; returns their number.

    For small results that people read. Tables are written by ``write_jsonl``. A file that is there already is an error.
    """
    files, at = arrow_fs.FileSystem.from_uri(path)
    if files.get_file_info(at).type != arrow_fs.FileType.NotFound:
        raise FileExistsError(path)
    n = 0
    with files.open_output_stream(at) as out:
        out.write(b"[")
        for row in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            text = json.dumps(json.loads(row["j"]), indent=4, ensure_ascii=False)
            out.write(((",\n" if n else "\n") + textwrap.indent(text, "    ")).encode())
            n += 1
        out.write(b"\n]\n")
    return n
