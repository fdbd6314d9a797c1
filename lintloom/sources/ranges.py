"""Data sources of lines: a reader that opens only the byte ranges that an offset needs, and a sink of exact shards.

Both go through Arrow's file systems, in the tasks and where a read or write is planned; what Arrow can't open (a mount
table of Hadoop's, say) has to be read by Spark's own readers.
"""

from __future__ import annotations

import io
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import accumulate, chain, islice

import pyarrow as pa
import pyarrow.dataset as arrow_dataset
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lintloom.operators.keys import ranked

#: Bytes of a range, and lines of a batch.
RANGE, BATCH = 64 << 20, 4096
#: Files that a task counts the lines of, and files moved at the same time.
FILES, MOVES = 1000, 16
INDEX = "file string, start long, end long, lines long"


def _files(path: str) -> list[tuple[str, int]]:
    """(name, size) of the files of a folder, or of a file, by name. Names that begin with _ or a dot are left out."""
    files, root = arrow_fs.FileSystem.from_uri(path)
    info = files.get_file_info(root)
    if info.type == arrow_fs.FileType.File:
        return [(root, info.size)]
    found = files.get_file_info(arrow_fs.FileSelector(root, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == arrow_fs.FileType.File and x.size and x.base_name[0] not in "_.")


def count_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, start, end, lines): how many lines begin in each byte range of the files, each read once.

    A task has many ranges if they are small: there are as many tasks as there are cores, or more for many files or bytes.
    """
    # what is dealt are stretches of whole ranges, which the tasks cut
    step = max(1, RANGE // range_bytes) * range_bytes
    stretches = [(name, at, min(size, at + step)) for name, size in _files(path) for at in range(0, size, step)]
    tasks = max(spark.sparkContext.defaultParallelism, len(stretches) // FILES, sum(end - at for _, at, end in stretches) // RANGE)
    rows = spark.createDataFrame(stretches, "file string, start long, end long").repartition(max(1, min(tasks, len(stretches))), "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = arrow_fs.FileSystem.from_uri(path)
        for batch in batches:
            counts = chain.from_iterable(_counts(files, *row, range_bytes) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            while some := list(islice(counts, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some, strict=True)], names=["file", "start", "end", "lines"])

    return rows.mapInArrow(run, INDEX)


def _counts(files: arrow_fs.FileSystem, name: str, start: int, end: int, range_bytes: int) -> Iterator[tuple[str, int, int, int]]:
    """The ranges of a stretch of a file with the lines that begin in each; the file is opened once and read in its order."""
    with files.open_input_file(name) as raw, io.BufferedReader(raw, 1 << 20) as f:
        f.seek(at := max(start, 1) - 1)
        for own in range(start, end, range_bytes):
            # a line begins after a line end, or where the file does
            n, stop = int(own == 0), min(end, own + range_bytes)
            while at < stop - 1:
                part = f.read(min(1 << 20, stop - 1 - at))
                n, at = n + part.count(b"\n"), at + len(part)
            yield name, own, stop, n


def index_lines(spark: SparkSession, path: str, index: str, range_bytes: int = RANGE) -> None:
    """Writes the counts of ``count_lines`` as a table that ``LinesAt`` reads."""
    count_lines(spark, path, range_bytes).write.parquet(index)


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int
    #: The number of the first line, from 0; lines to skip and to take of those that begin in the range.
    first: int
    skip: int
    take: int


class _LinesAtReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.index = options["path"], options["index"]
        self.offset, self.count = int(options.get("offset", 0)), int(options.get("count", 1 << 62))
        if self.offset < 0 or self.count < 0:
            raise ValueError("an offset and a count must not be negative")

    def partitions(self) -> list[_Range]:
        """The ranges in which lines from the offset on begin, as far as the count goes; others aren't opened."""
        files, root = arrow_fs.FileSystem.from_uri(self.index)
        rows = sorted(zip(*arrow_dataset.dataset(root, filesystem=files, format="parquet").to_table().select(["file", "start", "end", "lines"]).to_pydict().values(), strict=True))
        ends = list(accumulate(r[3] for r in rows))
        stop, out = self.offset + self.count, []
        for (file, start, end, lines), last in zip(rows[(i := bisect_right(ends, self.offset)) :], ends[i:], strict=True):
            first = last - lines
            if first >= stop:
                break
            skip = max(0, self.offset - first)
            if lines > skip:
                out.append(_Range(file, start, end, first, skip, min(lines, stop - first) - skip))
        return out

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # none was asked for
            return
        files, _ = arrow_fs.FileSystem.from_uri(self.path)
        with files.open_input_file(partition.file) as raw, io.BufferedReader(raw) as f:
            f.seek(max(partition.start, 1) - 1)
            if partition.start:
                f.readline()
            for _ in range(partition.skip):
                f.readline()
            number, left = partition.first + partition.skip, partition.take
            while left:
                some = [f.readline().rstrip(b"\n").decode(errors="replace") for _ in range(min(left, BATCH))]
                yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(some)), pa.int64()), pa.array(some)], names=["line_no", "value"])
                number, left = number + len(some), left - len(some)


class LinesAt(DataSource):
    """``lines_at``: (line_no, value) of the lines of files from ``offset`` on, ``count`` of them at most.

    Options: path, index (see ``index_lines``), offset, count. Lines are numbered from 0 over the files by name.
    """

    @classmethod
    def name(cls) -> str:
        return "lines_at"

    def schema(self) -> str:
        return "line_no long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _LinesAtReader(self.options)


def read_at(spark: SparkSession, path: str, index: str, schema: str, offset: int, count: int | None = None) -> DataFrame:
    """O-13, O-04: the rows of JSON lines from ``offset`` on. Lines that aren't rows of the schema are left out, but count."""
    spark.dataSource.register(LinesAt)
    options = {"path": path, "index": index, "offset": offset} | ({} if count is None else {"count": count})
    lines = spark.read.format("lines_at").options(**options).load()
    read = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("line_no", read.alias("r")).where("r IS NOT NULL AND r._bad IS NULL")
    return rows.select("line_no", "r.*").drop("_bad")


@dataclass
class _Written(WriterCommitMessage):
    #: (number of the first row, rows, file) of each shard.
    shards: list[tuple[int, int, str]]


class _ShardWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"].rstrip("/"), int(options["rows"])
        if self.rows < 1:
            raise ValueError("a shard has one row at least")
        parent, _, name = self.path.rpartition("/")
        self.staging = f"{parent}/.{name}.{uuid.uuid4().hex}"
        self._refuse()

    def _refuse(self) -> None:
        files, root = arrow_fs.FileSystem.from_uri(self.path)
        if files.get_file_info(root).type != arrow_fs.FileType.NotFound:
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator[Row]) -> _Written:
        """The shards of a task, one after the other; a task that is run again writes into another folder."""
        files, root = arrow_fs.FileSystem.from_uri(self.staging)
        own, out, shards = f"{root}/{uuid.uuid4().hex}", None, []
        try:
            for row in iterator:
                first = row["place"] - row["place"] % self.rows
                if not shards or shards[-1][0] != first:
                    if out is not None:
                        out.close()
                    if not shards:
                        files.create_dir(own, recursive=True)
                    name = f"{own}/from_{first:015d}.jsonl"
                    out = files.open_output_stream(name)
                    shards.append((first, 0, name))
                if row["place"] != first + shards[-1][1]:
                    raise ValueError(f"row {row['place']} isn't in its place")
                out.write(f"{row['value']}\n".encode())
                shards[-1] = (first, shards[-1][1] + 1, shards[-1][2])
        finally:
            if out is not None:
                out.close()
        return _Written(shards)

    def commit(self, messages: list[_Written | None]) -> None:
        """All shards are seen at once, if each but the last one is whole and none is missing; else none is."""
        shards = sorted(s for m in messages if m is not None for s in m.shards)
        sizes = [n for _, n, _ in shards]
        if [first for first, *_ in shards] != [i * self.rows for i in range(len(shards))] or any(n != self.rows for n in sizes[:-1]):
            self.abort(messages)
            raise ValueError("the shards aren't whole")
        self._refuse()
        files, root = arrow_fs.FileSystem.from_uri(self.staging)
        _, target = arrow_fs.FileSystem.from_uri(self.path)
        files.create_dir(f"{root}/whole", recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda s: files.move(s[2], f"{root}/whole/{s[2].rpartition('/')[2]}"), shards))
        files.move(f"{root}/whole", target)
        files.delete_dir(root)

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = arrow_fs.FileSystem.from_uri(self.staging)
        if files.get_file_info(root).type != arrow_fs.FileType.NotFound:
            files.delete_dir(root)


class ExactShards(DataSource):
    """``exact_shards``: a sink of (place, value), numbered from 0 and sorted in each task, for files of ``rows`` lines."""

    @classmethod
    def name(cls) -> str:
        return "exact_shards"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ShardWriter(self.options)


def write_exact_shards(df: DataFrame, path: str, rows: int, order: list[Column]) -> None:
    """O-24: JSON lines in files of exactly ``rows`` rows in order, the last one of the rest, named by their first row.

    The files are seen when all of them are whole, and where ``path`` is there already nothing is written. ``order`` is
    a total order of the rows; an empty table leaves an empty folder.
    """
    df.sparkSession.dataSource.register(ExactShards)
    packed = df.select(F.lit(0).alias("_all"), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("_order"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    placed = ranked(packed, "_all", [F.col("_order"), F.col("value")], "_rank").select((F.col("_rank") - 1).cast("long").alias("place"), "value")
    dealt = placed.repartition(F.floor(F.col("place") / rows)).sortWithinPartitions("place")
    dealt.write.format("exact_shards").option("path", path).option("rows", rows).mode("append").save()
