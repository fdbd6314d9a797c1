"""Shared helpers of the training-data operators: tables, filters of ids, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a Python worker turns into objects at a time.
SLICE_ROWS = 256
#: Bytes of text of one slice, unless a single text is longer.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash01(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the given columns only."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / F.lit(float(1 << 53))


#: Bits of a filter of ids: 4 MB at most, however many ids there are.
FILTER_BITS = 1 << 24


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` with underscores before each name until no column of ``df`` is called that, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def flag_ids(df: DataFrame, ids: DataFrame, flag: str = "flagged") -> DataFrame:
    """``df`` with a column ``flag`` that is false only where doc_id isn't among the doc_ids of ``ids``.

    The ids are hashed into a bitmap of FILTER_BITS, which is sent to all executors: its size is bounded by
    FILTER_BITS / 64 rows. True needs confirming by a join; with many more ids than bits most rows are flagged and
    the join does all the work. It keeps rows with texts from being shuffled for a join with few ids. Columns of
    ``df`` keep their names and values, but none may be called ``flag``: ``free_names`` finds a name for it.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    word, bit = F.floor(place / 64).cast("int"), F.pmod(place, F.lit(64)).cast("int")
    w, b, bits = free_names(df, "word", "bit", "bits")
    some = ids.select(word.alias("at"), F.expr("1L").alias("one"), bit.alias("place"))
    words = some.groupBy(F.col("at").alias(w)).agg(F.bit_or(F.expr("shiftleft(one, place)")).alias(bits))
    marked = df.withColumns({w: word, b: bit}).join(F.broadcast(words), w, "left")
    hit = F.coalesce(F.expr(f"shiftright({bits}, {b}) & 1L") == 1, F.lit(False)) & F.col("doc_id").isNotNull()
    return marked.select(*(named(c) for c in df.columns), hit.alias(flag))


def crc_rest(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts stay within SLICE_BYTES, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        per_row = max(1, column.nbytes // max(1, len(column)))
        step = max(1, min(SLICE_ROWS, SLICE_BYTES // per_row))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def release() -> None:
    """Gives memory that a finished task has freed back to the system; workers live on and share an executor's limit."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over slices. ``make`` runs once a task and returns what maps one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for part in slices(batches):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out
        finally:
            getattr(work, "close", lambda: None)()
            del work
            release()

    return df.mapInArrow(run, schema)


def batch_of(**columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns.values()], names=list(columns))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, bound: int) -> DataFrame:
    """(text, label) of documents for fitting: ``bound`` rows of each label at most, whatever repeats.

    Ids whose crc32 modulo ``modulus`` is ``rest`` are held out. The ids of a label that are taken are those with the
    least hash, so the sample is the same in every run; they are bounded by ``bound`` a label and are sent to all
    executors. Conflicting labels of an id count as 1. Of rows that repeat an id, one is taken, that of the least text
    hash; rows with a null id or text aren't.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_rest(F.col("doc_id"), modulus) != rest))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    least = lambda value: known.where(F.col("label") == value).orderBy(hash01(F.col("doc_id")), "doc_id").limit(bound)
    some = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(least(0).union(least(1))), "doc_id")
    return some.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label")).select("text", "label")


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of ``df`` whose text passes; all columns stay as they are, whatever their names."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        try:
            for part in slices(batches, f"c{at}"):
                yield part.filter(pa.array(test(part.column(at).to_pylist()), pa.bool_()))
        finally:
            release()

    # plain names on the way, as some names can't be looked up by Spark's Arrow functions
    plain = df.select(*(named(c).alias(f"c{i}") for i, c in enumerate(df.columns)))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
