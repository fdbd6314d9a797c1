"""Operator 11: vectors as short codes, by codebooks of integer means that are searched through a VA-file.

A vector is cut into parts, and each part position has a codebook. In every round the vectors stay where they are: a
task assigns the parts of its vectors and gives the count and the sum of each entry's parts, and what comes to the
driver is the codebooks, of a size that doesn't depend on the data.

The nearest entry is found as in a VA-file: each coordinate of an entry is quantised into one of 2 ** BITS cells of its
dimension. For a part, a table of the least and the greatest squared distance to each cell of each dimension gives
bounds on its distance to every entry; entries whose lower bound is above the least upper bound are out, and where more
than one is left their integer distances decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintloom.llm.common import release, table
from lintloom.sources.scratch import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bits of an entry's coordinate in the VA-file.
BITS = 3
#: Integer components beyond this, and longer vectors, have no code: squared distances must fit 64 bits.
LARGEST, LONGEST = 1 << 24, 1 << 13
#: Numbers of one table at a time.
CELLS = 1 << 20


class VaFile:
    """The entries of one codebook, (entries, width) integers."""

    def __init__(self, book: np.ndarray, bits: int = BITS):
        self.book = book
        low, high = book.min(axis=0), book.max(axis=0)
        cells = 1 << bits
        step = np.maximum(1, -(-(high - low + 1) // cells))
        #: The cell of each entry's coordinate, and the least and greatest coordinate in each cell.
        self.cell = (book - low) // step
        self.low, self.high = (np.zeros((book.shape[1], cells), np.int64) for _ in range(2))
        for d in range(book.shape[1]):
            for c in np.unique(self.cell[:, d]):
                inside = book[self.cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = inside.min(), inside.max()

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part and entry, what the squared distance is at least and at most."""
        least, most = (np.zeros((len(parts), len(self.book)), np.int64) for _ in range(2))
        for d in range(parts.shape[1]):
            below, above = self.low[d] - parts[:, d, None], parts[:, d, None] - self.high[d]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            least += (near * near)[:, self.cell[:, d]]
            most += (far * far)[:, self.cell[:, d]]
        return least, most

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, ties to the lower index, and the squared distance to it."""
        least, most = self.bounds(parts)
        part, entry = np.nonzero(least <= most.min(axis=1, keepdims=True))
        gap = parts[part] - self.book[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        starts = np.searchsorted(part, np.arange(len(parts)))
        best = np.minimum.reduceat(distance, starts)
        # the first of a part's candidates at its least distance: entries ascend
        hits = np.flatnonzero(distance == best[part])
        return entry[hits[np.searchsorted(part[hits], np.arange(len(parts)))]], best


def _matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, vectors) of a batch, a bounded number of components at a time. Vectors are its last column."""
    column = batch.column(batch.num_columns - 1)
    step = max(1, CELLS // width)
    for at in range(0, len(column), step):
        some = column.slice(at, step)
        yield at, some.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(some), width)


def _sums(books: np.ndarray):
    """Count and sums of the parts that go to each entry, once a task: (part, entry, n, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        files = [VaFile(b) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, rows in _matrices(batch, parts * width):
                for p, file in enumerate(files):
                    own = rows[:, p * width : (p + 1) * width]
                    entry, _ = file.nearest(own)
                    n[p] += np.bincount(entry, minlength=entries)
                    np.add.at(total[p], entry, own)
        at = np.argwhere(n > 0)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(n[n > 0]), pa.array(list(total[n > 0]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
        release()

    return run


def _codes(books: np.ndarray, schema: pa.Schema):
    """The columns before the vector, its code and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        files = [VaFile(b) for b in books]
        for batch in batches:
            for at, rows in _matrices(batch, parts * width):
                found = [f.nearest(rows[:, p * width : (p + 1) * width]) for p, f in enumerate(files)]
                entries = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
                raw = entries.tobytes().hex()
                codes = [raw[i : i + 2 * parts] for i in range(0, len(raw), 2 * parts)]
                kept = [c.slice(at, len(rows)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.string()), pa.array(sum(d for _, d in found))], schema=schema)
        release()

    return run


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(parts, entries, width): the parts of the vectors of the smallest ids, each id once with its least vector."""
    least = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    if not least:
        return None
    vectors = np.array([r["v"] for r in least], np.int64)
    return vectors.reshape(len(vectors), parts, -1).swapaxes(0, 1).copy()


def refined(books: np.ndarray, rows: DataFrame) -> np.ndarray:
    """The codebooks after a round: each entry the mean of its parts, rounded down; one without parts stays."""
    width = books.shape[2]
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    found = rows.select("v").mapInArrow(_sums(books), "part long, entry long, n long, sums array<long>")
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # parts * entries rows at most
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each sound vector.

    Components become floor(scale * x). Rows whose vector is null or empty, or holds null or non-finite components, are
    dropped. Codebooks begin with the vectors of the ``entries`` smallest ids; an id that repeats counts once there,
    with its least vector, and rows without an id aren't taken. ``error`` is the squared distance to the entries,
    ``label_error`` its sum over the rows of a label, null being one. Rows that repeat are coded each. Where a vector
    isn't as long as that of the smallest id, doesn't divide into ``parts``, is longer than LONGEST, or has integer
    components beyond LARGEST, it takes no part and its row has null code and error; so have all rows where no row has an id. Columns besides
    vec_id, embedding and label aren't read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("v"))
    fits = (F.size("v") % parts == 0) & (F.size("v") <= LONGEST) & F.forall("v", lambda e: (e <= LARGEST) & (e >= -LARGEST))
    rows = scratch.put(rows.withColumn("fits", fits), "vectors")
    first = rows.where("fits AND vec_id IS NOT NULL").agg(F.min_by(F.size("v"), F.struct("vec_id", "v"))).first()[0]
    good = F.col("fits") & (F.size("v") == (first or 0))
    coded = rows.where(good).select("vec_id", "label", "v")
    kept = [f for f in rows.schema.fields if f.name in ("vec_id", "label")]
    schema = f"vec_id long, label {kept[1].dataType.simpleString()}, code string, error long"
    left = rows.where(~good).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    books = first_books(coded, parts, entries)
    text = ""
    if books is not None:
        for _ in range(rounds):
            books = refined(books, coded)
        text = ",".join(map(str, books.ravel().tolist()))
        arrow = pa.schema([("vec_id", pa.int64()), ("label", _arrow_type(kept[1].dataType)), ("code", pa.string()), ("error", pa.int64())])
        left = coded.mapInArrow(_codes(books, arrow), schema).union(left)
    out = with_totals(scratch.put(left, "codes"), "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def with_totals(rows: DataFrame, key: str, value: str, name: str, share: int = 1000) -> DataFrame:
    """``rows`` with the sum of ``value`` over those of the same ``key``, null being one.

    Keys that hold one of ``share`` rows or more are ``share`` at most, whatever the rows are: their sums are sent to
    all tasks, and the rows stay where they are. The rows of other keys meet their sums in a join that no key can skew.
    """
    totals = rows.groupBy(F.col(key).alias("k")).agg(F.sum(value).alias(name), F.count("*").alias("size"))
    n = rows.count()
    hot = totals.where((F.col("size") * share >= n) | F.col("k").isNull())
    marked = rows.join(F.broadcast(hot.select(F.col("k").alias("hot"), F.col(name).alias("hot_total"), F.lit(True).alias("is_hot"))), F.col(key).eqNullSafe(F.col("hot")), "left")
    columns = [F.col(c) for c in rows.columns]
    near = marked.where("is_hot").select(*columns, F.col("hot_total").alias(name))
    rest = marked.where("is_hot IS NULL").select(*columns).join(totals.where(F.col("size") * share < n).select("k", name), F.col(key) == F.col("k"))
    return near.union(rest.select(*columns, name))


def op11_va_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out. Sums are of 128 bits; a quotient is rounded down."""
    parts = [f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, v FROM v),
q AS (SELECT row, vec_id, label, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM p, range({PARTS}) r(part)),
b0 AS (SELECT part, rank - 1 AS entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM q) WHERE rank <= {ENTRIES})"""]

    def assign(k: int) -> None:
        distance = "CAST(list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        parts.append(f"""
a{k} AS MATERIALIZED (SELECT row, part, min(d * 256 + entry) % 256 AS entry, min(d * 256 + entry) // 256 AS d, any_value(x) AS x
  FROM (SELECT q.row, q.part, q.x, b.entry, {distance} AS d FROM q JOIN b{k} b ON b.part = q.part) GROUP BY row, part)""")

    for k in range(ROUNDS):
        assign(k)
        parts.append(f"""
m{k} AS (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS c FROM a{k}, range(1, len(x) + 1) r(i) GROUP BY part, entry, i),
n{k} AS (SELECT part, entry, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS x FROM m{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN n{k} n ON n.part = b.part AND n.entry = b.entry)""")
    assign(ROUNDS)
    parts.append(f"""
c AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256
FROM c JOIN p USING (row)""")
    return "WITH " + ",".join(parts)


ORACLE = _sql()
