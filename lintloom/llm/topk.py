"""Operator 7: top-k inner products, exact, by KD-trees, one per shard.

Vectors are dealt into shards of a bounded number of components. A shard's tree is made once, by median splits of the widest dimension,
with tight bounding boxes; the queries then stream past it. A query goes through the tree best first: the bound of a
box is the largest inner product any vector in it could have, and the walk ends when the best bound left is below the
kth score. That kth score is handed on: shards are searched in a few waves, and every query starts a wave with the kth
score that it reached over all shards of the waves before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintloom.llm.common import release, table
from lintloom.sources.scratch import Scratch

#: Components of a shard's vectors, on average (16384 vectors of 64), and vectors of a leaf.
SHARD_CELLS, LEAF = 1 << 20, 256
#: The share of shards that is done after each wave: early ones are small, as their queries have lower bounds.
WAVES = (1 / 16, 1 / 4, 1)
NONE = -(2**63)


def exact(a: np.ndarray, b: np.ndarray) -> type:
    """float64 where all inner products of rows of a and b are exact in it, else int64."""
    top = (float(np.abs(a).max(initial=0)) or 1) * (float(np.abs(b).max(initial=0)) or 1) * max(1, a.shape[1])
    return np.float64 if top < 2**52 else np.int64


class KdTree:
    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.low, self.high, self.kids, self.rows = [], [], [], []
        self._build(vectors, 0, len(vectors), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, vectors: np.ndarray, start: int, end: int, leaf: int) -> None:
        todo = [(start, end, -1)]
        while todo:
            start, end, parent = todo.pop()
            own = vectors[self.order[start:end]]
            low, high = own.min(axis=0), own.max(axis=0)
            node = len(self.rows)
            self.low.append(low)
            self.high.append(high)
            self.rows.append((start, end))
            self.kids.append(())
            if parent >= 0:
                self.kids[parent] += (node,)
            if end - start > leaf and low.size and (high > low).any():
                half = (end - start) // 2
                by = own[:, int((high - low).argmax())]
                self.order[start:end] = self.order[start:end][np.argpartition(by, half)]
                todo += [(start + half, end, node), (start, start + half, node)]

    def search(self, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, ids, scores) of each query's k best of at least its bound, ties to the smaller id."""
        kind = exact(vectors, queries)
        data, box_low, box_high = vectors[self.order].astype(kind), self.low.astype(kind), self.high.astype(kind)
        place = ids[self.order]
        for at in range(0, len(queries), 256):
            some = queries[at : at + 256].astype(kind)
            limit = np.maximum(some, 0) @ box_high.T + np.minimum(some, 0) @ box_low.T
            for i, q in enumerate(some):
                kth, best, who = bounds[at + i], np.empty(0, np.int64), np.empty(0, np.int64)
                heap = [(-limit[i, 0], 0)]
                while heap:
                    top, node = heapq.heappop(heap)
                    if -top < kth:
                        break
                    for kid in self.kids[node]:
                        if limit[i, kid] >= kth:
                            heapq.heappush(heap, (-limit[i, kid], kid))
                    if self.kids[node]:
                        continue
                    start, end = self.rows[node]
                    scores = (data[start:end] @ q).astype(np.int64)
                    fit = (scores >= kth) & (place[start:end] != own[at + i])
                    if fit.any():
                        best, who = np.concatenate([best, scores[fit]]), np.concatenate([who, place[start:end][fit]])
                        if len(best) > k:
                            keep = np.lexsort((who, -best))[:k]
                            best, who = best[keep], who[keep]
                        if len(best) == k:
                            kth = max(kth, int(best.min()))
                if len(best):
                    yield at + i, who, best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


#: Rows of a task, sorted: of each shard its vectors (kind 0), then the queries (kind 1).
_STREAM = ["dim", "shard", "kind", "vec_id", "n", "v"]


def _search(k: int):
    """Builds the tree of each shard and searches it for the queries that follow. ``n``: copies of a vector, bound of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tree, vectors, ids = None, [], None, None, None
        try:
            for batch in batches:
                dim, shard, kind, vec_id, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(dim)], strict=True):
                    if a == b:
                        continue
                    if (dim[a], shard[a]) != key:
                        key, parts, tree = (dim[a], shard[a]), [], None
                    rows = _matrix(batch.column(5).slice(a, b - a), int(dim[a]))
                    if kind[a] == 0:
                        parts.append((rows, vec_id[a:b], n[a:b]))
                        continue
                    if not parts and tree is None:  # no vector of this length is in the shard
                        continue
                    if tree is None:
                        # a vector is k of its copies at most: more can't be among the k best
                        copies = np.minimum(np.concatenate([c for *_, c in parts]), k)
                        vectors, ids = np.repeat(np.concatenate([v for v, *_ in parts]), copies, axis=0), np.repeat(np.concatenate([i for _, i, _ in parts]), copies)
                        tree, parts = KdTree(vectors), []
                    found = list(tree.search(vectors, ids, rows, vec_id[a:b], n[a:b], k))
                    if found:
                        own = np.repeat(vec_id[a:b][[i for i, *_ in found]], [len(w) for _, w, _ in found])
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([w for _, w, _ in found])), pa.array(np.concatenate([s for *_, s in found]))], names=["query_id", "vec_id", "score"])
        finally:
            release()

    return run


def top_k(vectors: DataFrame, k: int = 10, modulus: int = 100, scale: int = 1024, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to the smaller vec_id.

    Queries are the vectors whose vec_id is divisible by ``modulus``; candidates are all vectors but those with the
    query's own id. Components become floor(scale * x). Vectors that are null, have a null id, or hold null or
    non-finite components, or none at all, take no part; vectors of other lengths are no candidates of a query. Rows that repeat an id
    are candidates each; as a query an id counts once, with its least vector. Columns besides vec_id and embedding
    aren't read. An empty table, or one without queries, gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf")))
    rows = vectors.where(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"),
    )
    cells = rows.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    repeated = vectors.groupBy("vec_id").agg(F.count("*").alias("n")).where("vec_id IS NOT NULL AND n > 1").limit(1).count()
    # equal rows are one with a number of copies, so that the copies of a hot row don't fill a shard
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("n")) if repeated else rows.withColumn("n", F.lit(1).cast("long"))
    rows = rows.where(F.size("v") > 0)
    shards = max(1, -(-cells // shard_cells))
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    queries = scratch.put(rows.where(F.col("vec_id") % modulus == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    best, done, schema = None, 0, "query_id long, vec_id long, score long"
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    for end in sorted({max(1, round(shards * w)) for w in WAVES}):
        bounds = queries.withColumn("n", F.lit(NONE).cast("long"))
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
            bounds = queries.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("kth", F.lit(NONE)).alias("n"))
        some = rows.withColumn("shard", shard).where((F.col("shard") >= done) & (F.col("shard") < end)).withColumn("kind", F.lit(0))
        asked = bounds.withColumn("shard", F.explode(F.sequence(F.lit(done), F.lit(end - 1)))).withColumn("kind", F.lit(1))
        both = some.select("vec_id", "n", "v", "shard", "kind").union(asked.select("vec_id", "n", "v", "shard", "kind")).withColumn("dim", F.size("v"))
        streams = both.select(*_STREAM).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
        found = streams.mapInArrow(_search(k), schema)
        if best is not None:
            found = found.union(best.select("query_id", "vec_id", "score"))
        ranked = found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if end == shards:
            return ranked
        best, done = scratch.put(ranked, "best"), end


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
) WHERE rank <= 10
"""
