"""Top-k by shards and waves against brute force, with ties, repeated rows and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintloom.llm import topk


def brute(rows, k=10, modulus=100):
    sound = [(i, tuple(np.floor(1024 * np.array(v, float)).astype(int).tolist())) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    asked = {}
    for i, v in sound:
        if i % modulus == 0:
            asked[i] = min(asked.get(i, v), v)
    want = []
    for q, x in asked.items():
        best = sorted((-int(np.dot(x, y)), i) for i, y in sound if i != q and len(y) == len(x))[:k]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize("shard_cells", [1 << 20, 400, 28])
def test_top_k_is_brute_force(spark, shard_cells):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (304, [1.0, 2.0]), (None, [1.0] * 4), (400, [1.0, 2.0]), (305, []), (500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("shard", F.lit(0)).withColumn("n", F.lit("x"))
    assert sorted(tuple(r) for r in topk.top_k(df, shard_cells=shard_cells).collect()) == brute(rows)
    assert topk.top_k(df.limit(0), shard_cells=shard_cells).count() == 0


def test_repeated_rows_are_candidates_each(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 3) / 4]) for i in range(60)]
    rows += [(7, [1.0, 1.0, 1.0])] * 40 + [(100, [0.5, 0.0, 0.5]), (100, [0.25, 1.0, 0.5]), (7, [0.5, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, shard_cells=60).collect()) == brute(rows)


def test_bounds_are_handed_on(spark, monkeypatch):
    """With the kth scores of earlier waves, later shards give fewer rows than k a query."""
    rng, given = np.random.default_rng(9), []
    rows = [(i, rng.normal(size=6).tolist()) for i in range(3000)]
    put = topk.Scratch.put

    def spy(self, df, name):
        given.append((name, put(self, df, name)))
        return given[-1][1]

    monkeypatch.setattr(topk.Scratch, "put", spy)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_cells=900)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert [n for n, _ in given] == ["queries", "best", "best"]
    first, second = (df.where("rank = 10").orderBy("query_id").collect() for n, df in given[1:])
    assert len(second) == 30 and all(a.score <= b.score for a, b in zip(first, second, strict=True))
