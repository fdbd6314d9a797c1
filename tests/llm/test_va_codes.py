"""Codebooks and codes against plain search, with odd vectors, ties, repeated rows, hot labels and empty tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintloom.llm import va_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts, entries, rounds, scale=4096):
    sound = [(i, [int(np.floor(x * scale)) for x in v], y) for i, v, y in rows if v and None not in v and np.isfinite(v).all()]
    known = sorted((i, v) for i, v, _ in sound if i is not None and len(v) % parts == 0)
    length = len(known[0][1]) if known else 0
    good = [r for r in sound if len(r[1]) == length]
    width = length // parts
    firsts = {}
    for i, v in sorted((i, v) for i, v, _ in good if i is not None):
        firsts.setdefault(i, v)
    start = [firsts[i] for i in sorted(firsts)[:entries]]
    books = [[v[p * width : (p + 1) * width] for v in start] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, v, _ in good:
                x = v[p * width : (p + 1) * width]
                got.setdefault(nearest(p, x)[1], []).append(x)
            for k, xs in got.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, y in sound:
        if len(v) != length:
            out.append((i, None, None, y))
            continue
        found = [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
    totals = {}
    for *_, error, y in out:
        if error is not None:
            totals[y] = totals.get(y, 0) + error
    return sorted(((i, c, e, totals.get(y), digest) for i, c, e, y in out), key=str)


def run(df, **given):
    return sorted((tuple(r) for r in va_codes.compress(df, **given).collect()), key=str)


@pytest.mark.parametrize(("entries", "grid"), [(16, 0), (16, 2), (3, 1), (40, 3)])
def test_codes_are_those_of_plain_search(spark, entries, grid):
    rng = np.random.default_rng(entries + grid)
    vectors = rng.integers(-grid, grid + 1, (150, 8)) / 4 if grid else rng.normal(size=(150, 8))
    rows = [(i * 3 % 151, v.tolist(), [None, 1, 2, i][i % 4]) for i, v in enumerate(vectors)]
    assert run(spark.createDataFrame(rows, SCHEMA), parts=4, entries=entries, rounds=3) == brute(rows, 4, entries, 3)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), 1) for i in range(30)] + [(5, [0.5] * 8, None)] * 20 + [(3, [0.25] * 8, 2), (None, [1.0] * 8, 2), (None, [2.0] * 8, None)]
    rows += [(50, None, 1), (51, [], 1), (52, [None] * 8, 1), (53, [float("nan")] * 8, 1), (54, [float("-inf")] + [0.0] * 7, 1), (55, [1.0] * 4, 3), (56, [1.0] * 5, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 4, 16, 2)
    clashing = df.select("*", *(F.lit("x").alias(c) for c in ("v", "fits", "code", "error", "k", "size", "hot", "is_hot", "part", "n")))
    assert run(df, parts=4, rounds=2) == want == run(clashing.repartition(5), parts=4, rounds=2)
    assert run(clashing.limit(0)) == []
    lone = run(spark.createDataFrame([(None, [1.0] * 8, 1), (7, [1e30] * 8, 1)], SCHEMA))
    assert [r[:4] for r in lone] == [(7, None, None, None), (None, None, None, None)]


def test_bounds_hold_and_leave_few():
    rng = np.random.default_rng(4)
    book, parts = rng.integers(-4000, 4000, (16, 8)), rng.integers(-5000, 5000, (400, 8))
    file = va_codes.VaFile(book)
    least, most = file.bounds(parts)
    exact = ((parts[:, None] - book) ** 2).sum(axis=2)
    assert (least <= exact).all() and (exact <= most).all()
    assert (least <= most.min(axis=1, keepdims=True)).sum(axis=1).mean() < 8
    entry, distance = file.nearest(parts)
    assert (entry == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_totals_of_hot_and_rare_keys(spark):
    rows = [(i, (i % 3000 if i % 2 else 7) if i % 5 else None, i) for i in range(9000)]
    got = va_codes.with_totals(spark.createDataFrame(rows, "id long, key int, value long"), "key", "value", "total", share=10).collect()
    totals = {}
    for _, k, v in rows:
        totals[k] = totals.get(k, 0) + v
    assert sorted((r.id, r.total) for r in got) == [(i, totals[k]) for i, k, _ in rows]
