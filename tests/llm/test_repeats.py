"""Repeated passages against plain comparison of all windows, with small chunks, shifts, overlaps and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintloom.llm import repeats

SCHEMA = "doc_id long, text string"


def brute(rows):
    def order(r):
        mark = r[2]
        return (r[0] is None, r[0] or 0, mark)

    seen, split = {}, {}
    for r in rows:
        split[order(r)] = re.findall("[^\x20\x09-\x0d]+", r[1] or "")
    for key in sorted(split):
        w = split[key]
        for i in range(len(w) - 19):
            seen.setdefault(tuple(w[i : i + 20]), (key, i))
    out = []
    for r in rows:
        w, gone = split[order(r)], set()
        for i in range(len(w) - 19):
            if seen[tuple(w[i : i + 20])] < (order(r), i):
                gone |= set(range(i, i + 20))
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def check(df, **given):
    rows = [tuple(r) for r in df.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0))).collect()]
    want = brute(rows)
    assert sorted((tuple(r) for r in repeats.remove_repeats(df, **given).collect()), key=str) == want
    return want


def corpus(seed, n):
    """Documents made of passages that are cut, shifted and repeated, also within a document."""
    rng = random.Random(seed)
    fresh = lambda k: [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(k)]
    pool = [fresh(rng.choice((19, 20, 21, 35, 60))) for _ in range(12)] + [["same"] * 30, ["x", "y"] * 20]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(pool)
            a = rng.randrange(4)
            w += fresh(rng.randrange(25)) + p[a : len(p) - rng.randrange(3)]
        out.append((rng.randrange(10 * n), "".join(x + rng.choice([" ", "\n", "\t ", "\x0b"]) for x in w)))
    return out + [(i, t) for i, t in zip(rng.sample(range(10 * n), n // 5), rng.choices([t for _, t in out], k=n // 5), strict=True)]


@pytest.mark.parametrize(("seed", "chunk", "parts"), [(1, 1 << 16, 4), (2, 1, 1), (3, 1000, 1), (4, 1, 600)])
def test_same_as_comparing_all_windows(spark, seed, chunk, parts):
    want = check(spark.createDataFrame(corpus(seed, 150), SCHEMA).repartition(3), chunk=chunk, parts=parts)
    assert sum(r[2] for r in want) > 500


def test_odd_rows(spark):
    rng = random.Random(5)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(120_000))
    part = " ".join(long.split()[70_003:70_063])
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 19), (5, "a " * 20), (6, "a " * 21), (7, long), (8, "z " + part), (7, "b " + part + " c"), (None, part), (None, "q " + part), (9, part.upper()), (10, part), (10, part)]
    rows += [(11, part.replace(" ", " ")), (12, "é " + part)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = check(df)
    clashing = df.select("*", *(F.lit("x").alias(c) for c in ("id", "mark", "key", "flagged", "part", "found", "hits", "own_id", "word", "bit", "bits")))
    got = sorted((tuple(r) for r in repeats.remove_repeats(clashing).collect()), key=str)
    assert got == want and repeats.remove_repeats(clashing.limit(0)).count() == 0


def test_many_copies_and_repeated_rows(spark):
    rng = random.Random(6)
    text = " ".join(str(rng.randrange(500)) for _ in range(200))
    rows = [(i, text) for i in range(300)] + [(7, text)] * 300 + [(1000 + i, text[i:]) for i in range(100)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_rolling_and_least():
    x = np.arange(100, dtype=np.uint64) * np.uint64(7919)
    for n in (1, 2, 3, 10, 20, 31):
        f = 0x9E3779B97F4A7C15
        want = [sum(int(x[i + k]) * pow(f, n - 1 - k) for k in range(n)) % 2**64 for i in range(101 - n)]
        assert repeats.rolling(x, n, f).tolist() == want
        y = (x * np.uint64(31)) % np.uint64(97)
        assert repeats.least(y, n).tolist() == [min(y[i : i + n]) for i in range(101 - n)]
    assert len(repeats.rolling(x[:5], 6, 3)) == 0
