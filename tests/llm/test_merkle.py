"""The Merkle manifest against a tree that is built plainly, with nulls, ties, repeated rows, lone leaves and empty tables."""

import hashlib
import string
import zlib

import pytest
from pyspark.sql import functions as F

from lintloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """The root, and for each leaf the pairs (digests on the left, on the right), from the leaf up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a - a % 16 : a - a % 16 + 16]
            paths[i].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
            at[i] = a // 16
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    subtrees = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subtrees[s] = own, *tree([leaf(r) for r in own])
    root, above = tree([subtrees[s][1] for s in order])
    out = []
    for s, more in zip(order, above, strict=True):
        own, subroot, paths = subtrees[s]
        for r, path in zip(own, paths, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h = leaf((*r[:4], r[4].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))) if changed else leaf(r)
            for left, right in path + more:
                h = sha(left, h, right)
            out.append((r[0], leaf(r), subroot, root, sha(*(x for pair in path + more for x in pair)), h, h == root))
    return sorted(out, key=str)


def run(df):
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(df, F.when(chosen, merkle.lowered(F.col("text"))))


def rows_of(n, source):
    return [(i, source, "en", i % 7, f"Text {i} ÄÖ" if i % 3 else "lower") for i in range(n)]


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1], [300, 1, 16, 33], [2] * 20])
def test_sizes(spark, sizes):
    rows = [r for k, n in enumerate(sizes) for r in rows_of(n, f"s{k}")]
    got = run(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = rows_of(40, "a") + rows_of(20, None) + rows_of(5, "") + rows_of(18, "-") + rows_of(3, "é") + rows_of(2, "\U0001f600") + rows_of(2, "￮")
    rows += [(7, "a", None, None, None)] * 30 + [(None, "a", "x", 1, "Y")] * 3 + [(None, None, None, None, None), (5, "a", "en", 5, ""), (5, "a", "en", 5, "ABC"), (10, "z", "en", 1, "A b " * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.select("*", *(F.lit("x").alias(c) for c in ("g", "h", "idx", "n", "p", "kids", "proof", "root", "other", "part", "leaf")))
    for x in (df, clashing.repartition(7)):
        got = run(x).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert run(clashing.limit(0)).collect() == []
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_a_hot_row_is_many_ranges(spark):
    rows = [(1, "a", "en", 1, "Same")] * 3000 + rows_of(50, "b")
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in run(df).collect()), key=str) == brute(rows)
