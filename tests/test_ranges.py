"""Lines from an offset and exact shards: what is opened, what is seen, and what a failed write leaves."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lintloom.sources import ranges

SCHEMA = "a long, b string"


def lines_of(folder, files):
    os.makedirs(folder)
    for name, text in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(text.encode())


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_lines_from_an_offset(spark, tmp_path, size):
    """Ranges cut anywhere, lines longer than a range, files with and without a last line end."""
    rng = random.Random(size)
    rows = [json.dumps({"a": i, "b": "é" * rng.randrange(20)}, ensure_ascii=False) for i in range(25)]
    files = {"a.jsonl": "\n".join(rows[:11]) + "\n", "b.jsonl": "\n".join(rows[11:12]), "c.jsonl": "\n".join(rows[12:]), "_hidden": "x\n", "d.jsonl": ""}
    path, index = str(tmp_path / "in"), str(tmp_path / f"index{size}")
    lines_of(path, files)
    ranges.index_lines(spark, path, index, size)
    assert spark.read.parquet(index).agg(F.sum("lines")).first()[0] == 25
    for offset, count in ((0, None), (0, 3), (10, 3), (11, 1), (24, 5), (25, 1), (7, 0), (5, None)):
        got = ranges.read_at(spark, path, index, SCHEMA, offset, count).orderBy("line_no").collect()
        want = list(range(25))[offset:][:count]
        assert [(r.line_no, r.a) for r in got] == [(i, i) for i in want]
        reader = ranges._LinesAtReader({"path": path, "index": index, "offset": str(offset)} | ({} if count is None else {"count": str(count)}))
        assert sum(p.take for p in reader.partitions()) == len(want)


def test_only_the_ranges_that_are_asked_for(spark, tmp_path):
    path, index = str(tmp_path / "in"), str(tmp_path / "index")
    lines_of(path, {f"{i}.jsonl": "".join(f'{{"a": {100 * i + k}, "b": "x"}}\n' for k in range(100)) for i in range(5)})
    ranges.index_lines(spark, path, index, 500)
    opened = ranges._LinesAtReader({"path": path, "index": index, "offset": "250", "count": "30"}).partitions()
    assert {p.file.rpartition("/")[2] for p in opened} == {"2.jsonl"} and len(opened) < 5
    os.remove(f"{path}/0.jsonl")  # what isn't needed isn't opened
    assert [r.a for r in ranges.read_at(spark, path, index, SCHEMA, 250, 30).orderBy("a").collect()] == list(range(250, 280))
    with pytest.raises(ValueError, match="negative"):
        ranges._LinesAtReader({"path": path, "index": index, "offset": "-1"})


def test_small_ranges_are_no_tasks_of_their_own(spark, tmp_path):
    path = str(tmp_path / "in")
    lines_of(path, {f"{i:03d}.jsonl": "".join(f"{k}\n" for k in range(50)) for i in range(60)})
    counts = ranges.count_lines(spark, path, 10)
    assert counts.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert counts.agg(F.sum("lines"), F.max(F.col("end") - F.col("start")), F.count("*")).first()[:] == (3000, 10, 60 * 14)


def test_lines_that_are_no_rows_count(spark, tmp_path):
    path, index = str(tmp_path / "in"), str(tmp_path / "index")
    lines_of(path, {"a": '{"a": 1}\nnot json\n\n{"a": 2, "b": "y"}\n[1]\n{"a": 3}\n'})
    ranges.index_lines(spark, path, index)
    assert [(r.line_no, r.a, r.b) for r in ranges.read_at(spark, path, index, SCHEMA, 1).orderBy("line_no").collect()] == [(3, 2, "y"), (5, 3, None)]


def shards(path):
    return {name: [json.loads(x) for x in open(f"{path}/{name}", encoding="utf-8")] for name in sorted(os.listdir(path))}


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 730])
def test_shards_are_exact(spark, tmp_path, n):
    path = str(tmp_path / "out")
    rows = [(i, None if i % 3 else f"t{i}\n") for i in range(n)]
    ranges.write_exact_shards(spark.createDataFrame(rows, SCHEMA).repartition(6), path, 100, [-F.col("a")])
    got = shards(path)
    assert list(got) == [f"from_{at:015d}.jsonl" for at in range(0, n, 100)]
    assert [(x["a"], x["b"]) for own in got.values() for x in own] == rows[::-1]
    assert os.listdir(tmp_path) == ["out"]


def test_nothing_is_left_of_a_write_that_fails(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(500).select(F.col("id").alias("a"), F.lit("x").alias("b"))
    bad = df.select(F.col("a").alias("place"), F.when(F.col("a") == 333, F.raise_error(F.lit("lost"))).otherwise(F.lit("{}")).alias("value"))
    spark.dataSource.register(ranges.ExactShards)
    write = lambda rows: rows.write.format("exact_shards").option("path", path).option("rows", 100).mode("append").save()
    with pytest.raises(Exception, match="lost"):
        write(bad.repartition(F.floor(F.col("place") / 100)).sortWithinPartitions("place"))
    gap = df.where("a <> 250").select(F.col("a").alias("place"), F.lit("{}").alias("value"))
    with pytest.raises(Exception, match="place|whole"):
        write(gap.repartition(F.floor(F.col("place") / 100)).sortWithinPartitions("place"))
    missing = df.where("a >= 100").select(F.col("a").alias("place"), F.lit("{}").alias("value"))
    with pytest.raises(Exception, match="whole"):
        write(missing.repartition(F.floor(F.col("place") / 100)).sortWithinPartitions("place"))
    assert os.listdir(tmp_path) == []
    ranges.write_exact_shards(df, path, 250, [F.col("a")])
    before = shards(path)
    with pytest.raises(Exception, match="out"):
        ranges.write_exact_shards(df.limit(3), path, 1, [F.col("a")])
    assert shards(path) == before and os.listdir(tmp_path) == ["out"]
