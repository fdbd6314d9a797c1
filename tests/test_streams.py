"""Rows in order from a stream: repeats, gaps, restarts and timers; batches that are done twice."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lintloom.streaming import streams


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Rows(dict):
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class Handle:
    def __init__(self):
        self.timers = set()

    getValueState = staticmethod(lambda name, schema: Value())
    getMapState = staticmethod(lambda name, key, value: Rows())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentProcessingTimeInMs(self):
        return self.at


def ordered(patience=None):
    p, h = streams.InOrder(patience), Handle()
    p.init(h)
    give = lambda *at, now=0: [i for out in p.handleInputRows(("k",), iter([pd.DataFrame({"at": list(at), "row": [f"r{i}" for i in at]})]), Now(now)) for i in out["at"]]
    expire = lambda now: [i for out in p.handleExpiredTimer(("k",), Now(now), None) for i in out["at"]]
    return p, h, give, expire


def test_rows_go_out_once_and_in_order():
    p, h, give, _ = ordered()
    assert give(2, 1) == [] and give(0, 0) == [0, 1, 2] and give(1, 4, 3, 3) == [3, 4] and give(6, 2) == [] and give(6) == []
    assert dict(p.waiting) == {(6,): ("r6",)} and give(5) == [5, 6] and not p.waiting and not h.timers


def test_a_gap_is_passed_over_when_patience_ends():
    p, h, give, expire = ordered(100)
    assert give(0, 2, now=10) == [0] and h.timers == {110}
    assert give(3, now=50) == [] and h.timers == {110}
    h.timers.clear()
    assert expire(110) == [2, 3] and not h.timers
    assert give(1, now=120) == []  # too late
    assert give(5, 7, now=130) == [] and h.timers == {230}
    assert give(4, now=140) == [4, 5] and h.timers == {240}  # the gap before 7 has a time of its own
    assert expire(230) == [7] or p.gap.get()[0] == 6


def test_calls_of_the_state_go_by_blocks():
    """However many rows of a key arrive at once, a block of them is read and written once; repeats and gaps go across blocks."""
    p, h, give, expire = ordered(100)
    n, calls = 4 * streams.BLOCK, []

    class Counted(Rows):
        def updateValue(self, key, value):
            calls.append(key)
            self[key] = value

        def removeKey(self, key):
            calls.append(key)
            del self[key]

    p.waiting.state = Counted()
    assert give(*range(n, 0, -1), *range(1, n)) == [] and len(calls) == 5 and len(p.waiting) == n
    assert give(n + 2, n, 5) == [] and len(calls) == 6
    assert give(0) == list(range(n + 1)) and len(calls) == 11 and dict(p.waiting) == {(n + 2,): (f"r{n + 2}",)}
    h.timers.clear()
    assert expire(200) == [n + 2] and not p.waiting and not p.waiting.state and give(n + 1, n + 2) == []


SCHEMA = "job long, idx long, note string, at timestamp"


def test_a_stream_that_is_stopped_and_goes_on(spark, tmp_path):
    inputs, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    parts = [[(1, 2, "c"), (1, 0, "a"), (2, 1, "y"), (None, 0, "n"), (1, None, "x"), (1, -1, "x")], [(1, 0, "again"), (1, 4, None), (2, 3, "w")], [(1, 1, "b"), (2, 0, "x"), (1, 3, "d"), (2, 1, "again")]]
    told = []
    for rows in parts:
        spark.createDataFrame(rows, "job long, idx long, note string").withColumn("at", F.timestamp_seconds(F.col("idx"))).coalesce(1).write.mode("append").parquet(inputs)
        stream = streams.stream_in_order(spark.readStream.schema(SCHEMA).parquet(inputs), "job", "idx")
        with streams.keyed_state(spark):
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        told.append(sorted(((r.job, r.idx, r.note) for r in spark.read.schema(SCHEMA).parquet(out).collect()), key=str))
    assert told[0] == told[1] == sorted([(1, 0, "a"), (None, 0, "n")], key=str)
    assert told[2] == sorted([(None, 0, "n"), *((1, i, x) for i, x in enumerate(["a", "b", "c", "d", None])), (2, 0, "x"), (2, 1, "y")], key=str)
    assert all(r.at.timestamp() == r.idx for r in spark.read.schema(SCHEMA).parquet(out).collect())


def test_a_batch_that_is_done_again_is_written_once(spark, tmp_path):
    inputs, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def fail(rows, number):
        if number == 1:
            raise RuntimeError("lost")

    spark.createDataFrame([(i,) for i in range(5)], "id long").write.parquet(inputs)
    start = lambda then=None: streams.start_batches(spark.readStream.schema("id long").parquet(inputs), out, checkpoint, then).awaitTermination()
    start(fail)
    spark.createDataFrame([(i,) for i in range(5, 9)], "id long").write.mode("append").parquet(inputs)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            start(fail)
    assert sorted(r.id for r in streams.read_batches(spark, out, "id long").collect()) == list(range(9))
    start()
    assert sorted((r.id, r.batch) for r in streams.read_batches(spark, out, "id long").collect()) == [(i, int(i > 4)) for i in range(9)]
