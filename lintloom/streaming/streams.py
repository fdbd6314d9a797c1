"""Structured Streaming twins: findings appended while files arrive, groups given out when complete, rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lintloom.functions import rules
from lintloom.operators import patterns

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_findings(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """ST-04: rule findings of documents as their files arrive; the same expressions as in a batch."""
    return rules.violations(spark.readStream.schema(schema).parquet(folder))


def start_append(df: DataFrame, out: str, checkpoint: str):
    """O-26: resumes from its checkpoint; each input is done once."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_complete_groups(samples: DataFrame, size: int, time_col: str | None = None, wait: str = "1 day") -> DataFrame:
    """ST-02 over (id, idx, reward): an id is given out once, when ``size`` different samples of it have arrived.

    Of a group that was given out only its mark stays. With ``time_col``, a group's state goes once the watermark, the
    latest time less ``wait``, has passed the group's last sample by ``wait`` again: groups that never fill don't stay
    for ever, and samples that come later than that begin a new group.
    """
    limit = pd.Timedelta(wait)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, best, done = state.get if state.exists else ([], None, False)
        seen, last = set(seen), None
        for pdf in batches:
            if not done:
                seen |= set(pdf["idx"].tolist())
                best = max([x for x in (best, pdf["reward"].max()) if x is not None])
            if time_col is not None:
                last = max([x for x in (last, pdf["at"].max()) if x is not None])
        if not done and len(seen) >= size:
            yield pd.DataFrame({"id": [key[0]], "n": [len(seen)], "best": [best]})
            seen, best, done = set(), None, True
        state.update((sorted(int(x) for x in seen), float(best) if best is not None else None, done))
        if last is not None:
            at = int((last + limit).timestamp() * 1000)
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))

    columns = ["id", "idx", "reward"]
    if time_col is not None:
        samples = samples.withColumn("at", samples[time_col].cast("timestamp")).withWatermark("at", wait)
        columns.append("at")
    timeout = "NoTimeout" if time_col is None else "EventTimeTimeout"
    return samples.select(*columns).groupBy("id").applyInPandasWithState(step, "id long, n long, best double", "seen array<long>, best double, done boolean", "append", timeout)


@contextmanager
def keyed_state(spark: SparkSession):
    """A query started here keeps its state in RocksDB, which state with several variables and timers needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


#: Indexes of a block, whose waiting rows are one entry of the state.
BLOCK = 64


class Waiting(Mapping):
    """The rows of a key that wait, (index,) to (row,), in a map state with an entry for each block of indexes.

    Every call of the state is a message to the JVM. So a block is read once, changed here, and written by ``save``; no
    more blocks are read than rows arrive for or go out of.
    """

    def __init__(self, state):
        self.state = state
        self.forget()

    def forget(self) -> None:
        """What was read is of one key."""
        self.read: dict[int, dict[int, str]] = {}
        self.there: set[int] = set()
        self.changed: set[int] = set()

    def block(self, number: int) -> dict[int, str]:
        if number not in self.read:
            self.read[number] = {}
            if self.state.containsKey((number,)):
                self.there.add(number)
                self.read[number] = dict(zip(*self.state.getValue((number,)), strict=True))
        return self.read[number]

    def add(self, at: int, row: str) -> None:
        """A row that waits already stays."""
        rows = self.block(at // BLOCK)
        if at not in rows:
            rows[at] = row
            self.changed.add(at // BLOCK)

    def run(self, at: int) -> list[tuple[int, str]]:
        """The rows from ``at`` on without a gap, taken out."""
        out = []
        while at in (rows := self.block(at // BLOCK)):
            out.append((at, rows.pop(at)))
            self.changed.add(at // BLOCK)
            at += 1
        return out

    def first(self) -> int | None:
        number = min((k[0] for k in self.state.keys()), default=None)
        return None if number is None else min(self.block(number))

    def save(self) -> None:
        for number in sorted(self.changed):
            if rows := self.read[number]:
                self.state.updateValue((number,), (list(rows), list(rows.values())))
                self.there.add(number)
            elif number in self.there:
                self.state.removeKey((number,))
                self.there.remove(number)
        self.changed.clear()

    def __getitem__(self, key: tuple[int]) -> tuple[str]:
        return (self.block(key[0] // BLOCK)[key[0]],)

    def __iter__(self) -> Iterator[tuple[int]]:
        return ((i,) for k in list(self.state.keys()) for i in list(self.block(k[0])))

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def __bool__(self) -> bool:
        return next(iter(self.state.keys()), None) is not None


class InOrder(StatefulProcessor):
    """Rows of a key by their index, from 0 and without a gap; those that come too early wait in the state.

    A row whose index was given out, or that waits already, is a repeat and is dropped. With ``patience``, a gap that
    is still there so many milliseconds after it was met is passed over: the rows that wait behind it go out.
    """

    def __init__(self, patience: int | None = None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "at long")
        self.waiting = Waiting(handle.getMapState("waiting", "block long", "at array<long>, row array<string>"))
        #: The gap that the timer is for, and the time of the timer.
        self.gap = handle.getValueState("gap", "at long, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.waiting.forget()
        before = self._next()
        for pdf in rows:
            for i, row in zip(pdf["at"].tolist(), pdf["row"].tolist(), strict=True):
                if i >= before:
                    self.waiting.add(int(i), row)
        out, at = self._run(before)
        if self.patience is not None:
            self._watch(at, timerValues.getCurrentProcessingTimeInMs())
        yield from self._given(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.waiting.forget()
        at = self._next()
        if not self.gap.exists() or self.gap.get()[0] != at:
            return
        self.gap.clear()
        later = self.waiting.first()
        out, at = self._run(at if later is None else later)
        self._watch(at, timerValues.getCurrentProcessingTimeInMs())
        yield from self._given(key, out)

    def close(self) -> None:
        pass

    def _next(self) -> int:
        known = self.next.get()
        return 0 if known is None else int(known[0])

    def _run(self, at: int) -> tuple[list[tuple[int, str]], int]:
        """The rows from ``at`` on without a gap, and the index after them; what is left waits."""
        out = self.waiting.run(at)
        self.waiting.save()
        if out:
            self.next.update((at + len(out),))
        return out, at + len(out)

    def _watch(self, at: int, now: int) -> None:
        """A timer for the gap at ``at``, if rows wait behind it; the one for an earlier gap goes."""
        if self.gap.exists():
            known, due = self.gap.get()
            if known == at:
                return
            self.handle.deleteTimer(int(due))
            self.gap.clear()
        if self.waiting:
            self.gap.update((at, now + self.patience))
            self.handle.registerTimer(now + self.patience)

    @staticmethod
    def _given(key: tuple, out: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "at": [i for i, _ in out], "row": [r for _, r in out]})


def stream_in_order(rows: DataFrame, key: str, index: str, patience: int | None = None) -> DataFrame:
    """ST-01: the rows of each ``key`` in the order of ``index``, each when all before it were given out.

    Start what comes of it within ``keyed_state``. A row is given out once, also after a restart from the checkpoint.
    Rows with a null index, or one below 0, are left out. ``patience`` in milliseconds: see InOrder.
    """
    rest = [c for c in rows.columns if c not in (key, index)]
    packed = rows.where(F.col(index) >= 0).select(F.col(key).alias("key"), F.col(index).cast("long").alias("at"), F.to_json(F.struct(*rest)).alias("row"))
    kind = rows.schema[key].dataType.simpleString()
    time = "None" if patience is None else "ProcessingTime"
    out = packed.groupBy("key").transformWithStateInPandas(InOrder(patience), f"key {kind}, at long, row string", "Append", time)
    schema = rows.select(*rest).schema
    given = out.select(F.col("key").alias(key), F.col("at").cast(rows.schema[index].dataType).alias(index), F.from_json("row", schema).alias("r"))
    return given.select(key, index, *(F.col("r")[c].alias(c) for c in rest))


def stream_patterns(files: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """ST-04 with the code detectors: matches of a stream of files (blob_id, content), by the same function as in a batch."""
    return patterns.find_patterns(files, wanted)


def start_batches(df: DataFrame, out: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None):
    """O-26: each batch is written once, into a folder of its own that is named by its number.

    A batch that is done again, as the query ended before it could be marked as done, overwrites what it had written:
    its rows are never there twice. ``then`` is called with the rows as written.
    """

    def write(batch: DataFrame, number: int) -> None:
        place = f"{out.rstrip('/')}/batch={number}"
        batch.write.mode("overwrite").parquet(place)
        if then is not None:
            then(batch.sparkSession.read.schema(batch.schema).parquet(place), number)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows of all batches that ``start_batches`` has written, with the number of their batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(out)
