"""H4: similarity in hundredths, 200 * common / (n + m) by longest common subsequence, as used for fuzzy matches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: str, b: str) -> int:
    """By a bit-parallel longest common subsequence: one big-integer step for each character of b."""
    if not a and not b:
        return 100
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return round(200 * common / (len(a) + len(b)))


def similar(a: str, b: str, percent: int) -> bool:
    """Whether the ratio reaches ``percent``; lengths and characters that rule it out are looked at first."""
    n, m = len(a), len(b)
    if 200 * min(n, m) < (percent - 1) * (n + m):
        return False
    common = sum((Counter(a) & Counter(b)).values())
    return 200 * common >= (percent - 1) * (n + m) and ratio(a, b) >= percent


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def fuzzy_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_ratios, "int")(a, b)


def could_reach(a: Column, b: Column, percent: int) -> Column:
    """Native bound: two texts of very different lengths can't be that similar."""
    return 200 * F.least(F.length(a), F.length(b)) >= (percent - 1) * (F.length(a) + F.length(b))


#: Characters of a gram; lines of a block that look for partners, and among which they do, at most.
GRAM, FEW, MANY = 3, 2000, 20_000


@lru_cache(maxsize=4096)
def least_common(n: int, percent: int) -> int:
    """How many of the grams of a text of n characters any text as similar as ``percent`` holds at least.

    Two texts with d characters that are in one and not in the common subsequence differ by that many deletions and
    insertions. A deletion from the text spoils GRAM of its grams, an insertion one less; the worst length of the other
    text counts.
    """
    worst = 0
    share = 1 - (percent - 1) / 100  # as in ``similar``, a little less than the rounded ratio asks for
    for m in range(int(n * (percent - 1) / (201 - percent)), int(n * (201 - percent) / (percent - 1)) + 2):
        d = int(share * (n + m) + 1e-9)
        if abs(n - m) <= d:
            deleted, added = (d + n - m) // 2, (d - n + m) // 2
            worst = max(worst, GRAM * deleted + (GRAM - 1) * added)
    return n - GRAM + 1 - worst


def grams(text: str) -> np.ndarray:
    """A number for each gram of a text, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = c[: max(0, len(c) - GRAM + 1)]
    for k in range(1, GRAM):
        out = out * np.uint64(0x110001) + c[k : len(c) - GRAM + 1 + k]
    return out


class GramIndex:
    """Distinct texts by their grams, to tell whether any of them is similar to another text.

    A text that is similar enough shares ``least_common`` grams; those that share as many are compared, the ones with
    most common grams first, until one is similar. Texts too short for that bound are compared by length.
    """

    def __init__(self, texts: list[str], percent: int):
        self.texts, self.percent = texts, percent
        self.sizes = np.array([len(t) for t in texts])
        own = [np.unique(grams(t)) for t in texts]
        every = np.concatenate(own) if own else np.empty(0, np.uint64)
        which = np.repeat(np.arange(len(texts)), [len(g) for g in own])
        order = np.argsort(every, kind="stable")
        self.which = which[order]
        self.keys, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))

    def has_partner(self, text: str) -> bool:
        n, p = len(text), self.percent
        near = (200 * np.minimum(self.sizes, n) >= (p - 1) * (self.sizes + n)) if p > 1 else np.ones(len(self.sizes), bool)
        least = least_common(n, p) if p > 1 else 0
        if least > 0:
            mine = grams(text)
            at = np.searchsorted(self.keys, mine)
            at = at[at < len(self.keys)]
            at = at[np.isin(self.keys[at], mine)] if len(at) else at
            lists = [self.which[self.starts[i] : self.starts[i + 1]] for i in at]
            shared = np.bincount(np.concatenate(lists), minlength=len(self.sizes)) if lists else np.zeros(len(self.sizes), np.int64)
            near &= shared >= least
            found = np.flatnonzero(near)
            found = found[np.argsort(-shared[found], kind="stable")]
        else:
            found = np.flatnonzero(near)
        return any(similar(text, self.texts[i], p) for i in found)


def band(length: Column, percent: int) -> Column:
    """Lengths by a scale on which those of similar texts are one step apart at most."""
    if percent <= 1:
        return F.lit(0)
    step = log((201 - percent) / (percent - 1)) * 1.0001
    return F.floor(F.log(length.cast("double")) / step).cast("int")


def partners(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(keys, line, side) of the lines that no equal one, but a similar one, has on the other side of their group.

    ``rows`` has ``keys``, a distinct ``line``, and how often either side has it (g, p). Lines meet by steps of length,
    each with the step below and above; what looks for partners and what it looks among are dealt into blocks of FEW
    and MANY lines, so that a group of any size is many tasks and no pair of lines is ever a row.
    """
    step = band(F.length("line"), percent)
    steps = F.array(step - 1, step, step + 1) if percent > 1 else F.array(step)
    asks = lambda side, test: F.when(test, F.array(F.struct(F.lit(side).alias("side"), F.lit(1).alias("asks"), step.alias("step")))).otherwise(F.array())
    told = lambda side, test: F.when(test, F.transform(steps, lambda x: F.struct(F.lit(side).alias("side"), F.lit(0).alias("asks"), x.alias("step")))).otherwise(F.array())
    g, p = F.col("g") > 0, F.col("p") > 0
    entries = F.concat(asks("p", p & ~g), told("p", g), asks("g", g & ~p), told("g", p))
    each = rows.where("line <> ''").select(*keys, "line", F.explode(entries).alias("e")).select(*keys, "line", "e.side", "e.asks", "e.step")
    group = [*keys, "side", "step"]
    sizes = each.groupBy(*group).agg(F.sum("asks").alias("n"), F.sum(1 - F.col("asks")).alias("m")).where("n > 0 AND m > 0")
    sizes = sizes.select(*(F.col(c).alias(f"_{c}") for c in group), F.ceil(F.col("n") / FEW).cast("int").alias("few"), F.ceil(F.col("m") / MANY).cast("int").alias("many"))
    own = lambda n: F.array(F.pmod(F.xxhash64("line"), F.col(n)).cast("int"))
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asking = F.col("asks") == 1
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    dealt = each.join(sizes, same).withColumn("i", F.explode(F.when(asking, own("few")).otherwise(all_("few")))).withColumn("j", F.explode(F.when(asking, all_("many")).otherwise(own("many"))))
    block = [*group, "i", "j"]
    stream = dealt.select(*block, "asks", "line").repartition(*block).sortWithinPartitions(*block, "asks")
    schema = stream.select(*keys, "side", "line").schema
    return stream.mapInArrow(_with_partner(len(block), len(keys), percent), schema).distinct()


def _with_partner(n_block: int, n_keys: int, percent: int):
    """Of each block, the asking lines that have a partner. Rows are sorted by block; those to look among come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, texts, index = None, [], None
        for batch in batches:
            rows = batch.to_pydict()
            columns, hits = list(rows.values()), []
            for k, own in enumerate(zip(*columns[:n_block], strict=True)):
                if own != block:
                    block, texts, index = own, [], None
                line = columns[-1][k]
                if not columns[-2][k]:
                    texts.append(line)
                    continue
                index = index or GramIndex(texts, percent)
                if index.has_partner(line):
                    hits.append(k)
            if hits:
                some = batch.take(pa.array(hits))
                yield pa.RecordBatch.from_arrays([*some.columns[:n_keys], some.column(n_keys), some.column(some.num_columns - 1)], names=[*batch.schema.names[:n_keys], "side", "line"])

    return run
