"""Operator 8: packing token pieces into windows by minimum bin slack.

Every document is encoded once. What fills whole windows is cut off and is placed at once, without a shuffle; the rest
of each document, shorter than a window, is dealt into groups of a bounded size, and in each group a subset-sum dynamic
program over bitsets picks, for the longest rest that is left, the multiset of other lengths that fills its window
closest to capacity. The counts of the multiset are found by walking back through the bitsets; a multiset is used as
often as the lengths that are left allow. Only lengths and checksums of rests are shuffled, never texts or ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintloom.llm import bpe
from lintloom.llm.common import release, slices, table
from lintloom.sources.scratch import Scratch

#: The vocabulary of byte_bpe_50k.json as ranks.
RANK_FILE = "byte_bpe_50k.tiktoken"
#: The id after each document.
END_ID = 0
#: Rests of documents packed together, on average.
GROUP_ROWS = 16_384
#: Sequence ids of whole windows begin here; those of groups are below.
WHOLE = 1 << 62

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, uid long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def best_fill(counts: np.ndarray, target: int) -> list[tuple[int, int]]:
    """(length, count) pairs with the largest sum up to ``target``, no more of a length than ``counts`` has.

    ``counts[L]`` is how many pieces of length L are left. Bit s of a bitset says that s can be reached.
    """
    if target <= 0:
        return []
    mask, reach, steps = (1 << target + 1) - 1, 1, []
    goal = 1 << target
    for length in np.flatnonzero(counts[: target + 1])[::-1].tolist():
        left, k = min(int(counts[length]), target // length), 1
        while left:  # 1, 2, 4, ... copies at a time
            k = min(k, left)
            wider = reach | reach << length * k & mask
            if wider != reach:
                steps.append((length, k, reach))
                reach = wider
            left -= k
            k *= 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            used[length] = used.get(length, 0) + k
    return sorted(used.items(), reverse=True)


def plan_windows(counts: np.ndarray, capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """(multiset, times) until no piece is left. ``counts`` is used up."""
    for length in range(len(counts) - 1, 0, -1):
        while counts[length]:
            counts[length] -= 1
            rest = best_fill(counts, capacity - length)
            counts[length] += 1
            use = dict(rest)
            use[length] = use.get(length, 0) + 1
            times = min(int(counts[x]) // k for x, k in use.items())
            for x, k in use.items():
                counts[x] -= k * times
            yield sorted(use.items(), reverse=True), times


@lru_cache(maxsize=1)
def _library(file: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(file), special_tokens={})


@lru_cache(maxsize=1)
def _added(file: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """Added tokens with their ids, and a pattern that finds them, from the JSON file beside a rank file, if there is one."""
    beside = os.path.splitext(file)[0] + ".json"
    if not os.path.exists(beside):
        return None, {}
    with open(beside, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"{beside}: added tokens that take their surroundings into account")
    ids = {t["content"]: t["id"] for t in tokens}
    longest = sorted(ids, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, longest)) + ")") if ids else None, ids


def token_ids(text: str, file: str, added: bool = False) -> np.ndarray:
    """Ids of a text; with ``added``, an added token within it is one id, as it is for the tokenizer by default.

    The library gives up on very long runs of white space; such a text is encoded by ``bpe``.
    """
    find, ids = _added(file) if added else (None, {})
    if find is not None and find.search(text):
        parts = find.split(text)  # every second part is an added token
        return np.concatenate([np.array([ids[x]], "<u4") if k % 2 else token_ids(x, file) for k, x in enumerate(parts)])
    try:
        return _library(file).encode_to_numpy(text, disallowed_special=())
    except BaseException as e:  # a panic of the library is no Exception
        if type(e).__name__ != "PanicException":
            raise
        return bpe.load(file).encode([text])[0]


def _cut(file: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4")
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([token_ids(text or "", file, added=True), end])
                total = len(ids)
                for start in range(0, total, capacity):
                    piece = ids[start : start + capacity]
                    uid = part << 36 | row
                    row += 1
                    out.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), total, uid))
            columns = list(zip(*out, strict=True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "uid"])
        release()

    return run


def _pack(capacity: int):
    def run(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([("length", "ascending"), ("uid", "ascending")])
        length = pieces["length"].to_numpy()
        n, grp = len(length), int(pieces["grp"][0].as_py())
        first = np.searchsorted(length, np.arange(capacity + 2))
        sequence, offset, size, made = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        counts = np.diff(first)[:capacity].copy()
        nxt = first.copy()
        for use, times in plan_windows(counts, capacity):
            filled, windows = 0, made + np.arange(times)
            took = []
            for x, k in use:
                for _ in range(k):
                    rows = np.arange(nxt[x], nxt[x] + times)
                    nxt[x] += times
                    sequence[rows], offset[rows] = windows, filled
                    filled += x
                    took.append(rows)
            for rows in took:
                size[rows] = filled if filled & filled - 1 == 0 else capacity
            made += times
        out = pieces.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        for name, values in (("sequence_id", (np.int64(grp) << 32) + sequence), ("offset", offset), ("padded_length", size)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return run


def pack(df: DataFrame, capacity: int = 1024, file: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of the documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``df`` has doc_id and text. A null or empty text is its end id alone. ``padded_length`` is the capacity, but where
    a sequence's length is a power of two it is that length. Repeated rows are packed like any others; a null doc_id
    stays null. No table, no rows.
    """
    file = file or public_tokenizers.path(RANK_FILE)
    # written once: the places of pieces must not change when a task of what follows is run again
    pieces = Scratch(df.sparkSession).put(df.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(file, capacity), PIECES), "pieces")
    rests = pieces.where(F.col("length") < capacity)
    groups = max(1, round(rests.count() / group_rows))
    dealt = rests.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("long"))
    packed = dealt.groupBy("grp").applyInArrow(_pack(capacity), PACKED)
    size = F.lit(capacity).cast("long").alias("padded_length")
    whole = pieces.where(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("uid") + F.lit(WHOLE)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), size
    )
    return packed.union(whole)


def op8_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
