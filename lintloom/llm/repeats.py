"""Operator 12: passages that repeat, found by fixed-block anchors.

Every document's blocks of BLOCK words that don't overlap are the index, and every window of BLOCK words of every
document is a probe. Of WINDOW consecutive words some BLOCK are a block of their document, so the earlier of two equal
passages of WINDOW words holds a block that the later one's probes hit, wherever it stands there.

1. Blocks and probes meet by parts of their hashes. They travel packed, thousands of a chunk of documents in a row, by
   32 bits each, as a false hit only costs work. A hash that a chunk can decide by itself is sent once, so that no
   chunk sends a common passage more than once.
2. Where a hit lies, it is extended: the windows of WINDOW words around it meet those that share its words by 96 bits,
   routed by the least probe inside, so that neighbours travel together, and only the first of a chunk. All but the
   first in the order of documents repeat, and runs of them are the maximal repeats.
3. The words of these windows go.

Only documents with hits, then only those with repeats, are shuffled with their texts; a bitmap of a fixed size tells
which may be. No pair of documents is ever made.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lintloom.llm.common import flag_ids, map_texts, release, slices, table
from lintloom.llm.near_dup import mix
from lintloom.sources.scratch import Scratch

#: Words of a window; blocks of half of it, so that each window holds a whole block.
WINDOW, BLOCK = 20, 10
#: Windows of a chunk at least, and parts of the hashes for each partition of a shuffle.
CHUNK, PARTS = 1 << 16, 4
#: Bytes of text that are split into words at a time.
SPLIT_BYTES = 1 << 19
#: Factors of the polynomials: any odd numbers.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WHITE = re.compile(rb"[ \t-\r]")


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a part of it at a time."""
    raw, at = (text or "").encode(), 0
    while at < len(raw):
        cut = _WHITE.search(raw, at + SPLIT_BYTES) if len(raw) - at > SPLIT_BYTES else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


def word_hashes(text: str | None) -> np.ndarray:
    parts = [np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w)) for w in words(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def rolling(hashes: np.ndarray, n: int, factor: int) -> np.ndarray:
    """The polynomial of each n consecutive hashes, by doubling."""
    if len(hashes) < n:
        return hashes[:0]
    power = lambda k: np.uint64(pow(factor, k, 1 << 64))
    out, size = hashes, 1
    for bit in bin(n)[3:]:
        out, size = out[:-size] * power(size) + out[size:], 2 * size
        if bit == "1":
            out, size = out[:-1] * power(1) + hashes[size:], size + 1
    return out


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    size = 1
    while 2 * size <= n:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: len(values) - (n - size)], values[n - size :])


def _rows(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each key, which stands in the first columns and by which rows are sorted."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _spans(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return starts, np.append(starts[1:], len(ordered))


def _pack(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


_HEAD, _ENTRIES = 0, 1
#: part of the hashes, chunk, what a row is; then of the head: keys, (first place, first window) of documents, hits
#: that the chunk knows; of entries: nothing, places in the chunk, hashes with the mark of blocks as lowest bit.
_PROBES = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int64()), ("keys", pa.binary()), ("places", pa.binary()), ("more", pa.binary())])


class _Probes:
    """Collects the probes of documents and packs them, a chunk at a time."""

    def __init__(self, parts: int, chunk: int):
        self.parts, self.room = parts, max(chunk, 64 * parts)
        self.clear()

    def clear(self) -> None:
        self.docs, self.values, self.blocks, self.n = [], [], [], 0

    def add(self, key: int, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(hashes):
            some = hashes[at : at + self.room - self.n]
            self.docs.append((key, self.n, at))
            self.values.append(some)
            self.blocks.append(np.arange(at, at + len(some)) % BLOCK == 0)
            self.n, at = self.n + len(some), at + len(some)
            if self.n == self.room:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        value, block = np.concatenate(self.values), np.concatenate(self.blocks)
        order = np.argsort(value, kind="stable")
        starts, ends = _spans(value[order])
        some_block = np.logical_or.reduceat(block[order], starts)
        known = (ends - starts > 1) & some_block
        inside = np.repeat(known, ends - starts)
        hits = np.sort(order[inside])
        # of what is known one entry is enough, as a block
        sent = ~inside
        sent[starts[known]] = True
        block[order[starts[known]]] = True
        place = np.sort(order[sent])
        keys, first, window = (np.array(x) for x in zip(*self.docs, strict=True))
        head = keys.astype("<i8").tobytes(), _pack(np.stack([first, window], axis=1), "<u4"), _pack(hits, "<u4")
        chunk = xxh3_64_intdigest(head[0] + head[1]) - (1 << 63)
        rows = [(chunk % self.parts, chunk, _HEAD, *head)]
        value, block = value[place], block[place]
        part = ((value >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64)
        code = (value << np.uint64(1) | block).astype("<u4")
        by = np.argsort(part.astype(np.uint16) if self.parts < 1 << 16 else part, kind="stable")
        for a, b in zip(*_spans(part[by]), strict=True):
            own = by[a:b]
            rows.append((int(part[own[0]]), chunk, _ENTRIES, None, _pack(place[own], self.kind), code[own].tobytes()))
        self.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PROBES, strict=True)], schema=_PROBES)

    @property
    def kind(self) -> str:
        return "<u2" if self.room <= 1 << 16 else "<u4"


def _probe(parts: int, chunk: int):
    """Documents (key, text) to packed probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _Probes(parts, chunk)
        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = word_hashes(text)
                if len(hashes) >= WINDOW:
                    yield from probes.add(key, mix(rolling(hashes, BLOCK, _FACTORS[0])))
        yield from probes.flush()
        release()

    return run


def _meet(kind: str):
    """The entries of a part of the hashes: those with a block and another window are hits. Heads pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in _rows(batches, 1):
            out = [(part, *r) for r in rows if r[1] == _HEAD]
            rows = [r for r in rows if r[1] == _ENTRIES]
            if rows:
                sizes = np.array([len(r[4]) // 4 for r in rows])
                code = np.concatenate([np.frombuffer(r[4], "<u4") for r in rows])
                place = np.concatenate([np.frombuffer(r[3], kind) for r in rows])
                order = np.argsort(code, kind="stable")
                starts, ends = _spans(code[order] >> 1)
                # blocks stand last among equals
                hit = np.empty(len(code), bool)
                hit[order] = np.repeat((ends - starts > 1) & ((code[order][ends - 1] & 1) == 1), ends - starts)
                ends = np.cumsum(sizes)
                for r, a, b in zip(rows, ends - sizes, ends, strict=True):
                    if hit[a:b].any():
                        out.append((part, r[0], _ENTRIES, None, _pack(place[a:b][hit[a:b]], "<u4"), None))
            for at in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 1000], strict=True), _PROBES, strict=True)], schema=_PROBES)
        release()

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits of a chunk, as windows of its documents: (key, windows)."""
    for _, rows in _rows(batches, 1):
        heads, found = [r for r in rows if r[0] == _HEAD], [np.frombuffer(r[2], "<u4") for r in rows if r[0] == _ENTRIES]
        out = []
        for _, keys, starts, known in heads:
            hits = np.unique(np.concatenate([np.frombuffer(known, "<u4"), *found]))
            first, window = np.frombuffer(starts, "<u4").reshape(-1, 2).T.astype(np.int64)
            ends = np.searchsorted(hits, np.append(first[1:], 1 << 32))
            begins = np.searchsorted(hits, first)
            for key, a, b, f, w in zip(np.frombuffer(keys, "<i8").tolist(), begins, ends, first, window, strict=True):
                if a < b:
                    out.append((key, _pack(hits[a:b] - f + w, "<u4")))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["key", "windows"])


#: Windows of a part: ids and marks of documents with the number of their windows, starts of these, and 96 bits each.
_WINDOWS = pa.schema([("part", pa.int64()), ("docs", pa.binary()), ("starts", pa.binary()), ("digests", pa.binary())])
_DOC, _DIGEST = np.dtype([("id", "<i8"), ("mark", "<i8"), ("n", "<u4")]), np.dtype([("a", "<u8"), ("b", "<u4")])
#: What is known of a document: some of its windows that repeat.
_REPEATS = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("windows", pa.binary())])


def _order(a: np.ndarray, b: np.ndarray, *then: np.ndarray) -> np.ndarray:
    return np.lexsort((*reversed(then), b, a))


class _Windows:
    """Collects the windows around hits and packs them, a chunk at a time; of equal ones only the first."""

    def __init__(self, parts: int, chunk: int):
        self.parts, self.room = parts, max(chunk, 64 * parts)
        self.clear()

    def clear(self) -> None:
        self.docs, self.found, self.n = {}, [], 0

    def add(self, doc: tuple[int, int], text: str, hits: np.ndarray) -> Iterator[pa.RecordBatch]:
        if doc in self.docs:  # a row that repeats
            return
        hashes = word_hashes(text)
        blocks = rolling(hashes, BLOCK, _FACTORS[0])
        n = len(hashes) - WINDOW + 1
        # a window holds the probes from its own place to WINDOW - BLOCK further
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, np.maximum(hits - (WINDOW - BLOCK), 0), 1)
        np.add.at(edge, hits + 1, -1)
        start = np.flatnonzero(np.cumsum(edge)[:n] > 0)
        whole = blocks[:-BLOCK] * np.uint64(pow(_FACTORS[0], BLOCK, 1 << 64)) + blocks[BLOCK:]
        other = rolling(hashes, WINDOW, _FACTORS[1]) >> np.uint64(32)
        route = mix(least(mix(blocks), WINDOW - BLOCK + 1)) % np.uint64(self.parts)
        for at in range(0, len(start), self.room):
            some = start[at : at + self.room]
            self.docs[doc] = len(self.docs)
            self.found.append((np.full(len(some), len(self.docs) - 1), some, whole[some], other[some], route[some]))
            self.n += len(some)
            if self.n >= self.room:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        doc, start, a, b, part = (np.concatenate(x) for x in zip(*self.found, strict=True))
        ids = np.array(list(self.docs), np.int64)
        order = _order(a, b, ids[doc, 0], ids[doc, 1], start)
        again = np.zeros(len(order), bool)
        again[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        later = order[again]
        part = part.astype(np.int64)
        # windows that are known to repeat: a part below 0 of their own, without digests
        for value, own in ((-1 - (xxh3_64_intdigest(later.tobytes() + ids.tobytes()) >> 2), later), (None, order[~again])):
            own = own[np.lexsort((start[own], doc[own]))] if value else own[np.lexsort((start[own], doc[own], part[own]))]
            rows = []
            for f, t in zip(*_spans(np.full(len(own), -1) if value else part[own]), strict=True) if len(own) else ():
                some = own[f:t]
                begin, end = _spans(doc[some])
                docs = np.empty(len(begin), _DOC)
                docs["id"], docs["mark"], docs["n"] = ids[doc[some[begin]], 0], ids[doc[some[begin]], 1], end - begin
                digests = np.empty(len(some), _DIGEST)
                digests["a"], digests["b"] = a[some], b[some]
                rows.append((value or int(part[some[0]]), docs.tobytes(), _pack(start[some], "<u4"), None if value else digests.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _WINDOWS, strict=True)], schema=_WINDOWS)
        self.clear()


def _extend(parts: int, chunk: int):
    """Documents (id, mark, text, hits) to packed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(parts, chunk)
        for batch in slices(batches):
            for i, mark, text, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.unique(np.concatenate([np.frombuffer(h, "<u4") for h in hits])).astype(np.int64)
                yield from windows.add((i, mark), text, found)
        yield from windows.flush()
        release()

    return run


def _not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the windows of a part, those that aren't the first of their words: (id, mark, windows) of documents."""
    for (part,), rows in _rows(batches, 1):
        docs = np.concatenate([np.frombuffer(r[0], _DOC) for r in rows])
        start = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows])
        doc = np.repeat(np.arange(len(docs)), docs["n"])
        if part >= 0:
            digest = np.concatenate([np.frombuffer(r[2], _DIGEST) for r in rows])
            order = _order(digest["a"], digest["b"], docs["id"][doc], docs["mark"][doc], start)
            begin, end = _spans(digest[order])
            first = np.repeat(order[begin], end - begin)
            same = (docs["id"][doc[order]] == docs["id"][doc[first]]) & (docs["mark"][doc[order]] == docs["mark"][doc[first]]) & (start[order] == start[first])
            keep = np.sort(order[~same])
            doc, start = doc[keep], start[keep]
        if len(doc):
            begin, end = _spans(doc)
            own = docs[doc[begin]]
            found = [start[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
            for at in range(0, len(own), 5000):
                some = slice(at, at + 5000)
                yield pa.RecordBatch.from_arrays([pa.array(own["id"][some]), pa.array(own["mark"][some]), pa.array(found[some], pa.binary())], schema=_REPEATS)
    release()


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words a window that begins at one of ``starts`` covers."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(edge)[:n] > 0


def _kept():
    """doc_id, text and the windows that repeat to the result."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, digests = [], [], []
        for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            gone = None
            if found:
                starts = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in found])).astype(np.int64)
                gone = covered(starts, sum(len(w) for w in words(text)))
            digest, n, removed, begun = hashlib.sha256(), 0, 0, False
            for some in words(text):
                n += len(some)
                if gone is not None:
                    keep = ~gone[n - len(some) : n]
                    removed += len(some) - int(keep.sum())
                    some = [some[i] for i in np.flatnonzero(keep)]
                if some:
                    digest.update(b" " * begun + b" ".join(some))
                    begun = True
            n_words.append(n)
            n_removed.append(removed)
            digests.append(digest.hexdigest())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return work


def remove_repeats(docs: DataFrame, chunk: int = CHUNK, parts: int = PARTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row: a text without the windows that stand earlier, too.

    Words are what stands between blanks and the control characters 9 to 13. A window is WINDOW consecutive words; one
    whose words also begin earlier (in a document of a smaller id, or further ahead in the same one) is removed, as
    judged on the input. A null id counts as the greatest. Rows that share an id but not their text are ordered by a
    hash of the text; rows equal in both are one document and have equal results. Null and empty texts have no words.
    Long texts are split a part at a time, and their windows are dealt over chunks, of ``chunk`` windows or more, and
    ``parts`` parts for each partition of a shuffle; neither changes a result. Columns besides doc_id and text
    aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts *= int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col("doc_id").alias("own_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark"), "text",
    )
    rows = rows.withColumn("doc_id", F.xxhash64("id", "mark"))
    schema = "part long, chunk long, kind long, keys binary, places binary, more binary"
    probes = rows.where("text IS NOT NULL").select(F.col("doc_id").alias("key"), "text").mapInArrow(_probe(parts, chunk), schema)
    met = probes.repartition("part").sortWithinPartitions("part").mapInArrow(_meet(_Probes(parts, chunk).kind), schema)
    met = met.select("chunk", "kind", "keys", "places", "more").repartition("chunk").sortWithinPartitions("chunk", "kind")
    hits = met.mapInArrow(_by_document, "key long, windows binary").groupBy("key").agg(F.collect_set("windows").alias("hits"))
    hits = scratch.put(hits, "hits")
    near = flag_ids(rows.where("text IS NOT NULL"), hits.select(F.col("key").alias("doc_id")), "flagged").where("flagged")
    near = near.join(hits, F.col("doc_id") == F.col("key")).select("id", "mark", "text", "hits")
    schema = "part long, docs binary, starts binary, digests binary"
    windows = near.mapInArrow(_extend(parts, chunk), schema)
    dealt = windows.repartition("part").sortWithinPartitions("part")
    repeats = dealt.mapInArrow(_not_first, "id long, mark long, windows binary").groupBy("id", "mark").agg(F.collect_set("windows").alias("found"))
    repeats = scratch.put(repeats, "repeats")
    marked = flag_ids(rows, repeats.select(F.xxhash64("id", "mark").alias("doc_id")), "flagged")
    clean = marked.where("NOT flagged").select("own_id", "text", F.lit(None).cast("array<binary>").alias("found"))
    rest = marked.where("flagged").join(repeats, ["id", "mark"], "left").select("own_id", "text", "found")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(clean.union(rest), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string", _kept)


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS r(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rank FROM a) WHERE rank > 1),
c AS (SELECT DISTINCT doc_id, i + s AS i FROM r, range(20) AS t(s)),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM k
"""
