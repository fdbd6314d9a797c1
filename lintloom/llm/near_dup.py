"""Operator 6: near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document's set are the hashes of its distinct 5-word shingles. Two permutations give all signature coordinates: the
first scatters the set over PLACES places, the second, shifted by k places around the circle, gives coordinate k as
the least value that the set meets. Documents with equal sets are one class from the start, stood for by the smallest
id. Classes that agree on all rows of a band are candidates.

A band's bucket with few classes gives all its pairs. In a larger one all classes are compared with a few pivots
first; what is one component afterwards needs no more comparing, and each class outside the bucket's largest component
is then compared with all classes of other components, in blocks. No group is ever expanded into all its pairs, and no
link between components is lost.

Before sets are fetched, pairs go through a parity sketch: a bit of it tells whether an odd number of shingles falls on
it, so two sketches differ in no more bits than the sets in elements, and pairs that differ too much for the threshold
are dropped for certain. What is left is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh3_64_intdigest

from lintloom.llm.common import flag_ids, map_texts, named, release, slices, table
from lintloom.sources.scratch import Scratch

#: Words of a shingle; similarity in hundredths.
WORDS, PERCENT = 5, 75
#: A pair at the threshold shares no band with a probability of (1 - 0.75 ** ROWS) ** BANDS, two in a million.
BANDS, ROWS = 24, 3
PLACES = 1 << 20
#: Classes of a bucket up to which all pairs are taken; pivots of a larger one; classes of a block of the rest.
SMALL, PIVOTS, FEW, MANY = 24, 4, 512, 4096
#: Bits of a sketch, least and most.
SKETCH = (64, 1 << 14)

#: Bytes of text that are split into words at a time.
SPLIT_BYTES = 1 << 19

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_WHITE = re.compile(rb"[ \t-\r]")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _B
    x = x ^ (x >> np.uint64(27))
    x = x * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes (XXH3, 64 bits) of a text's words, in order. A long text is split a part at a time."""
    raw, at, out = (text or "").encode().lower(), 0, []  # bytes: only A-Z change, only 9 to 13 and 32 part words
    while at < len(raw):
        cut = _WHITE.search(raw, at + SPLIT_BYTES) if len(raw) - at > SPLIT_BYTES else None
        end = cut.start() if cut else len(raw)
        words = raw[at:end].split()
        out.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for a text without words."""
    factors = mix(np.arange(1, WORDS + 2, dtype=np.uint64) * _C) | np.uint64(1)
    out = []
    for text in texts:
        word = word_hashes(text)
        n = len(word)
        if n >= WORDS:
            n -= WORDS - 1
            out.append(np.unique(mix(sum(word[k : n + k] * factors[k] for k in range(WORDS)))))
        elif n:
            out.append(mix((word * factors[:n]).sum(dtype=np.uint64, keepdims=True) + factors[WORDS : WORDS + 1] * np.uint64(n)))
        else:
            out.append(word)
    return out


def identity(own: np.ndarray) -> tuple[int, int]:
    """128 bits of the SHA-256 of a set: documents of equal sets are one class."""
    low, high = struct.unpack_from("<qq", hashlib.sha256(own.tobytes()).digest())
    return low, high


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    second = rng.permutation(PLACES).astype(np.uint32)
    return rng.permutation(PLACES).astype(np.int32), np.concatenate([second, second[: BANDS * ROWS]])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Coordinate k: the least value of the second permutation, shifted by k, at the places of the set. No set is empty."""
    first, second = _permutations()
    places = first[(np.concatenate(sets) >> np.uint64(44)).astype(np.int64)]
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat(second[k:].take(places), starts)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    x = signature.reshape(len(signature), BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _A)
    for r in range(ROWS):
        key = mix(key * _C + x[:, :, r] * _A)
    return key.view(np.int64)


def sketch(own: np.ndarray) -> bytes:
    low, high = SKETCH
    bits = min(high, max(low, 1 << (2 * len(own) - 1).bit_length()))
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) if len(x) > size else x


def may_link(n: int, a: bytes, m: int, b: bytes) -> bool:
    """False only where the sets of n and m elements can't reach the threshold.

    A similarity of at least p hundredths leaves at most (n + m) * (100 - p) / (100 + p) elements that are in one set.
    """
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
    return apart * (100 + PERCENT) <= (n + m) * (100 - PERCENT)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = shingle_sets(batch.column(1).to_pylist())
    some = [i for i, s in enumerate(sets) if len(s)]
    keys: list = [None] * len(sets)
    h1, h2 = [0] * len(sets), [0] * len(sets)
    # signatures are made over a bounded number of shingles at a time
    at = 0
    while at < len(some):
        to, total = at, 0
        while to < len(some) and (to == at or total + len(sets[some[to]]) < 500_000):
            total += len(sets[some[to]])
            to += 1
        made = bands(signatures([sets[i] for i in some[at:to]]))
        for i, row in zip(some[at:to], made, strict=True):
            keys[i] = row
        at = to
    for i in some:
        h1[i], h2[i] = identity(sets[i])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
        names=["doc_id", "n", "h1", "h2", "bands", "sketch"],
    )


def with_standing(df: DataFrame, m: str, h1: str, h2: str) -> DataFrame:
    """``df`` with three columns more, by which the text that stands for an id is the least of those of its rows."""
    at = df.columns.index("text")
    plain = df.select(*(named(c).alias(f"c{i}") for i, c in enumerate(df.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}"):
            sets = shingle_sets(part.column(at).to_pylist())
            marks = [(-len(s), *(identity(s) if len(s) else (0, 0))) for s in sets]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[k] for x in marks], pa.int64()) for k in range(3))], names=[*part.schema.names, "m", "h1", "h2"])
        release()

    schema = StructType([*plain.schema.fields, *(StructField(c, LongType()) for c in ("m", "h1", "h2"))])
    return plain.mapInArrow(run, schema).toDF(*df.columns, m, h1, h2)


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The sets of texts, where an identity is given only of those that have it: of rows that repeat an id, the ones that stand for it."""
    rows = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True)
    found = [(doc, own.tobytes()) for doc, h1, h2, own in rows if h1 is None or identity(own) == (h1, h2)]
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "shingles"])


def _keep(test, columns: tuple[str, ...]):
    """Filters pairs (a, b) by a test of the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)
                yield part.select(["a", "b"]).filter(pa.array([test(*v) for v in values], pa.bool_()))

    return run


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").where(F.col("n_a") > 0).join(side("b"), "b").where((100 * F.least("n_a", "n_b")) >= PERCENT * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(_keep(may_link, ("n_a", "s_a", "n_b", "s_b")), "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, chosen: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The pairs that reach the threshold on full sets. ``chosen`` has the identities of ids that rows repeat, if any do."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if chosen is not None:
        wanted = wanted.join(chosen.select("doc_id", "h1", "h2"), "doc_id", "left")
    wanted = scratch.put(wanted, "wanted")
    near = flag_ids(docs, wanted).where("flagged").select("doc_id", "text").join(wanted, "doc_id")
    identities = [F.col(c) if chosen is not None else F.lit(None).cast("long").alias(c) for c in ("h1", "h2")]
    sets = map_texts(near.select("doc_id", "text", *identities), "doc_id long, shingles binary", lambda: _sets)
    sets = scratch.put(sets.dropDuplicates(["doc_id"]), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    test = lambda x, y: linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
    out = scratch.put(both.select("a", "b", "x", "y").mapInArrow(_keep(test, ("x", "y")), "a long, b long"), "links")
    scratch.drop(sets)
    return out


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, component) of each node of the links: the smallest node it is connected to. Large and small stars in turn."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        # edges hold (u, v) both ways for a large star, u > v for a small one
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = edges.join(least, "u")
        if large:
            return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))

    edges, before = scratch.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, True).distinct()
        after = scratch.put(star(large, False).distinct(), "edges")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(edges)
        edges = after
        if before == tuple(state):
            break
        before = tuple(state)
    nodes = edges.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("rep"), F.col("v").alias("component"))).distinct()


def _rest(key: tuple, few: pa.Table, many: pa.Table) -> pa.Table:
    """Pairs of different components of one block of the few and one of the many, as far as sketches allow."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    out = []
    if len(few) and len(many):
        ids, sizes, comps = (many[c].to_numpy() for c in ("rep", "n", "component"))
        sketches = many["sketch"].to_pylist()
        by_width: dict[int, np.ndarray] = {}
        for width in {len(s) for s in sketches}:
            rows = np.array([i for i, s in enumerate(sketches) if len(s) == width])
            by_width[width] = (rows, np.frombuffer(b"".join(sketches[i] for i in rows), np.uint8).reshape(len(rows), width))
        for rep, n, comp, own in zip(*(few[c].to_pylist() for c in ("rep", "n", "component", "sketch")), strict=True):
            x = np.frombuffer(own, np.uint8)
            for width, (rows, data) in by_width.items():
                m = sizes[rows]
                fit = (comps[rows] != comp) & (100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n))
                if not fit.any():
                    continue
                rows_, y, m = rows[fit], data[fit], m[fit]
                size = min(width, len(x))
                if width > size:
                    y = np.bitwise_xor.reduce(y.reshape(len(y), -1, size), axis=1)
                apart = np.bitwise_count(y ^ _fold(x, size)).sum(axis=1, dtype=np.int64)
                out += [(min(rep, b), max(rep, b)) for b in ids[rows_[apart * (100 + PERCENT) <= (n + m) * (100 - PERCENT)]].tolist()]
    out = sorted(set(out))
    return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], schema=schema)


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``df`` (doc_id, text).

    A null text, or one without words, has no shingles and is linked with nothing. Rows that repeat an id are one
    document; if their texts differ, the text with the largest set stands for all of them (of equally large ones, that
    of the least digest), and n_shingles is its size. A row with a null id is linked with nothing; its component is
    null and it isn't kept. Columns besides doc_id and text aren't read. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = scratch.put(map_texts(docs, "doc_id long, n long, h1 long, h2 long, bands array<long>, sketch binary", lambda: _features), "features")
    some, told, chosen = features, features.select("doc_id", "n", "h1", "h2"), None
    own = F.min(F.struct((-F.col("n")).alias("m"), "h1", "h2")).alias("own")
    known = features.where("doc_id IS NOT NULL").groupBy("doc_id")
    if known.agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        # of rows of one id and different sets, (largest set, least digest) stands for the id
        sets = known.agg(own, F.count("*").alias("rows")).where("rows > 1")
        chosen = scratch.put(sets.select("doc_id", (-F.col("own.m")).alias("n"), F.col("own.h1").alias("h1"), F.col("own.h2").alias("h2")), "chosen")
        mine = chosen.select("doc_id", *(F.col(c).alias(f"own_{c}") for c in ("n", "h1", "h2")))
        marked = features.join(mine, "doc_id", "left")
        fits = F.col("own_n").isNull() | ((F.col("n") == F.col("own_n")) & (F.col("h1") == F.col("own_h1")) & (F.col("h2") == F.col("own_h2")))
        some = marked.where(fits).select(*features.columns)
        told = marked.select("doc_id", *(F.coalesce(f"own_{c}", c).alias(c) for c in ("n", "h1", "h2")))
    classes = scratch.put(
        some.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes"
    )
    entries = classes.select("rep", F.explode("bands").alias("key"))
    # counts and pivots are tables of their own, so that a hot key of the joins with them can be split over tasks
    counts = scratch.put(entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    shared = scratch.put(entries.join(counts, "key"), "shared")

    few = shared.where(F.col("m") <= SMALL)
    pairs = few.select("key", F.col("rep").alias("a")).join(few.select("key", F.col("rep").alias("b")), "key").where("a < b").select("a", "b")
    large = shared.where(F.col("m") > SMALL)
    pivots = large.groupBy("key").agg(F.array(*(F.min(F.struct(F.xxhash64("rep", F.lit(i)).alias("h"), "rep"))["rep"] for i in range(PIVOTS))).alias("p"))
    pivots = scratch.put(pivots.select("key", F.explode(F.array_distinct("p")).alias("p")), "pivots")
    starred = large.join(pivots, "key").where("rep <> p").select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))
    candidates = scratch.put(_plausible(pairs.union(starred).distinct(), classes), "candidates")
    links = _confirmed(candidates, docs, chosen, scratch)
    found = components(links, scratch)

    # large buckets that are not one component yet
    member = large.join(found, "rep", "left").select("key", "rep", "m", F.coalesce("component", "rep").alias("component"))
    member = scratch.put(member, "members")
    parts = member.groupBy("key", "component").agg(F.count("*").alias("k"), F.first("m").alias("m"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("parts"), (F.first("m") - F.max("k")).alias("others"), F.first("m").alias("size")).where("parts > 1")
    mixed = scratch.put(mixed.select("key", "main", F.ceil(F.col("others") / FEW).cast("int").alias("few"), F.ceil(F.col("size") / MANY).cast("int").alias("many")), "mixed")
    if mixed.limit(1).count():
        open_ = member.join(mixed, "key").join(classes.select("rep", "n", "sketch"), "rep")
        block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # new names on either side: both come from the same tables
        columns = [F.col(c).alias(c) for c in ("key", "i", "j", "rep", "n", "component", "sketch")]
        left = open_.where("component <> main").withColumn("i", block("few")).withColumn("j", whole("many")).select(*columns)
        right = open_.withColumn("j", block("many")).withColumn("i", whole("few")).select(*columns)
        more = scratch.put(left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(_rest, "a long, b long").distinct().join(candidates, ["a", "b"], "left_anti"), "more")
        links = links.union(_confirmed(more, docs, chosen, scratch))
        found = components(links, scratch)
    group = classes.join(found, "rep", "left").select("h1", "h2", F.col("n").alias("n"), F.coalesce("component", "rep").alias("component"))
    told = told.join(group, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return told.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM w
  UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), c AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
