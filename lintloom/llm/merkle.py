"""Operator 13: a Merkle manifest of a dataset: a tree for each source, a tree over their roots, and a proof for each row.

Bottom-up build, top-down push. Leaves are ranked within their source by ranges, so that no source is sorted in one
task; every level of nodes is then the hash of runs of 16 of the level below, joined from children to parents by an
aggregate of at most 16 rows, and written. The proofs come down the same levels: a node hands the proof it has
inherited to its children, each of which puts the digests beside it in front. What is copied for a leaf is made where
the leaf is: a run of 16 leaves and its proof meet their leaves in one join.

All of it is DataFrame functions; no digest but the counts of the largest tree comes to the driver.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintloom.llm.common import table
from lintloom.sources.scratch import Scratch

#: Children of a node.
FANOUT = 16
#: A leaf's fields, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a partition in the id that Spark gives a row.
_ROW_BITS = 33


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(**changed: Column) -> Column:
    return digest(*(field(changed.get(c, F.col(c))) for c in FIELDS))


def ranked(nodes: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``nodes`` with ``idx``, the rank from 0 of a row among those of its tree ``g`` by ``keys``, and ``n``, their number.

    Rows are dealt into sorted ranges and written with their places; a range's rows of one tree stand together, so a
    rank is a place in the range and the count of the ranges before. Equal rows are told apart by where they are read,
    so that a row which repeats very often is many ranges; they are equal in all that follows, too.
    """
    columns = nodes.columns
    placed = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("g", *keys, "tie").sortWithinPartitions("g", *keys, "tie")
    place = F.monotonically_increasing_id()
    placed = scratch.put(placed.select(*columns, F.shiftright(place, _ROW_BITS).alias("part"), place.bitwiseAND((1 << _ROW_BITS) - 1).alias("row")), "ranges")
    runs = placed.groupBy("g", "part").agg(F.min("row").alias("first"), F.count("*").alias("size"))
    of_tree = W.partitionBy("g")
    before = F.coalesce(F.sum("size").over(of_tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(of_tree).alias("n"))
    return placed.join(runs, ["g", "part"]).select(*columns, (F.col("row") + F.col("shift")).alias("idx"), "n")


def climb(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """From the leaves (g, idx, n, h) of trees: the runs (g, p, n, kids) of each level, and the roots (g, level, h).

    ``p`` is the place of the parent of a run, ``n`` the number of nodes on the run's level of its tree.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], nodes.where("n = 1").select("g", F.lit(0).alias("level"), "h")
    while most > 1:
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x.h)
        runs = nodes.where("n > 1").groupBy("g", F.floor(F.col("idx") / FANOUT).alias("p")).agg(F.first("n").alias("n"), kids.alias("kids"))
        levels.append(scratch.put(runs, f"level{len(levels)}"))
        most = -(-most // FANOUT)
        nodes = levels[-1].select("g", F.col("p").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"), digest(F.array_join("kids", "")).alias("h"))
        roots = roots.union(nodes.where("n = 1").select("g", F.lit(len(levels)).alias("level"), "h"))
    return levels, roots


def beside(kids: Column, at: Column) -> Column:
    """The digests on the left and on the right of the child at ``at``."""
    left, right = F.slice(kids, F.lit(1), at), F.slice(kids, at + 2, F.lit(FANOUT))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def push(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(g, p, kids, proof, root columns) of the lowest runs, from the proofs (g, level, proof, ...) of the roots.

    A tree of one leaf has no run: its row has null ``kids``.
    """
    rest = [c for c in tops.columns if c not in ("g", "level", "proof")]
    known = None
    for level in range(len(levels), 0, -1):
        own = tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("p"), "proof", *rest)
        known = own if known is None else own.union(known)
        runs = levels[level - 1].select("g", "p", "kids").join(known, ["g", "p"])
        if level > 1:
            child = runs.select("g", "p", "kids", "proof", *rest, F.posexplode("kids").alias("at", "h"))
            proof = F.concat(F.array(beside(F.col("kids"), F.col("at"))), F.col("proof"))
            known = child.select("g", (F.col("p") * FANOUT + F.col("at")).alias("p"), proof.alias("proof"), *rest)
    lone = tops.where("level = 0").select("g", F.lit(0).cast("long").alias("p"), F.lit(None).cast("array<string>").alias("kids"), "proof", *rest)
    return lone if not levels else lone.union(runs.select("g", "p", "kids", "proof", *rest))


def proofs(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """``leaves`` (g, idx, ...) with their whole proof: pairs of the digests left and right of the way, from the leaf up."""
    names = [c for c in leaves.columns if c not in ("g", "idx")]
    rest = [c for c in runs.columns if c not in ("g", "p", "kids", "proof")]
    at = F.pmod(F.col("idx"), F.lit(FANOUT)).cast("int")
    whole = F.when(F.col("kids").isNull(), F.col("proof")).otherwise(F.concat(F.array(beside(F.col("kids"), at)), F.col("proof")))
    both = leaves.withColumn("p", F.floor(F.col("idx") / FANOUT)).join(runs, ["g", "p"])
    return both.select(*names, whole.alias("proof"), *rest)


def fold(proof: Column, leaf: Column) -> Column:
    """The root that a leaf and the digests beside its way give."""
    return F.aggregate(proof, leaf, lambda h, x: digest(x.left, h, x.right))


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    ``tampered``: the text that a row is checked with, null to leave the row as it is. A row's leaf is the digest of
    its doc_id, source, lang, n_chars and text, ``-`` for nulls. Rows of a source (null is one) ascend by doc_id, null
    first, then by their digests; equal rows are leaves each. A lone leaf is the root of its source, with an empty
    proof there. Texts of any length are read once, and only digests are shuffled. Other columns aren't read. An empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    # the key of a source sorts null first, then by bytes
    g = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(
        F.col("doc_id"), g.alias("g"), leaf_digest().alias("h"), F.when(tampered.isNotNull(), leaf_digest(text=tampered)).alias("other"),
    )
    leaves = ranked(scratch.put(leaves, "leaves"), ["doc_id", "h", "other"], scratch)
    levels, roots = climb(leaves.select("g", "idx", "n", "h"), scratch)
    roots = scratch.put(roots, "roots")
    sources = ranked(roots.select(F.lit("").alias("g"), F.col("g").alias("source"), "level", "h"), ["source"], scratch)
    upper, top = climb(sources.select("g", "idx", "n", "h"), scratch)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    above = push(upper, top.select("g", "level", nothing.alias("proof"), F.col("h").alias("root")))
    tops = proofs(sources.select("g", "idx", "source", "level", F.col("h").alias("subroot")), above)
    tops = scratch.put(tops.select(F.col("source").alias("g"), "level", "proof", "subroot", "root"), "tops")
    every = proofs(leaves.select("g", "idx", "doc_id", "h", "other"), push(levels, tops))
    folded = every.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join(F.transform("proof", lambda x: F.concat(x.left, x.right)), ""), 256).alias("proof_sha256"),
        fold(F.col("proof"), F.coalesce("other", "h")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case, nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest(docs, F.when(chosen, lowered(F.col("text"))))


def _sql(depth: int = 6) -> str:
    """Two trees of ``depth`` levels, level by level: enough for 16 ** depth leaves of a source, and sources."""
    fields = "concat({})".format(", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in FIELDS))
    changed = fields.replace("strlen(CAST(text AS VARCHAR)), ':', text", f"strlen(text), ':', translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {step}), 4294967295)"
    parts = [f"""
d AS (SELECT *, sha256({fields}) AS h, CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND {crc} % 5 = 0 THEN sha256({changed}) END AS other FROM documents),
s0 AS (SELECT coalesce('=' || source, '') AS g, doc_id, h, other, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d)"""]

    def tree(t: str) -> None:
        for k in range(1, depth + 1):
            parts.append(f"""
{t}{k} AS (SELECT g, CASE WHEN n > 1 THEN idx // 16 ELSE idx END AS idx, any_value(CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END) AS n,
  list(h ORDER BY idx) AS kids, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h
  FROM {t}{k - 1} GROUP BY g, CASE WHEN n > 1 THEN idx // 16 ELSE idx END)""")

    def walk(t: str, start: str) -> None:
        """The pairs beside the way of each leaf of ``t``0, an empty pair and no step where a tree has ended."""
        parts.append(f"\n{t}w0 AS ({start})")
        for k in range(1, depth + 1):
            parts.append(f"""
{t}w{k} AS (SELECT w.* REPLACE (CASE WHEN c.n > 1 THEN w.place // 16 ELSE w.place END AS place,
    CASE WHEN c.n > 1 THEN list_append(w.proof, [array_to_string(p.kids[1 : w.place % 16], ''), array_to_string(p.kids[w.place % 16 + 2 :], '')]) ELSE w.proof END AS proof)
  FROM {t}w{k - 1} w JOIN {t}{k - 1} c ON c.g = w.g AND c.idx = w.place JOIN {t}{k} p ON p.g = w.g AND p.idx = CASE WHEN c.n > 1 THEN w.place // 16 ELSE w.place END)""")

    tree("s")
    parts.append(f"\nt0 AS (SELECT '' AS g, g AS source, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM s{depth})")
    tree("t")
    walk("s", "SELECT g, idx AS place, doc_id, h, other, CAST([] AS VARCHAR[][]) AS proof FROM s0")
    walk("t", "SELECT g, idx AS place, source, h AS subroot, CAST([] AS VARCHAR[][]) AS proof FROM t0")
    parts.append(f"""
e AS (SELECT s.doc_id, s.h AS leaf, t.subroot, (SELECT h FROM t{depth}) AS root, list_concat(s.proof, t.proof) AS proof, coalesce(s.other, s.h) AS begun
  FROM sw{depth} s JOIN tw{depth} t ON t.source = s.g),
f AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(flatten(proof), '')) AS proof_sha256,
  list_reduce(list_prepend([begun, ''], proof), lambda a, x: [sha256(x[1] || a[1] || x[2]), ''])[1] AS folded_root FROM e)""")
    return "WITH " + ",".join(parts) + "\nSELECT *, folded_root = root AS verified FROM f"


ORACLE = _sql()
