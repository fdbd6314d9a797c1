"""J-10: documents that hold a benchmark text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintloom.functions.text import normalize_space
from lintloom.sources.scratch import Scratch

#: Characters of all benchmark texts together up to which every task gets an automaton of them (about 100 bytes each).
SMALL_CHARS = 2_000_000
#: Bits of the filter of anchors: 2 MB at most.
FILTER_BITS = 1 << 23
#: Characters of an anchor in texts without an inner word.
GRAM = 3


def contaminated(docs: DataFrame, benchmark: DataFrame, small_chars: int = SMALL_CHARS) -> DataFrame:
    """doc_id of each document whose normalised text contains a normalised benchmark text that isn't empty.

    Up to ``small_chars`` characters of benchmark, one pass over the documents searches for all texts at once. Beyond,
    documents are joined with the texts by an anchor, see ``by_anchor``. Both give the same rows.
    """
    items = benchmark.select(normalize_space(F.col("text")).alias("item")).where("item <> ''").distinct()
    texts = docs.select("doc_id", normalize_space(F.col("text")).alias("body"))
    if items.agg(F.coalesce(F.sum(F.length("item")), F.lit(0))).first()[0] > small_chars:
        return by_anchor(texts, items)
    found = sorted(r["item"] for r in items.collect())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = ahocorasick.Automaton()
        for item in found:
            search.add_word(item, True)
        if found:
            search.make_automaton()
        for pdf in batches:
            yield pdf.loc[[bool(found) and isinstance(t, str) and next(search.iter(t), None) is not None for t in pdf["body"]], ["doc_id"]]

    return texts.mapInPandas(run, texts.select("doc_id").schema)


def _grams(text: Column) -> Column:
    """All runs of up to GRAM characters, each once."""
    # a look ahead matches at every place without using it up
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in range(1, GRAM + 1))))


def by_anchor(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The same for benchmarks of any size, over (doc_id, body) and (item).

    A word inside a text (not its first or last) is a whole word of any document that holds the text: its anchor is the
    inner word that the fewest documents have. Texts without one have a run of a few characters for an anchor. Words of
    documents that a bitmap of bounded size knows from no text are dropped where they are made, and only ids and
    anchors are shuffled; a document's text meets the few texts whose anchor it has.
    """
    scratch = Scratch(texts.sparkSession)
    words = items.withColumn("w", F.split("item", " ")).withColumn("inner", F.array_distinct(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))))
    short = F.size("inner") == 0
    own = F.when(short, F.array(F.substring("item", 1, GRAM))).otherwise(F.col("inner"))
    anchors = scratch.put(words.select(F.xxhash64("item").alias("id"), "item", short.alias("short"), own.alias("anchors")), "anchors")
    with_short = anchors.where("short").limit(1).count() > 0
    known = anchors.select(F.explode("anchors").alias("a")).distinct()
    place = F.pmod(F.xxhash64("a"), F.lit(FILTER_BITS))
    bits = known.select(F.floor(place / 64).cast("int").alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit")).withColumn("one", F.expr("1L"))
    bits = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))  # FILTER_BITS / 64 rows at most
    parts = F.split("body", " ")
    every = F.array_distinct(F.concat(parts, _grams(F.col("body"))) if with_short else parts)
    each = texts.where("body IS NOT NULL").select("doc_id", F.explode(every).alias("a"))
    marked = each.withColumn("word", F.floor(place / 64).cast("int")).join(F.broadcast(bits), "word")
    some = marked.where(F.expr(f"shiftright(bits, cast(pmod(xxhash64(a), {FILTER_BITS}) % 64 as int)) & 1L") == 1).select("doc_id", "a")
    held = scratch.put(some.join(known, "a", "left_semi"), "held")
    counts = held.groupBy("a").agg(F.count("*").alias("n"))
    least = anchors.select("id", "item", F.explode("anchors").alias("a")).join(counts, "a").groupBy("id", "item").agg(
        F.min(F.struct("n", "a")).alias("least"), F.count("*").alias("found")
    )
    # an inner word that no document has rules the text out
    least = least.join(anchors.select("id", "item", F.size("anchors").alias("all")), ["id", "item"]).where("found = all")
    pairs = held.join(least.select("item", F.col("least.a").alias("a")), "a").select("doc_id", "item").distinct()
    return texts.join(pairs, (texts["doc_id"] == pairs["doc_id"]) & F.contains(texts["body"], pairs["item"]), "left_semi").select("doc_id")
