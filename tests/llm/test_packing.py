"""Packed pieces against the tokenizer, exhaustive fills, and texts that are far longer than a window."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintloom.llm import bpe, packing
from tests.llm.brute import check_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "Ünï cödé 日本語 😀"), (5, "Ünï cödé 日本語 😀"), (None, "the end"), (7, "word " * 30000), (8, "x" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", F.lit(1).alias("length"), F.lit("x").alias("uid"), F.lit(2).alias("grp"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_packing(docs):
    coder = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    some = docs.where("doc_id < 400")
    ids = {r.doc_id: np.append(coder.encode([r.text])[0], 0).astype("<u4") for r in some.collect()}
    rows = packing.pack(some).collect()
    assert check_pieces(rows, {k: len(v) for k, v in ids.items()}) < 0.02
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in rows)


def test_packing_odd_rows(odd):
    rows = packing.pack(odd.where("doc_id <> 5")).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 7, 8} and next(r for r in rows if r.doc_id == 1).doc_tokens == 1
    assert packing.pack(odd.limit(0)).count() == 0


def test_best_fill_is_best():
    rng = random.Random(8)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 7))]
        target = rng.randint(0, 40)
        counts = np.bincount(sizes, minlength=64)
        got = packing.best_fill(counts, target)
        best = max(s for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if (s := sum(c)) <= target)
        assert sum(a * b for a, b in got) == best and all(counts[a] >= b for a, b in got)


def test_few_huge_texts_are_not_one_group(spark):
    """What fills whole windows is placed by the task that cuts it: only rests, one a document, are dealt."""
    some = spark.createDataFrame([(i, "word next " * 4000 + "x " * i) for i in range(6)], "doc_id long, text string")
    rows = packing.pack(some, capacity=64, group_rows=4).collect()
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    check_pieces(rows, tokens, 64)
    whole = [r for r in rows if r.sequence_id >= packing.WHOLE]
    assert len(whole) == sum(n // 64 for n in tokens.values()) and all(r.length == 64 and r.offset == 0 for r in whole)
    assert len(rows) - len(whole) <= 6


def test_packed_ids_are_those_of_tokenizers(docs):
    from tokenizers import Tokenizer

    file = public_tokenizers.path(packing.RANK_FILE)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = [r.text or "" for r in docs.select("text").collect()] + ["", " \n\t x", "<|endoftext|>", "é" * 5000, "a  b   c    ", " " * 300_000 + "x"]
    for text in texts:
        assert packing.token_ids(text, file).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packed_ids_hold_added_tokens(spark):
    from tokenizers import Tokenizer

    file, end = public_tokenizers.path(packing.RANK_FILE), "<|endoftext|>"
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = [end, f"a {end} b", f"{end}{end}", f"a  {end}  b \n", f"<|end{end}oftext|>", "<|endoftext", " " * 300_000 + f"x{end} y", "plain", ""]
    want = [tok.encode(x, add_special_tokens=False).ids for x in some]
    assert want[1] == [64, 220, 50256, 275]
    assert [packing.token_ids(x, file, added=True).tolist() for x in some] == want
    rows = packing.pack(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), capacity=1 << 20).collect()
    packed = {r.doc_id: (r.length, r.doc_tokens, r.ids_crc32) for r in rows}
    assert packed == {k: (len(x) + 1, len(x) + 1, zlib.crc32(np.array([*x, packing.END_ID], "<u4").tobytes())) for k, x in enumerate(want)}
