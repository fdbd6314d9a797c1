"""The ten operators: brute force, round trips and held-out accuracy, and rows that are null, empty, repeated or long."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintloom.llm import bpe, bpe_ops, chat, common, language, license_scan, near_dup, ogg, packing, quality, topk, toxicity
from tests.llm.brute import check_pieces
from tests.llm.brute import components as brute_components

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "Ünï cödé 日本語 😀"), (5, "Ünï cödé 日本語 😀"), (None, "the end"), (7, "word " * 30000), (8, "x" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every awkward kind, with further columns whose names clash with results."""
    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", F.lit("x").alias("score"), F.lit(1).alias("n"), F.lit("en").alias("lang"), F.lit("s").alias("sketch"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(docs, n=400):
    return [r.text for r in docs.orderBy("doc_id").limit(n).collect()]


SPACES = ["", " ", "  a", "a  b", "a   b", "a\n b", "a \nb", "a\n \nb", "a ", "a\n ", "\n x\t y  \n", "it's I'll 12345 ab1", "z" * 129 + " " + "qwxz" * 40, "aaaa" * 300, "a\x1c b\x85 c\xa0d"]


@pytest.mark.parametrize("file", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_is_tiktoken(docs, file):
    import tiktoken

    coder = bpe.load(public_tokenizers.path(file))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    some = texts(docs, 300) + SPACES
    ids = coder.encode(some)
    assert all(theirs.encode_ordinary(t) == x.tolist() and coder.decode(x) == t.encode() for t, x in zip(some, ids, strict=True))


def test_bpe_is_tokenizers(docs):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    some = texts(docs, 200) + SPACES + ["<|endoftext|>"]
    ours = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode(some)
    assert [e.ids for e in theirs.encode_batch(some, add_special_tokens=False)] == [x.tolist() for x in ours]


def test_bpe_odd_rows(odd):
    got = bpe_ops.encode(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 0 and by[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[7].decoded_sha256 == hashlib.sha256(dict(ODD)[7].encode()).hexdigest()


def crc_slow(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg_checksum_and_damage():
    data = bytes(random.Random(1).randbytes(200))
    assert ogg.page_checksum(data) == crc_slow(data)
    payload = random.Random(2).randbytes(192 * 2000)
    stored = ogg.mux(payload)
    assert ogg.read(stored)[0] == payload
    for at in (5, 30, 1000, len(stored) - 1):
        with pytest.raises(ogg.OggError):
            ogg.read(stored[:at] + bytes([stored[at] ^ 1]) + stored[at + 1 :])
    with pytest.raises(ogg.OggError):
        ogg.read(stored[:-100])


def test_ogg_continued_packets():
    payload = bytes(range(256)) * 600
    assert ogg.read(ogg.mux(payload, block=70_000))[0] == payload
    assert ogg.read(ogg.mux(payload, block=255 * 4))[0] == payload


def test_ogg_every_size():
    for size in [*range(ogg.UNIT, 300_000, ogg.UNIT), *range(1_000_128, 10_000_000, 1_000_128)]:
        payload = bytes(size)
        assert ogg.read(ogg.mux(payload))[0] == payload, size


def test_ogg_odd_rows(odd):
    for r in ogg.media(odd).collect():
        raw = (dict(ODD)[r.doc_id] or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and ogg.read(r.media)[0] == want


def test_chat_template_is_reversible():
    rng = random.Random(3)
    bits = ["[", "<", "\\", "INST]", "/INST]", "s>", "/s>", "</s>", "[INST] ", " [/INST]", "<<ROLE:", "<</ROLE>>", "<ROLE:", "/ROLE>>", "a", " ", "\n"]
    for _ in range(20_000):
        turns = [(rng.choice(["user", "assistant", "system", ""]), "".join(rng.choices(bits, k=rng.randint(0, 6)))) for _ in range(3)]
        whole = "".join(chat.render(*t)[0] for t in turns)
        assert [(r, chat.unescape(whole[a:b])) for r, a, b in chat.parse(whole)] == turns


def test_near_dup_large_groups_lose_no_link(spark):
    """A hot passage, a chain of near copies that don't all reach each other, and exact copies, past the all-pairs size."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, base, passage = [], [word() for _ in range(60)], [word() for _ in range(30)]
    for i in range(120):
        base = base.copy()
        base[rng.randrange(60)] = word()
        rows.append((i, " ".join(base)))
    rows += [(200 + i, " ".join(passage + [word() for _ in range(rng.randint(0, 40))])) for i in range(60)]
    rows += [(300 + i, "Same text in ALL of these " + "rows " * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_near_dup_odd_rows(odd):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (1, 2, 3))
    assert by[5].component_id == 5 and by[7].n_shingles == 1 and by[None].component_id is None and not by[None].kept
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_sketch_never_rules_out_a_link():
    rng = np.random.default_rng(5)
    for n in (1, 3, 10, 100, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for part in (0.7, 0.76, 0.9, 1.0):
            b = np.unique(np.concatenate([a[: int(len(a) * part)], rng.integers(0, 2**63, int(n * 0.1)).astype(np.uint64)]))
            if len(b) and near_dup.linked(a, b):
                assert near_dup.may_link(len(a), near_dup.sketch(a), len(b), near_dup.sketch(b))


def test_kd_tree_is_exact_over_leaves():
    rng = np.random.default_rng(7)
    data, queries = rng.integers(-300, 300, (2000, 8)), rng.integers(-300, 300, (20, 8))
    data[500:1500] = data[0]  # one very common vector
    ids = rng.permutation(2000)
    for i, who, scores in topk.KdTree(data, 16).search(data, ids, queries, np.full(20, -1), np.full(20, topk.NONE), 10):
        all_scores = data @ queries[i]
        best = np.lexsort((ids, -all_scores))[:10]
        assert sorted(zip(-scores, who, strict=True)) == sorted(zip(-all_scores[best], ids[best], strict=True))


def accuracy(rows, want, column):
    held = [(r[column], want[r.doc_id]) for r in rows if r.held_out and r.doc_id in want]
    return sum(a == b for a, b in held) / len(held)


def test_held_out_accuracy(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert accuracy(language.predict(docs, language.learn(docs)).collect(), lang, "lang_pred") > 0.97
    known = {r.doc_id: r for r in labels.collect()}
    assert accuracy(quality.score(docs, *quality.learn(docs, labels)).collect(), {k: r.quality for k, r in known.items()}, "predicted") > 0.95
    assert accuracy(toxicity.score(docs, toxicity.learn(docs, labels)).collect(), {k: r.toxic for k, r in known.items()}, "predicted") > 0.9


def test_learned_operators_odd_rows(spark, odd, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    codes = language.learn(docs)
    by = {r.doc_id: r for r in language.predict(odd, codes).collect()}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3)) and by[4].lang_pred != "und"
    scored = [quality.score(odd, *quality.learn(docs, labels)), toxicity.score(odd, toxicity.learn(docs, labels))]
    # nothing to learn from
    none = labels.limit(0)
    scored += [quality.score(odd, *quality.learn(odd, none)), toxicity.score(odd, toxicity.learn(odd, none))]
    for df in scored:
        rows = df.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert language.predict(odd, language.learn(odd.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_grammar_contexts():
    g = toxicity.Grammar({"=fool": 3.0, "scoun": 2.0}, {"negated": -2.0, "reported": -1.0, "targeted": 0.5}, -1.0, -4.0)
    assert g.read("you fool! he is a fool. not a fool; they said he is a fool\nscoundrels scounx foolish") == [
        ("=fool", "targeted"), ("=fool", "targeted"), ("=fool", "negated"), ("=fool", "reported"), ("scoun", "plain"), ("scoun", "plain")]
    assert g.score("a fool")[0] > g.score("not a fool")[0] > g.score("nothing")[0] == g.score(None)[0]


def test_codewords_differ():
    for k in (2, 3, 4, 5, 9):
        code = language.codewords(k)
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= (1 if k == 2 else 2)


def test_id_bitmap_never_misses(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "doc_id")
    flagged = common.flag_ids(spark.range(5000).withColumnRenamed("id", "doc_id"), ids).where("flagged")
    assert ids.join(flagged, "doc_id", "left_anti").count() == 0 and flagged.count() < 800


def test_pipeline_against_its_operators(spark, docs):
    import corpus_pipeline as c

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, *quality.learn(docs, labels)).where("predicted = 1").collect()}
    first = docs.where(F.col("doc_id").isin(sorted(good)))
    spoken = {r.doc_id for r in language.predict(first, language.learn(first)).where("lang_pred <> 'und'").collect()}
    second = [(r.doc_id, r.text) for r in first.collect() if r.doc_id in spoken]
    kept = {i for i, (_, root) in brute_components(second).items() if root == i}
    rows = c.run(spark, DATA).collect()
    assert {r.doc_id for r in rows} == kept
    coder = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert check_pieces(rows, {i: len(coder.encode([t or ""])[0]) + 1 for i, t in second if i in kept}) < 0.02
    stage = dict(c.STAGES)["near_dup"](spark, docs.union(docs.where("doc_id < 5")).withColumn("kept", F.lit(1)), DATA)
    assert stage.columns == [*docs.columns, "kept"] and stage.groupBy("doc_id").count().where("count > 1").count() == 0
