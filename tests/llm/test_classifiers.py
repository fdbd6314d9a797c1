"""Quality and language against brute force: explicit inverses and determinants, explicit losses; odd columns."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintloom.llm import language, quality

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def brute_probability(x, y, new, own, identity, slope, shift):
    """The same discriminant with covariances by loops, inverted and their determinants taken as they are."""
    n, d = len(x), len(x[0])
    mean = [sum(r[j] for r in x) / n for j in range(d)]
    scale = [math.sqrt(sum((r[j] - mean[j]) ** 2 for r in x) / n) + 1e-9 for j in range(d)]
    z = [[(r[j] - mean[j]) / scale[j] for j in range(d)] for r in x]
    centres, spreads = [], []
    for k in (0, 1):
        some = [r for r, label in zip(z, y, strict=True) if label == k]
        m = [sum(r[j] for r in some) / len(some) for j in range(d)]
        centres.append(m)
        spreads.append((np.array([[sum((r[i] - m[i]) * (r[j] - m[j]) for r in some) / len(some) for j in range(d)] for i in range(d)]), len(some)))
    pooled = sum(s * c for s, c in spreads) / n
    out = []
    for r in new:
        u = np.array([(r[j] - mean[j]) / scale[j] for j in range(d)])
        density = []
        for m, (s, _) in zip(centres, spreads, strict=True):
            cov = (1 - identity) * (own * s + (1 - own) * pooled) + identity * np.eye(d)
            density.append(-0.5 * math.log(np.linalg.det(cov)) - 0.5 * float((u - m) @ np.linalg.inv(cov) @ (u - m)))
        diff = density[1] - density[0]
        out.append(1 / (1 + math.exp(-max(-30, min(30, slope * math.copysign(math.log1p(abs(diff)), diff) + shift)))))
    return out


def test_quality_is_brute_force(spark, docs):
    rows = [r.text for r in docs.orderBy("doc_id").limit(90).collect()]
    x = np.array([quality.statistics(t) for t in rows])
    y = np.array([zlib.crc32(t.encode()) % 3 != 0 for t in rows]).astype(int)
    new = np.array([quality.statistics(t) for t in (None, "", "a", "some words here.", "x" * 3000, rows[3] * 2)])
    for own, identity in ((0.2, 0.05), (0.95, 0.01)):
        model = quality.Discriminant.fit(x, y, own, identity)
        model.slope, model.shift = 0.7, -0.2
        assert np.allclose(model.probability(new), brute_probability(x.tolist(), y.tolist(), new.tolist(), own, identity, 0.7, -0.2), atol=1e-6)


def test_quality_rows_are_the_model_s(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model, prior = quality.learn(docs, labels)
    some = docs.limit(50)
    want = {r.doc_id: float(model.probability(np.array([quality.statistics(r.text)]))[0]) for r in some.collect()}
    for r in quality.score(some, model, prior).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def brute_decode(codes, text):
    """The language of least loss and its score, by loops over n-grams, bits and codewords."""
    found = language.grams(text).tolist()
    margins = [sum(codes.weights[g][b] for g in found) / len(found) if found else 0.0 for b in range(codes.weights.shape[1])]
    losses = [sum(t * math.log(1 + math.exp(-c * m * g)) for c, m, g, t in zip(word, margins, codes.gain, codes.trust, strict=True)) for word in codes.code]
    e = [math.exp(-4 * (x - min(losses))) for x in losses]
    return codes.langs[losses.index(min(losses))], max(e) / sum(e)


def test_language_is_brute_force(spark, docs):
    codes = language.learn(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["a", "Съешь ещё", "the le der que", "x" * 20_000]
    for t, (lang, score, *_) in zip(texts, map(codes.predict, texts), strict=True):
        want, p = brute_decode(codes, t)
        assert lang == want and math.isclose(score, p, rel_tol=1e-6)


def test_codewords_of_many_languages_differ():
    for k in (6, 40, 256):
        code = language.codewords(k)
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= 8
        assert all(len(set(bit)) == 2 for bit in code.T)


def test_a_dirty_column_of_languages(spark):
    """Very many values are learned each; the sample isn't larger for it."""
    rng = random.Random(5)
    rows, word = [], lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 7)))
    sets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 8)) for _ in range(12)]
    for i in range(1200):
        rows.append((i, " ".join(word(sets[i % 12]) for _ in range(30)), f"l{i % 12:02}"))
    rows += [(2000 + i, "odd words here", f"dirty {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("share", F.lit(1)).withColumn("score", F.lit("x"))
    codes = language.learn(df)
    assert codes.langs == sorted({f"l{i:02}" for i in range(12)} | {r[2] for r in rows[1200:] if zlib.crc32(str(r[0]).encode()) % 3 != 1}) and len(codes.langs) > language.SEARCHED // 2
    got = language.predict(df.where("doc_id < 1200"), codes).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95


def test_samples_are_bounded(spark, docs, monkeypatch):
    """20 000 rows of one id, and as many of none, don't exceed what a model is fitted on."""
    from lintloom.llm.common import labelled_sample

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    one = next(r.doc_id for r in labels.orderBy("doc_id").collect() if r.quality == 1 and not held(r.doc_id))
    many = spark.range(20_000).select(F.lit(one).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    none = many.withColumn("doc_id", F.lit(None).cast("long"))
    more = docs.select("doc_id", "text", "lang").union(many).union(none).union(many.limit(1).withColumn("text", F.lit("same")).crossJoin(spark.range(5000)).drop("id"))
    got = labelled_sample(more, labels, "quality", 3, 1, 30).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 30, 1: 30}
    monkeypatch.setattr(language, "SAMPLE", 70)
    sample, langs = language.sample_of(more)
    counts = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert counts == dict.fromkeys(langs, 70)
    monkeypatch.setattr(language, "TOTAL", 2)
    assert language.sample_of(more)[0].groupBy("lang").count().where("count <> 1").count() == 0


def test_only_letters_are_letters(spark, docs):
    codes = language.learn(docs)
    for text in ("½ ²", "Ⅻ ①", "12 34", "_ -", "", None):
        assert codes.predict(text)[0] == "und"
    for text in ("ª", "ʰ", "中", "a1"):
        assert codes.predict(text)[0] != "und"


def test_sparse_counts_are_the_dense_ones():
    """Weights and familiarity from the places that occur, against all places of all languages."""
    rng = np.random.default_rng(2)
    for k in (1, 3, 7):
        counts = [(np.sort(rng.choice(language.PLACES, 50, replace=False)), rng.random(50) * 9) for _ in range(k)]
        codes = language.Codes([f"l{i}" for i in range(k)], counts)
        dense = np.full((k, language.PLACES), 0.5)
        for i, (at, n) in enumerate(counts):
            dense[i, at] += n
        dense /= dense.sum(axis=1, keepdims=True)
        for b, bit in enumerate(codes.code.T):
            if (bit > 0).any() and (bit < 0).any():
                assert np.allclose(codes.weights[:, b], np.log(dense[bit > 0].mean(axis=0) / dense[bit < 0].mean(axis=0)))
        found = rng.integers(0, language.PLACES, 500)
        assert all(np.isclose(codes.familiarity(found, f"l{i}"), np.log(dense[i])[found].mean()) for i in range(k))


FOREIGN = ["Съешь ещё этих мягких французских булок да выпей чаю", "这是一个用中文写成的句子没有空格", "日本語の文章です。これはテストです", "Ελληνικό κείμενο για δοκιμή", "مرحبا بالعالم هذا نص عربي", "Zażółć gęślą jaźń"]


def test_language_stage_takes_its_prediction(spark, docs):
    """Texts in languages that weren't learned go, whatever their length; those of the learned ones stay."""
    import corpus_pipeline as c

    rows = [(900_000 + i, t * n, None, "s", 0) for i, (t, n) in enumerate((t, n) for t in FOREIGN for n in (1, 30))] + [(900_100, "12 34", None, "s", 0)]
    out = c.keep_language(spark, docs.union(spark.createDataFrame(rows, docs.schema)), DATA)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
