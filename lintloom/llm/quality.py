"""Operator 4: quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed document statistics. Each class has a Gaussian whose covariance is shrunk
towards the pooled covariance and the identity; a score is the difference of the log densities, by Mahalanobis
distances from Cholesky factors that are made once, calibrated to a probability. Shrinkage and calibration are chosen
on a part of the sample that the Gaussians haven't seen; then these are fitted again, on all of it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintloom.llm.common import crc_rest, labelled_sample, map_texts, slices, table

#: Texts of each label to learn from, at most about; ids whose crc32 modulo MODULUS is REST are held out.
SAMPLE, MODULUS, REST = 4000, 3, 1
THRESHOLD = 0.5
#: Weights of the class's own covariance and of the identity that are tried; the rest is the pooled covariance.
OWN, IDENTITY = (0.2, 0.5, 0.8, 0.95), (0.001, 0.01, 0.05)

_KIND = np.zeros(256, np.int64)  # 0 letters and other bytes, 1 upper, 2 digit, 3 white, 4 sentence marks, 5 brackets and quotes, 6 other symbols
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
for _c in b".,;:":
    _KIND[_c] = 4
for _c in b"'\"()-":
    _KIND[_c] = 5
for _c in range(33, 127):
    if not _KIND[_c] and not chr(_c).isalnum():
        _KIND[_c] = 6
NAMES = (
    "words", "bytes", "word_bytes", "distinct", "adjacent_repeats", "top_word", "upper", "digits", "white", "marks", "quotes",
    "symbols", "exclamations", "newlines", "short_words", "repeated_lines", "clause_words", "entropy", "longest_word",
)


def statistics(text: str | None) -> list[float]:
    """Statistics of a text, transformed to be nearer to Gaussian: logarithms of sizes, of shares with a floor."""
    raw = (text or "").encode()
    words = (text or "").split()
    n, size = len(words), max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=7) / size
    used = counts[counts > 0] / size
    often = Counter(words)
    lines = [x for x in (text or "").split("\n") if x]
    share = lambda x, floor=1e-3: math.log(x + floor)
    m = max(1, n)
    lengths = list(map(len, words))
    return [
        math.log1p(n), math.log1p(len(raw)), math.log1p(size / m), math.log1p(len(often)) / math.log1p(n) if n else 1.0,
        share(sum(map(str.__eq__, words, words[1:])) / m), share(max(often.values(), default=0) / m, 0.01),
        share(kinds[1]), share(kinds[2]), share(kinds[3], 0.01), share(kinds[4], 0.01), share(kinds[5]), share(kinds[6]), share(counts[33] / size),
        share(counts[10] / size), share(sum(x < 4 for x in lengths) / m, 0.01), share(1 - len(set(lines)) / max(1, len(lines))),
        math.log1p(n / (1 + counts[46] + counts[44])), float(-(used * np.log(used)).sum()), math.log1p(max(lengths, default=0)),
    ]


class Discriminant:
    """Quadratic discriminant of two classes; ``fit`` needs some rows of each."""

    def __init__(self, mean, scale, centres, factors, constants, slope=1.0, shift=0.0):
        self.mean, self.scale, self.centres, self.factors, self.constants = mean, scale, centres, factors, constants
        self.slope, self.shift = slope, shift

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, own: float, identity: float) -> Discriminant:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = (x - mean) / scale
        groups = [z[y == k] for k in (0, 1)]
        centres = [g.mean(axis=0) for g in groups]
        spreads = [np.atleast_2d(np.cov(g, rowvar=False, bias=True)) if len(g) > 1 else np.zeros((z.shape[1],) * 2) for g in groups]
        pooled = sum(s * len(g) for s, g in zip(spreads, groups, strict=True)) / len(z)
        factors, constants = [], []
        for s in spreads:
            cov = (1 - identity) * (own * s + (1 - own) * pooled) + identity * np.eye(len(s))
            low = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(low))
            constants.append(-float(np.log(np.diag(low)).sum()))
        return cls(mean, scale, centres, factors, constants)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density as class 1 less that as class 0."""
        z = (x - self.mean) / self.scale
        density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.centres, self.factors, self.constants, strict=True)]
        return density[1] - density[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        d = self.difference(x)
        # squashed first: far from both classes, densities differ without telling more
        return 1 / (1 + np.exp(-np.clip(self.slope * np.sign(d) * np.log1p(np.abs(d)) + self.shift, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """Fits slope and shift by Newton's method; returns the mean log loss."""
        d = self.difference(x)
        f = np.stack([np.sign(d) * np.log1p(np.abs(d)), np.ones(len(d))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            g = f.T @ (weight * (p - y)) + 1e-3 * w
            h = (f * (weight * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
            w = w - np.linalg.solve(h, g)
        self.slope, self.shift = max(1e-3, float(w[0])), float(w[1])
        p = np.clip(self.probability(x), 1e-6, 1 - 1e-6)
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def fit_best(x: np.ndarray, y: np.ndarray, prior: float) -> Discriminant | None:
    """The discriminant with the least log loss on every third row, when fitted on the others, fitted again on all rows.
    None without both classes.

    ``prior`` is the share of class 1 among all labelled rows; the calibration weighs the sample's rows to match it.
    """
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return None
    # rows are in no order: the third that is kept for choosing is dealt by class
    test = np.zeros(len(y), bool)
    for k in (0, 1):
        test[np.flatnonzero(y == k)[::3]] = True
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    best = None
    for own in OWN:
        for identity in IDENTITY:
            model = Discriminant.fit(x[~test], y[~test], own, identity)
            loss = model.calibrate(x[test], y[test], weight[test])
            if best is None or loss < best[0]:
                best = (loss, own, identity, model)
    _, own, identity, chosen = best
    model = Discriminant.fit(x, y, own, identity)
    model.slope, model.shift = chosen.slope, chosen.shift
    return model


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Discriminant | None, float]:
    """The discriminant and the share of label 1; only vectors of a bounded sample come to the driver."""
    sample = labelled_sample(docs, labels, "quality", MODULUS, REST, SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [statistics(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    rows = sorted((r["x"], r["label"]) for r in sample.mapInArrow(run, "x array<double>, label int").collect())
    counts = labels.where(crc_rest(F.col("doc_id"), MODULUS) != REST).agg(F.count(F.when(F.col("quality") == 1, 1)).alias("a"), F.count(F.when(F.col("quality") == 0, 1)).alias("b")).first()
    prior = (counts["a"] + 0.5) / (counts["a"] + counts["b"] + 1)
    if not rows:
        return None, prior
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return fit_best(x, y, prior), prior


def score(df: DataFrame, model: Discriminant | None, prior: float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each text.

    Null texts count as empty, whose statistics are scored like any others; a null id stays null. Without a model every
    score is the prior. Repeated rows give repeated rows, an empty table none; other columns are not read, so their
    names don't matter. A score on the threshold is predicted 1.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            if model is None:
                p = np.full(batch.num_rows, prior)
            else:
                p = model.probability(np.array([statistics(t) for t in batch.column(2).to_pylist()]))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

        return work

    kind = df.schema[id_col].dataType.simpleString()
    given = df.select(id_col, (crc_rest(F.col(id_col), MODULUS) == REST).alias("held_out"), F.col(text_col).alias("text"))
    return map_texts(given, f"`{id_col}` {kind}, held_out boolean, score double, predicted int", make)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *learn(docs, table(spark, sf_dir, "labels")))
