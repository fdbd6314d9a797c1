"""Operator 9: language ID by error-correcting output codes.

Each language has a codeword. A binary classifier for each bit tells from the n-grams of a text whether the bit is set:
its weights are log ratios of n-gram frequencies among the languages that have the bit and those that haven't. Decoding
chooses the codeword with the least weighted logistic loss; a text whose two best codewords are nearly as good is
flagged as ambiguous. One whose n-grams are far rarer in the chosen language than those of nearly all texts that it was
learned from is flagged as strange: no codeword stands for its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintloom.llm.common import crc_rest, map_texts, slices, table

#: Texts of each language to learn from at most, and of all (but one of each language, however many there are); ids whose crc32 modulo MODULUS is REST are held out.
SAMPLE, TOTAL, MODULUS, REST = 1500, 60_000, 3, 1
#: Languages up to which the best of many random codes is looked for; beyond, one code of as many bits is far enough apart.
SEARCHED = 256
#: Languages whose frequencies a task keeps at hand.
LOGS = 64
#: n-grams are hashed to so many places.
PLACES = 1 << 14
#: Two codewords are nearly as good within this share of probability.
AMBIGUOUS = 0.1
#: A text is strange if the mean log frequency of its n-grams is this far below that of all but such a share of texts.
STRANGE, STRANGE_SHARE = 2.5, 0.001
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")
#: Bytes other than letters count as blank; ASCII letters in lower case; bytes of other scripts stay.
_FOLD = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Places of the text's byte bigrams and trigrams."""
    b = np.frombuffer(b" " + text.encode().translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
    keep2, keep3 = (b[:-1] != 32) | (b[1:] != 32), (b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))
    both = np.concatenate([two[keep2], three[keep3]])
    both ^= both >> np.uint32(15)
    return (both * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k codewords of -1 and 1: all bits that split the languages, for up to five; the best of random codes for up to
    SEARCHED; else one random code whose words all differ."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 5:
        bits = np.arange(1, 1 << k - 1)
        return np.where(np.array([[b >> i & 1 for b in bits] for i in range(k)]), 1.0, -1.0)
    rng, n = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(k)))
    while k > SEARCHED:
        code = np.where(rng.random((k, n)) < 0.5, np.int8(-1), np.int8(1))
        if len(np.unique(code, axis=0)) == k:
            return code
    best, apart = None, -1
    for _ in range(200):
        code = np.where(rng.random((k, n)) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(axis=0)) < k]
        differ = (code.shape[1] - code @ code.T) / 2
        d = int(differ[np.triu_indices(k, 1)].min())
        if d > apart:
            best, apart = code, d
    return best


class Codes:
    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: of each language, the places that its n-grams have and how many; 0.5 is added at every place."""
        self.langs, self.code, self.counts = langs, codewords(len(langs)), counts
        self.at = {lang: i for i, lang in enumerate(langs)}
        bits = self.code.shape[1]
        self.sums = np.array([n.sum() for _, n in counts]) + 0.5 * PLACES
        # frequencies are summed over the languages with a bit and without it: what all places have, and what some have
        side = np.stack([self.code > 0, self.code < 0]).astype(float)
        total = np.einsum("skb,k->sb", side, 0.5 / self.sums)[:, None, :].repeat(PLACES, axis=1)
        for i, (places, n) in enumerate(counts):
            total[:, places] += (n / self.sums[i])[None, :, None] * side[:, i, None, :]
        held = side.sum(axis=1)
        both = (held > 0).all(axis=0)
        self.weights = np.ones((PLACES, bits))
        self.weights[:, both] = np.log(total[0][:, both] / held[0, both]) - np.log(total[1][:, both] / held[1, both])
        self.gain, self.trust = np.full(bits, 20.0), np.ones(bits)
        self.logs, self.floor = {}, -np.inf

    def margins(self, text: str) -> np.ndarray:
        """Of each bit: the mean weight of the text's n-grams."""
        return self._margins(grams(text))

    def familiarity(self, found: np.ndarray, lang: str) -> float:
        """The mean log frequency of n-grams in a language; 0 without any."""
        return float(self._logs(lang)[found].mean()) if len(found) else 0.0

    def _logs(self, lang: str) -> np.ndarray:
        """The log frequency of every place in a language. Those of the languages used last are kept, LOGS of them."""
        if lang not in self.logs:
            if len(self.logs) >= LOGS:
                self.logs.pop(next(iter(self.logs)))
            i = self.at[lang]
            places, n = self.counts[i]
            own = np.full(PLACES, 0.5)
            own[places] += n
            self.logs[lang] = np.log(own / self.sums[i])
        return self.logs[lang]

    def _margins(self, found: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.zeros(self.weights.shape[1])
        if len(found) < PLACES // 4:
            return self.weights[found].mean(axis=0)
        return np.bincount(found, minlength=PLACES) @ self.weights / len(found)

    def tune(self, margins: np.ndarray, langs: list[str]) -> None:
        """Trust in each bit by its errors on the sample, and a gain that gives its margins the scale of log odds."""
        truth = self.code[[self.at[x] for x in langs]]
        for b in range(truth.shape[1]):
            right = margins[:, b] * truth[:, b]
            wrong = ((right <= 0).sum() + 0.5) / (len(right) + 1)
            self.trust[b] = max(0.05, np.log((1 - wrong) / wrong) if wrong < 0.5 else 0.05)
            self.gain[b] = 3.0 / max(1e-6, float(np.median(np.abs(margins[:, b]))))
        self.trust /= self.trust.sum()

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        loss = np.logaddexp(0, -self.code * (margins * self.gain)) @ self.trust
        p = np.exp(-(loss - loss.min()) * 4)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        near = len(p) > 1 and p[order[0]] - p[order[1]] < AMBIGUOUS
        return self.langs[order[0]], float(p[order[0]]), bool(near)

    def predict(self, text: str | None) -> tuple[str, float, bool, bool]:
        """(language, score, whether it is ambiguous, whether it is strange)."""
        if not text or not LETTER.search(text) or not self.langs:
            return UNKNOWN, 0.0, False, False
        found = grams(text)
        lang, score, near = self.decode(self._margins(found))
        return lang, score, near, self.familiarity(found, lang) < self.floor


def sample_of(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(text, lang) to learn from, and all languages. Of a language the rows with the least hash of id and text, and no
    more than SAMPLE, or its share of TOTAL where there are many; one at least. Rows equal in id and text count once,
    whatever the id, so neither a repeated id nor null ids can exceed the bound."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_rest(F.col("doc_id"), MODULUS) != REST))
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    each = max(1, min(SAMPLE, TOTAL // max(1, len(langs))))
    hashed = known.select("text", "lang", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("h"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    few = hashed.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "h")
    if len(langs) <= TOTAL:  # so few rows at most
        few = F.broadcast(few)
    return hashed.join(few, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang"), langs


def learn(docs: DataFrame) -> Codes | None:
    """Codes from texts of every language, see ``sample_of``. None without any."""
    sample, langs = sample_of(docs)
    if not langs:
        return None
    sample = sample.persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(grams(text), minlength=PLACES)
                total[lang] = total.get(lang, 0) + found / max(1.0, found.sum())  # long texts don't outweigh others
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.float64())], names=["lang", "place", "n"])

    try:
        rows = sample.mapInArrow(count, "lang string, place int, n double").groupBy("lang", "place").agg(F.sum(F.round("n", 9)).alias("n")).toPandas()
        found = {lang: (own["place"].to_numpy(), own["n"].round(6).to_numpy() * 1000) for lang, own in rows.sort_values("place").groupby("lang")}
        nothing = np.empty(0, np.int64), np.empty(0)
        codes = Codes(langs, [found.get(lang, nothing) for lang in langs])

        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                each = [grams(t) for t in batch.column(0).to_pylist()]
                found = [codes._margins(g).tolist() for g in each]
                usual = [codes.familiarity(g, lang) for g, lang in zip(each, batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1), pa.array(usual, pa.float64())], names=["m", "lang", "usual"])

        seen = sample.mapInArrow(margins, "m array<double>, lang string, usual double").collect()
    finally:
        sample.unpersist()
    if seen:
        codes.tune(np.array([r["m"] for r in seen]), [r["lang"] for r in seen])
        codes.floor = float(np.quantile([r["usual"] for r in seen], STRANGE_SHARE)) - STRANGE
    return codes


def predict(df: DataFrame, codes: Codes | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous and strange of each text.

    A text that is null or has no letter is ``und`` with score 0, as is every text where nothing was learned; a null id
    stays null. Of equally good languages the first by name is chosen. Repeated rows give repeated rows, an empty table
    none; other columns are not read, so their names don't matter.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [codes.predict(t) if codes else (UNKNOWN, 0.0, False, False) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], names=[id_col, "held_out", "lang_pred", "score", "ambiguous", "strange"])

        return work

    kind = df.schema[id_col].dataType.simpleString()
    given = df.select(id_col, (crc_rest(F.col(id_col), MODULUS) == REST).alias("held_out"), F.col(text_col).alias("text"))
    return map_texts(given, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean, strange boolean", make)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
