"""Operator 1: toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause side by side: insults and threats (words, stems and phrases, as a trie over
words), targets, negations and reported speech. They are composed with one that holds a match back for some words, as a
target may follow it, into one deterministic transducer, whose output for a match is its context: an insult is plain,
targeted, negated or reported, a threat idle without a target. Matches have the weight of their entry and of their
context; a clause's score is the sum over its different matches. A text's log odds are those of any text and the scores
of its clauses, the heaviest first, where a match that an earlier clause had isn't counted again.

The lexicon (words, stems and pairs of words) and all weights are learned from a bounded sample of labelled texts. An
entry must be rare in clean texts and stand between many different pairs of neighbours in toxic ones, so that words
which only ride along with copies of a toxic text stay out. Pairs of words are looked for in toxic texts that no single
word explains. Clauses without any word that an entry begins or ends with can't have a match and aren't read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintloom.llm.common import crc_rest, labelled_sample, map_texts, slices, table

#: Texts of each label to learn from, at most about; ids whose crc32 modulo MODULUS is REST are held out.
SAMPLE, MODULUS, REST = 4000, 4, 2
THRESHOLD = 0.3
#: Letters of a stem, least and most; toxic texts and pairs of neighbours that an entry needs, and times it must be likelier in toxic texts.
STEMS, MIN_TEXTS, MIN_NEIGHBOURS, MIN_RATIO = (4, 6), 4, 6, 10.0
#: Pairs of neighbours for each toxic text that has the entry, at least.
MIN_SPREAD = 0.6
#: Log likelihood by which an entry's counts must differ from chance: among very many candidates some differ by a little.
MIN_EVIDENCE = 12.0
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]")

#: Fixed word classes of the grammar, in the languages of the texts.
NEGATION = frozenset("not never no isn aren wasn weren don doesn nobody nicht kein keine keinen nie niemals pas jamais aucun nunca jamás".split())
REPORT = frozenset("said says say told wrote writes claimed claims called reported quoted sagte sagt schrieb behauptet nannte dit disait écrit prétend dijo dice escribió llamó".split())
TARGET = frozenset("you your yours you're they them he she him her these those people everyone du dich dir ihr euch sie tu vous te toi ils elles tú usted ustedes vosotros ellos ellas".split())
THREAT = frozenset("kill murder destroy hurt hang shoot stab strangle beat burn töten umbringen ermorden vernichten erschießen tuer assassiner détruire matar asesinar destruir".split())
#: Threats of several words; they hold their target.
THREAT_PHRASES = (("watch", "your", "back"), ("burn", "in", "hell"), ("drop", "dead"), ("go", "die"), ("kill", "yourself"), ("hope", "you", "die"), ("sleep", "with", "the", "fishes"))
#: Words over which negation reaches; words within which a target counts, on either side of a match.
NEGATION_SCOPE, TARGET_SCOPE = 3, 3
#: What a context adds to a weight before anything is learned, and how many matches that belief is worth.
CONTEXTS = {"plain": 0.0, "targeted": 0.5, "negated": -1.5, "reported": -1.0}
BELIEF = 20.0
#: The same of threats, of which most samples hold few: the weights of a threat at a target and of one without.
THREATS, THREAT_BELIEF = {"threat": 3.0, "idle": 0.0}, 2.0
END = ("end", None)

# --- transducers: step(state, kind) gives the next state and what the word stands in, or that it is a target


def _negation(state: int, kind: str) -> tuple[int, bool]:
    if kind == "neg":
        return NEGATION_SCOPE, False
    return max(0, state - 1), state > 0


def _report(state: int, kind: str) -> tuple[int, bool]:
    # bit 0: after a verb of speech; bit 1: within quotation marks
    if kind == "say":
        state |= 1
    elif kind == "quote":
        state ^= 2
    return state, state > 0


def _target(state: int, kind: str) -> tuple[int, bool]:
    if kind == "target":
        return TARGET_SCOPE, False
    return max(0, state - 1), state > 0


class Trie:
    """The transducer of insults and threats: words of phrases lead from node to node, back to the longest beginning that fits."""

    def __init__(self, phrases: dict[tuple[str, ...], str]):
        self.phrases = phrases
        self.nodes = {p[:n] for p in phrases for n in range(len(p) + 1)} | {()}
        self.words = {w for p in phrases for w in p}

    def step(self, node: tuple[str, ...], kind: str, word: str | None) -> tuple[tuple[str, ...], str, tuple[str, ...] | None]:
        """(next node, kind of match that ends here or "", phrase that ends here). A phrase goes before a word of its own."""
        run = (*node, word) if word is not None else ()
        while run and run not in self.nodes:
            run = run[1:]
        tail = run
        while tail and tail not in self.phrases:
            tail = tail[1:]
        if tail:
            return run, self.phrases[tail], tail
        return run, kind if kind in ("insult", "threat") else "", None


def _delay(held: tuple, match: str, negated: bool, reported: bool, near: bool, target: bool) -> tuple[tuple, list[tuple[int, str]]]:
    """The last transducer: (matches still held back, [(words back, context)]). ``held`` has (words back, kind) of each."""
    out, left = [], []
    for back, kind in held:
        if target:
            out.append((back + 1, "threat" if kind == "threat" else "targeted"))
        elif back + 1 == TARGET_SCOPE:
            out.append((back + 1, "idle" if kind == "threat" else "plain"))
        else:
            left.append((back + 1, kind))
    if match:
        if negated or reported:
            out.append((0, "negated" if negated else "reported"))
        elif match == "menace" or near:
            out.append((0, "targeted" if match == "insult" else "threat"))
        else:
            left.append((0, match))
    return tuple(left), out


class Composed:
    """All transducers as one machine over symbols (kind, word of a phrase or None); a transition is made when first used."""

    def __init__(self, phrases: dict[tuple[str, ...], str] | None = None):
        self.trie = Trie(phrases or {})
        start = ((), 0, 0, 0, ())
        self.states, self.names, self.table = {start: 0}, [start], {}

    def step(self, state: int, symbol: tuple[str, str | None]) -> tuple[int, tuple[tuple[int, str], ...], tuple[str, ...] | None]:
        found = self.table.get((state, symbol))
        if found is None:
            node, neg, rep, tgt, held = self.names[state]
            kind, word = symbol
            if symbol == END:
                name, phrase = self.names[0], None
                out = [(back + 1, "idle" if k == "threat" else "plain") for back, k in held]
            else:
                node, match, phrase = self.trie.step(node, kind, word)
                neg, negated = _negation(neg, kind)
                rep, reported = _report(rep, kind)
                tgt, near = _target(tgt, kind)
                held, out = _delay(held, match, negated, reported, near, kind == "target")
                name = (node, neg, rep, tgt, held)
            if name not in self.states:
                self.states[name] = len(self.names)
                self.names.append(name)
            found = self.table[state, symbol] = (self.states[name], tuple(out), phrase)
        return found

    def run(self, symbols: list[tuple[str, str | None]]) -> list[tuple[int, tuple[str, ...] | None, str]]:
        """(place, phrase or None for the word there, context) of each match of a clause."""
        state, out, phrases = 0, [], {}
        for i, symbol in enumerate([*symbols, END]):
            state, told, phrase = self.step(state, symbol)
            if phrase is not None:
                phrases[i] = phrase
            out += [(i - back, phrases.get(i - back), context) for back, context in told]
        return sorted(out, key=lambda m: m[0])


def word_class(word: str) -> str:
    if word in THREAT:
        return "threat"
    if word in NEGATION:
        return "neg"
    if word in REPORT:
        return "say"
    if word in TARGET:
        return "target"
    return "quote" if not word[0].isalpha() else ""


class Grammar:
    """Lexicon entries are words ("=word"), stems ("stem") or words in a row ("=one two"); ``weights`` has a log
    likelihood ratio for each, ``contexts`` one for each context.

    ``prior`` is the log odds that a text is toxic, ``no_match`` those of a text without a match. ``triggers`` gives
    for a phrase the word whose clauses are searched for it, its first one by default.
    """

    def __init__(self, weights: dict[str, float], contexts: dict[str, float], prior: float, no_match: float, triggers: dict[str, str] | None = None):
        self.weights, self.context_weights, self.prior, self.no_match = weights, contexts, prior, min(prior, no_match)
        phrases = {p: "menace" for p in THREAT_PHRASES} | {tuple(e[1:].split()): "insult" for e in weights if " " in e}
        self.machine = Composed(phrases)
        self.search = ahocorasick.Automaton()
        found = {e.lstrip("="): [e] for e in weights if " " not in e}
        for e in weights:
            if e[0] == "=" and e[1:] in weights:
                found[e[1:]] = [e[1:], e]
        begin = {(triggers or {}).get("=" + " ".join(p), p[0]) for p in phrases}
        for word in sorted({*found, *THREAT, *begin}):
            self.search.add_word(word, (word, found.get(word, []), word in THREAT or word in begin))
        self.search.make_automaton()

    def matches(self, text: str) -> list[tuple[int, str]]:
        """(place of the word, entry) of the longest entry at the start of each word; no entry for a word that may only be part of one."""
        best: dict[int, str] = {}
        for last, (word, entries, begins) in self.search.iter(text):
            start = last - len(word) + 1
            if start and text[start - 1].isalpha():
                continue
            whole = last + 1 == len(text) or not text[last + 1].isalpha()
            if begins and whole:
                best.setdefault(start, "")
            for entry in entries:
                if (whole or entry[0] != "=") and len(word) >= len(best.get(start, "").lstrip("=")):
                    best[start] = entry
        return sorted(best.items())

    def clauses(self, text: str | None) -> list[list[tuple[str, str]]]:
        """(entry, context) of the matches of each clause that has any."""
        text = (text or "").lower()
        found, out, at, end = self.matches(text), [], 0, 0
        while at < len(found):
            # searched back no further than the end of the clause before, so that no text is read twice
            start = max(end, *(text.rfind(c, end, found[at][0]) + 1 for c in ".!?;:\n"))
            close = CLAUSE.search(text, found[at][0])
            end = close.start() if close else len(text)
            own = {}
            while at < len(found) and found[at][0] < end:
                own[found[at][0]] = found[at][1]
                at += 1
            words, symbols = [], []
            for m in TOKEN.finditer(text, start, end):
                word = m[0]
                kind = word_class(word)
                if own.get(m.start()) and kind != "threat":
                    kind = "insult"
                words.append((word, own.get(m.start())))
                symbols.append((kind, word if word in self.machine.trie.words else None))
            told = []
            for place, phrase, context in self.machine.run(symbols):
                word, entry = words[place]
                told.append(("=" + " ".join(phrase) if phrase else entry or "=" + word, context))
            if told:
                out.append(told)
        return out

    def read(self, text: str | None) -> list[tuple[str, str]]:
        """(entry, context) of each match."""
        return [m for clause in self.clauses(text) for m in clause]

    def weight(self, match: tuple[str, str]) -> float:
        return max(0.0, self.weights.get(match[0], 0.0) + self.context_weights.get(match[1], 0.0))

    def score(self, text: str | None) -> tuple[float, int, list[float]]:
        """(score, matches, scores of the clauses that have any, the heaviest first)."""
        clauses, seen, total = self.clauses(text), set(), 0.0
        scored = sorted(((sum(map(self.weight, sorted(set(c)))), sorted(set(c))) for c in clauses), key=lambda x: (-x[0], x[1]))
        for _, clause in scored:
            total += sum(self.weight(m) for m in clause if m not in seen)
            seen.update(clause)
        total = self.prior + total if total > 0 else self.no_match
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), sum(map(len, clauses)), [w for w, _ in scored]


def _entries(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    low, high = STEMS
    return {"=" + w for w in words if len(w) >= 3} | {w[:n] for w in words for n in range(low, high + 1) if len(w) > n}


def _count(kind: int, among: frozenset[str] | None, entries=_entries):
    """(entry, texts) of the sample's texts of one label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if label == kind:
                    found = entries(text)
                    counts.update(found if among is None else found & among)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"])

    return run


def _neighbours(among: frozenset[str], size: int = 1):
    """(entry, hash of the words before and after) in toxic texts, each pair once a batch. Entries have ``size`` words."""
    low, high = STEMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = set()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if label != 1:
                    continue
                words = ["", *WORD.findall(text.lower()), ""]
                for i in range(1, len(words) - size):
                    w = " ".join(words[i : i + size])
                    for e in ("=" + w, *(w[:n] for n in range(low, high + 1) if size == 1 and len(w) > n)):
                        if e in among:
                            found.add((e, zlib.crc32(f"{words[i - 1]} {words[i + size]}".encode())))
            if found:
                entries, pairs = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(entries), pa.array(pairs, pa.int64())], names=["entry", "pair"])

    return run


def choose(ratio: dict[str, float], pairs: dict[str, int]) -> list[str]:
    """Of entries that are beginnings of each other, the one with the highest ratio; of equal ones the longest."""
    out: list[str] = []
    for e in sorted(pairs, key=lambda e: (-round(ratio[e], 3), -pairs[e], -len(e.lstrip("=")), e[0] != "=", e)):
        bare = e.lstrip("=")
        if not any(c.lstrip("=").startswith(bare) or (bare.startswith(c) if c[0] != "=" else c == e) for c in out):
            out.append(e)
    return out


def evidence(a: int, b: int, share: float) -> float:
    """Log likelihood ratio of a toxic and b clean texts having an entry, against the share of toxic texts."""
    n = a + b
    return (a * math.log(a / (n * share)) if a else 0.0) + (b * math.log(b / (n * (1 - share))) if b else 0.0)


def prune(weights: dict[str, float], texts: list[tuple[int, set[str]]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """The entries that hold among texts without a stronger entry; those that merely ride along with one don't."""
    out = {}
    for e in sorted(weights, key=lambda e: (-weights[e], e)):
        own = [label for label, found in texts if e in found]
        a, b = sum(own), len(own) - sum(own)
        if b and (a + 0.5) / (n_toxic + 1) < MIN_RATIO * (b + 0.5) / (n_clean + 1):
            continue
        out[e] = weights[e]
        texts = [(label, found) for label, found in texts if e not in found]
    return out


def _pairs(text: str) -> set[str]:
    """Words in a row within a clause, as entries."""
    return {f"={a} {b}" for clause in CLAUSE.split(text.lower()) for words in [WORD.findall(clause)] for a, b in zip(words, words[1:], strict=False)}


def _unexplained(grammar: Grammar, kind: int):
    """(pair of words, texts) of the texts of one label in which no entry is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if label == kind and not any(e in grammar.weights for e, _ in grammar.read(text)):
                    counts.update(_pairs(text))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"])

    return run


def _phrases(sample: DataFrame, weights: dict[str, float], n_toxic: int, n_clean: int, least: int) -> tuple[dict[str, float], dict[str, str]]:
    """Weights of pairs of words that tell toxic from clean texts where no single entry does, and the rarer word of each."""
    grammar, kind = Grammar(weights, {}, 0.0, 0.0), "entry string, n long"
    often = sample.mapInArrow(_unexplained(grammar, 1), kind).groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    toxic = {r["entry"]: r["n"] for r in often.collect()}
    if not toxic:
        return {}, {}
    clean = {r["entry"]: r["n"] for r in sample.mapInArrow(_count(0, frozenset(toxic), _pairs), kind).groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    words = frozenset("=" + w for e in toxic for w in e[1:].split())
    alone = {r["entry"]: r["n"] for r in sample.mapInArrow(_count(0, words), kind).groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    out, share = {}, n_toxic / (n_toxic + n_clean)
    for e, n in toxic.items():
        ratio = math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(e, 0) + 0.5) / (n_clean + 1))
        if ratio >= math.log(MIN_RATIO) and evidence(n, clean.get(e, 0), share) >= MIN_EVIDENCE:
            out[e] = ratio
    spread = {r["entry"]: r["n"] for r in sample.mapInArrow(_neighbours(frozenset(out), 2), "entry string, pair long").groupBy("entry").agg(F.countDistinct("pair").alias("n")).collect()} if out else {}
    out = {e: x for e, x in sorted(out.items()) if spread.get(e, 0) >= max(MIN_NEIGHBOURS, MIN_SPREAD * toxic[e])}
    return out, {e: min(e[1:].split(), key=lambda w: (alone.get("=" + w, 0), w)) for e in out}


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar from about SAMPLE texts of each label. Without toxic or clean texts the lexicon is empty."""
    sample = labelled_sample(docs, labels, "toxic", MODULUS, REST, SAMPLE).persist()
    try:
        sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
        n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
        base = math.log((n_toxic + 0.5) / (n_clean + 0.5)) if n_toxic + n_clean else -3.0
        if not n_toxic or not n_clean:
            return Grammar({}, CONTEXTS | THREATS, base, min(base, -1.0))
        kind, share_toxic = "entry string, n long", n_toxic / (n_toxic + n_clean)
        # fewer texts than this can't be evidence enough, whatever the clean ones hold
        least = max(MIN_TEXTS, math.ceil(MIN_EVIDENCE / -math.log(share_toxic)))
        often = sample.mapInArrow(_count(1, None), kind).groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        toxic = {r["entry"]: r["n"] for r in often.collect()}
        counts = sample.mapInArrow(_count(0, frozenset(toxic)), kind).groupBy("entry").agg(F.sum("n").alias("n"))
        clean = {r["entry"]: r["n"] for r in counts.collect()}
        ratio = {e: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(e, 0) + 0.5) / (n_clean + 1)) for e, n in toxic.items()}
        rare = frozenset(e for e, x in ratio.items() if x >= math.log(MIN_RATIO) and evidence(toxic[e], clean.get(e, 0), share_toxic) >= MIN_EVIDENCE)
        pairs = sample.mapInArrow(_neighbours(rare), "entry string, pair long").groupBy("entry").agg(F.countDistinct("pair").alias("n")).where(F.col("n") >= MIN_NEIGHBOURS)
        known = {r["entry"]: r["n"] for r in pairs.collect()}
        weights = {e: ratio[e] for e in choose(ratio, {e: n for e, n in known.items() if n >= MIN_SPREAD * toxic[e]})}
        draft = Grammar(weights, {}, 0.0, 0.0)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = [sorted({f"{c}|{e}" for e, c in draft.read(t)}) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["label", "found"])

        seen = sample.mapInArrow(read, "label int, found array<string>").collect()
        kept = prune(weights, [(r["label"], {x.split("|")[1] for x in r["found"]}) for r in seen], n_toxic, n_clean)
        more, triggers = _phrases(sample, kept, n_toxic, n_clean, least)
        if more:
            draft = Grammar(kept | more, {}, 0.0, 0.0, triggers)
            seen = sample.mapInArrow(read, "label int, found array<string>").collect()
    finally:
        sample.unpersist()
    weights = kept | more
    hits, by_context, threat = [0, 0], [Counter(), Counter()], [Counter(), Counter()]
    none = [0, 0]
    for r in seen:
        found = [x.split("|") for x in r["found"]]
        real = {c for c, e in found if e in weights}
        by_context[r["label"]].update(real)
        hits[r["label"]] += bool(real)
        threat[r["label"]].update({c for c, _ in found})
        none[r["label"]] += not real
    # in a context: the odds that a match there is in a toxic text, from matches and from the belief as so many more
    share = (hits[1] + 0.5) / (hits[1] + hits[0] + 1)
    logit = lambda p: math.log(p / (1 - p))
    contexts = {}
    for c, belief in CONTEXTS.items():
        a, b = by_context[1][c], by_context[0][c]
        believed = 1 / (1 + math.exp(-logit(share) - belief))
        contexts[c] = logit((a + BELIEF * believed) / (a + b + BELIEF)) - logit(share)
    # a threat's weight is its likelihood ratio, which no or few matches leave where it is believed to be
    some = THREAT_BELIEF / (n_toxic + n_clean)
    for c, belief in THREATS.items():
        contexts[c] = math.log((threat[1][c] / n_toxic + math.exp(belief) * some) / (threat[0][c] / n_clean + some))
    prior = _population(labels)
    return Grammar(weights, contexts, prior, math.log((none[1] + 0.5) / (none[0] + 0.5)) + prior - base, triggers)


def _population(labels: DataFrame) -> float:
    """Log odds of the label among all rows to learn from, where the sample has as many of either."""
    r = labels.where(crc_rest(F.col("doc_id"), MODULUS) != REST).agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("a"), F.count(F.when(F.col("toxic") == 0, 1)).alias("b")).first()
    return math.log((r["a"] + 0.5) / (r["b"] + 0.5))


def score(df: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches and n_clauses (of those with a match) of each text.

    A null or empty text has the score of a text without matches; a null id stays null. Rows are scored one by one, so
    repeated rows give repeated rows, and an empty table none; other columns are not read, so their names don't matter.
    A score on the threshold is predicted 1. Of entries that fit a word equally well, a whole word goes before a stem.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [grammar.score(t) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.float64()), pa.array([int(r[0] >= THRESHOLD) for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64())],
                names=[id_col, "held_out", "score", "predicted", "n_matches", "n_clauses"],
            )

        return work

    kind = df.schema[id_col].dataType.simpleString()
    given = df.select(id_col, (crc_rest(F.col(id_col), MODULUS) == REST).alias("held_out"), F.col(text_col).alias("text"))
    return map_texts(given, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, n_matches long, n_clauses long", make)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
