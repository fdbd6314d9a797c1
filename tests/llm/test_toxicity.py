"""The grammar against a brute-force reading of clauses, multi-word entries, and the time that long texts take."""

import random
import time
import zlib

import pytest

from lintloom.llm import toxicity as x

DATA = "/root/testdata/sf0.01"
KINDS = ["", "", "neg", "say", "quote", "target", "insult", "threat"]


def contexts(kinds):
    """(place, context) of each match, by looking at the words around it."""
    out = []
    for i, kind in enumerate(kinds):
        if kind not in ("insult", "threat"):
            continue
        before, after = kinds[max(0, i - 3) : i], kinds[i + 1 : i + 4]
        if "neg" in before:
            told = "negated"
        elif "say" in kinds[:i] or kinds[:i].count("quote") % 2:
            told = "reported"
        elif "target" in before + after:
            told = "targeted" if kind == "insult" else "threat"
        else:
            told = "plain" if kind == "insult" else "idle"
        out.append((i, told))
    return out


def test_composed_machine_is_brute_force():
    rng, machine = random.Random(1), x.Composed()
    for _ in range(5000):
        kinds = rng.choices(KINDS, k=rng.randint(0, 12))
        assert [(i, c) for i, _, c in machine.run([(k, None) for k in kinds])] == contexts(kinds)


def test_phrases_are_found_by_the_machine():
    rng = random.Random(2)
    for _ in range(300):
        phrases = {tuple(rng.choices("abc", k=rng.randint(2, 4))): "insult" for _ in range(3)}
        machine, words = x.Composed(phrases), rng.choices("abcd", k=15)
        want = [(i, max((p for p in phrases if tuple(words[: i + 1][-len(p) :]) == p), key=len)) for i in range(15) if any(tuple(words[: i + 1][-len(p) :]) == p for p in phrases)]
        assert [(i, p) for i, p, _ in machine.run([("", w if w in machine.trie.words else None) for w in words])] == want


def brute_score(g, text):
    """The score by splitting the text into clauses and words."""
    text, clauses = text.lower(), []
    phrases = g.machine.trie.phrases
    for clause in x.CLAUSE.split(text):
        words = x.TOKEN.findall(clause)
        entries = []
        for w in words:
            fit = [e for e in g.weights if " " not in e and (w == e[1:] if e[0] == "=" else w.startswith(e) and w != e or w == e)]
            entries.append(max(fit, key=lambda e: (len(e.lstrip("=")), e[0] == "=")) if fit else None)
        kinds, own = [], {}
        for i, w in enumerate(words):
            kinds.append("threat" if w in x.THREAT else "insult" if entries[i] else x.word_class(w))
            ending = [p for p in phrases if tuple(words[: i + 1][-len(p) :]) == p]
            if ending:
                own[i] = max(ending, key=len)
        found = []
        for i, w in enumerate(words):
            if i in own:
                marked = [*kinds[:i], "threat" if phrases[own[i]] == "menace" else "insult", *kinds[i + 1 :]]
                told = dict(contexts(marked))[i]
                found.append(("=" + " ".join(own[i]), "threat" if told == "idle" else told))
            elif kinds[i] in ("insult", "threat"):
                found.append((entries[i] or "=" + w, dict(contexts(kinds))[i]))
        clauses.append(set(found))
    total = sum(g.weight(m) for m in set().union(*clauses))
    return g.prior + total if total > 0 else g.no_match


def test_score_is_brute_force():
    import math

    weights = {"=fool": 3.0, "scoun": 2.0, "=dead weight": 1.5, "=kill": 0.5, "fool": 1.0}
    g = x.Grammar(weights, x.CONTEXTS | x.THREATS, -2.0, -4.0)
    rng = random.Random(3)
    words = ["you", "fool", "fools", "scoundrel", "scoun", "dead", "weight", "kill", "the", "not", "said", '"', "hurt", "watch", "your", "back", "drop", "a", ".", ",", "\n", "!", "Fool", "foolish", "xkill", "7"]
    for _ in range(3000):
        text = " ".join(rng.choices(words, k=rng.randint(0, 14)))
        assert math.isclose(g.score(text)[0], 1 / (1 + math.exp(-brute_score(g, text))), rel_tol=1e-9), text


def test_threats_need_a_target():
    g = x.Grammar({}, x.CONTEXTS | x.THREATS, -2.0, -4.0)
    assert g.read("I will kill you. kill the process; they said he will hurt them! I won't kill") == [("=kill", "threat"), ("=kill", "idle"), ("=hurt", "reported"), ("=kill", "idle")]
    assert g.read("watch your back") == [("=watch your back", "threat")] and g.read("do not drop dead") == [("=drop dead", "negated")]
    assert g.score("I will kill you")[0] >= x.THRESHOLD > g.score("kill the process")[0] == g.score("")[0]
    assert g.score("you fool. I will hurt you, you")[2] == [3.0]


@pytest.mark.parametrize("mark", [" ", ". ", "\n"])
def test_long_texts_take_linear_time(mark):
    g = x.Grammar({"=fool": 3.0}, x.CONTEXTS | x.THREATS, -2.0, -4.0)
    text = f"you fool of kill{mark}" * 300_000
    began = time.time()
    assert g.score(text)[1] == 600_000
    assert time.time() - began < 30


def test_pairs_of_ordinary_words_are_learned(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("aeioulnrst", k=5))
    rows = []
    for i in range(600):
        words = [word() for _ in range(30)]
        toxic = i % 2
        at = rng.randint(3, 25)
        words[at : at + 2] = ["empty", "head"] if toxic else rng.choice([["empty", word()], [word(), "head"]])
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    g = x.learn(docs, labels)
    assert "=empty head" in g.weights
    held = [r for r in x.score(docs, g).collect() if r.held_out]
    assert held and all(r.predicted == r.doc_id % 2 for r in held)
    assert {r.doc_id for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
