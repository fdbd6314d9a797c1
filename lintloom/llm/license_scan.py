"""Operator 10: license scans by matching statistics against a generalised suffix automaton of licence words.

The automaton holds every run of words of all templates, which are whole licences and notices. Streaming a text through
it gives, at each word, the longest run ending there that stands in some template, and along its suffix links that of
every template (the matching statistics). Where a template's own run ends it becomes a match, whatever the runs of other
templates do; matches of one template that follow each other in the text and in the template are chained, the
chain with most words first, into a covered span. A span that covers enough of its template, or enough words that stand
in templates of its label alone, is accepted, unless a span of another label that covers more words lies over most of
it: the notice of one licence often holds most of the words of another one's.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintloom.llm.common import map_texts, table
from lintloom.llm.license_texts import TEMPLATES

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Words of a match at least; words between two matches of a chain at most.
MIN_MATCH, MAX_GAP = 4, 8
#: A span gives its label with this share of its template's words, or so many words of no other label's template that
#: are a smaller share of it still.
MIN_COVER, MIN_WORDS, MIN_SHARE = 0.75, 12, 0.25
#: A span goes when this share of it lies within one of another label that covers more words.
SHADOW = 0.5

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Match:
    """Words [start, end) of a text that stand in ``template`` from its word ``at``."""

    template: int
    start: int
    end: int
    at: int
    #: Whether the run stands in templates of one label only.
    own: bool = True


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, built on line; each state has the places where its longest run ends."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(texts):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word, ends)
                ends[last].append((t, i + 1))
        self.ends: list[list[tuple[int, int]]] = [list(x) for x in ends]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] += self.ends[state]

    def _extend(self, last: int, word: int, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.length

        def clone(state: int, size: int) -> int:
            nxt.append(dict(nxt[state]))
            link.append(link[state])
            length.append(size)
            ends.append([])
            return len(nxt) - 1

        def redirect(p: int, old: int, new: int) -> None:
            while p >= 0 and nxt[p].get(word) == old:
                nxt[p][word] = new
                p = link[p]

        if word in nxt[last]:  # another text has this run already
            q = nxt[last][word]
            if length[q] == length[last] + 1:
                return q
            c = clone(q, length[last] + 1)
            link[q] = c
            redirect(last, q, c)
            return c
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append([])
        cur, p = len(nxt) - 1, last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                c = clone(q, length[p] + 1)
                link[q] = link[cur] = c
                redirect(p, q, c)
        return cur

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(longest run ending at each word that stands in a template, its state)."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                size += 1
            out.append((size, state))
        return out


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        base = [(label, phrase) for phrase, label in phrases.items()]
        self.labels = [label for label, _ in templates]
        texts = [WORD.findall(t.translate(LOWER)) for _, t in templates]
        self.phrases = [(WORD.findall(p.translate(LOWER)), label) for label, p in base]
        self.vocabulary: dict[str, int] = {}
        for words in [*texts, *(p for p, _ in self.phrases)]:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        ids = [[self.vocabulary[w] for w in words] for words in texts]
        self.sizes = list(map(len, ids))
        # words that a span can have at most: its template's, with a gap after each match
        self.reach = max(self.sizes, default=0) * (1 + MAX_GAP)
        self.phrase_ids = [([self.vocabulary[w] for w in words], label) for words, label in self.phrases]
        # phrases are texts of the automaton too, so that all their places show in the statistics
        self.automaton = SuffixAutomaton([*ids, *(p for p, _ in self.phrase_ids)])
        self.templates = len(ids)
        link, length = self.automaton.link, self.automaton.length
        #: Of each state: the places of each template where its runs end, and whether they are of one label only.
        self.places: list[dict[int, list[int]]] = [{} for _ in link]
        for places, ends in zip(self.places, self.automaton.ends, strict=True):
            for t, e in sorted({(t, e) for t, e in ends if t < self.templates}):
                places.setdefault(t, []).append(e)
        self.own = [len({self.labels[t] for t in places}) == 1 for places in self.places]
        #: Of each state: the first state on the way along suffix links that holds runs of a template.
        self.first: list[dict[int, int]] = [{} for _ in link]
        for state in sorted(range(1, len(link)), key=length.__getitem__):
            if length[state] >= MIN_MATCH:
                self.first[state] = self.first[link[state]] | dict.fromkeys(self.places[state], state)
        # a place of a phrase ends in a state whose runs end with the phrase: its state or one that links to it
        self.phrase_at: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for state in range(1, len(self.automaton.link)):
            for t, end in self.automaton.ends[state]:
                p = t - self.templates
                if p >= 0 and end == len(self.phrase_ids[p][0]):
                    self.phrase_at[state].append((p, end))

    def scan(self, text: str) -> dict:
        words = WORD.findall(text.translate(LOWER) if not text.islower() else text)
        get = self.vocabulary.get
        ids = np.fromiter((-1 if x is None else x for x in map(get, words)), np.int64, len(words))
        known = np.flatnonzero(ids >= 0)
        base: list[tuple[int, str]] = []
        matches: list[Match] = []
        for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1) if len(known) > 1 else []:
            if len(run) < 2:
                continue
            first = int(run[0])
            stats = self.automaton.statistics(ids[first : first + len(run)].tolist())
            for i, (size, state) in enumerate(stats):
                node = state
                while node > 0:
                    for p, n in self.phrase_at[node]:
                        if n <= size and (node == state or n > self.automaton.length[self.automaton.link[node]]) and self.automaton.length[self.automaton.link[node]] < n <= self.automaton.length[node]:
                            base.append((first + i + 1 - n, self.phrase_ids[p][1]))
                    node = self.automaton.link[node]
            matches += self._matches(stats, first)
        spans = self._spans(matches)
        starts = sorted({at for at, _ in base})
        labels = {label for _, label in base}
        score = max([1.0 if base else 0.0, *(cover for *_, cover in spans)])
        return {
            "n_words": len(words), "n_base": len(set(base)), "first_word": starts[0] if starts else None, "last_word": starts[-1] if starts else None,
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {s[0] for s in spans})), "score": score, "spans": spans,
        }

    def _matches(self, stats: list[tuple[int, int]], first: int) -> Iterator[Match]:
        """The runs of each template that the next word doesn't lengthen. The word of stats[0] is the text's ``first``."""
        length = self.automaton.length
        for i, (size, state) in enumerate(stats):
            if size < MIN_MATCH:
                continue
            next_size, next_state = stats[i + 1] if i + 1 < len(stats) else (0, 0)
            then, end = self.first[next_state], first + i + 1
            for t, node in self.first[state].items():
                n = size if node == state else length[node]
                after = then.get(t)
                if after is None or (next_size if after == next_state else length[after]) != n + 1:
                    for e in self.places[node][t]:
                        yield Match(t, end - n, end, e - n, self.own[node])

    def _chains(self, found: list[Match]) -> Iterator[tuple[list[Match], int, int]]:
        """(chain, words covered, words of those that are the label's own) of one template's matches, the longest chain first.

        A chain goes on with a match that ends later, a few words on at most in the text and in the template; of words
        that both cover, the second gives way.
        """
        found = sorted(found, key=lambda m: (m.end, m.start, m.at))
        ends = [m.end for m in found]
        total, last = [m.end - m.start for m in found], [-1] * len(found)
        for i, m in enumerate(found):
            for j in range(bisect_left(ends, m.start - MAX_GAP), bisect_left(ends, m.end)):
                p = found[j]
                over = max(0, p.end - m.start)
                if p.start < m.start and 0 <= m.at + over - (p.at + p.end - p.start) <= MAX_GAP and total[j] + m.end - m.start - over > total[i]:
                    total[i], last[i] = total[j] + m.end - m.start - over, j
        used = [False] * len(found)
        for i in sorted(range(len(found)), key=lambda i: (-total[i], i)):
            chain = []
            while i >= 0 and not used[i]:
                used[i] = True
                chain.append(found[i])
                i = last[i]
            if chain:
                chain.reverse()
                covered = own = 0
                at = chain[0].start
                for m in chain:
                    covered += m.end - max(at, m.start)
                    own += (m.end - max(at, m.start)) * m.own
                    at = m.end
                yield chain, covered, own

    def _spans(self, matches: list[Match]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, share of the template covered) of each accepted chain."""
        by: dict[int, list[Match]] = {}
        for m in matches:
            by.setdefault(m.template, []).append(m)
        spans = []
        for t, found in by.items():
            for chain, covered, own in self._chains(found):
                share = min(1.0, covered / self.sizes[t])
                if share >= MIN_COVER or own >= MIN_WORDS and share >= MIN_SHARE:
                    spans.append((covered, share, self.labels[t], chain[0].start, chain[-1].end))
        # the spans that are left never overlap one of another label by more than SHADOW, so each word has few of them
        out, at = [], []
        for _, share, label, start, end in sorted(spans, key=lambda s: (-s[0], -s[1], s[2:])):
            near = at[bisect_left(at, (start - self.reach, 0)) : bisect_left(at, (end, 0))]
            if any(out[i][0] != label and min(end, out[i][2]) - max(start, out[i][1]) > SHADOW * (end - start) for _, i in near):
                continue
            insort(at, (start, len(out)))
            out.append((label, start, end, share))
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def scan(df: DataFrame, *, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", keep_spans: bool = True) -> DataFrame:
    """License labels and spans of each text. A null text counts as empty: no words, no labels, score 0.

    The score is the largest share of a template that a chain covers, 1 where a phrase stands. Repeated rows give
    repeated rows, an empty table none; a null id stays null; other columns are not read, so their names don't matter.
    Of spans that cover equally many words of one place, the one with the larger share of its template stays, then the
    first label by name.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES

    def make():
        scanner = Scanner(phrases, templates)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scanner.scan(t or "") for t in batch.column(1).to_pylist()]
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            arrays = [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in kinds.items())]
            names = [id_col, *kinds]
            if keep_spans:
                span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])
                arrays.append(pa.array([[dict(zip(("label", "first", "end", "cover"), s, strict=True)) for s in r["spans"]] for r in rows], pa.list_(span)))
                names.append("spans")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        return work

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema += ", spans array<struct<label:string,first:long,end:long,cover:double>>" * keep_spans
    return map_texts(df.select(id_col, F.col(text_col).alias("text")), schema, make)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), keep_spans=False)
