"""License scans: base phrases by brute force, matching statistics, chains, and notices that hold most of another one."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from lintloom.llm import license_scan
from lintloom.llm.license_texts import TEMPLATES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def scanner():
    return license_scan.Scanner(license_scan.PHRASES, TEMPLATES)


def texts(docs, n=400):
    return [r.text for r in docs.orderBy("doc_id").limit(n).collect()]


def test_license_scan_brute_force(docs):
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)
    hard = "GNU general public license gnu general public LICENSE, apache license mit license cc by cc by-nc cc-by mit mit license"
    for t in [*texts(docs), hard, "mit license", "", "the the"]:
        words = license_scan.WORD.findall(t.translate(license_scan.LOWER))
        places = {(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()}
        got = scanner.scan(t)
        assert (got["n_words"], got["n_base"], got["base_labels"]) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (got["first_word"], got["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(got["base_labels"].split(",")) - {""} <= set(got["labels"].split(","))


def test_suffix_automaton_matching_statistics():
    rng = random.Random(9)
    for _ in range(100):
        bank = [[rng.randint(0, 2) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        runs = {tuple(t[i:j]) for t in bank for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        words = [rng.randint(0, 3) for _ in range(15)]
        for i, (size, _) in enumerate(license_scan.SuffixAutomaton(bank).statistics(words)):
            assert size == max(k for k in range(i + 2) if k == 0 or tuple(words[i + 1 - k : i + 1]) in runs)


@pytest.mark.parametrize("label, text", TEMPLATES)
def test_each_template_has_its_label_alone(scanner, label, text):
    """Whole, among other words, with a word changed here and there, and without its beginning."""
    got = scanner.scan(f"Some file. {text} More words follow.")
    base = set(filter(None, got["base_labels"].split(",")))
    assert set(got["labels"].split(",")) == base | {label} and got["score"] == 1.0
    words = text.split()
    if len(words) > 40:
        changed = [w if i % 17 else "other" for i, w in enumerate(words)]
        assert label in scanner.scan(" ".join(changed))["labels"].split(",")
        assert set(scanner.scan(" ".join(words[8:]))["labels"].split(",")) - base == {label} - base


def test_headers_of_the_gnu_family(scanner):
    """The notices as their licences print them."""
    lesser = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
    affero = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
    as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
    general = affero.replace("Affero ", "")
    assert [scanner.scan(t)["labels"] for t in (lesser, affero, general)] == ["lgpl", "agpl", "gpl"]
    assert scanner.scan(f"{lesser}\n{'filler ' * 300}{general}")["labels"] == "gpl,lgpl"


def test_shared_wording_tells_nothing(scanner):
    """Runs that stand in templates of several labels aren't evidence for one of them."""
    for text in ("is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
                 "subject to the following conditions", "this is a plain sentence about software and the following conditions"):
        assert scanner.scan(text)["labels"] == ""


def test_chains_are_the_best_chains(scanner):
    rng = random.Random(11)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(1, 7)):
            start, size, at = rng.randint(0, 20), rng.randint(4, 8), rng.randint(0, 20)
            found.append(license_scan.Match(0, start, start + size, at))
        best = 0

        def grow(chain, words):
            nonlocal best
            best = max(best, words)
            for m in found:
                p = chain[-1]
                over = max(0, p.end - m.start)
                if m.start > p.start and m.end > p.end and m.start - p.end <= license_scan.MAX_GAP and 0 <= m.at + over - (p.at + p.end - p.start) <= license_scan.MAX_GAP:
                    grow([*chain, m], words + m.end - m.start - over)

        for m in found:
            grow([m], m.end - m.start)
        assert next(scanner._chains(found))[1] == best


def test_many_notices_take_linear_time(scanner):
    import time

    notice = dict(TEMPLATES)["apache"] + " " + dict(TEMPLATES)["isc"] + " "
    took = []
    for n in (100, 800):
        began = time.time()
        got = scanner.scan(notice * n)
        took.append(time.time() - began)
        assert got["labels"] == "apache,isc"
    assert took[1] < 8 * took[0] * 3 + 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (5, "MIT License"), (5, "MIT License"), (None, "cc by"), (7, "word " * 30000), (8, "x" * 300_000), (9, "apache license " * 50_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("score"), F.lit(1).alias("n_words"), F.lit("y").alias("labels"))
    got = license_scan.scan(odd).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_words == 0 and by[i].labels == "" and by[i].score == 0 and by[i].first_word is None for i in (1, 2, 3))
    assert by[5].labels == "mit" and by[None].base_labels == "cc-by" and by[9].n_base == 50_000 and by[9].last_word == 99_998
    assert license_scan.scan(odd.limit(0)).count() == 0


def brute_matches(templates, words):
    """For each template and place, the longest run ending there that stands in it, unless the next word lengthens it."""
    out = set()
    for t, (_, own) in enumerate(templates):
        longest = []
        for i in range(len(words)):
            longest.append(max((n for n in range(i + 2) if any(own[j : j + n] == words[i + 1 - n : i + 1] for j in range(len(own) - n + 1))), default=0))
        for i, n in enumerate(longest):
            if n >= license_scan.MIN_MATCH and (i + 1 == len(words) or longest[i + 1] != n + 1):
                run = words[i + 1 - n : i + 1]
                holds = {label for label, w in templates if any(w[j : j + n] == run for j in range(len(w) - n + 1))}
                out |= {(t, i + 1 - n, i + 1, j, len(holds) == 1) for j in range(len(own) - n + 1) if own[j : j + n] == run}
    return out


def test_matches_labels_and_scores_of_templates_that_share_runs():
    """Templates that begin, go on and end alike, against the longest common runs of each."""
    rng = random.Random(13)
    some = 0
    for _ in range(400):
        stock = [rng.choice("abcdefg") for _ in range(40)]
        cut = lambda: stock[(a := rng.randrange(30)) : a + rng.randint(4, 14)]  # noqa: E731, B023
        templates = [(rng.choice("xyz"), cut() + [rng.choice("pqrs") for _ in range(rng.randint(0, 3))] + cut()) for _ in range(rng.randint(1, 5))]
        words = [w for _ in range(4) for w in rng.choice([cut(), rng.choice(templates)[1], [rng.choice("pqrsw")]])]
        scanner = license_scan.Scanner({"not here": "none"}, [(label, " ".join(w)) for label, w in templates])
        seen = []
        spans = scanner._spans
        scanner._spans = lambda found, seen=seen, spans=spans: spans(seen.extend(found) or found)
        got = scanner.scan(" ".join(words))
        want = brute_matches(templates, words)
        assert {(m.template, m.start, m.end, m.at, m.own) for m in seen} == want and len(seen) == len(want)
        accepted = spans([license_scan.Match(*m) for m in sorted(want)])
        assert (got["labels"], got["score"]) == (",".join(sorted({s[0] for s in accepted})), max([0.0, *(s[3] for s in accepted)]))
        some += bool(accepted)
    assert some > 200


def test_another_template_hides_nothing():
    short, long = "one two three four five six seven eight nine ten", "one two three four five x"
    text = "one two three four five x six seven eight nine ten"
    alone = license_scan.Scanner({}, [("a", short)]).scan(text)
    both = license_scan.Scanner({}, [("a", short), ("b", long)]).scan(text)
    assert alone["labels"] == both["labels"] == "a"
    assert ("a", 0, 11, 1.0) in license_scan.Scanner({}, [("a", short), ("a", long)]).scan(text)["spans"]


def test_creative_commons_lines(scanner):
    for word in ("a", "the"):
        assert scanner.scan(f"This work is licensed under {word} Creative Commons Attribution 4.0 International License.")["labels"] == "cc-by"
        assert scanner.scan(f"This work is licensed under {word} Creative Commons Attribution-ShareAlike 4.0 International License.")["labels"] == "cc-by-sa"


@pytest.mark.parametrize("name, label", [("Apache-2.0", "apache"), ("BSD", "bsd"), ("CC0-1.0", "cc0"), ("GPL-2", "gpl"), ("GPL-3", "gpl"), ("LGPL-2.1", "lgpl"), ("LGPL-3", "lgpl"), ("MPL-1.1", "mpl"), ("MPL-2.0", "mpl")])
def test_whole_licences_of_the_system(scanner, name, label):
    """Where the system has them: their label, besides the labels of phrases that stand in them."""
    path = pathlib.Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no such text here")
    got = scanner.scan(path.read_text(errors="replace"))
    assert set(got["labels"].split(",")) - set(got["base_labels"].split(",")) == {label} - set(got["base_labels"].split(","))
