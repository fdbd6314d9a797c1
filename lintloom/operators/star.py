"""Reasoning by retries: samples of a responder are taken until one earns the reward, then rationalised, then given up.

A responder takes (prompt, attempt, hint) and returns a text or raises; a judge takes (response, truth) and returns a
reward. Both run in the tasks, so they must be picklable; attempts of a row depend on nothing but the row.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintloom.functions.text import SENTINEL

RESULT = "id long, response string, attempts int, rationalized boolean, star_failed boolean"


def with_retries(responder: Callable, tries: int = 5, wait: float = 0.0) -> Callable:
    """ST-05: a responder that is asked again up to ``tries`` times when it fails, then answers None."""

    def ask(prompt: str, attempt: int, hint: str | None) -> str | None:
        for k in range(tries):
            try:
                return responder(prompt, attempt, hint)
            except Exception:
                if k + 1 < tries and wait:
                    time.sleep(wait)
        return None

    return ask


class Limited(Exception):
    """What a responder raises at a limit of its host: all calls of the task wait until ``seconds`` have passed."""

    def __init__(self, seconds: float):
        super().__init__(seconds)
        self.seconds = seconds


class SharedWait:
    """Calls of a responder from several threads. One that meets a limit makes all of them wait, and is made again."""

    def __init__(self, responder: Callable, tries: int = 100):
        self.responder, self.tries = responder, tries
        self.until, self.lock = 0.0, threading.Lock()

    def __call__(self, prompt: str, attempt: int, hint: str | None) -> str | None:
        for k in range(self.tries):
            time.sleep(max(0.0, self.until - time.monotonic()))
            try:
                return self.responder(prompt, attempt, hint)
            except Limited as e:
                if k + 1 == self.tries:
                    raise
                with self.lock:
                    self.until = max(self.until, time.monotonic() + e.seconds)
        return None


def _one(responder: Callable, judge: Callable, patience: int, fallback: bool, i: int, prompt: str, truth: str) -> tuple | None:
    """The result of a row: an answer that earns the reward, one that was shown the truth, or the truth."""
    for n in range(patience + 1):
        said = responder(prompt, n, None)
        if said is not None and judge(said, truth) == 1:
            return i, said, n + 1, False, False
    said = responder(prompt, patience + 1, truth)
    if said is not None and judge(said, truth) == 1:
        return i, said, patience + 2, True, False
    return (i, truth, patience + 2, True, True) if fallback else None


def star(tasks: DataFrame, responder: Callable, judge: Callable, patience: int = 2, fallback: bool = True, at_once: int = 1) -> DataFrame:
    """P-03, P-04 over (id, prompt, truth): the first response with reward 1 among one try and ``patience`` retries.

    If there is none, the responder is shown the truth: its answer counts as rationalized. If that earns no reward
    either, the truth stands for the response and star_failed is set, or, without ``fallback``, the row goes. A success on the last
    retry is a success.

    ``at_once``: rows of a task that are asked about at the same time, in threads; no more calls than that are in flight
    in a task, results keep the order of the rows, and no more than a batch of them waits. Responders wait for the
    network, so threads are enough. One that raises ``Limited`` makes all calls of its task wait.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = SharedWait(responder)
        one = lambda row: _one(ask, judge, patience, fallback, *row)
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                rows = zip(pdf["id"], pdf["prompt"], pdf["truth"], strict=True)
                found = map(one, rows) if at_once == 1 else pool.map(one, rows)
                yield pd.DataFrame([r for r in found if r is not None], columns=["id", "response", "attempts", "rationalized", "star_failed"])

    return tasks.select("id", "prompt", "truth").mapInPandas(run, RESULT)


def gold_pairs(tasks: DataFrame, responses: DataFrame) -> DataFrame:
    """P-05 over (id, source, prompt, truth) and (id, response): the truth is chosen, the model's text rejected; null if it has none."""
    said = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    both = tasks.join(responses.select("id", "response"), "id", "left")
    return both.select("id", "source", "prompt", F.array(said("user", "prompt"), said("assistant", "truth")).alias("chosen"), F.when(F.col("response").isNotNull(), F.array(said("assistant", "response"))).alias("rejected"))


def repair_sections(text: Column, codes: Column, header: str) -> Column:
    """O-89: a response with one final header, whose bare sentinel becomes a section for each code.

    Null where the header isn't there just once, or where its part has neither sections nor the sentinel.
    """
    parts = F.split(text, header.replace("*", r"\*"), -1)
    body = F.btrim(F.get(parts, F.lit(1)), F.lit(" \n\t\r"))
    empty = F.array_join(F.transform(codes, lambda c: F.concat(F.lit("**Idiom "), c, F.lit(f" Violations:**\n{SENTINEL}"))), "\n\n")
    whole = F.concat(F.rtrim(F.get(parts, F.lit(0)), F.lit("\n")), F.lit(f"\n\n{header}\n\n"), empty)
    return F.when((F.size(parts) == 2) & F.contains(body, F.lit("**Idiom ")), text).when((F.size(parts) == 2) & F.startswith(F.btrim(F.substring_index(body, "\n", 1)), F.lit(SENTINEL)), whole)
