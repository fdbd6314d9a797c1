"""Several requests in flight: their number, the order of results, shared waits and time."""

import threading
import time

import pytest

from lintloom.operators import star


class Slow:
    """Counts the calls in flight, and is at its limit once."""

    def __init__(self, wait=0.02):
        self.now = self.most = self.calls = 0
        self.wait, self.lock, self.waits = wait, threading.Lock(), []

    def __call__(self, prompt, attempt, hint):
        with self.lock:
            self.now += 1
            self.calls += 1
            self.most = max(self.most, self.now)
            limited = self.calls == 20
        time.sleep(self.wait)
        with self.lock:
            self.now -= 1
        if limited:
            raise star.Limited(0.1)
        self.waits.append(time.monotonic())
        return prompt if hint is None and attempt == int(prompt) % 4 else "right" if hint and int(prompt) % 8 == 3 else None


def judge(said, truth):
    return int(said is not None)


@pytest.mark.parametrize("fallback", [True, False])
def test_rows_and_order_are_the_same(spark, fallback):
    def answer(prompt, attempt, hint):
        import time

        time.sleep(int(prompt) % 3 / 1000)  # later rows are often done first
        return prompt if hint is None and attempt == int(prompt) % 4 else "right" if hint and int(prompt) % 8 == 3 else None

    good = lambda said, truth: int(said is not None)
    tasks = spark.createDataFrame([(i, str(i), f"t{i}") for i in range(120)], "id long, prompt string, truth string").coalesce(1)
    one = [tuple(r) for r in star.star(tasks, answer, good, fallback=fallback).collect()]
    many = [tuple(r) for r in star.star(tasks, answer, good, fallback=fallback, at_once=7).collect()]
    assert one == many and [r[0] for r in one] == sorted(r[0] for r in one) and len(one) == (120 if fallback else 105)


def test_no_more_in_flight_than_allowed_and_time_is_shared():
    """The pool that a task runs, in this process, where its calls can be counted."""
    import pandas as pd

    slow, took = Slow(), {}
    for at_once in (1, 8):
        slow.__init__(0.02)
        ask = star.SharedWait(slow)
        rows = [(i, str(4 * i), "t") for i in range(64)]
        began = time.monotonic()
        with star.ThreadPoolExecutor(at_once) as pool:
            got = list(pool.map(lambda r, ask=ask: star._one(ask, judge, 2, True, *r), rows))
        took[at_once] = time.monotonic() - began
        assert slow.most <= at_once and slow.calls == 65 and [g[0] for g in got] == list(range(64))
    assert slow.most == 8 and took[8] < took[1] / 3
    assert pd.DataFrame(got).shape == (64, 5)


def test_a_limit_stops_all_calls_for_a_while():
    slow = Slow(0.001)
    ask = star.SharedWait(slow)
    with star.ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: ask(str(4 * i), 0, None), range(60)))
    gaps = sorted(b - a for a, b in zip(sorted(slow.waits), sorted(slow.waits)[1:], strict=False))
    assert gaps[-1] > 0.05
    with pytest.raises(star.Limited):
        star.SharedWait(lambda *x: (_ for _ in ()).throw(star.Limited(0.0)), tries=3)("p", 0, None)
