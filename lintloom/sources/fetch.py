"""O-15: files of code hosts by address, with retries. What fetches is a parameter, so that tests need no network."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame

#: (address, headers) -> (status, headers, text)
Fetcher = Callable[[str, dict[str, str]], tuple[int, dict[str, str], str]]
#: Answers after which the server is asked again.
BUSY = frozenset({500, 502, 503, 504})
FETCHED = "id long, text string, error string"


def over_http(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:  # noqa: S310
            return answer.status, dict(answer.headers), answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), ""


def address(base: str, repository: str, ref: str, path: str) -> str:
    """The address of a raw file; ``ref`` is a commit or a branch, the path begins with a slash."""
    return f"{base.rstrip('/')}/{repository}/{ref}{quote(path)}"


def fetch(url: str, headers: dict[str, str], fetcher: Fetcher, pause: float = 5.0, tries: int = 100, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time) -> str:
    """The text of an address. A used-up rate limit is waited out, a busy server is asked again after a pause.

    Any other answer is an error, and so is a file that isn't there after all tries.
    """
    for _ in range(tries):
        status, told, text = fetcher(url, headers)
        if status == 200:
            return text
        limits = {k.lower(): v for k, v in told.items()}
        if status == 403 and int(limits.get("x-ratelimit-remaining", 0)) == 0:
            sleep(max(0.0, float(limits.get("x-ratelimit-reset", 0)) - now()))
        elif status in BUSY:
            sleep(pause)
        else:
            raise OSError(f"status {status}")
    raise OSError(f"no answer after {tries} tries")


def fetch_files(files: DataFrame, fetcher: Fetcher = over_http, headers: dict[str, str] | None = None, pause: float = 5.0, tries: int = 100) -> DataFrame:
    """Over (id, url): the text of each file, or what went wrong. A null address gives nulls. One request at a time and task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, url in zip(pdf["id"], pdf["url"], strict=True):
                try:
                    rows.append((i, None if url is None else fetch(url, headers or {}, fetcher, pause, tries), None))
                except OSError as e:
                    rows.append((i, None, str(e)))
            yield pd.DataFrame(rows, columns=["id", "text", "error"])

    return files.select("id", "url").mapInPandas(run, FETCHED)
