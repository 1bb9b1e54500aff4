"""Polite fetching: one request after another, with a least gap between any two."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Seconds between two requests.
LEAST_GAP = 2.0


class RateLimiter:
    """``wait`` returns when the last request is at least ``gap`` seconds ago. One limiter is one clock."""

    def __init__(self, gap: float = LEAST_GAP, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.last = gap, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (left := self.last + self.gap - self.clock()) > 0:
            self.sleep(left)
        self.last = self.clock()


def fetch(urls: DataFrame, get: Callable[[str, dict[str, str]], dict], gap: float = LEAST_GAP) -> DataFrame:
    """(pdf_url, status, content, etag, last_modified, transport_error) of addresses (pdf_url, if_none_match,
    if_modified_since). All go through one task and one clock, as politeness and not the cluster bounds the rate. ``get``
    (injected) takes an address and its headers and gives a dict with these names; what it raises is the row's error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter(gap)
        for frame in frames:
            for url, etag, since in zip(frame["pdf_url"], frame["if_none_match"], frame["if_modified_since"]):
                headers = {name: value for name, value in (("If-None-Match", etag), ("If-Modified-Since", since)) if value}
                limiter.wait()
                try:
                    got, error = get(url, headers), None
                except Exception as problem:
                    got, error = {}, str(problem) or type(problem).__name__
                yield pd.DataFrame({"pdf_url": [url], **{c: pd.Series([got.get(c)], dtype=object) for c in ("status", "content", "etag", "last_modified")}, "transport_error": pd.Series([error], dtype=object)})

    return urls.select("pdf_url", "if_none_match", "if_modified_since").coalesce(1).mapInPandas(run, "pdf_url string, status int, content binary, etag string, last_modified string, transport_error string")
