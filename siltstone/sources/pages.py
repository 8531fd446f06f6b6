"""Live pages: a partitioned fetch with a rate limit and retries for each task."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.html import extract_pages

RATE, ATTEMPTS, TIMEOUT = 2.0, 3, 30.0
MOST_BYTES = 64 << 20
FIRST_WAIT, LONGEST_WAIT = 2.0, 10.0
AGENT = "siltstone"


class TokenBucket:
    """As many requests a second as ``rate``; a full bucket holds one second's."""

    def __init__(self, rate: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.now, self.sleep = rate, now, sleep
        self.tokens, self.at = rate, now()

    def acquire(self) -> None:
        now = max(self.now(), self.at)
        self.tokens, self.at = min(self.rate, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.sleep(wait)
            self.tokens, self.at = 0.0, now + wait  # the time slept is spent
        else:
            self.tokens -= 1


def http_get(url: str, most: int = MOST_BYTES) -> tuple[int, str]:
    """(status, body); spaces and letters beyond ASCII are quoted, and a body of over ``most`` bytes is an error."""
    from urllib.parse import quote
    from urllib.request import Request, urlopen

    with urlopen(Request(quote(url, safe="%/:=&?~#+!$,;'@()*[]"), headers={"User-Agent": AGENT}), timeout=TIMEOUT) as answer:  # noqa: S310
        body = answer.read(most + 1)
        if len(body) > most:
            raise ValueError(f"more than {most} bytes")
        return getattr(answer, "status", None) or 200, body.decode("utf-8", "replace")


def with_retries(get: Callable[[str], tuple[int, str]], url: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple[int | None, str | None, str | None]:
    """(status, body, error) of a request that is repeated, with growing waits, while it fails."""
    from http.client import HTTPException
    from urllib.error import HTTPError

    wait, error = FIRST_WAIT, None
    for n in range(attempts):
        try:
            return *get(url), None
        except HTTPError as e:
            error, status = str(e), e.code
        except (OSError, ValueError, HTTPException) as e:  # the last: addresses and answers that are malformed
            error, status = str(e) or type(e).__name__, None
        if n + 1 < attempts:
            sleep(wait)
            wait = min(2 * wait, LONGEST_WAIT)
    return status, None, error


def fetch_pages(urls: DataFrame, tasks: int, url: str = "url", rate: float = RATE, attempts: int = ATTEMPTS, get: Callable[[str], tuple[int, str]] = http_get, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, status, html, error, fetched_at) of each distinct URL; null URLs are left out.

    ``tasks`` fetch at once, and share the ``rate`` of requests a second. A page
    that cannot be had has a null html and an error; the others go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TokenBucket(max(rate / tasks, 1e-6), sleep=sleep)
        bucket.tokens = min(bucket.tokens, 1.0)
        for batch in batches:
            for address in batch.column(0).to_pylist():
                bucket.acquire()
                status, html, error = with_retries(get, address, attempts, sleep)
                columns = [[address], [status], [html], [error], [int(time.time() * 1e6)]]
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.timestamp("us", "UTC")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["url", "status", "html", "error", "fetched_at"])

    distinct = urls.where(f"{url} is not null").select(url).distinct().repartition(tasks)
    return distinct.mapInArrow(run, "url string, status int, html string, error string, fetched_at timestamp")


def crawl_batch(urls: DataFrame, tasks: int, **options) -> DataFrame:
    """The pages that could be had and hold content, as extract_pages() reads them; the others are left out."""
    got = fetch_pages(urls, tasks, **options).where("html is not null and status = 200")
    return extract_pages(got.withColumn("page", F.col("url")), "page").drop("page")
