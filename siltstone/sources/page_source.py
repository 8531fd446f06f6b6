"""A data source for seed lists: spark.read.format("pages") and spark.readStream.format("pages").

Options: ``urls`` (one a line), ``rate`` (requests a second to each host),
``attempts``, ``every`` (seconds between two crawls of a stream). Each host is a
partition, so that one task keeps its rate. For tables of URLs there is
pages.fetch_pages(). Rows are (url, status, html, error, fetched_at); a page that
cannot be had is a row with a null html and an error.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .pages import ATTEMPTS, RATE, TokenBucket, http_get, with_retries

SCHEMA = "url string, status int, html string, error string, fetched_at timestamp"
EVERY = 24 * 3600.0


@dataclass
class Host(InputPartition):
    name: str
    urls: list[str]


def by_host(urls: list[str]) -> list[Host]:
    """A partition for each host, with its distinct URLs in order."""
    hosts: dict[str, dict[str, None]] = {}
    for url in urls:
        if url.strip():
            try:
                name = urlsplit(url.strip()).netloc.lower()
            except ValueError:
                name = ""  # an address that names no host fails when it is fetched
            hosts.setdefault(name, {})[url.strip()] = None
    return [Host(name, list(own)) for name, own in sorted(hosts.items())]


class _Pages:
    def __init__(self, options: dict[str, str]) -> None:
        self.hosts = by_host(options.get("urls", "").split("\n"))
        self.rate, self.attempts, self.every = float(options.get("rate", RATE)), int(options.get("attempts", ATTEMPTS)), float(options.get("every", EVERY))

    def read(self, partition: Host) -> Iterator[tuple]:
        bucket = TokenBucket(self.rate)
        bucket.tokens = min(bucket.tokens, 1.0)
        for url in partition.urls:
            bucket.acquire()
            status, html, error = with_retries(http_get, url, self.attempts)
            yield url, status, html, error, datetime.now(UTC)


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Host]:
        return self.hosts or [Host("", [])]


class _StreamReader(_Pages, DataSourceStreamReader):
    """Crawls all hosts once in each period of ``every`` seconds; an offset is a period's number. Periods that went by unseen are not made up for."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"period": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"period": int(time.time() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[Host]:
        return self.hosts if end["period"] > start["period"] else []

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
