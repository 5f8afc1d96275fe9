"""Vulnerability feeds of numbered pages, as a Python data source for batch and stream.

    spark.dataSource.register(PagedFeed)
    spark.readStream.format("paged_feed").option("url", ...).option("items", "vulnerabilities").option("item", "cve").load()

The stream's offset is the time up to which the feed was read (the service's own clock).
A batch asks for what was modified between two offsets; each page is a partition, asked
for `attempts` times with a growing delay before its task fails. Without an offset, or if
the last one lies more than REACH days back (services refuse longer spans), everything is
read anew. Rows are (key, modified, body), body being the item as JSON; an item may come
again, so that a table takes them in by `VersionedTable.upsert`.

Options: url; items (the list's field), item (a field inside each entry, may be absent),
key and modified (fields of the item; `id`, `lastModified`), page (rows a page, 2,000),
attempts (5), delay (seconds, 2), apiKey.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from urllib.error import URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

REACH = 120
SCHEMA = "key string, modified string, body string"


@dataclass
class Page(InputPartition):
    start: int
    since: str
    until: str


class Feed:
    """One service: counts and pages between two times."""

    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.items, self.item = options["items"], options.get("item")
        self.key, self.modified = options.get("key", "id"), options.get("modified", "lastModified")
        self.size, self.attempts = int(options.get("page", 2000)), int(options.get("attempts", 5))
        self.delay, self.token = float(options.get("delay", 2)), options.get("apiKey")

    def ask(self, start: int, size: int, since: str, until: str) -> dict:
        span = {"lastModStartDate": since, "lastModEndDate": until} if since else {}
        request = Request(f"{self.url}?{urlencode({'startIndex': start, 'resultsPerPage': size, **span})}", headers={"apiKey": self.token} if self.token else {})
        for turn in range(self.attempts):
            try:
                with urlopen(request, timeout=60) as reply:
                    return json.load(reply)
            except (URLError, TimeoutError, ConnectionError, json.JSONDecodeError):
                if turn == self.attempts - 1:
                    raise
                time.sleep(self.delay * 2**turn)
        raise ValueError("attempts must be positive")

    def now(self) -> str:
        return self.ask(0, 1, "", "")["timestamp"]

    def pages(self, since: str, until: str) -> list[Page]:
        if since and (datetime.fromisoformat(until) - datetime.fromisoformat(since)).days > REACH:
            since = ""
        total = int(self.ask(0, 1, since, until)["totalResults"])
        return [Page(at, since, until) for at in range(0, total, self.size)]

    def rows(self, page: Page | None) -> Iterator[tuple[str, str | None, str]]:
        if page is None:  # Spark's stand-in where there are no pages
            return
        for entry in self.ask(page.start, self.size, page.since, page.until)[self.items]:
            found = entry[self.item] if self.item else entry
            if found.get(self.key) is not None:
                yield str(found[self.key]), found.get(self.modified), json.dumps(found, ensure_ascii=False, sort_keys=True)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.feed = Feed(options)

    def partitions(self) -> list[Page]:
        return self.feed.pages("", self.feed.now())

    def read(self, page: Page) -> Iterator[tuple]:
        return self.feed.rows(page)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.feed = Feed(options)

    def initialOffset(self) -> dict:
        return {"mark": ""}

    def latestOffset(self) -> dict:
        return {"mark": self.feed.now()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.feed.pages(start["mark"], end["mark"])

    def read(self, page: Page) -> Iterator[tuple]:
        return self.feed.rows(page)

    def commit(self, end: dict) -> None:
        """Nothing is held back."""


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(dict(self.options))
