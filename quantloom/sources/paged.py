"""A batch data source over a paged JSON service: one input partition a request key, retries inside the task.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("transport", "module:function").option("keys", '["A", "B"]').schema(...).load()

The transport is a function (key, start) -> (rows, total or None), rows being lists of values in the schema's order;
it raises TransientError for what is worth another try and SubscriptionError for what is not.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quantloom.sources.tables import EngineError, SubscriptionError


class TransientError(EngineError):
    """Worth another try: throttling, a server's error, a broken connection."""


Transport = Callable[[str, int], tuple[list[list], int | None]]


def with_retries(call: Callable[[], object], tries: int = 5, base: float = 0.5, pause: Callable[[float], None] = time.sleep):
    """call(), again after TransientError with waits of base * 2**k seconds, 60 at most."""
    for k in range(tries):
        try:
            return call()
        except TransientError:
            if k == tries - 1:
                raise
            pause(min(60.0, base * 2**k))


def fetch_rows(transport: Transport, key: str, cap: int | None = None, tries: int = 5, pause: Callable[[float], None] = time.sleep) -> Iterator[list]:
    """All pages of a key: until an empty page, or until the total is reached. A page that doesn't advance, and more
    than `cap` rows (a sign of truncation by the service), raise."""
    start, seen = 0, None
    while True:
        rows, total = with_retries(lambda at=start: transport(key, at), tries, pause=pause)
        if not rows:
            return
        if rows == seen:
            raise EngineError(f"{key}: the page at {start} repeats the one before")
        seen, start = rows, start + len(rows)
        if cap is not None and start >= cap:
            raise EngineError(f"{key}: {start} rows; the service may have cut them at {cap}")
        yield from rows
        if total is not None and start >= total:
            return


def demo_pages(key: str, start: int) -> tuple[list[list], int | None]:
    """A transport without a network: seven rows in pages of three."""
    rows = [[i, f"{key}{i}"] for i in range(7)]
    return rows[start : start + 3], len(rows)


_failed: set[tuple[str, int]] = set()


def demo_service(key: str, start: int) -> tuple[list[list], int | None]:
    """The same from a service that fails the first time each page is asked for, and doesn't tell its total."""
    if (key, start) not in _failed:
        _failed.add((key, start))
        raise TransientError("try again")
    return demo_pages(key, start)[0], None


def demo_days(key: str, start: int) -> tuple[list[list], int | None]:
    """Rows of one day, a key YYYY-MM-DD: as many as the day of its month modulo 5."""
    return [[i, f"{key}#{i}"] for i in range(int(key[8:]) % 5)][start:], None


class _Key(InputPartition):
    def __init__(self, key: str):
        self.key = key


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Key]:
        return [_Key(k) for k in json.loads(self.options["keys"])]

    def read(self, partition: _Key) -> Iterator[tuple]:
        module, _, name = self.options["transport"].partition(":")
        cap = self.options.get("cap")
        wait = float(self.options.get("pause", "1"))
        call = getattr(importlib.import_module(module), name)
        for row in fetch_rows(call, partition.key, int(cap) if cap else None, pause=lambda s: time.sleep(s * wait)):
            yield (partition.key, *row)


class PagedSource(DataSource):
    """Columns: key, then those of the transport's rows."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


__all__ = ["PagedSource", "SubscriptionError", "TransientError", "fetch_rows", "with_retries"]
