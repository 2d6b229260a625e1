"""A paged interface as a Spark data source, for batches and streams.

``fetch(cursor, limit)`` gives ``{"items": [...], "cursor": next or None}``.
Without a network, ``folder`` is such an interface: its files, in order of name,
hold the items, and a file of more than ``limit`` is several pages.
"""

from __future__ import annotations

import importlib
import json
import os
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

Page = dict


class PageError(OSError):
    """A page could not be had."""


def with_retries(fetch: Callable[[], Page], tries: int = 5, delay: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Page | None:
    """The page, or None once all tries have failed. Waits grow by ``factor``, with jitter."""
    for turn in range(tries):
        try:
            return fetch()
        except Exception:
            if turn + 1 < tries:
                sleep(delay * factor**turn * random.uniform(0.5, 1.5))
    return None


def pages(fetch: Callable[[str | None, int], Page], limit: int = 100, max_pages: int | None = None, cursor: str | None = None, pause: float = 0.0, on_failure: str = "raise", **retries) -> Iterator[tuple[dict, str | None]]:
    """(item, cursor after its page) until there is no further cursor, or the page limit.

    A page that can't be had is an error, as what follows it would be missing;
    with ``on_failure="end"`` the items end there.
    """
    n = 0
    while max_pages is None or n < max_pages:
        at = cursor
        page = with_retries(lambda: fetch(at, limit), **retries)
        if page is None:
            if on_failure == "end":
                return
            raise PageError(f"no page at cursor {at!r} after {n} pages")
        cursor, n = page.get("cursor"), n + 1
        for item in page["items"]:
            yield item, cursor
        if cursor is None:
            return
        time.sleep(pause)


def folder(path: str) -> Callable[[str | None, int], Page]:
    """The cursor is the number of a file and, within a file, ``:`` and the number of items before."""
    names = sorted(os.listdir(path))

    def fetch(cursor: str | None, limit: int) -> Page:
        if limit < 1:
            raise ValueError(f"limit {limit} gives no items")
        i, _, skip = (cursor or "0").partition(":")
        i, skip = int(i), int(skip or 0)
        if i >= len(names):
            return {"items": [], "cursor": None}
        with open(os.path.join(path, names[i])) as f:
            items = json.load(f)
        upto = skip + limit
        after = f"{i}:{upto}" if upto < len(items) else str(i + 1) if i + 1 < len(names) else None
        return {"items": items[skip:upto], "cursor": after}

    return fetch


def _fetcher(options: dict) -> Callable[[str | None, int], Page]:
    """``fetch``: "module:function", called with the options; or ``folder``."""
    if "fetch" in options:
        module, _, name = options["fetch"].partition(":")
        return getattr(importlib.import_module(module), name)(options)
    return folder(options["folder"])


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").option("folder", path)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "__pos long, __doc string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(dict(self.options))


def _settings(options: dict) -> dict:
    return {"limit": int(options.get("limit", 100)), "max_pages": int(options["max_pages"]) if "max_pages" in options else None, "on_failure": options.get("on_failure", "raise")}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        for i, (item, _) in enumerate(pages(_fetcher(self.options), **_settings(self.options))):
            yield i, json.dumps(item, ensure_ascii=False)


class _StreamReader(SimpleDataSourceStreamReader):
    """Each batch is a page; the offset is the cursor and the items so far."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"cursor": None, "n": 0, "end": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["end"]:
            return iter([]), start
        page = with_retries(lambda: _fetcher(self.options)(start["cursor"], _settings(self.options)["limit"]))
        if page is None:
            if _settings(self.options)["on_failure"] == "end":
                return iter([]), start
            raise PageError(f"no page at cursor {start['cursor']!r}")
        rows = [(start["n"] + i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(page["items"])]
        return iter(rows), {"cursor": page["cursor"], "n": start["n"] + len(rows), "end": page["cursor"] is None}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.read(start)[0]
