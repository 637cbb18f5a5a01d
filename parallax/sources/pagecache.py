"""The page cache as a data source: pages are read, fetched and written by the tasks, a shard of the cache each.

``spark.read.format("page_cache").option("path", folder).load()`` has the columns page (a file's name), url, html and
error. Without a filter every cached page is a row, without its address. A filter on ``page`` or ``url`` (equality or a list of
values) is pushed down, and only the files that it names are opened; an absent one is downloaded where the source has
an address and a way to, and else is a row with the error. Each task keeps its share of the rate limit.

Pages lie in folders by the first two digits of their names, so that no one lists all of them.
"""

from __future__ import annotations

import importlib
import os
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from parallax.sources.fetch import FetchError, PageCache, RateLimiter, page_name

SCHEMA = "page string, url string, html string, error string"
#: Digits of a page's name that its folder has; tasks of a scan that names its pages.
DIGITS, TASKS = 2, 16


def place(folder: str, page: str) -> str:
    return os.path.join(folder, page[:DIGITS], page)


class Shard(InputPartition):
    """Folders to list, or pages by name and address."""

    def __init__(self, prefixes: list[str], named: list[tuple[str, str | None]], of: int):
        self.prefixes, self.named, self.of = prefixes, named, of


class PageCacheReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].removeprefix("file://")
        self.gap, self.per_minute = float(options.get("gap", 3.5)), float(options.get("per_minute", 16))
        self.download = options.get("download")
        self.pages: set[str] | None = None
        self.urls: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what names pages or addresses; all other filters go back to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("page",), ("url",)):
                yield f
            elif f.attribute == ("page",):
                self.pages = values if self.pages is None else self.pages & values
            else:
                self.urls = values if self.urls is None else self.urls & values

    def partitions(self) -> list[Shard]:
        if self.pages is None and self.urls is None:
            digits = [f"{i:0{DIGITS}x}" for i in range(16**DIGITS)]
            return [Shard([p], [], len(digits)) for p in digits]
        if self.urls is None:
            named = [(p, None) for p in sorted(p for p in self.pages if p)]
        else:
            named = [(page_name(u), u) for u in sorted(u for u in self.urls if u)]
            named = [x for x in named if self.pages is None or x[0] in self.pages]
        dealt: dict[int, list] = defaultdict(list)
        for at, x in enumerate(sorted(named)):
            dealt[at * min(TASKS, len(named)) // len(named)].append(x)
        return [Shard([], own, len(dealt)) for own in dealt.values()] or [Shard([], [], 1)]

    def read(self, shard: Shard) -> Iterator[tuple]:
        for prefix in shard.prefixes:
            folder = os.path.join(self.folder, prefix)
            for page in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
                if page.endswith(".html"):
                    yield page, None, self.text(page), None
        cache = PageCache(self.folder, self.downloader(), RateLimiter(self.gap * shard.of, max(1, int(self.per_minute / shard.of))))
        for page, url in shard.named:
            if os.path.exists(place(self.folder, page)):
                yield page, url, self.text(page), None
            elif url is None:
                yield page, None, None, "not in the cache"
            else:
                try:
                    yield page, url, cache.get(url), None
                except FetchError as e:
                    yield page, url, None, e.reason

    def text(self, page: str) -> str:
        with open(place(self.folder, page), encoding="utf-8", errors="replace") as f:
            return f.read()

    def downloader(self):
        """The function that the option names as module:function; none is offline."""
        if not self.download:
            return None
        module, name = self.download.split(":")
        return getattr(importlib.import_module(module), name)


class PageCacheWriter(DataSourceWriter):
    """Writes rows (page, html) or (url, html); a page is complete or absent, and the last of equal names stays."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.folder, self.columns = options["path"].removeprefix("file://"), columns

    def write(self, rows: Iterator) -> WriterCommitMessage:
        for row in rows:
            cells = dict(zip(self.columns, row, strict=True))
            page = cells.get("page") or (cells.get("url") and page_name(cells["url"]))
            if page and cells.get("html") is not None:
                target = place(self.folder, page)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(cells["html"])
                os.replace(part, target)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        """Every page was put in its place by itself."""

    def abort(self, messages) -> None:
        """Pages that were written are whole, and stay."""


class PageCacheSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageCacheReader:
        return PageCacheReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PageCacheWriter:
        return PageCacheWriter(self.options, schema.names)


def read_cache(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """(page, url, html, error) of a cache in a folder that all executors share; see the module for filters."""
    spark.dataSource.register(PageCacheSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("page_cache").options(path=folder, **options).load()


def write_cache(pages: DataFrame, folder: str) -> None:
    """Adds pages (page or url, html) to a cache; rows without a name or text are left out."""
    pages.sparkSession.dataSource.register(PageCacheSource)
    pages.write.format("page_cache").option("path", folder).mode("append").save()
