"""A Spark data source of fetched pages: one partition per request, query and page.

    spark.dataSource.register(PageSource)
    pages = (
        spark.read.format("fetched_pages")
        .option("fetcher", "my_package.my_module:fetch")
        .option("requests", json.dumps(["a", "b"])).option("queries", 4).option("pages", 4)
        .load()
        .filter("from_time >= '2024-01-15' AND to_time <= '2024-01-22' AND query_no IN (0, 2)")
    )

``fetch(request_id, query_no, page_no, from_time, to_time)`` returns (ok, payload). It runs in
the tasks, so fetching spreads over the cluster, and a lost task fetches its page again.
Filters on request, query and page leave partitions out; the window reaches the fetcher. What
raises counts as a page that failed, as a refused answer does.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "request_id string, query_no int, page_no int, from_time timestamp, to_time timestamp, ok boolean, payload string"


@dataclass
class Page(InputPartition):
    request_id: str
    query_no: int
    page_no: int


class PageReader(DataSourceReader):
    """Reads the pages that the options name and the filters leave."""

    def __init__(self, options: dict[str, str]) -> None:
        self.fetcher = options["fetcher"]
        self.wanted = {"request_id": json.loads(options["requests"]), "query_no": list(range(int(options["queries"]))), "page_no": list(range(1, int(options["pages"]) + 1))}
        self.from_time: dt.datetime | None = None
        self.to_time: dt.datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if isinstance(f, EqualTo | In) and name in self.wanted:
                values = f.value if isinstance(f, In) else (f.value,)
                self.wanted[name] = [v for v in self.wanted[name] if v in values]
            elif isinstance(f, GreaterThanOrEqual) and name == "from_time":
                self.from_time = max(self.from_time or f.value, f.value)
            elif isinstance(f, LessThanOrEqual) and name == "to_time":
                self.to_time = min(self.to_time or f.value, f.value)
            yield f  # Spark looks again: a page fetched for another window is not lost silently

    def partitions(self) -> list[InputPartition]:
        return [Page(r, q, p) for r in self.wanted["request_id"] for q in self.wanted["query_no"] for p in self.wanted["page_no"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        module, _, function = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), function)
        try:
            ok, payload = fetch(partition.request_id, partition.query_no, partition.page_no, self.from_time, self.to_time)
        except Exception:
            ok, payload = False, None
        yield partition.request_id, partition.query_no, partition.page_no, self.from_time, self.to_time, ok, payload


class PageSource(DataSource):
    """Format ``fetched_pages``; options fetcher, requests (a JSON list), queries, pages."""

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options)
