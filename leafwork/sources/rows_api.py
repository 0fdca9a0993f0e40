"""Batch data source over a paged HTTP rows service: format("paged_rows")."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedRows(DataSource):
    """Options: url (with {offset} and {length}), total, length (rows a page), pages (a partition).

    A page that can't be had fails its task, and so the read: no page is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "row_idx long, row string"

    def reader(self, schema) -> DataSourceReader:
        return PagedRowsReader(self.options)


class PagedRowsReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.url, self.total = options["url"], int(options["total"])
        self.length, self.pages = int(options.get("length", 100)), int(options.get("pages", 10))

    def partitions(self) -> list[InputPartition]:
        step = self.length * self.pages
        return [InputPartition((at, min(at + step, self.total))) for at in range(0, self.total, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        begin, end = partition.value
        for at in range(begin, end, self.length):
            with urlopen(self.url.format(offset=at, length=min(self.length, end - at)), timeout=60) as page:
                for row in json.load(page)["rows"]:
                    yield row["row_idx"], json.dumps(row["row"], ensure_ascii=False)
