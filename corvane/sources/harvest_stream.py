"""A paged list as a stream: its offsets are resumption tokens, so a harvest goes on after a stop where it was."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

_TOKEN = re.compile(r"<resumptionToken[^>]*>\s*([^<\s][^<]*?)\s*</resumptionToken>")


class _Pages(SimpleDataSourceStreamReader):
    """Page by page; a page is known by its number and the token that asks for it."""

    def __init__(self, fetch: Callable[[str | None], str]):
        self.fetch = fetch

    def initialOffset(self) -> dict:
        return {"page": 0, "token": "", "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter([]), start
        page = self.fetch(start["token"] or None)
        found = _TOKEN.search(page)
        return iter([(start["page"], start["token"], page)]), {"page": start["page"] + 1, "token": found[1] if found else "", "done": not found}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages of a batch that must run again."""
        at = start
        while at["page"] < end["page"]:
            rows, at = self.read(at)
            yield from rows


def registered(spark: SparkSession, fetch: Callable[[str | None], str], name: str = "paged_harvest") -> str:
    """Make fetch(token) (None: the first page) readable as spark.readStream.format(name): page, token, xml."""

    class Harvest(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page int, token string, xml string"

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Pages(fetch)

    spark.dataSource.register(Harvest)
    return name


def landed(pages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write each batch of pages below folder, which records.scan() reads. A batch that runs again takes the place of its first run."""

    def land(batch: DataFrame, number: int) -> None:
        batch.select("xml").write.mode("overwrite").text(f"{folder}/batch_{number:06d}")

    return pages.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).start()
