"""Cursor-paged REST source of works, batch and streaming.

The transport is a plug-in: an object with ``page(cursor) -> dict`` of the API's shape. Without a
network, `FolderTransport` serves pages from a folder of JSON files.
"""

from __future__ import annotations

import importlib
import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from scholia.functions.text import file_name, id_in_url, title_or_default

#: The source whose locations count, and the delays of the polite client.
SOURCE_ID = "S4306400194"
PAGE_DELAY, TOO_MANY_DELAY, NETWORK_DELAY = 0.2, 10.0, 5.0
PAGE_SCHEMA = (
    "id string, title string, display_name string, cited_by_count bigint, ids struct<arxiv:string>, "
    "locations array<struct<source:struct<id:string>,pdf_url:string>>"
)
ROW_SCHEMA = "id string, payload string"


class TooManyRequests(Exception):
    """The server asked to slow down (status 429)."""


class FolderTransport:
    """Pages from files named after their cursor; '*' is the first."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def page(self, cursor: str) -> dict:
        name = "start" if cursor == "*" else cursor
        with open(os.path.join(self.folder, f"{name}.json"), encoding="utf-8") as f:
            return json.load(f)


def fetch(transport, cursor: str, attempts: int = 6, sleep=time.sleep) -> dict:
    """One page, waiting as the answers ask; gives up after ``attempts`` so that the task can be retried."""
    for attempt in range(attempts):
        try:
            return transport.page(cursor)
        except TooManyRequests:
            sleep(TOO_MANY_DELAY)
        except OSError:
            if attempt == attempts - 1:
                raise
            sleep(NETWORK_DELAY)
    raise RuntimeError(f"no answer for cursor {cursor}")


def _transport(options):
    module, _, name = options.get("transport", "scholia.sources.works_api:FolderTransport").partition(":")
    return getattr(importlib.import_module(module), name)(options["path"])


def _rows(page: dict):
    return [(w.get("id"), json.dumps(w)) for w in page.get("results") or []]


class WorksReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = options

    def partitions(self):
        return [InputPartition(0)]  # a cursor chain is sequential

    def read(self, partition):
        transport, cursor, limit, seen = _transport(self.options), "*", int(self.options.get("limit", 0)), 0
        while cursor:
            page = fetch(transport, cursor)
            rows = _rows(page)
            for row in rows:
                yield row
                seen += 1
                if limit and seen >= limit:
                    return
            cursor = (page.get("meta") or {}).get("next_cursor") if rows else None


class WorksStream(SimpleDataSourceStreamReader):
    """The cursor is the offset, so the checkpoint resumes where the last page ended."""

    def __init__(self, options) -> None:
        self.options = options

    def initialOffset(self):
        return {"cursor": "*", "done": 0}

    def read(self, start):
        if start["done"]:
            return iter(()), start
        page = fetch(_transport(self.options), start["cursor"])
        following = (page.get("meta") or {}).get("next_cursor") if page.get("results") else None
        return iter(_rows(page)), {"cursor": following or start["cursor"], "done": int(not following)}

    def readBetweenOffsets(self, start, end):
        return iter(_rows(fetch(_transport(self.options), start["cursor"]))) if not start["done"] else iter(())

    def commit(self, end):
        pass


class WorksSource(DataSource):
    """``spark.dataSource.register(WorksSource)``, then ``spark.read.format("works_api")``."""

    @classmethod
    def name(cls):
        return "works_api"

    def schema(self):
        return ROW_SCHEMA

    def reader(self, schema):
        return WorksReader(self.options)

    def simpleStreamReader(self, schema):
        return WorksStream(self.options)


def works(payloads: DataFrame, source: str = SOURCE_ID) -> DataFrame:
    """The wanted fields of raw works; those without a PDF at the source drop out, repeated ids too."""
    w = payloads.select(F.from_json("payload", PAGE_SCHEMA).alias("w")).select("w.*")
    at = F.try_element_at(F.filter("locations", lambda x: F.endswith(x["source"]["id"], F.lit(source))), F.lit(1))
    named = w.withColumn("pdf_url", at["pdf_url"]).filter(F.col("pdf_url") != "")
    identifier = F.coalesce(F.col("ids.arxiv"), id_in_url("pdf_url"))
    typed = named.withColumn("arxiv_id", identifier).withColumn("shown", title_or_default("title", "display_name"))
    return typed.select("id", F.col("shown").alias("title"), file_name("arxiv_id", "shown").alias("filename"), "pdf_url", F.col("cited_by_count").alias("citations"), "arxiv_id").dropDuplicates(["id"])


def top_cited(rows: DataFrame, n: int) -> DataFrame:
    """The n most cited; the id breaks ties."""
    return rows.orderBy(F.desc("citations"), F.asc("id")).limit(n)
