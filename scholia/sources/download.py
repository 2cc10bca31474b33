"""Fetching documents by URL (S22, S23, Z2's second half): skipped if there, one error a row, polite pauses.

The transport is a plug-in ``url -> (status, content type, bytes)``; there is no network here.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Seconds between two downloads of one task; the content type that counts as a document.
PAUSE, DOCUMENT = 3.0, "application/pdf"


def download(wanted: DataFrame, stored: DataFrame, fetch: Callable[[str], tuple[int, str, bytes]], pause: float = PAUSE) -> DataFrame:
    """(key, url, content BINARY, error) for rows (key, url) whose key isn't stored (Q15: by key, not by file name)."""
    todo = wanted.dropDuplicates(["key"]).join(stored.select("key"), "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, errors = [], []
            for n, url in enumerate(batch.column("url").to_pylist()):
                if n and pause:
                    time.sleep(pause)
                try:
                    status, kind, body = fetch(url)
                    good = status == 200 and DOCUMENT in kind
                    contents.append(body if good else None)
                    errors.append(None if good else f"status {status}, {kind}")
                except Exception as e:
                    contents.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["key", "url", "content", "error"])

    return todo.select("key", "url").mapInArrow(run, "key string, url string, content binary, error string")
