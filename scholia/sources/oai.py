"""OAI-PMH harvest: records from pages, checkpointed token stream.

Pages come from a plug-in transport with ``list(token, since) -> bytes``.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from datetime import UTC, datetime
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

RECORD_SCHEMA = "identifier string, datestamp string, sets array<string>, metadata string"
#: Pages in a row with the same token, or without a record, before the harvest starts again from the last date.
STUCK = 3
#: Tries of a page, seconds to wait where a busy service doesn't say, and the factor of the wait after each failure.
TRIES, BUSY_DELAY, BACKOFF = 6, 10, 2.0


class Busy(Exception):
    """The service answers 503; ``retry_after``: its Retry-After header, if there is one."""

    def __init__(self, retry_after: str | None = None) -> None:
        super().__init__("503")
        self.retry_after = retry_after


def fetch(transport, token: str | None, since: str | None, sleep=time.sleep) -> bytes | None:
    """S3: a page, after as many waits as the service asks for and twice as long a one after each failure.

    None if a token keeps failing and there's a date to begin anew from; else the last failure is raised
    after TRIES (busy) or twice as many (failed) tries, so that the task can be retried.
    """
    busy = failed = 0
    while True:
        try:
            return transport.list(token, since)
        except Busy as e:
            busy += 1
            if busy > TRIES:
                raise
            sleep(int(e.retry_after) if e.retry_after and e.retry_after.isdigit() else BUSY_DELAY)
        except OSError:
            failed += 1
            if failed >= TRIES and token and since:
                return None
            if failed > 2 * TRIES:
                raise
            sleep(BACKOFF**failed)


def local_name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def to_value(element: ElementTree.Element):
    """A leaf as its trimmed text, else a dict by tag; a repeated tag becomes a list, attributes drop."""
    children = list(element)
    if not children:
        return (element.text or "").strip()
    grouped: dict[str, list] = {}
    for child in children:
        grouped.setdefault(local_name(child.tag), []).append(to_value(child))
    return {name: values[0] if len(values) == 1 else values for name, values in grouped.items()}


def _children(element, name: str):
    return [c for c in element if local_name(c.tag) == name]


def records(page: bytes):
    """(identifier, datestamp, sets, metadata JSON or None) of every record; deleted ones have no metadata."""
    root = ElementTree.fromstring(page)
    for record in (e for e in root.iter() if local_name(e.tag) == "record"):
        header = next(iter(_children(record, "header")), None)
        get = lambda n: next((c.text or "" for c in _children(header, n)), "").strip() if header is not None else ""
        sets = [(c.text or "").strip() for c in _children(header, "setSpec")] if header is not None else []
        body = next(iter(_children(record, "metadata")), None)
        inner = list(body) if body is not None else []
        metadata = json.dumps(to_value(inner[0] if len(inner) == 1 else body), ensure_ascii=False) if inner else None
        yield get("identifier"), get("datestamp"), sets, metadata


def resumption(page: bytes) -> tuple[str | None, dict]:
    """The token (None at the end) and its attributes."""
    for e in ElementTree.fromstring(page).iter():
        if local_name(e.tag) == "resumptionToken":
            return ((e.text or "").strip() or None), dict(e.attrib)
    return None, {}


def expired(info: dict, now: datetime | None = None) -> bool:
    """Whether the token's expirationDate has passed; one that can't be read hasn't."""
    try:
        at = datetime.fromisoformat(str(info.get("expirationDate", "")).replace("Z", "+00:00"))
    except ValueError:
        return False
    return (at if at.tzinfo else at.replace(tzinfo=UTC)) < (now or datetime.now(UTC))


class FolderTransport:
    """Pages from files named after their token; 'start' is the first."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def list(self, token: str | None, since: str | None) -> bytes:
        with open(os.path.join(self.folder, f"{token or 'start'}.xml"), "rb") as f:
            return f.read()


class OaiStream(SimpleDataSourceStreamReader):
    """Offset: token, date of the last record, and how often nothing moved. Repeats are dropped downstream by id."""

    def __init__(self, options) -> None:
        self.options = options

    def _transport(self):
        module, _, name = self.options.get("transport", "scholia.sources.oai:FolderTransport").partition(":")
        return getattr(importlib.import_module(module), name)(self.options["path"])

    def initialOffset(self):
        return {"token": "", "since": self.options.get("from", ""), "last": "", "stuck": 0, "done": 0}

    def _next(self, start):
        page = fetch(self._transport(), start["token"] or None, start["since"] or None)
        if page is None:  # the token is stale: begin anew at the last date
            return [], start | {"token": "", "stuck": 0}
        rows = list(records(page))
        ids = [r[0] for r in rows]
        if not start["token"] and start.get("last") in ids:  # begun anew: what came up to the last record is known
            rows = rows[ids.index(start["last"]) + 1 :]
        token, info = resumption(page)
        stuck = start["stuck"] + 1 if (token == start["token"] and token) or not rows else 0
        since = max([start["since"], *(r[1] for r in rows)])
        last = rows[-1][0] if rows else start.get("last", "")
        if token and (stuck >= STUCK or expired(info)):
            token, stuck = "", 0  # begin anew at the last date
            return rows, {"token": "", "since": since, "last": last, "stuck": 0, "done": 0}
        return rows, {"token": token or start["token"], "since": since, "last": last, "stuck": stuck, "done": int(not token)}

    def read(self, start):
        if start["done"]:
            return iter(()), start
        rows, end = self._next(start)
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        return iter(()) if start["done"] else iter(self._next(start)[0])

    def commit(self, end):
        pass


class OaiSource(DataSource):
    @classmethod
    def name(cls):
        return "oai_pmh"

    def schema(self):
        return RECORD_SCHEMA

    def simpleStreamReader(self, schema):
        return OaiStream(self.options)
