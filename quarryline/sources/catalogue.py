"""Catalogue APIs as a Python data source.

    spark.dataSource.register(CatalogueSource)
    spark.read.format("catalogue").option("client", "package.module:make_client").option("pages", 40).load()

A client is made once a task by the named function. It has ``page(number) -> list of dicts`` and, where
details are asked for, ``detail(id) -> dict or None`` and ``readme(id, branch) -> str or None``. Pages are
the partitions, so they are fetched in parallel and again if an executor is lost.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from importlib import import_module
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = "id string, title string, raw_description string, url string, tags array<string>, license string, language string, page int, collected_at string"
TRIES, FIRST_WAIT, LONGEST_WAIT = 12, 30.0, 600.0
BRANCHES = ("main", "master")


class StatusError(Exception):
    """A client's answer with an HTTP status."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def with_retry(call: Callable[[], Any], sleep: Callable[[float], None] = time.sleep, tries: int = TRIES) -> Any:
    """The call's result; 429 and 5xx are tried again after 30, 60, 120 ... at most 600 seconds and up to 5 more, anything else is raised."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:
            status = getattr(e, "status", None)
            busy = status == 429 or (status is not None and 500 <= status <= 599) or (status is None and any(w in str(e).lower() for w in ("too many requests", "429")))
            if not busy:
                raise
            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**n) + random.random() * 5)
    raise RuntimeError(f"no answer after {tries} tries")


def readme(client: Any, ident: str) -> str:
    """The first branch whose text is not blank; a branch that fails counts as missing."""
    for branch in BRANCHES:
        try:
            text = client.readme(ident, branch)
        except Exception:
            continue
        if text and text.strip():
            return text
    return ""


def detail(client: Any, ident: str) -> dict:
    """A record's details; one that cannot be had is empty."""
    try:
        return client.detail(ident) or {}
    except Exception:
        return {}


class _Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client = options["client"]
        self.pages = int(options.get("pages", "1"))
        self.details = options.get("details", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Page(n) for n in range(self.pages)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        module, _, name = self.client.partition(":")
        client = getattr(import_module(module), name)()
        for row in with_retry(lambda: client.page(partition.number)):
            ident = str(row["id"])
            more = detail(client, ident) if self.details else {}
            text = readme(client, ident) if self.details else ""
            # A card's first 40 lines, else what the listing or its details say.
            text = "\n".join(text.split("\n")[:40]).strip() or str(more.get("description") or row.get("description") or "").strip()
            known = {**row, **{k: v for k, v in more.items() if v}}
            yield (ident, known.get("title"), text, known.get("url"), [str(t) for t in known.get("tags") or []], known.get("license"), known.get("language"), partition.number, datetime.now(timezone.utc).isoformat())


class CatalogueSource(DataSource):
    """S7-S10."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
