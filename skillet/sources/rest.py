"""Paged and batched web sources: the requests are made by functions that are handed in, so that any transport serves."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records of a page, ids of a batch, tries of a request.
PAGE, BATCH, TRIES = 200, 20, 5


class Refused(Exception):
    """An answer that another try won't change, such as a wrong key."""


def api_key(name: str = "FOOD_API_KEY") -> str:
    """The key from the environment; a missing one is said plainly before any request."""
    if not (key := os.environ.get(name, "").strip()):
        raise Refused(f"set {name} to the key of the service")
    return key


def tried(request: Callable[[], object], tries: int = TRIES, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The answer of a request; failures but ``Refused`` are tried again after 1, 2, 4 ... times ``pause``."""
    for k in range(tries):
        try:
            return request()
        except Refused:
            raise
        except Exception:
            if k == tries - 1:
                raise
            sleep(pause * 2**k)


def pages(get: Callable[[int], list[dict]], size: int = PAGE, first: int = 1, **how) -> Iterator[dict]:
    """The records of all pages; the first page that isn't full is the last."""
    number = first
    while True:
        page = tried(lambda: get(number), **how) or []  # noqa: B023
        yield from page
        if len(page) < size:
            return
        number += 1


class PagedReader(DataSourceReader):
    def __init__(self, get, total: int, size: int):
        self.get, self.size, self.numbers = get, size, range(1, -(-total // size) + 1)

    def partitions(self):
        return [InputPartition(n) for n in self.numbers]

    def read(self, partition):
        for record in tried(lambda: self.get(partition.value)) or []:
            yield (json.dumps(record),)


def paged_source(name: str, get: Callable[[int], list[dict]], total: int, size: int = PAGE) -> type[DataSource]:
    """A data source of ``total`` records whose pages are read by the executors, one page a partition: register it and load by ``name``."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "raw_payload string"

        def reader(self, schema):
            return PagedReader(get, total, size)

    return Paged


def fetched(spark: SparkSession, ids: DataFrame, post: Callable[[list[str]], dict[str, dict]], cached: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """(id, raw_payload) of the distinct ``ids``: those that ``cached`` lacks are posted in batches by the executors and added to it.

    An id that no answer holds comes out with a null payload, so that it isn't asked for again.
    """
    asked = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id is not null").distinct()
    if cached is not None:
        asked = asked.join(cached.select("id"), "id", "left_anti")

    def run(batches):
        import pandas as pd

        for b in batches:
            for k in range(0, len(b), batch):
                part = b["id"].iloc[k : k + batch].tolist()
                got = tried(lambda: post(part)) or {}  # noqa: B023
                yield pd.DataFrame({"id": part, "raw_payload": [json.dumps(got[i]) if i in got else None for i in part]})

    new = asked.mapInPandas(run, "id string, raw_payload string")
    return new if cached is None else cached.select("id", "raw_payload").unionByName(new)
