"""Paged and per-id sources as a Python data source: bounded parallelism, retry with back-off, type checks."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Page size, retries and the base of the back-off.
PAGE, RETRIES, BASE_SECONDS, JITTER_SECONDS = 100, 2, 0.5, 0.199


class Retryable(Exception):
    """A failure that another try may mend."""


def with_retry(call: Callable, retries: int = RETRIES, base: float = BASE_SECONDS, sleep: Callable = time.sleep):
    """Call until it succeeds; waits double and carry some chance, other errors pass through."""
    for turn in range(retries + 1):
        try:
            return call()
        except Retryable:
            if turn == retries:
                raise
            sleep(base * 2**turn + random.random() * JITTER_SECONDS)


def pages(fetch: Callable[[int, int], list], size: int = PAGE) -> Iterator[tuple[int, dict]]:
    """``(ordinal, record)`` until a page comes up short; anything but a list of objects is an error."""
    offset = 0
    while True:
        page = with_retry(lambda at=offset: fetch(at, size))
        if not isinstance(page, list) or not all(isinstance(r, dict) for r in page):
            raise ValueError("a page is not a list of objects")
        yield from enumerate(page, offset)
        if len(page) < size:
            return
        offset += len(page)


class _Ids(InputPartition):
    def __init__(self, ids):
        self.ids = ids


class PagedSource(DataSource):
    """Format ``millrace-paged``: option ``module`` and ``fetch`` name an importable function.

    Without ids, ``fetch(offset, limit)`` is paged by one reader, since the end shows only in a
    short page. With option ``ids`` (comma-separated), ``fetch(id)`` runs in batches of ``batch``.
    """

    @classmethod
    def name(cls) -> str:
        return "millrace-paged"

    def schema(self) -> str:
        return "ord long, id string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        ids = [i for i in self.options.get("ids", "").split(",") if i]
        size = int(self.options.get("batch", "20"))
        return [_Ids(ids[i : i + size]) for i in range(0, len(ids), size)] or [_Ids(None)]

    def read(self, partition):
        import importlib

        fetch = getattr(importlib.import_module(self.options["module"]), self.options["fetch"])
        if partition.ids is None:
            for ord_, record in pages(fetch, int(self.options.get("page", PAGE))):
                yield ord_, None, json.dumps(record, ensure_ascii=False)
        else:
            for i, own in enumerate(partition.ids):
                yield i, own, json.dumps(with_retry(lambda own=own: fetch(own)), ensure_ascii=False)


def read_pages(spark: SparkSession, module: str, fetch: str, ids: list[str] | None = None, **options) -> DataFrame:
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("millrace-paged").option("module", module).option("fetch", fetch)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return (reader.option("ids", ",".join(map(str, ids))) if ids else reader).load()


def json_records(spark: SparkSession, path: str, key: str = "contracts", schema: str = "map<string,string>") -> DataFrame:
    """``(path, ord, record, error)`` of files with an array, or an object that holds one under ``key``; a file that
    is neither, or holds something other than objects, has an error."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    bare = F.ltrim("value")
    body = F.when(bare.startswith("["), F.col("value")).otherwise(F.get_json_object("value", f"$.{key}"))
    rows = files.withColumn("items", F.from_json(body, "array<string>"))
    odd = F.exists("items", lambda i: i.isNull() | ~F.ltrim(i).startswith("{"))
    error = F.when(F.col("items").isNull(), F.lit("no array of records")).when(odd, F.lit("all records must be objects"))
    rows = rows.withColumn("error", error)
    good = rows.where("error is null").select("path", F.posexplode("items").alias("ord", "item"))
    good = good.select("path", "ord", F.from_json("item", schema).alias("record"), F.lit(None).cast("string").alias("error"))
    bad = rows.where("error is not null").select("path", F.lit(None).cast("int").alias("ord"), F.lit(None).cast(schema).alias("record"), "error")
    return good.unionByName(bad)
