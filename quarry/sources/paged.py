"""Paginated sources as a Spark data source: a partition is a range of pages, filters go to the server, failing pages are reported."""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, StringStartsWith

#: (options, page, filters) -> {"data": [items], "meta": {"pagination": {"totalCount", "totalPages"}}}; an error is retried.
Transport = Callable[[dict, int, list[tuple[str, str, object]]], dict]
ATTEMPTS, LONGEST_WAIT = 6, 30
_SENT = {EqualTo: "$eq", GreaterThan: "$gt", GreaterThanOrEqual: "$gte", StringStartsWith: "$startsWith", IsNotNull: "$notNull"}
_TESTS = {"$notNull": lambda a, b: True, "$eq": lambda a, b: a == b, "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$startsWith": lambda a, b: str(a).startswith(b)}


def landed_page(options: dict, page: int, filters: list[tuple[str, str, object]]) -> dict:
    """The transport of pages that land() wrote: the folder ``page=N`` of the option ``path``, filtered as a server would."""
    root = options["path"].removeprefix("file://").removeprefix("file:")
    pages = [int(x.partition("=")[2]) for x in os.listdir(root) if x.startswith("page=")]
    folder, items = os.path.join(root, f"page={page}"), []
    for name in sorted(os.listdir(folder)) if page in pages else ():
        if not name.startswith((".", "_")):
            with open(os.path.join(folder, name), encoding="utf-8") as lines:
                items += [json.loads(x) for x in lines if x.strip()]
    fits = lambda item: all(item.get(c) is not None and _TESTS[op](item[c], v) for op, c, v in filters)
    return {"data": [x for x in items if fits(x)], "meta": {"pagination": {"totalPages": max(pages, default=0)}}}


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = dict(options), names
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the comparisons that the server knows, on columns of the items; Spark keeps the others.

        Spark does not test again what is taken, so rows of failed pages, which have no items, stay.
        """
        for f in filters:
            if type(f) in _SENT and len(f.attribute) == 1 and f.attribute[0] not in ("page", "place", "error"):
                self.filters.append((_SENT[type(f)], f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def _fetch(self, page: int) -> tuple[dict | None, str | None]:
        """(body, None), or (None, the last error) after ATTEMPTS; waits 1, 2, 4 ... seconds, 30 at most, times the option ``wait``."""
        module, _, name = self.options.get("transport", f"{__name__}:landed_page").partition(":")
        transport: Transport = getattr(importlib.import_module(module), name)
        error = ""
        for k in range(ATTEMPTS):
            try:
                return transport(self.options, page, self.filters), None
            except Exception as e:  # any failure of a page costs that page only, and is reported
                error = f"{type(e).__name__}: {e}"[:200]
                if k + 1 < ATTEMPTS:
                    time.sleep(min(2**k, LONGEST_WAIT) * float(self.options.get("wait", "1")))
        return None, error

    def partitions(self) -> list[InputPartition]:
        """Page ranges, by the first page's count; if that page fails it alone is read, and reported."""
        body, _ = self._fetch(1)
        last = int(body["meta"]["pagination"]["totalPages"]) if body else 1
        step = int(self.options.get("pages_a_partition", "8"))
        return [Pages(k, min(k + step - 1, last)) for k in range(1, last + 1, step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        own = [c for c in self.names if c not in ("page", "place", "error")]
        for page in range(partition.first, partition.last + 1):
            body, error = self._fetch(page)
            if body is None:
                yield tuple({"page": page, "error": error}.get(c) for c in self.names)
                continue
            for place, item in enumerate(body.get("data", [])):
                values = {"page": page, "place": place, **{c: item.get(c) for c in own}}
                yield tuple(values.get(c) for c in self.names)


class Paged(DataSource):
    """Format ``paged``: rows of (page, place, error, ...) with the stated columns of each item.

    Options: ``transport`` (module:function; landed_page by default, which wants ``path``),
    ``pages_a_partition`` (8), ``wait`` (1; times the pauses between attempts).  A page that
    fails six times gives one row with its number and its error, and no item.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, schema.names)


def read(spark: SparkSession, columns: str, **options: object) -> DataFrame:
    """(page, place, error, ``columns``) of a paginated source; filters on ``columns`` are sent to it."""
    spark.dataSource.register(Paged)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged").schema(f"page int, place int, error string, {columns}").options(**{k: str(v) for k, v in options.items()}).load()


def land(items: DataFrame, number: str, size: int, path: str) -> None:
    """Writes items as pages of ``size`` consecutive numbers (from 0; null is 0): a folder of JSON lines for each page, from 1 on."""
    page = (F.floor(F.coalesce(F.col(number), F.lit(0)) / size) + 1).cast("int")
    items.withColumn("page", page).repartition("page").sortWithinPartitions("page", number).write.mode("overwrite").partitionBy("page").json(path)


def fetched(pages: DataFrame, target: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, skipped): the items in the source's order, up to ``target`` where given (S17), and the pages that failed with their errors."""
    items = pages.where("error IS NULL").drop("error")
    if target is not None:
        items = items.orderBy("page", "place").limit(target)
    return items, pages.where("error IS NOT NULL").select("page", "error")
