"""Paged JSON over HTTP as a Spark data source: pages are partitions, equality filters become query parameters.

    spark.dataSource.register(Rest)
    spark.read.format("rest").schema("id long, kind string").option("url", "http://host/items").load().where("kind = 'a'")

The service answers a page with an object that holds the items and how many there are over all pages. Options: url; items, total (names in
the answer); page, size (names of the parameters); page_size, pages_per_task, first_page; tries; header.<name>. A page that fails is asked for
again, with growing pauses; after the last try the task fails, and Spark runs it anew elsewhere.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import DataType, StructType

DEFAULTS = {"items": "items", "total": "total_items", "page": "page", "size": "size", "page_size": "100", "pages_per_task": "10", "first_page": "1", "tries": "4"}


@dataclass
class Pages(InputPartition):
    first: int
    last: int


def entry(value: Any, kind: DataType) -> Any:
    """JSON's value as the column's: numbers may come as text, and objects in text columns stay JSON."""
    name = kind.simpleString()
    if value is None:
        return None
    if name == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if name in ("double", "float"):
        return float(value)
    if name in ("bigint", "int", "smallint", "tinyint"):
        return int(value)
    return value


class Rest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        raise ValueError("a rest source needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RestReader(schema, DEFAULTS | dict(self.options))


class RestReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.fields, self.options, self.parameters = schema, options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities of top-level columns go to the service; what is returned Spark tests itself."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, (str, int)) and not isinstance(f.value, bool) and f.attribute[0] not in self.parameters:
                self.parameters[f.attribute[0]] = str(f.value)
            else:
                yield f

    def get(self, **more: int) -> dict:
        o = self.options
        asked = self.parameters | {o[k]: v for k, v in more.items()}
        at = f"{o['url']}{'&' if '?' in o['url'] else '?'}{urllib.parse.urlencode(asked)}"
        headers = {k.removeprefix("header."): v for k, v in o.items() if k.startswith("header.")}
        for k in range(int(o["tries"])):
            try:
                with urllib.request.urlopen(urllib.request.Request(at, headers=headers), timeout=30) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429 or k + 1 == int(o["tries"]):
                    raise
            except OSError:
                if k + 1 == int(o["tries"]):
                    raise
            time.sleep(0.1 * 2**k)
        raise AssertionError

    def partitions(self) -> list[InputPartition]:
        """One question for the number of items, then runs of pages."""
        o = self.options
        first, each = int(o["first_page"]), int(o["pages_per_task"])
        total = int(self.get(page=first, size=1)[o["total"]])
        pages = -(-total // int(o["page_size"]))
        return [Pages(first + a, first + min(a + each, pages)) for a in range(0, pages, each)] or [Pages(first, first)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            for item in self.get(page=page, size=int(self.options["page_size"]))[self.options["items"]]:
                yield tuple(entry(item.get(f.name), f.dataType) for f in self.fields)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Rest)
