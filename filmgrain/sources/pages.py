"""A data source for paged REST endpoints: one partition for each page, with retries. `spark.dataSource.register(Pages)` makes it known.

Options: base (any URL that urllib reads, files included), endpoint (with {page} where the page goes), pages, language and key (sent
as parameters if given), retries, pause. Each page is one row: its number and its JSON as it came, NULL if it never came.
A busy server (429) is asked again after the seconds it names, each time at the cost of an attempt; if none is left the page is empty.
Other errors are raised after the last attempt.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, retries: int = 3, pause: float = 0.1) -> str | None:
    """What a URL answers, after at most so many attempts."""
    for attempt in range(1, retries + 1):
        time.sleep(pause)
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if e.code == 429:
                time.sleep(float(e.headers.get("Retry-After") or 10))
            elif attempt == retries:
                raise
        except OSError:
            if attempt == retries:
                raise
    return None


class Page(InputPartition):
    pass


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filmgrain_pages"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Page(n) for n in range(1, int(self.options.get("pages", 1)) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, page = self.options, partition.value
        asked = {k: o[n] for k, n in (("language", "language"), ("api_key", "key")) if n in o}
        url = f"{o['base'].rstrip('/')}/{o['endpoint'].lstrip('/').replace('{page}', str(page))}" + (f"?{urllib.parse.urlencode(asked)}" if asked else "")
        yield page, fetch(url, int(o.get("retries", 3)), float(o.get("pause", 0.1)))


def read_pages(spark: SparkSession, schema: str, base: str, endpoint: str, pages: int, **options: str) -> DataFrame:
    """The pages as rows of the schema; a page that never came or isn't JSON is a row of NULLs."""
    spark.dataSource.register(Pages)
    raw = spark.read.format("filmgrain_pages").options(base=base, endpoint=endpoint, pages=str(pages), **options).load()
    return raw.select(F.from_json("body", schema).alias("p")).select("p.*")


def self_test(spark: SparkSession, genres: DataFrame, first_page: DataFrame) -> bool:
    """Whether genres and the first page of films can be read and have something."""
    try:
        return not genres.isEmpty() and not first_page.isEmpty()
    except Exception:  # a source that can't be read fails in many ways
        return False
