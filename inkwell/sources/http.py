"""Fetching public-domain texts: mirrors, retries, and a batch source over them."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Where the files of a number may lie.
MIRRORS = (
    "https://www.gutenberg.org/cache/epub/{id}/pg{id}.txt",
    "https://www.gutenberg.org/files/{id}/{id}-0.txt",
    "https://www.gutenberg.org/files/{id}/{id}.txt",
)


def _open(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read()


def fetch_text(number: int, opener: Callable[[str, float], bytes] = _open, attempts: int = 3, pause: float = 1.0, timeout: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The text of a number from the first mirror that has it."""
    errors = []
    for url in MIRRORS:
        for n in range(attempts):
            try:
                return opener(url.format(id=number), timeout).decode("utf-8-sig")
            except urllib.error.HTTPError as e:
                errors.append(f"{url}: {e.code}")
                if e.code == 404:
                    break
                sleep(pause * 2**n)
            except (OSError, UnicodeDecodeError) as e:
                errors.append(f"{url}: {e}")
                sleep(pause * 2**n)
    raise OSError(f"no text for {number}: {'; '.join(errors)}")


def fetched(numbers: DataFrame, opener: Callable[[str, float], bytes] = _open, tasks: int = 2) -> DataFrame:
    """number, text, error of every row of ``number``; a failure is a row, not the job's end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n in b["number"]:
                try:
                    out.append((n, fetch_text(int(n), opener), None))
                except OSError as e:
                    out.append((n, None, str(e)))
            yield pd.DataFrame(out, columns=["number", "text", "error"])

    return numbers.select("number").distinct().repartition(tasks).mapInPandas(run, "number int, text string, error string")


class _Numbers(InputPartition):
    def __init__(self, numbers: list[int]) -> None:
        self.numbers = numbers


class _MirrorReader(DataSourceReader):
    def __init__(self, numbers: list[int], tasks: int, opener: Callable[[str, float], bytes]) -> None:
        self.numbers, self.tasks, self.opener = numbers, max(1, tasks), opener

    def partitions(self) -> list[_Numbers]:
        return [_Numbers(self.numbers[i :: self.tasks]) for i in range(min(self.tasks, len(self.numbers) or 1))]

    def read(self, partition: _Numbers) -> Iterator[tuple]:
        for n in partition.numbers:
            try:
                yield n, fetch_text(n, self.opener), None
            except OSError as e:
                yield n, None, str(e)


class MirrorSource(DataSource):
    """``spark.read.format("inkwell_mirrors").option("numbers", "10,11").load()``: number, text, error of each
    number once, read by ``tasks`` tasks (default 2: the mirrors are not to be hurried). For lists that fit an
    option; for a table of numbers, ``fetched``."""

    #: What opens a URL; tests put another in its place.
    opener: Callable[[str, float], bytes] = staticmethod(_open)

    @classmethod
    def name(cls) -> str:
        return "inkwell_mirrors"

    def schema(self) -> str:
        return "number int, text string, error string"

    def reader(self, schema) -> _MirrorReader:
        numbers = sorted({int(x) for x in self.options.get("numbers", "").split(",") if x.strip()})
        return _MirrorReader(numbers, int(self.options.get("tasks", "2")), type(self).opener)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(MirrorSource)
