"""A Python data source for pull-style event iterators: ``spark.read.format("event_iterator")``.

Options: ``module`` and ``function`` name a function that returns an iterable of rows (or of single values), ``schema`` is given by
the reader. Each of ``partitions`` readers calls the function with its number and the number of readers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class EventIterator(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_iterator"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("partitions", "1")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        make = getattr(importlib.import_module(self.options["module"]), self.options["function"])
        for row in make(partition.value, int(self.options.get("partitions", "1"))):
            yield tuple(row) if isinstance(row, (tuple, list)) else (row,)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventIterator)
