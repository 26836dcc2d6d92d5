"""Sources of one's own for the crawl: a Python data source with a batch and a stream reader."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RAW = "value string, file string, block long, at long"


class RawItems(Protocol):
    """What a hook supplies: raw items in numbered blocks that never change once they are there."""

    def blocks(self) -> int:
        """Blocks that are there now; later calls never give less."""

    def read(self, block: int) -> Iterator[dict]:
        """The raw items of a block, the same ones in the same order each time."""


class Block(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


def _rows(items: RawItems, name: str, block: Block) -> Iterator[tuple]:
    for at, item in enumerate(items.read(block.value)):
        yield json.dumps(item, ensure_ascii=False, default=str), name, block.value, at


class _Batch(DataSourceReader):
    def __init__(self, name: str, items: RawItems):
        self.name, self.items = name, items

    def partitions(self) -> list[Block]:
        return [Block(i) for i in range(self.items.blocks())]

    def read(self, partition: Block) -> Iterator[tuple]:
        return _rows(self.items, self.name, partition)


class _Stream(DataSourceStreamReader):
    """The offset is the number of blocks taken, so a batch that is repeated reads the same blocks."""

    def __init__(self, name: str, items: RawItems):
        self.name, self.items = name, items

    def initialOffset(self) -> dict:
        return {"blocks": 0}

    def latestOffset(self) -> dict:
        return {"blocks": self.items.blocks()}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        return [Block(i) for i in range(start["blocks"], end["blocks"])]

    def read(self, partition: Block) -> Iterator[tuple]:
        return _rows(self.items, self.name, partition)


def register(spark: SparkSession, name: str, make) -> None:
    """Make ``make(options) -> RawItems`` known to the session as a source called ``name``."""
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return RAW

        def reader(self, schema) -> DataSourceReader:
            return _Batch(name, make(dict(self.options)))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(name, make(dict(self.options)))
    spark.dataSource.register(Source)


def read(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """All raw items of a registered source: value (JSON), file (the source's name), block and place."""
    return spark.read.format(name).options(**options).load()


def stream(spark: SparkSession, name: str, **options: str) -> DataFrame:
    return spark.readStream.format(name).options(**options).load()


class ParquetRows:
    """A hook over the row groups of a Parquet file: option ``path``, which the workers must reach."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def blocks(self) -> int:
        import pyarrow.parquet as pq
        return pq.ParquetFile(self.path).num_row_groups

    def read(self, block: int) -> Iterator[dict]:
        import pyarrow.parquet as pq
        yield from pq.ParquetFile(self.path).read_row_group(block).to_pylist()
