"""A data source of generated rows, by the Python data source API: the extension point for custom datasets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class GeneratedSource(DataSource):
    """``spark.read.format("generated").option("rows", n).option("partitions", p).load()``: id, bucket."""

    @classmethod
    def name(cls) -> str:
        return "generated"

    def schema(self) -> str:
        return "id bigint, bucket bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(int(self.options.get("rows", 0)), max(1, int(self.options.get("partitions", 1))))


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, rows: int, parts: int):
        self.rows, self.parts = rows, parts

    def partitions(self) -> list[InputPartition]:
        step = -(-self.rows // self.parts) if self.rows else 0
        return [_Range(i * step, min(self.rows, (i + 1) * step)) for i in range(self.parts)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for i in range(partition.start, partition.stop):
            yield i, i % 7
