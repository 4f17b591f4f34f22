"""Ordered scans: a state carried along the rows of each group, in one pass, with the memory of one state.

Rows are spread by group and sorted; they stream through the task in Arrow batches, and the state lives on from one batch to the next. So a group of any
length takes linear time and is never collected. Only one group can be in one task; what it costs there is one call per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan(df: DataFrame, group: str, order: list[str | Column], columns: list[str], out: dict[str, str], start: tuple, step: Callable[..., tuple[tuple, tuple]]) -> DataFrame:
    """Adds the columns ``out`` (name: type): ``step(state, *columns)`` gives a row's values and the next state; each group begins at ``start``."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kinds = {name: to_arrow_type(_parse_datatype_string(kind)) for name, kind in out.items()}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{name}` {kind}" for name, kind in out.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, start, False
        for b in batches:
            values: list[tuple] = []
            for g, *x in zip(b.column(group).to_pylist(), *(b.column(c).to_pylist() for c in columns)):
                if not begun or g != now:
                    now, state, begun = g, start, True
                v, state = step(state, *x)
                values.append(v)
            made = [pa.array([v[i] for v in values], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *kinds])

    keys = [F.col(group), *[F.col(c) if isinstance(c, str) else c for c in order]]
    return df.repartition(group).sortWithinPartitions(*keys).mapInArrow(run, schema)
