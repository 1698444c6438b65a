"""Running a plain Python function over the rows of a DataFrame in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def flat_map(df: DataFrame, rows: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Each row, as a dict, becomes any number of rows of `schema`."""
    shape = _parse_datatype_string(schema)
    assert isinstance(shape, StructType)
    arrow = to_arrow_schema(shape)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out = [r for row in batch.slice(start, 1000).to_pylist() for r in rows(row)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def group_map(df: DataFrame, keys: list[str], order: list[str], rows: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """The rows of each group, in order, become any number of rows of `schema`. One group is in memory at a time."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(table: pa.Table) -> pa.Table:
        held = table.sort_by([(c, "ascending") for c in order]).to_pylist()
        return pa.Table.from_pylist(list(rows(held)), schema=arrow)

    return df.groupBy(*keys).applyInArrow(run, schema)
