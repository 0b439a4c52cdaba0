"""Sorted groups of rows that pass through a task one row at a time, whatever a group's size."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and numbers in arrays that are handed back at once.
ROWS_AT_ONCE, NUMBERS_AT_ONCE = 1_000, 4_000_000


#: Tasks for each core in a shuffle before Python.
TASKS_A_CORE = 3


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df shuffled by keys to a stated number of tasks: adaptive execution would join them by their bytes, to one task often, where the work is in the tasks."""
    return df.repartition(TASKS_A_CORE * max(df.sparkSession.sparkContext.defaultParallelism, 2), *keys)


def _values(column: pa.Array) -> list[Any]:
    """Python values; lists of numbers as NumPy arrays, null as None."""
    if pa.types.is_list(column.type) and not pa.types.is_nested(column.type.value_type) and not pa.types.is_string(column.type.value_type):
        values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [values[a:b] if there else None for a, b, there in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]
    return column.to_pylist()


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    """Rows as dictionaries, one batch of them at a time."""
    for batch in batches:
        columns = [_values(c) for c in batch.columns]
        for row in zip(*columns, strict=True):
            yield dict(zip(batch.schema.names, row, strict=True))


def grouped_rows(df: DataFrame, keys: list[str], order: list[str], of: Callable[[tuple, Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """What of(key values, the group's rows in order) yields for each group of equal keys. A task holds one batch of rows beside what of keeps."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    def run(batches):
        out, numbers = [], 0
        for key, rows in itertools.groupby(rows_of(batches), key=lambda r: tuple(r[k] for k in keys)):
            for done in of(key, rows):
                out.append(done)
                numbers += sum(v.size for v in done.values() if isinstance(v, np.ndarray))
                if len(out) >= ROWS_AT_ONCE or numbers >= NUMBERS_AT_ONCE:
                    yield batch(out)
                    out, numbers = [], 0
        if out:
            yield batch(out)

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def matrix_of(frames: pa.ListScalar) -> np.ndarray:
    """A list of equally long lists of numbers as a matrix."""
    return frames.values.flatten().to_numpy(zero_copy_only=False).reshape(len(frames.values), -1)
