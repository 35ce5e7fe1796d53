"""Rows of a key handled together, without a call of Spark for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Keys read from a batch at once, and bytes of results written as one batch.
_KEYS, _BYTES = 16, 1 << 21


def by_key(rows: DataFrame, key: str, make: Callable[[list[dict]], Iterable[tuple]], schema: T.StructType) -> DataFrame:
    """What ``make`` gives for the rows of each ``key``, as rows of ``schema``.

    One shuffle by key, which gathers the rows of a key as one value; a task
    holds a few keys' rows and a small batch of results. A null key is a key of
    its own.
    """
    size_of = lambda row: 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        made, size = [], 0

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, _KEYS):
                for group in batch.slice(at, _KEYS).to_pylist():
                    for result in make(group["_rows"]):
                        made.append(result)
                        size += size_of(result)
                    if size > _BYTES:
                        yield batch_of(made)
                        made, size = [], 0
        if made:
            yield batch_of(made)

    return rows.groupBy(key).agg(F.collect_list(F.struct(*rows.columns)).alias("_rows")).select("_rows").mapInArrow(runs, schema)
