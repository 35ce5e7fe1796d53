"""Arrow UDFs with a return type as DDL, built when a session is there."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of values whose results an iterator UDF gives as one batch.
_PORTION = 1 << 18


def portions(f: Callable[[Any], Any], *columns: pd.Series) -> Iterator[pd.Series]:
    """``f`` of each row, in batches that hold what few bytes of the first column give.

    A batch of Arrow may have thousands of rows, and nested results take many
    times the room of the bytes they come from.
    """
    made, size = [], 0
    for row in zip(*columns, strict=True):
        made.append(f(*row))
        size += 32 + (len(row[0]) if isinstance(row[0], (bytes, str)) else 0)
        if size > _PORTION:
            yield pd.Series(made, dtype=object)
            made, size = [], 0
    if made or not len(columns[0]):
        yield pd.Series(made, dtype=object)


def arrow_udf(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf(schema)``, for functions of a module: a type's text can only be read in a session."""

    def decorate(f: Callable) -> Callable[..., Column]:
        @functools.cache
        def built() -> Callable[..., Column]:
            return F.pandas_udf(f, schema)

        return lambda *columns: built()(*columns)

    return decorate
