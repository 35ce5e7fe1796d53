"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Links that one task takes to their end at most, some megabytes; a fixed size, whatever the input.
FEW = 1 << 16


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, component`` of the nodes of links ``(a, b)``; the component is its smallest node."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        kinds = [c.type for c in batch.columns]
        for ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high = sorted(map(root, ends))
            parent[high] = low
    if parent:
        found = ([*parent], [*map(root, parent)])
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)], ["node", "component"])


def connected_components(links: DataFrame, few: int = FEW) -> DataFrame:
    """``node, component`` for each node of ``links(a, b)``; the component is its smallest node.

    Each round points the larger neighbours of a node, then the smaller ones,
    at the smallest node of the neighbourhood, until only stars are left. A
    round costs a partial aggregate and an equi-join; the number of rounds grows
    with the logarithm of the longest path. Rounds go on while there are more
    than ``few`` links; so few are merged in one task of that size, as a round
    costs shuffles however few they are. Links with a null end or to itself
    are ignored; repeated links count once; no links give an empty table.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0] > few:
        # large star: every larger neighbour of u now points at the smallest of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours point at the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        kind = edges.schema["a"].dataType
        return cut(edges.coalesce(1).mapInArrow(_merged, T.StructType([T.StructField(name, kind) for name in ("node", "component")])))
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
