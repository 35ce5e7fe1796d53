"""Nearest neighbours by a block matrix join: int8 tiles, error bounds, float64 recomputation, heaps.

Vectors are rounded to int8 once, and only these blocks and their norms are
shuffled. A task multiplies some blocks of queries with some blocks of
candidates, tile by tile; the rounding errors bound how far each product can be
off, so that it keeps only candidates that may be among a query's nearest. Heaps
merge the tasks' lists, and the pairs that survive are computed again in double
precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

_LIST = "query_id long, vec_ids array<long>, lows array<double>, highs array<double>"
#: Blocks of queries and of candidates that one task takes at most.
TASK_QUERIES = 32
TASK_CANDIDATES = 8


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 rows, and for each its scale and the 2-norms of the row, of the rounded row and of the error (norms rounded up)."""
    scale = np.nextafter((np.abs(x).max(1) / 127).astype(np.float32), np.float32(np.inf)).astype(np.float64)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    rounded = q * scale[:, None]
    norms = [np.sqrt((y * y).sum(1)) * (1 + 1e-6) for y in (x, rounded, x - rounded)]
    return q, np.stack([scale.astype(np.float32), *[np.nextafter(n.astype(np.float32), np.float32(np.inf)) for n in norms]], 1)


def tile(queries: tuple[np.ndarray, np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, strip: int = 256) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the candidates of the block that may be among its ``k`` nearest, with bounds of their products.

    Blocks are ``(ids, int8 rows, scale and norms)``. With x = rx + ex,
    |x.y - rx.ry| <= |ex| |y| + |rx| |ey|. A candidate whose upper bound is
    below the k-th best lower bound is out.
    """
    query_ids, q8, q = queries
    ids, c8, c = candidates
    kind = np.float32 if q8.shape[1] <= 1040 else np.float64  # int8 products are exact in float32 up to 2**24 / 127**2 components
    ct = c8.astype(kind).T
    sizes, lengths, _, errors = np.ascontiguousarray(c.T, np.float64)
    out = []
    for start in range(0, len(query_ids), strip):
        part = slice(start, start + strip)
        scale, _, rounded, error = q[part].astype(np.float64).T[:, :, None]
        near = (q8[part].astype(kind) @ ct).astype(np.float64) * scale * sizes
        off = (error * lengths + rounded * errors) * (1 + 1e-9) + 1e-12 * (np.abs(near) + 1)
        own = query_ids[part, None] == ids
        low, high = np.where(own, -np.inf, near - off), near + off
        at = max(0, len(ids) - k)
        least = np.partition(low, at, axis=1)[:, at]
        row, col = np.nonzero((high >= least[:, None]) & ~own)
        first = np.searchsorted(row, np.arange(len(near)))
        for i, (a, b) in enumerate(zip(first, [*first[1:], len(row)], strict=True)):
            found = col[a:b]
            out.append((int(query_ids[start + i]), ids[found], low[i, found], high[i, found]))
    return out


def tiles(queries: tuple[np.ndarray, np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, strip: int = 256, width: int = 4096) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Like ``tile``, for as many candidates as a task holds: tiles of ``strip`` by ``width``, one product of matrices each.

    Norms and errors are columns beside the components, so that the product is
    the upper bound, with one more column for the rounding of float32 (its unit
    times the components and some more, times both norms). What is below the
    k-th best lower bound of the tiles before is out, so few bounds are looked
    at after the first tiles. Candidates are brought to norms of at most 1, and
    so is each query, by powers of two; what then underflows is below ``tiny``.
    """
    query_ids, q8, q = queries
    ids, c8, c = candidates
    if not (np.isfinite(q).all() and np.isfinite(c).all()):
        return tile(queries, candidates, k, strip)
    tiny, unit = 1e-30, (q8.shape[1] + 16) * 2.0**-24 * 1.1
    q, c = q.astype(np.float64), c.astype(np.float64)
    norm_q, norm_c = (np.sqrt(x[:, 1] ** 2 + x[:, 2] ** 2 + x[:, 3] ** 2) * 1.5 for x in (q, c))
    up_q, up_c = np.exp2(np.ceil(np.log2(norm_q))), np.exp2(np.ceil(np.log2(norm_c.max(initial=0, where=norm_c > 0) or 1)))
    wide = lambda x8, size, columns, up: np.concatenate([x8 * (size / up)[:, None], *[(y / up)[:, None] for y in columns]], 1).astype(np.float32)
    across_q, across_c = (q[:, 3], q[:, 2], unit * norm_q), (c[:, 1], c[:, 3], norm_c)
    right = wide(c8, c[:, 0], across_c, np.full(len(c), up_c))
    out = []
    for start in range(0, len(query_ids), strip):
        part = slice(start, start + strip)
        left, own, up = wide(q8[part], q[part, 0], [y[part] for y in across_q], up_q[part]), query_ids[part], up_q[part] * up_c
        off_q, off_c = left[:, -3:].astype(np.float64), right[:, -3:].astype(np.float64)
        first = left @ right[:1024].T - 2 * (1 + 1e-5) * (off_q @ off_c[:1024].T)
        first[own[:, None] == ids[:1024]] = -np.inf
        least = np.partition(first, first.shape[1] - k, 1)[:, first.shape[1] - k] - tiny if first.shape[1] >= k else np.full(len(own), -np.inf)
        rows, cols, lows, highs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        for at in range(0, len(ids), width):
            bound = left @ right[at : at + width].T
            row, col = np.divmod(np.flatnonzero(bound >= np.nextafter((least - tiny).astype(np.float32), np.float32(-np.inf))[:, None]), bound.shape[1])
            high = bound[row, col].astype(np.float64)
            col += at
            other = ids[col] != own[row]
            row, col, high = row[other], col[other], high[other]
            low = high - 2 * (1 + 1e-5) * (off_q[row] * off_c[col]).sum(1) - tiny
            rows, cols, lows, highs = (np.concatenate(x) for x in ((rows, row), (cols, col), (lows, low), (highs, high + tiny)))
            order = np.lexsort((-lows, rows))
            rows, cols, lows, highs = (x[order] for x in (rows, cols, lows, highs))
            begin = np.searchsorted(rows, np.arange(len(own) + 1))
            enough = np.flatnonzero(np.diff(begin) >= k)
            least[enough] = np.maximum(least[enough], lows[begin[enough] + k - 1])
            fits = highs >= least[rows]
            rows, cols, lows, highs = (x[fits] for x in (rows, cols, lows, highs))
        begin = np.searchsorted(rows, np.arange(len(own) + 1))
        for i, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
            out.append((int(own[i]), ids[cols[a:b]], lows[a:b] * up[i], highs[a:b] * up[i]))
    return out


def merged(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[list[int], list[float], list[float]]:
    """Of lists of candidates with bounds, those that a heap of the ``k`` best lower bounds does not exclude."""
    ids, lows, highs = (np.concatenate(x) for x in zip(*lists, strict=True))
    best = heapq.nlargest(k, lows)
    kept = highs >= (best[-1] if len(best) == k else -np.inf)
    return ids[kept].tolist(), lows[kept].tolist(), highs[kept].tolist()


def _blocks(vectors: DataFrame, name: str, n: int) -> DataFrame:
    """``_dim, name, _ids, _m, _s``: blocks of int8 vectors with scales and norms as packed bytes, dealt by the hash of the id."""
    block = F.pmod(F.xxhash64("_id", F.lit(name)), F.lit(n)).cast("int")
    kind = "_id long, _dim int, _m binary, _s binary"

    def round_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, group in batch.groupby("_dim"):
                q, s = quantised(np.stack([np.asarray(v, np.float64) for v in group["_v"]]))
                yield pd.DataFrame({"_id": group["_id"], "_dim": dim, "_m": [x.tobytes() for x in q], "_s": [x.tobytes() for x in s]})

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["_id"].to_numpy(np.int64).tobytes()
        return pd.DataFrame({"_dim": [group["_dim"].iloc[0]], name: [group[name].iloc[0]], "_ids": [ids], "_m": [b"".join(group["_m"])], "_s": [b"".join(group["_s"])]})

    small = vectors.select("_id", "_dim", "_v").mapInPandas(round_off, kind)
    return small.withColumn(name, block).groupBy("_dim", name).applyInPandas(pack, f"_dim int, {name} int, _ids binary, _m binary, _s binary")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    query_block: int = 1024,
    candidate_block: int = 8192,
    fan_in: int = 64,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates of largest inner product for each query row.

    Every row is a candidate for all queries but those of its own id. The
    result is exact: the score is the inner product in double precision, and
    ties go to the smaller id.

    Edge cases: null ids and vectors that are null, empty, zero or hold null or
    non-finite components take no part; vectors of different lengths have no
    product and are searched apart; rows that repeat an id are one vector (the
    least); fewer than ``k`` candidates give that many rows; a query without
    candidates gives none; an empty table gives an empty table; columns not
    named are ignored.

    At scale: blocks have about ``query_block`` and ``candidate_block`` rows
    whatever the input, a vector in them takes a byte a component and 24 more,
    and each query block meets each candidate block once, ``TASK_QUERIES`` by
    ``TASK_CANDIDATES`` of them in a task, which gives one list for each query.
    The number of tasks grows with the square of the input, up to 4096. Of equal vectors only
    the ``k + 1`` smallest ids can be among the nearest and are candidates, so
    that a common vector makes no long lists. Lists are merged ``fan_in`` at a
    time, so no task holds all lists of a query.
    """
    usable = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(
        F.col(id_col).cast("long").alias("_id"), is_query.alias("_q"), F.col(vector_col).cast("array<double>").alias("_v")
    )
    finite = ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    base = cut(usable.filter(finite).groupBy("_id").agg(F.min("_v").alias("_v"), F.max("_q").alias("_q")).withColumn("_dim", F.size("_v")))
    count = base.agg(F.count(F.lit(1)), F.count_if("_q")).first()
    n_candidates, n_queries = max(1, -(-count[0] // candidate_block)), max(1, -(-count[1] // query_block))
    alike = F.row_number().over(W.partitionBy(F.xxhash64("_v"), "_v").orderBy("_id"))
    candidates = _blocks(base.withColumn("_k", alike).filter(F.col("_k") <= k + 1), "_c", n_candidates).withColumnsRenamed({"_ids": "_cids", "_m": "_cm", "_s": "_cs"})
    queries = _blocks(base.filter("_q"), "_b", n_queries)
    n_right, n_left = -(-n_candidates // TASK_CANDIDATES), -(-n_queries // TASK_QUERIES)
    queries = queries.withColumns({"_l": F.floor(F.col("_b") / TASK_QUERIES).cast("int"), "_r": F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))})
    candidates = candidates.withColumns({"_r": F.floor(F.col("_c") / TASK_CANDIDATES).cast("int"), "_l": F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))})
    key, tasks = ["_dim", "_l", "_r"], min(4096, 2 * n_left * n_right)  # else two of them often meet in one task
    left, right = (x.repartition(tasks, *key).groupBy(*key) for x in (queries, candidates))

    def multiply(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        dim, found = key[0].as_py(), []
        if queries.num_rows and candidates.num_rows:
            read = lambda blocks, name, kind: np.frombuffer(b"".join(blocks.column(name).to_pylist()), kind)
            q, c = ((read(x, a, np.int64), read(x, m, np.int8).reshape(-1, dim), read(x, n, np.float32).reshape(-1, 4)) for x, a, m, n in ((queries, "_ids", "_m", "_s"), (candidates, "_cids", "_cm", "_cs")))
            found = tiles(q, c, k)
        columns = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64())), *(pa.array([x[j] for x in found], pa.list_(pa.float64())) for j in (2, 3))]
        return pa.Table.from_arrays([*columns, pa.array([key[2].as_py()] * len(found), pa.int32())], ["query_id", "vec_ids", "lows", "highs", "part"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(q, *merged(list(zip(g["vec_ids"], g["lows"], g["highs"], strict=True)), k)) for q, g in group.groupby("query_id", sort=False)]
        return pd.DataFrame(rows, columns=["query_id", "vec_ids", "lows", "highs"]).assign(part=int(group["part"].iloc[0]))

    lists = left.cogroup(right).applyInArrow(multiply, f"{_LIST}, part int")
    parts = n_right
    while parts > 1:
        parts = -(-parts // fan_in)
        # a group holds the lists of some 256 queries from fan_in tasks
        lists = lists.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).withColumn("_g", F.pmod(F.xxhash64("query_id"), F.lit(max(1, count[1] // 256))))
        lists = lists.groupBy("_g", "part").applyInPandas(merge, f"{_LIST}, part int")
    # the pairs that are left, in double precision, summed from the first component on
    pairs = lists.select("query_id", F.explode("vec_ids").alias("vec_id"))
    both = pairs.join(base.select(F.col("_id").alias("vec_id"), F.col("_v").alias("_cv")), "vec_id").join(base.filter("_q").select(F.col("_id").alias("query_id"), "_v"), "query_id")
    scored = both.select("query_id", "vec_id", F.aggregate(F.zip_with("_v", "_cv", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
