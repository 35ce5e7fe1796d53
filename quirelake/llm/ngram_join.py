"""Jaccard self-join of documents on word n-grams, as a blocked sparse matrix product.

The document by n-gram incidence matrix is cut down by bounds that follow from
the sizes: with n-grams in one global order, rarest first, two documents that
reach the threshold share a column among the first ``n - ceil(t * n) + 1`` of
each. Pairs that meet in such a column and pass the bounds are multiplied:
their rows are dealt into blocks of columns, Spark joins the blocks of a pair,
and the overlap counts of its blocks add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, stored
from .components import connected_components
from .tokens import mix, shingle_sets, text_chunks, words

#: The frequency sketch has a fixed size: 2**22 counters, 16 MB.
SKETCH_BITS = 22
#: Pairs of more n-grams than this are multiplied in ``2**COLUMN_BITS`` blocks of columns, others in one.
BLOCK_COLUMNS = 1 << 14
COLUMN_BITS = 4
#: Rounds at most in which one more class of a column meets the others before all pairs that are left do.
STARS = 2
_SLICES = 16
_FAN_IN = 256
_PARITY_BITS = 512


def _wide_parity(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of a set over as many hash ranges as it has n-grams, rounded up to a power of two, and over half as many."""
    bits = 1 << max(7, int(len(h) - 1).bit_length())
    odd = np.bincount((mix(h + np.uint64(5)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    half = odd[: bits // 2] ^ odd[bits // 2 :]
    return tuple(np.packbits(x.astype(np.uint8)).view(np.int64) for x in (odd, half))


def _apart(wide_a: Column, half_a: Column, wide_b: Column, half_b: Column) -> Column:
    """In how many n-grams two sets differ at least, by wide parities of one width; 0 if they have none."""

    def least(x: Column, y: Column) -> Column:
        differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
        return F.when(F.size(x) == F.size(y), differ)

    return F.coalesce(least(wide_a, wide_b), least(half_a, wide_b), least(wide_a, half_b), F.lit(0))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], n: int):
    for batch in batches:
        for row, end, data, offsets in text_chunks(batch.column(1)):
            h, rows, _, _ = words(data, offsets)
            yield batch.column(0)[row:end], *shingle_sets(h, rows, end - row, n)


def column_counts(docs: DataFrame, n: int) -> np.ndarray:
    """Documents of each n-gram hash range, over the whole table; the size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for _, h, _ in _chunks(batches, n):
            np.add.at(total, _bucket(h), 1)
        parts = [x.tobytes() for x in np.split(np.minimum(total, 255).astype(np.uint8), _SLICES)]  # only an order is wanted
        fan = TaskContext.get().partitionId() // _FAN_IN
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([fan] * _SLICES, pa.int32()), pa.array(parts, pa.binary())], ["slice", "fan", "counts"])

    def add(kind: type) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros((1 << SKETCH_BITS) // _SLICES, np.int32)
            for x in group["counts"]:
                total += np.frombuffer(x, kind)
            return pd.DataFrame({"slice": [group["slice"].iloc[0]], "fan": [np.int32(0)], "counts": [total.tobytes()]})

        return run

    schema = "slice int, fan int, counts binary"
    parts = docs.mapInArrow(count, schema).groupBy("slice", "fan").applyInPandas(add(np.uint8), schema).groupBy("slice").applyInPandas(add(np.int32), schema)
    total = np.zeros((_SLICES, (1 << SKETCH_BITS) // _SLICES), np.int32)
    for row in parts.collect():  # 16 MB, whatever the input; an iterator would run a job for each partition
        total[row["slice"]] = np.frombuffer(row["counts"], np.int32)
    return total.ravel()


def _incidence(docs: DataFrame, n: int, share: tuple[int, int]) -> DataFrame:
    """``_id, _n, _c1, _c2, _columns, _parity``: set size, set hash, the columns by which a document can be found, parities.

    Bit i of the parities tells whether the set has an odd number of n-grams in
    hash range i. Sets differ in at least as many n-grams as their parities do.
    """
    counts = docs.sparkSession.sparkContext.broadcast(column_counts(docs, n))
    num, den = share

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, offsets in _chunks(batches, n):
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(size)), size)
            filled = np.flatnonzero(size)
            sums = []
            for salt in (1, 2):
                s = np.zeros(len(size), np.uint64)
                if len(h):
                    s[filled] = np.add.reduceat(mix(h + np.uint64(salt)), offsets[:-1][filled])
                sums.append(mix(s).view(np.int64))
            order = np.lexsort((counts.value[_bucket(h)], owner))  # stable: ties stay in hash order
            prefix = np.where(size > 0, size - -(-num * size // den) + 1, 0)
            first = np.arange(len(h)) - np.repeat(offsets[:-1], size) < np.repeat(prefix, size)
            columns = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]), pa.int32()), pa.array(h[order][first].view(np.int64)))
            odd = np.bincount(owner * _PARITY_BITS + (mix(h + np.uint64(3)) % np.uint64(_PARITY_BITS)).astype(np.int64), minlength=len(size) * _PARITY_BITS) & 1
            bits = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(size), -1)
            parity = pa.StructArray.from_arrays([pa.array(bits[:, i].copy()) for i in range(bits.shape[1])], [f"p{i}" for i in range(bits.shape[1])])
            wide = [_wide_parity(h[a:b]) if b - a > _PARITY_BITS else (None, None) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            wide = [pa.array([w[k] for w in wide], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), *map(pa.array, sums), columns, parity, *wide], ["_id", "_n", "_c1", "_c2", "_columns", "_parity", "_wide", "_half"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"_id {kind}, _n long, _c1 long, _c2 long, _columns array<long>, _parity struct<{', '.join(f'p{i}: bigint' for i in range(_PARITY_BITS // 64))}>, _wide array<bigint>, _half array<bigint>")


def _rows_in_blocks(docs: DataFrame, n: int, share: tuple[int, int], most: int) -> DataFrame:
    """``_id, _class, _block, _cols``: rows of the incidence matrix, dealt into blocks of columns; ``_class`` is the set's hash.

    Block -1 holds a whole row, for pairs of ``most`` n-grams in all; a row that
    can be in a longer pair is given in blocks from 0 on, too or instead.
    """
    num, den = share

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, offsets in _chunks(batches, n):
            if not len(h):
                continue
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(ids)), size)
            filled = np.flatnonzero(size)
            sums = np.zeros(len(ids), np.uint64)
            sums[filled] = np.add.reduceat(mix(h + np.uint64(1)), offsets[:-1][filled])
            whole = filled[size[filled] * (den + num) <= most * den]
            dealt = size * (num + den) > most * num
            block = (h >> np.uint64(64 - COLUMN_BITS)).astype(np.int64)  # sets are sorted, so blocks are runs
            first = np.ones(len(h), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(h))
            kept = dealt[owner[starts]]
            data = memoryview(np.ascontiguousarray(h)).cast("B")
            spans = [*zip(offsets[whole], offsets[whole + 1], strict=True), *zip(starts[kept], ends[kept], strict=True)]
            at = np.concatenate([whole, owner[starts[kept]]])
            number = np.concatenate([np.full(len(whole), -1), block[starts[kept]]])
            columns = pa.array([bytes(data[x * 8 : y * 8]) for x, y in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(mix(sums).view(np.int64)[at]), pa.array(number, pa.int32()), columns], ["_id", "_class", "_block", "_cols"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_text").mapInArrow(rows, f"_id {kind}, _class long, _block int, _cols binary")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``overlap``, the number of common columns, to blocks of pairs ``(a, b, _ca, _cb, _xa, _xb)``."""
    for whole in batches:
        size = pc.add(pc.binary_length(whole.column(4)), pc.binary_length(whole.column(5))).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size), 0
        while start < whole.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (8 << 20), "right")))
            batch = whole.slice(start, end - start)
            start = end
            h, pair = [], []
            for column in batch.columns[4:]:
                lengths = pc.binary_length(column).to_numpy(zero_copy_only=False) // 8
                h.append(np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint64))
                pair.append(np.repeat(np.arange(batch.num_rows), lengths))
            h, pair = np.concatenate(h), np.concatenate(pair)
            order = np.lexsort((h, pair))
            h, pair = h[order], pair[order]
            same = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
            common = np.bincount(pair[1:][same], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(common, pa.int64())], ["a", "b", "_ca", "_cb", "overlap"])


def _likely(rows: DataFrame, keys: DataFrame, name: str, bits: int = 24) -> DataFrame:
    """``rows`` without most of those whose ``name`` is not in ``keys(name)``, by a bitmap of fixed size.

    The bitmap has at most ``2**(bits - 6)`` rows of 64 bits, so it can be
    broadcast whatever the input; it only saves shuffling, a join must follow.
    """
    slot = F.shiftrightunsigned(F.xxhash64(name), 64 - bits)
    page, bit = F.shiftright(slot, 6), slot.bitwiseAND(63).cast("int")
    pages = keys.select(page.alias("_page"), bit.alias("_bit")).groupBy("_page").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    kept = rows.withColumns({"_page": page, "_bit": bit}).join(F.broadcast(pages), "_page")
    return kept.filter("getbit(_bits, _bit) = 1").select(*rows.columns)


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3, share: tuple[int, int] = (90, 100), block_columns: int = BLOCK_COLUMNS) -> DataFrame:
    """Group documents whose n-gram sets have a Jaccard similarity of ``share`` or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lowered; a document's set
    holds its distinct runs of ``n`` words, or all its words as one run if they
    are fewer. Two documents link when ``den * intersection >= num * union``.

    Returns ``id, n_shingles, component_id`` (the smallest id that links reach,
    itself included), one row for each input row.

    Edge cases: a text without words, or null, has no n-grams and links with
    nothing; equal sets are one class and are compared once; repeated rows get
    equal results; a row with a null id gets a null component and links
    nothing; an empty table gives an empty table; columns not named are ignored.

    Exactness: documents of one set are a class. Classes that meet in a column
    are first compared with the column's smallest class. As long as columns hold
    more pairs of different components than there are rows, another class of
    each meets the others (``STARS`` times at most); what is left there is
    compared pair by pair if it passes the bounds. No link between two components can be missed, and
    a large group of copies needs one comparison for each member.

    At scale: a column's rows are aggregated before the shuffle, joins are
    equi-joins that AQE can split, and what is broadcast by hand has a fixed
    size: the frequency sketch of 16 MB and bitmaps of 2**18 rows.
    """
    num, den = share
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    wide = _incidence(base, n, share)  # read twice, as writing its columns for every row would cost more
    meta = cut(wide.select("_id", "_n", "_c1", "_c2"))
    # one row for each different set, so that copies of a text are compared once
    classes = stored(
        wide.filter("_n > 0 AND _id IS NOT NULL").groupBy("_c1", "_c2").agg(F.min("_id").alias("_rep"), F.first("_n").alias("_n"), F.first("_columns").alias("_columns"), F.first("_parity").alias("_parity"), F.first("_wide").alias("_wide"), F.first("_half").alias("_half"))
    )
    index = classes.select(F.explode("_columns").alias("_column"), "_rep", "_n")
    shared = cut(index.groupBy("_column").agg(F.min("_rep").alias("_lead"), F.max("_rep").alias("_last")).filter("_lead <> _last").drop("_last"))
    members = stored(_likely(index, shared, "_column").join(shared, "_column"))
    apart = sum((F.bit_count(F.col(f"_pa.p{i}").bitwiseXOR(F.col(f"_pb.p{i}"))) for i in range(_PARITY_BITS // 64)), F.lit(0))
    # what follows from the sizes, and from how many n-grams the sets differ in at least
    near = (F.least("_na", "_nb") * den >= F.greatest("_na", "_nb") * num) & (apart * (den + num) <= (F.col("_na") + F.col("_nb")) * (den - num))
    side = lambda x: classes.select(F.col("_rep").alias(x), F.col("_n").alias(f"_n{x}"), F.col("_parity").alias(f"_p{x}"))

    long_sets = classes.filter("_wide IS NOT NULL")

    def possible(pairs: DataFrame) -> DataFrame:
        """``pairs(a, b, _sum)`` without pairs of long sets that differ too much."""
        for x in "ab":
            pairs = pairs.join(long_sets.select(F.col("_rep").alias(x), F.col("_wide").alias(f"_w{x}"), F.col("_half").alias(f"_h{x}")), x, "left")
        return pairs.filter(_apart(*map(F.col, ("_wa", "_ha", "_wb", "_hb"))) * (den + num) <= F.col("_sum") * (den - num)).select("a", "b", "_sum")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs(a, b, _sum)``: blocks of one row go to its pairs, then the pairs to the blocks of the other."""
        rows = _rows_in_blocks(_likely(base.filter("_id IS NOT NULL"), cut(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()), "_id"), n, share, block_columns)
        wanted = (F.col("_block") >= 0) == (F.col("_sum") > block_columns)
        left = rows.select(F.col("_id").alias("a"), F.col("_class").alias("_ca"), "_block", F.col("_cols").alias("_xa")).join(pairs, "a").filter(wanted).drop("_sum")
        both = rows.select(F.col("_id").alias("b"), F.col("_class").alias("_cb"), "_block", F.col("_cols").alias("_xb")).join(left, ["b", "_block"])
        counts = both.select("a", "b", "_ca", "_cb", "_xa", "_xb").mapInArrow(_overlaps, f"a {kind}, b {kind}, _ca long, _cb long, overlap long")
        found = counts.groupBy("a", "b", "_ca", "_cb").agg(F.sum("overlap").alias("overlap")).groupBy("a", "b").agg(F.max("overlap").alias("overlap"))
        return pairs.join(found, ["a", "b"]).filter((F.col("_sum") - F.col("overlap")) * num <= F.col("overlap") * den).select("a", "b")

    met = members.filter("_rep <> _lead").select(F.col("_lead").alias("a"), F.col("_rep").alias("b")).distinct()
    first = cut(possible(met.join(side("a"), "a").join(side("b"), "b").filter(near).select("a", "b", (F.col("_na") + F.col("_nb")).alias("_sum"))))
    links = cut(verified(first))
    found = cut(connected_components(links))
    tried = first.select("a", "b")
    n_members, held = members.count(), members
    for turn in range(STARS + 1):
        # columns that still hold several components, and as long as they hold more pairs than there are rows,
        # one more class of each meets those of the others
        placed = held.join(found.withColumnRenamed("node", "_rep"), "_rep", "left").select("_column", "_rep", "_n", F.coalesce("component", "_rep").alias("_comp"))
        sizes = placed.groupBy("_column", "_comp").agg(F.count(F.lit(1)).alias("_k")).groupBy("_column")
        split = cut(sizes.agg(((F.sum("_k") ** 2 - F.sum(F.col("_k") * F.col("_k"))) / 2).alias("_pairs"), F.sum("_k").alias("_k")).filter("_pairs > 0 AND _k > 2"))
        held = stored(placed.join(split.select("_column"), "_column", "left_semi"))
        if turn == STARS or (split.agg(F.sum("_pairs")).first()[0] or 0) <= n_members:
            break
        one = F.struct("_rep", "_comp")
        heads = held.groupBy("_column").agg(F.min_by(one, F.xxhash64("_rep", F.lit(turn))).alias("_l"))
        met = held.join(heads, "_column").filter("_comp <> _l._comp").select(F.least("_rep", "_l._rep").alias("a"), F.greatest("_rep", "_l._rep").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        star = cut(possible(met.join(side("a"), "a").join(side("b"), "b").filter(near).select("a", "b", (F.col("_na") + F.col("_nb")).alias("_sum"))))
        held = held.drop("_comp")
        if star.isEmpty():
            continue
        tried = cut(tried.unionByName(star.select("a", "b")))
        links = cut(links.unionByName(verified(star)))
        found = cut(connected_components(links))
    # what is left: held has the classes of columns with more than one component
    rest = held.join(classes.select("_rep", "_parity"), "_rep")
    other = rest.select("_column", F.col("_rep").alias("b"), F.col("_n").alias("_nb"), F.col("_comp").alias("_cb"), F.col("_parity").alias("_pb"))
    pairs = (
        rest.withColumnsRenamed({"_rep": "a", "_n": "_na", "_comp": "_ca", "_parity": "_pa"})
        .join(other, "_column")
        .filter("a < b AND _ca <> _cb")
        .filter(near)
        .select("a", "b", (F.col("_na") + F.col("_nb")).alias("_sum"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    more = cut(possible(pairs))
    if not more.isEmpty():
        found = connected_components(links.unionByName(verified(more)))
    labels = classes.select("_c1", "_c2", "_rep").join(found.withColumnRenamed("node", "_rep"), "_rep", "left")
    labels = labels.select("_c1", "_c2", F.coalesce("component", "_rep").alias("_comp"))
    return meta.join(labels, ["_c1", "_c2"], "left").select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        F.when(F.col("_id").isNotNull(), F.coalesce("_comp", "_id")).alias("component_id"),
    )
