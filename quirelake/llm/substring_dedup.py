"""Removal of repeated byte strings with suffix arrays of shards.

Every ``length``-byte window of a text has one anchor: the smallest hash among
its ``K``-byte strings. Equal windows have equal anchors, so windows need only
be compared where anchors agree. Neighbouring windows with one anchor form a
block, and equal blocks of an anchor count once. A block has two cores, one in
all its windows that start near the anchor and one in all others; different
blocks with one core are a group, and groups are dealt into shards, whose
suffix array (induced sorting) and its common prefixes tell which windows are
equal. Of equal windows all but the earliest go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .suffixes import permuted_prefixes, prefix_sums, suffix_array
from .tokens import mix, text_chunks

#: Bytes of the strings that anchors are chosen from.
K = 24
_U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(20240301)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_STEP = 0xD1342543DE82EF95
_ROW = "_a long, _c long, _id long, _start long, _n int, _lead int, _fp int, _cores long"
#: ``_ROW`` as it is shuffled: ``_at`` has ``_fp`` and ``_start``, ``_of`` has ``_cores``, ``_n`` and ``_lead``.
_PACKED = "_a long, _c long, _id long, _at long, _of long"
_REMOVED = "_id long, _fp int, _from long, _to long"
#: A group with more different blocks than this is compared window by window.
WIDE = 4096
#: An anchor with more rows than this (told by one in ``SAMPLE`` documents) is dealt by block from the start.
HOT = 200_000
SAMPLE = 16


def _string_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``K`` bytes from each place on (K = 16 + 8)."""
    x = _BYTE[data]
    for width in (1, 2, 4):
        x = x[:-width] * _U(pow(_STEP, width, 1 << 64)) + x[width:]
    eight = x
    x = eight[:-8] * _U(pow(_STEP, 8, 1 << 64)) + eight[8:]
    return mix(x[: len(data) - K + 1] * _U(pow(_STEP, 8, 1 << 64)) + eight[16 : len(data) - K + 17])


def blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``row, start, windows, lead, anchor, content, cores``: runs of windows with one anchor, in order.

    ``start`` is where the first window starts in its text and ``lead`` how far
    the anchor is from there; the block's bytes are ``windows + length - 1``.
    ``cores`` holds 24 bits for the bytes that all windows share which start at
    most ``near(length)`` before the anchor, and 24 for those of the others.
    """
    n = len(data)
    if n < length:
        return (*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 3)
    h = _string_hashes(data)
    span = length - K + 1  # strings that start in a window
    padded = np.full(-(-len(h) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    keyed = padded.reshape(-1, span) & ~_U(127) | np.arange(span, dtype=np.uint64)  # ties: the first
    ahead = np.minimum.accumulate(keyed, 1).ravel()
    behind = np.minimum.accumulate(keyed[:, ::-1], 1)[:, ::-1].ravel()
    at = np.arange(len(h) - span + 1)
    left, right = behind[at], ahead[at + span - 1]
    from_left = left >> _U(7) <= right >> _U(7)
    anchor = np.where(from_left, at - at % span + (left & _U(127)).astype(np.int64), (at + span - 1) - (at + span - 1) % span + (right & _U(127)).astype(np.int64))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at]
    inside = at + length <= offsets[row + 1]
    at, anchor, row = at[inside], anchor[inside], row[inside]
    if not len(at):
        return (*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 3)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    windows = np.diff(np.append(first, len(at)))
    start, anchor, row = at[first], anchor[first], row[first]
    sums, down = prefix_sums(data)
    content = (sums[start + windows + length - 1] - sums[start]) * down[start]
    lead = anchor - start
    content = mix(content ^ mix(windows.astype(np.uint64) << _U(8) | lead.astype(np.uint64)))
    half, cores = near(length), np.zeros(len(start), np.uint64)
    for has, low, size, shift in ((lead - windows < half, anchor, length - half, 24), (lead > half, anchor - half - 1, half + 1 + K, 0)):
        low = np.where(has, low, 0)
        cores |= np.where(has, mix((sums[low + size] - sums[low]) * down[low]) >> _U(40), _U(0)) << _U(shift)
    return row, start - offsets[row], windows, lead, mix(h[anchor]), content, cores


def near(length: int) -> int:
    """Windows that start up to so many bytes before their anchor are compared apart from the others."""
    return (length - K) // 2


def _ranges(ids: np.ndarray, fps: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_REMOVED`` with the ranges of each document joined where they touch."""
    order = np.lexsort((start, fps, ids))
    ids, fps, start, end = ids[order], fps[order], start[order], end[order]
    if len(ids):
        document = np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1]) | (fps[1:] != fps[:-1])]))
        ends, rank = np.unique(end, return_inverse=True)
        reach = ends[np.maximum.accumulate(rank + document * len(ends)) - document * len(ends)]
        new = np.concatenate([[True], (document[1:] != document[:-1]) | (start[1:] > reach[:-1])])
        first = np.flatnonzero(new)
        ids, fps, start, end = ids[first], fps[first], start[first], reach[np.append(first[1:] - 1, len(reach) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["_id", "_fp", "_from", "_to"])


def _occurrences(batches: Iterator[pa.RecordBatch], length: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as rows of ``_ROW``; copies within a batch become ranges to remove (``_n`` 0, end in ``_c``).

    A block of a ``hot`` anchor (sorted) gets a key of its own in ``_a`` and
    a negative ``_lead`` (-1 less the lead), so that only its copies meet.
    """
    for batch in batches:
        ids, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        parts = []
        for row, _, data, offsets in text_chunks(batch.column(2), 1 << 16):  # its arrays stay in the processor's cache
            at, *rest = blocks(data, offsets, length)
            parts.append((at + row, *rest))
        if not parts:
            continue
        row, start, windows, lead, a, c, cores = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, fps[row], ids[row], c, a))
        row, start, windows, lead, a, c, cores = (x[order] for x in (row, start, windows, lead, a, c, cores))
        copy = np.concatenate([[False], (a[1:] == a[:-1]) & (c[1:] == c[:-1])]) if len(a) else np.zeros(0, bool)
        gone = _ranges(ids[row[copy]], fps[row[copy]], start[copy], start[copy] + windows[copy] + length - 1)
        own = ~copy
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, a), len(hot) - 1)] == a
            a, lead = np.where(is_hot, mix(a ^ mix(c)), a), np.where(is_hot, -1 - lead, lead)
        spread = mix(np.arange(gone.num_rows).astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([a[own].view(np.int64), spread])),
                pa.array(np.concatenate([c[own].view(np.int64), gone.column(3).to_numpy()])),
                pa.array(np.concatenate([ids[row[own]], gone.column(0).to_numpy()])),
                pa.array(np.concatenate([start[own], gone.column(2).to_numpy()])),
                pa.array(np.concatenate([windows[own], np.zeros(gone.num_rows)]).astype(np.int32)),
                pa.array(np.concatenate([lead[own], np.zeros(gone.num_rows)]).astype(np.int32)),
                pa.array(np.concatenate([fps[row[own]], gone.column(1).to_numpy()]).astype(np.int32)),
                pa.array(np.concatenate([cores[own].view(np.int64), np.zeros(gone.num_rows, np.int64)])),
            ],
            ["_a", "_c", "_id", "_start", "_n", "_lead", "_fp", "_cores"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_ROW`` as ``_PACKED``, in which the same columns are in order."""
    for batch in batches:
        start, n, lead, fp, cores = (batch.column(k).to_numpy().astype(np.int64) for k in ("_start", "_n", "_lead", "_fp", "_cores"))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp << 32 | start), pa.array(cores << 16 | n << 8 | lead + 128)], ["_a", "_c", "_id", "_at", "_of"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_PACKED`` as ``_ROW``."""
    for batch in batches:
        at, of = (batch.column(k).to_numpy() for k in ("_at", "_of"))
        n, lead, fp = (pa.array(x.astype(np.int32)) for x in (of >> 8 & 255, (of & 255) - 128, at >> 32))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at & 0xFFFFFFFF), n, lead, fp, pa.array(of >> 16 & (1 << 48) - 1)], ["_a", "_c", "_id", "_start", "_n", "_lead", "_fp", "_cores"])


def _pieces(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """``rows, goes_on, large`` of a partition sorted by anchor and content, about ``most_rows`` rows each.

    Anchors are whole, but one with over ``most_rows`` rows comes in several
    pieces, all of them ``large``; one that ``goes_on`` continues the piece before.
    """
    held: list[pa.RecordBatch] = []
    n, large = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if large is not None:
            more = int(np.searchsorted(key != large, True)) if (key != large).any() else len(key)
            if more:
                yield pa.Table.from_batches([batch.slice(0, more)]), True, True
            if more == len(key):
                continue
            batch, key, large = batch.slice(more), key[more:], None
        held.append(batch)
        n += batch.num_rows
        if n < most_rows:
            continue
        table = pa.Table.from_batches(held)
        key = table.column(0).to_numpy()
        last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        if last:
            yield table.slice(0, last), False, False
        held, n = table.slice(last).to_batches(), len(key) - last
        if n >= most_rows:
            yield table.slice(last), False, True
            held, n, large = [], 0, key[-1]
    if n:
        yield pa.Table.from_batches(held), False, False


def _judged(batches: Iterator[pa.RecordBatch], length: int, wide: int, most_rows: int = HOT) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, content and place: copies as ranges to remove, blocks of mixed groups as requests.

    Output rows are ``_REMOVED`` with ``_a`` (the group of a request, else
    null) and ``_wide``. About ``most_rows`` rows are held: blocks of an anchor
    with more are all requested as wide, piece by piece. Of other anchors only
    those parts of blocks are requested whose core another block has too.
    """
    before, half = None, near(length)
    for table, goes_on, large in _pieces(batches, most_rows):
        a, c, ids, start, windows, lead, fps = (table.column(k).to_numpy().astype(np.int64) for k in ("_a", "_c", "_id", "_start", "_n", "_lead", "_fp"))
        cores = table.column("_cores").to_numpy().view(np.uint64) if "_cores" in table.column_names else np.zeros(len(a), np.uint64)
        ready = windows == 0
        hot = large | (lead < 0)
        lead = np.where(lead < 0, -1 - lead, lead)
        new_a = np.concatenate([[True], (a[1:] != a[:-1])])
        new_c = new_a | np.concatenate([[True], c[1:] != c[:-1]])
        if goes_on and c[0] == before:
            new_c[0] = False
        before = c[-1]
        group = np.cumsum(new_a) - 1
        different = np.bincount(group, new_c & ~ready).astype(np.int64)[group]
        gone = ready | ~new_c
        mixed = np.flatnonzero(new_c & ~ready & ~hot & (different > 1))
        end = np.where(ready, c, start + windows + length - 1)
        # windows are equal only at the same distance from their anchors, so those near it and the others meet apart
        low, high = -lead[mixed], (windows - lead)[mixed]
        at = np.concatenate([mixed, mixed])
        key = np.concatenate([cores[mixed] >> _U(24) << _U(1), (cores[mixed] & _U(0xFFFFFF)) << _U(1) | _U(1)])
        low, high = np.concatenate([np.maximum(low, -half), low]), np.concatenate([high, np.minimum(high, -half)])
        at, key, low, high = (x[low < high] for x in (at, key, low, high))
        order = np.lexsort((key, group[at]))
        at, key, low, high = (x[order] for x in (at, key, low, high))
        one = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (group[at[1:]] != group[at[:-1]])])) if len(at) else at
        blocks_of = np.bincount(one)[one] if len(at) else at
        # of a group of two blocks, only windows that both have can be equal
        both_low, both_high = np.full(len(at), -(1 << 30)), np.full(len(at), 1 << 30)
        np.maximum.at(both_low, one, low)
        np.minimum.at(both_high, one, high)
        low, high = np.where(blocks_of == 2, both_low[one], low), np.where(blocks_of == 2, both_high[one], high)
        asked = (blocks_of > 1) & (low < high)
        at, key, low, high, blocks_of = (x[asked] for x in (at, key, low, high, blocks_of))
        alone = np.flatnonzero(new_c & ~ready & hot)
        at, low, high = (np.concatenate(x) for x in ((at, alone), (low, -lead[alone]), (high, (windows - lead)[alone])))
        key = np.concatenate([mix(a[at[: len(key)]].view(np.uint64) ^ mix(key)).view(np.int64), a[alone]])
        by_window = np.concatenate([blocks_of > wide, np.ones(len(alone), bool)])
        anchor = (start + lead)[at]
        removed = _ranges(ids[gone], fps[gone], start[gone], end[gone])
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.concat_arrays([x, pa.array(y, x.type)]) for x, y in zip(removed.columns, (ids[at], fps[at], anchor + low, anchor + high), strict=True)),
                pa.array(np.concatenate([np.zeros(removed.num_rows, np.int64), key]), mask=np.concatenate([np.ones(removed.num_rows, bool), np.zeros(len(at), bool)])),
                pa.array(np.concatenate([np.zeros(removed.num_rows, bool), by_window])),
            ],
            ["_id", "_fp", "_from", "_to", "_a", "_wide"],
        )


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of requested blocks; of those in wide groups, each window for itself, grouped by its own hash."""
    rows, parts, n = [], [], 0
    for batch in batches:
        for i, fp, text, asked in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            for q in asked:
                held = text[q["_from"] : q["_to"] + length - 1]
                if q["_wide"]:
                    parts.append((i, fp, q["_from"], held))
                    n += len(held) - length + 1
                else:
                    rows.append((q["_a"], i, fp, q["_from"], held))
                if len(rows) >= 20_000:
                    yield _context_rows(rows)
                    rows = []
                if n >= 20_000:
                    yield _window_rows(parts, length)
                    parts, n = [], 0
    yield _context_rows(rows)
    if parts:
        yield _window_rows(parts, length)


def _window_rows(parts: list[tuple[int, int, int, bytes]], length: int) -> pa.RecordBatch:
    """Each window of blocks ``(id, fp, start, bytes)`` as a row of its own, grouped by its hash."""
    size = np.array([len(p[3]) for p in parts])
    windows = size - length + 1
    data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(size) - size, windows) + inner
    sums, down = prefix_sums(data)
    key = mix((sums[at + length] - sums[at]) * down[at] ^ _U(1)).view(np.int64)
    ids, fps, start = (np.repeat(np.array([p[k] for p in parts], np.int64), windows) for k in range(3))
    text = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * np.int32(length)), pa.py_buffer(np.lib.stride_tricks.sliding_window_view(data, length)[at])])
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(fps.astype(np.int32)), pa.array(start + inner), text], ["_a", "_id", "_fp", "_from", "_text"])


def _context_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["_a", "_id", "_fp", "_from", "_text"])


def repeated_windows(texts: list[bytes], rank: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Of one shard: for each window of each text whether an equal one stands earlier (by rank, then place).

    The texts are joined with a separator between them; windows that are
    neighbours in the suffix array and share ``length`` bytes are equal.
    """
    size = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 2
    where = np.cumsum(size) - size
    text = np.ones(int(size.sum()) + len(texts) + 1, np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    text[np.arange(len(joined)) + owner] = joined
    text[-1] = 0
    first = where + np.arange(len(texts))
    sa = suffix_array(text)
    is_window, place, holder = np.zeros(len(text), bool), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    n = np.maximum(size - length + 1, 0)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(first, n) + inner
    is_window[at], place[at], holder[at] = True, np.repeat(start, n) + inner, np.repeat(rank, n)
    order = sa[is_window[sa]]
    run = np.cumsum(permuted_prefixes(text, sa, length, order) < length)
    by_age = np.lexsort((place[order], holder[order], run))
    sorted_run = run[by_age]
    later = np.concatenate([[False], sorted_run[1:] == sorted_run[:-1]])
    out = np.zeros(len(text), bool)
    out[order[by_age[later]]] = True
    return out[at]


def _sorted_shards(batches: Iterator[pa.RecordBatch], length: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Ranges to remove from blocks sorted by group and place; equal blocks of a group are held once.

    Windows of one block are at different distances from their one anchor, so
    none of them are equal, and a group of one block needs no suffix array.
    """
    held: dict[bytes, int] = {}
    texts: list[bytes] = []
    keys: list[tuple[int, int, int]] = []
    copies: list[tuple[int, int, int, int]] = []
    group, size = None, 0

    def shard() -> Iterator[pa.RecordBatch]:
        if copies:
            yield _ranges(*(np.array(x) for x in zip(*copies, strict=True)))
        if len(texts) > 1:
            ids, fps, start = (np.array(x) for x in zip(*keys, strict=True))
            order = np.lexsort((fps, ids))
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (np.diff(ids[order]) != 0) | (np.diff(fps[order]) != 0)]))
            later = repeated_windows(texts, rank, start, length)
            n = np.array([len(t) - length + 1 for t in texts])
            at = np.flatnonzero(later)
            holder = np.searchsorted(np.cumsum(n), at, "right")
            place = start[holder] + at - (np.cumsum(n) - n)[holder]
            yield _ranges(ids[holder], fps[holder], place, place + length)

    for batch in batches:
        for a, i, fp, start, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if a != group:
                if len(held) == 1:
                    size -= len(texts.pop())
                    keys.pop()
                if size >= shard_bytes or len(copies) >= 100_000:
                    yield from shard()
                    texts, keys, copies, size = [], [], [], 0
                group, held = a, {}
            if text in held:
                copies.append((i, fp, start, start + len(text)))
                if len(copies) >= 100_000:
                    yield _ranges(*(np.array(x) for x in zip(*copies, strict=True)))
                    copies.clear()
                continue
            held[text] = len(texts)
            texts.append(text)
            keys.append((i, fp, start))
            size += len(text)
    if len(held) == 1:
        texts.pop()
        keys.pop()
    yield from shard()


def _cut_out(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``text``, the number of removed bytes and of removed runs."""
    out, last, removed, runs = [], 0, 0, 0
    for a, b in sorted(ranges):
        if a > last or not runs:
            out.append(text[last:a])
            runs += 1
            last = a
        if b > last:
            removed += b - last
            last = b
    return b"".join(out) + text[last:], removed, runs


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, shard_bytes: int = 1 << 20, wide: int = WIDE, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that starts earlier too.

    Earlier is in a document with a smaller id, or before in the same document;
    strings overlap as they like, never cross documents, and are judged on the
    input. Returns ``id, kept`` (the bytes left), ``n_bytes, n_removed, n_spans``.

    Edge cases: a null text is empty; texts shorter than ``length`` stay whole;
    a null id sorts before all others; ids are integers. Rows that repeat an id
    and a text are one document and get equal results; rows that repeat an id
    with other texts are told apart by a hash of the text, by which they are
    also ordered. Very long texts are read whole; an empty table gives an empty
    table; columns not named are ignored.

    At scale: blocks are found in one pass; copies within a batch are settled
    there, so a block that a third of all documents hold reaches the shuffle
    once a batch. Blocks that occur once end in that shuffle (some 40 bytes for
    40 of text). Text is shuffled for joins by id, and again only for parts of
    blocks whose core a different block has too. Groups of more than ``wide``
    blocks go by the hash of each window instead of by their core. Anchors of more than
    ``hot`` rows, as one in ``SAMPLE`` documents tells, go that way without
    meeting at all; one that the sample misses is read by one task in pieces.
    Which way an anchor goes doesn't change the result. Shards are cut between
    groups at ``shard_bytes``.
    """
    if not 2 * K < length <= 127 + K:
        raise ValueError(f"length must be over {2 * K} and at most {127 + K}")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.pmod(F.xxhash64(text), F.lit(1 << 30)).cast("int").alias("_fp"), text.alias("_text")
    )
    none = np.zeros(0, np.uint64)
    sampled = base.filter(F.pmod(F.xxhash64("_id", "_fp"), F.lit(SAMPLE)) == 0).mapInArrow(lambda batches: _occurrences(batches, length, none), _ROW)
    common = sampled.filter("_n > 0").groupBy("_a").count().filter(F.col("count") * SAMPLE > hot).select("_a").collect()
    often = np.sort(np.array([r[0] for r in common], np.int64).view(np.uint64))
    found = base.mapInArrow(lambda batches: _packed(_occurrences(batches, length, often)), _PACKED).repartition("_a")
    judged = stored(found.sortWithinPartitions("_a", "_c", "_id", "_at").mapInArrow(lambda batches: _judged(_unpacked(batches), length, wide, max(hot, 1)), f"{_REMOVED}, _a long, _wide boolean"))
    asked = judged.filter("_a IS NOT NULL").groupBy("_id", "_fp").agg(F.collect_list(F.struct("_a", "_from", "_to", "_wide")).alias("_asked"))
    texts = base.join(asked, ["_id", "_fp"]).dropDuplicates(["_id", "_fp"]).select("_id", "_fp", "_text", "_asked")
    contexts = texts.mapInArrow(lambda batches: _contexts(batches, length), "_a long, _id long, _fp int, _from long, _text binary")
    shards = contexts.repartition("_a").sortWithinPartitions("_a", "_id", "_fp", "_from")
    compared = shards.mapInArrow(lambda batches: _sorted_shards(batches, length, shard_bytes), _REMOVED)
    gone = judged.filter("_a IS NULL").select("_id", "_fp", "_from", "_to").unionByName(compared).groupBy("_id", "_fp").agg(F.collect_list(F.struct("_from", "_to")).alias("_gone"))

    def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_cut_out(t, [(x["_from"], x["_to"]) for x in g or ()]) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            size = [len(t.as_buffer()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.binary()), *(pa.array(x, pa.int64()) for x in (size, [r[1] for r in rows], [r[2] for r in rows]))],
                ["_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    done = base.join(gone, ["_id", "_fp"], "left").select("_id", "_text", "_gone").mapInArrow(left_over, "_id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return done.select(F.nullif("_id", F.lit(-(2**63))).alias(id_col), "kept", "n_bytes", "n_removed", "n_spans")
