"""Benchmark decontamination by greedy string tiling of word tokens.

Documents and benchmark items that share a run of ``min_match`` words are
joined on it. For each such pair, running Karp-Rabin hashes of decreasing
length find the longest matches between words not yet marked, which become
tiles; the tiles' share of the item's words says how much of the item the
document holds, whatever the order of its passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, word_count
from .tokens import mix, text_chunks, words

_BASE = 0x9E3779B97F4A7C15 | 3


def _powers(n: int) -> np.ndarray:
    steps = np.full(max(1, n), _BASE, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def window_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``n`` tokens, from prefix sums (modulo 2**64)."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    up = _powers(len(tokens) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[:-1])])
    inverse = np.full(len(tokens), pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return mix((sums[n:] - sums[:-n]) * np.cumprod(inverse)[: len(tokens) - n + 1])


#: Equal runs looked at together; more of them are looked at in turns.
_PAIRS = 1 << 20


def _matches(doc: np.ndarray, item: np.ndarray, length: int, free: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Maximal matches ``(length, doc start, item start)`` of unmarked words, of ``length`` words or more.

    Runs of ``length`` words that are equal and follow each other on a diagonal
    are one match. Only the first and the last run of each are kept, so the
    memory grows with the matches and not with the pairs of equal runs, of
    which texts of one repeated word have very many.
    """
    hd, hi = window_hashes(doc, length), window_hashes(item, length)
    whole_d, whole_i = (_whole(f, length) for f in free)
    at_d = np.flatnonzero(whole_d & np.isin(hd, hi[whole_i])) if len(hd) and len(hi) else np.zeros(0, np.int64)
    if not len(at_d):
        return []
    order = np.flatnonzero(whole_i)
    order = order[np.argsort(hi[order], kind="stable")]
    left, right = (np.searchsorted(hi[order], hd[at_d], side) for side in ("left", "right"))
    sizes = np.cumsum(right - left)
    ends: list[list[np.ndarray]] = [[], []]
    start = 0
    while start < len(at_d):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + _PAIRS, "right")))
        n = right[start:stop] - left[start:stop]
        a = np.repeat(at_d[start:stop], n)
        b = order[np.repeat(left[start:stop] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        start = stop
        for kept, step in zip(ends, (-1, 1), strict=True):
            x, y = a + step, b + step
            inside = (x >= 0) & (y >= 0) & (x < len(hd)) & (y < len(hi))
            goes_on = np.zeros(len(a), bool)
            x, y = x[inside], y[inside]
            goes_on[inside] = whole_d[x] & whole_i[y] & (hd[x] == hi[y])
            kept.append(np.stack([a[~goes_on], b[~goes_on]]))
    firsts, lasts = (np.concatenate(x, 1) for x in ends)
    firsts, lasts = (x[:, np.lexsort((x[0], x[0] - x[1]))] for x in (firsts, lasts))  # on a diagonal they take turns
    found = np.stack([lasts[0] - firsts[0] + length, firsts[0], firsts[1]], 1)
    return [tuple(x) for x in found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))].tolist()]


def _whole(free: np.ndarray, length: int) -> np.ndarray:
    """Where a run of ``length`` words without a marked one begins."""
    if len(free) < length:
        return np.zeros(0, bool)
    seen = np.concatenate([[0], np.cumsum(~free)])
    return seen[length:] == seen[:-length]


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of ``item`` with runs of ``doc``: ``(doc start, item start, length)``.

    A pass takes a search length, hashes the runs of that length that hold no
    marked word in both texts, extends equal runs to maximal matches and marks
    them, longest first (ties: first in the document, then in the item). If a
    match is over twice the search length, the pass is done again at its
    length; else the search length is halved until it is ``min_match``.
    """
    free = [np.ones(len(doc), bool), np.ones(len(item), bool)]
    found: list[tuple[int, int, int]] = []
    length = max(min_match, min(len(item), 20))
    while True:
        matches = _matches(doc, item, length, free)
        if matches and matches[0][0] > 2 * length:
            length = matches[0][0]
            continue
        again = False
        for size, x, y in matches:
            if free[0][x : x + size].all() and free[1][y : y + size].all():
                free[0][x : x + size] = free[1][y : y + size] = False
                found.append((x, y, size))
            elif size > length:
                again = True  # what is left of it may be longer than the matches after it
                break
        if again:
            continue
        if length == min_match:
            return found
        length = max(min_match, length // 2)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for row, end, data, offsets in text_chunks(column):
        h, rows, _, _ = words(data, offsets)
        bounds = np.searchsorted(rows, np.arange(end - row + 1))
        yield row, end, [h[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _seeds(texts: DataFrame, lengths: list[int], among: np.ndarray | None = None) -> DataFrame:
    """``_id, _seed``: the distinct runs of each of ``lengths`` words of each text; without ``among``, of the largest of them that the text has."""
    shared = texts.sparkSession.sparkContext.broadcast(among) if among is not None else None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, tokens in _tokens(batch.column(1)):
                out, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for i, t in enumerate(tokens):
                    chosen = lengths if shared is not None else [x for x in lengths if x <= len(t)][-1:]
                    h = np.unique(np.concatenate([np.zeros(0, np.uint64), *(window_hashes(t, x) for x in chosen)]))
                    if shared is not None:
                        bits = shared.value
                        slot = h >> np.uint64(64 - (len(bits) * 8 - 1).bit_length())
                        h = h[(bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    out.append(h)
                    owner.append(np.full(len(h), row + i))
                seeds = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(seeds.view(np.int64))], ["_id", "_seed"])

    return texts.mapInArrow(find, f"_id {texts.schema['_id'].dataType.simpleString()}, _seed long")


def _seed_bits(seeds: DataFrame, bits: int) -> np.ndarray:
    """A table of ``2**bits`` bits in which a seed's leading bits are set: a filter of fixed size."""
    slots = seeds.select(F.shiftrightunsigned("_seed", 64 - bits).alias("_slot")).distinct()
    table = np.zeros(1 << (bits - 3), np.uint8)
    spans = slots.groupBy(F.shiftright("_slot", 13).alias("_page")).agg(F.collect_set(F.col("_slot").bitwiseAND(8191).cast("int")).alias("_on"))
    for row in spans.toLocalIterator():  # at most 2**(bits - 13) pages
        on = np.zeros(8192, bool)
        on[row["_on"]] = True
        table[row["_page"] * 1024 : (row["_page"] + 1) * 1024] = np.packbits(on, bitorder="little")
    return table


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 5,
    threshold: float = 0.8,
    filter_bits: int = 23,
    short_items: bool = False,
) -> DataFrame:
    """``id, item, covered, n_words, n_tiles, coverage`` of documents that hold ``threshold`` or more of an item.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lowered. Tiles are at least
    ``min_match`` words long; ``coverage`` is tiled words over words of the item.

    Edge cases: null or empty texts and items match nothing; an item of fewer
    than ``min_match`` words is, with ``short_items``, one tile that is found as
    a whole at word bounds, else it matches nothing; null ids take no part; repeated rows with one id count once (the least text is
    taken, so reruns agree); empty tables give an empty table; columns not
    named are ignored.

    At scale: a bit table of fixed size (1 MB) made from all items' seeds
    drops nearly all seeds of documents before the shuffle; what is left is
    joined exactly, once per document and seed, and counted down to pairs.
    A seed that very many documents hold spreads by AQE's skew join. Texts are
    shuffled only for documents in a pair.
    """
    items = cut(benchmark.filter(F.col(item_col).isNotNull()).groupBy(F.col(item_col).alias("_id")).agg(F.min(F.col(item_text_col).cast("string")).alias("_text")))
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    least = 1 if short_items else min_match
    item_seeds = cut(_seeds(items, list(range(least, min_match + 1))).select(F.col("_id").alias("_item"), "_seed"))
    short = items.select(word_count(F.col("_text")).cast("int").alias("n")).filter(F.col("n").between(least, min_match - 1)).distinct()
    lengths = sorted(r["n"] for r in short.collect())  # fewer than min_match numbers
    doc_seeds = _seeds(base, [*lengths, min_match], _seed_bits(item_seeds, filter_bits))
    pairs = cut(doc_seeds.join(item_seeds, "_seed").select("_id", "_item").distinct())
    texts = base.join(pairs.select("_id").distinct(), "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text"))
    both = pairs.join(texts, "_id").join(items.select(F.col("_id").alias("_item"), F.col("_text").alias("_item_text")), "_item")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item_tokens = [t for _, _, part in _tokens(batch.column(3)) for t in part]
            rows = []
            for row, _, part in _tokens(batch.column(2)):
                for i, doc in enumerate(part, row):
                    found = tiles(doc, item_tokens[i], min(min_match, len(item_tokens[i])))
                    rows.append((sum(x[2] for x in found), len(item_tokens[i]), len(found)))
            covered, n_words, n_tiles = (pa.array([r[k] for r in rows], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), covered, n_words, n_tiles], ["_id", "_item", "covered", "n_words", "n_tiles"])

    kinds = (base.schema["_id"].dataType.simpleString(), items.schema["_id"].dataType.simpleString())
    tiled = both.select("_id", "_item", "_text", "_item_text").mapInArrow(tile, f"_id {kinds[0]}, _item {kinds[1]}, covered long, n_words long, n_tiles long")
    return (
        tiled.withColumn("coverage", F.col("covered") / F.col("n_words"))
        .filter(F.col("coverage") >= threshold)
        .select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "covered", "n_words", "n_tiles", "coverage")
    )
