"""Ranked lexical search with Block-Max WAND over compressed posting blocks.

Documents are indexed in shards. A term's postings in a shard stand in blocks of
``BLOCK`` postings, bit-packed, each with its first and last document and the
largest impact in it. A query first moves over these heads only (shallow moves),
adds the largest impacts of the blocks that overlap, and unpacks a block only
where that sum can still reach the top of the list.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import ascii_lower, cut, stored

#: Postings in a block, documents in a shard, terms with repeats in a shard (a longer document is one of its own).
BLOCK, SHARD_DOCS, SHARD_TERMS = 128, 4096, 1 << 20
#: Query rows that are searched together, and distinct query terms up to which their list is broadcast (about 100 bytes each).
BATCH, BROADCAST_TERMS = 256, 100_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What bytes become: A-Z lowered, ASCII that no term has a blank, all other bytes as they are.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in (c + 32 if 65 <= c <= 90 else c for c in range(256)))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def pack(gaps: np.ndarray, more: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of consecutive blocks, bit by bit: ``(bits of a gap, bits of a count, offsets in bytes, bytes)``.

    A block has its gaps between documents and then its occurrences less one,
    each in as many bits as the largest of the block needs.
    """
    sizes = np.diff(starts, append=len(gaps))
    block, place = np.repeat(np.arange(len(starts)), sizes), np.arange(len(gaps)) - np.repeat(starts, sizes)
    widths = [np.frexp(np.maximum.reduceat(x, starts))[1].astype(np.int64) for x in (gaps, more)]
    offsets = np.concatenate(([0], np.cumsum((sizes * (widths[0] + widths[1]) + 7) // 8)))
    bits = np.zeros(int(offsets[-1]) * 8, bool)
    for values, width, before in ((gaps, widths[0], 0), (more, widths[1], sizes * widths[0])):
        at = (offsets[:-1] * 8 + before)[block] + place * width[block]
        for bit in range(int(width.max(initial=0))):
            some = width[block] > bit
            bits[at[some] + bit] = (values[some] >> bit) & 1
    return widths[0], widths[1], offsets, np.packbits(bits)


def unpack(data: bytes, first: int, n: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (a + b))
    gaps = bits[: n * a].reshape(n, a) @ (1 << np.arange(a))
    return first + np.cumsum(gaps), 1 + bits[n * a :].reshape(n, b) @ (1 << np.arange(b))


def _shard(shard: int, ids: list, found: list[tuple[np.ndarray, np.ndarray]], numbers: dict[bytes, int], n_docs: int, n_terms: int, kind: pa.DataType) -> pa.RecordBatch:
    """One row with the shard's documents, and one for each block of a term; ``found`` has numbers of terms and their occurrences by document."""
    m = 100 - 25 + 25 * np.array([tf.sum(dtype=np.int64) for _, tf in found]) * n_docs // max(n_terms, 1)
    docs = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
    of, tfs = (np.concatenate([x[k] for x in found]).astype(np.int64) for k in (0, 1))
    order = np.argsort(of, kind="stable")  # documents stay in order
    docs, tfs, of = docs[order], tfs[order], of[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    starts = np.flatnonzero(place % BLOCK == 0)
    gaps = np.diff(docs, prepend=0)
    gaps[starts] = 0
    a, b, offsets, data = pack(gaps, tfs - 1, starts)
    ends = np.append(starts[1:], len(docs)) - 1
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    terms_ = pa.array(list(numbers), pa.binary()).cast(pa.string()).take(pa.array(of[starts]))
    heads = (place[starts] // BLOCK, docs[starts], docs[ends], ends - starts + 1, a, b)
    top = np.maximum.reduceat(impact(tfs, m[docs]), starts)

    def after(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.nulls(1, column.type), column])

    size = len(starts)
    columns = [
        pa.array(np.full(size + 1, shard), pa.int64()), after(terms_), *(after(pa.array(x, pa.int32())) for x in heads), after(pa.array(top, pa.int64())), after(packed),
        pa.array([ids] + [None] * size, pa.list_(kind)), pa.array([m.tolist()] + [None] * size, pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "block", "first", "last", "n", "a", "b", "top", "data", "ids", "m"])


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index of all rows of ``docs``, and how many of them have a term.

    Rows ``shard, term, block, first, last, n, a, b, top, data, ids, m``: a
    block's places in its shard, postings, bits of a gap and of a count, largest
    impact and packed postings; and for
    each shard a row without term that has the ids and length factors of its
    documents. Two passes: counts of documents and terms, then the shards,
    which each task makes of its own rows, so nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(F.regexp_count(text, F.lit(TERM)).cast("long").alias("_n"))
    counted = sizes.agg(F.count_if(F.col("_n") > 0), F.coalesce(F.sum("_n"), F.lit(0))).first()
    n_docs, n_terms = int(counted[0]), int(counted[1])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size, ids, found, numbers, kind = TaskContext.get().partitionId() << 32, 0, [], [], {}, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, body in zip(batch.column(0), batch.column(1), strict=True):
                words = terms(body.as_py())
                if found and (len(found) == SHARD_DOCS or size + len(words) > SHARD_TERMS):
                    yield _shard(number, ids, found, numbers, n_docs, n_terms, kind)
                    number, size, ids, found, numbers = number + 1, 0, [], [], {}
                if words:
                    counts = Counter(words)
                    ids.append(doc.as_py())
                    found.append((np.fromiter((numbers.setdefault(t, len(numbers)) for t in counts), np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))))
                    size += len(words)
        if found:
            yield _shard(number, ids, found, numbers, n_docs, n_terms, kind)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"shard long, term string, block int, first int, last int, n int, a int, b int, top long, data binary, ids array<{kind}>, m array<long>"
    return stored(docs.select(F.col(id_col).alias("_id"), text.alias("_text")).mapInArrow(shards, schema)), n_docs


class Postings:
    """A term's blocks in a shard: heads as arrays, documents and impacts unpacked once asked for."""

    def __init__(self, heads: dict[str, np.ndarray], data: list[bytes], m: np.ndarray) -> None:
        self.heads, self.first, self.last, self.top = heads, heads["first"], heads["last"], heads["top"]
        self.data, self._m, self._open = data, m, {}

    def blocks(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks."""
        for k in numbers.tolist():
            if k not in self._open:
                docs, tfs = unpack(self.data[k], *(int(self.heads[c][k]) for c in ("first", "n", "a", "b")))
                self._open[k] = docs, impact(tfs, self._m[docs])
        some = [self._open[k] for k in numbers.tolist()]
        return some[0] if len(some) == 1 else (np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some]))

    @property
    def opened(self) -> int:
        return len(self._open)


#: Stretches that a query visits first, and how many times as many it visits after each visit.
FIRST_VISIT, GROWTH = 32, 8


def block_max_wand(weighted: list[tuple[int, Postings]], n_docs: int, k: int, before: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of a shard's documents and their scores; ``before`` puts documents of equal score into their order.

    The heads of all blocks cut the shard into stretches, in each of which one
    block of a term at most can stand; the sum of their largest impacts bounds
    its scores. Stretches are visited from the largest bound down until the next
    bound is under the k-th score so far; only then are their blocks unpacked.
    """
    edges = np.unique(np.concatenate([x for _, p in weighted for x in (p.first, p.last + 1)]))
    starts, ends = edges[:-1], edges[1:]
    bound, standing = np.zeros(len(starts), np.int64), []
    for weight, p in weighted:
        at = np.searchsorted(p.last, starts)
        at[at == len(p.last)] = -1
        at[p.first[at] > starts] = -1
        bound += np.where(at >= 0, weight * p.top[at], 0)
        standing.append(at)
    order = np.argsort(-bound, kind="stable")
    best_docs, best_scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    done, step = 0, FIRST_VISIT
    while done < len(order) and bound[order[done]] >= least:
        now = order[done : done + step]
        now = now[bound[now] >= least]
        done, step = done + step, step * GROWTH
        scores = np.zeros(n_docs, np.int64)
        for (weight, p), at in zip(weighted, standing, strict=True):
            wanted = np.zeros(len(p.last) + 1, bool)
            wanted[at[now]] = True
            wanted = np.flatnonzero(wanted[:-1])
            if len(wanted):
                docs, impacts = p.blocks(wanted)
                scores[docs] += weight * impacts
        visited = np.zeros(n_docs + 1, np.int64)
        visited[starts[now]] += 1
        visited[ends[now]] -= 1
        docs = np.flatnonzero((np.cumsum(visited[:-1]) > 0) & (scores >= least))
        docs, scores = np.concatenate((best_docs, docs)), np.concatenate((best_scores, scores[docs]))
        if len(docs) > k:
            least_of = np.partition(scores, -k)[-k]
            docs, scores = docs[scores >= least_of], scores[scores >= least_of]
        top = before(docs)
        top = top[np.argsort(-scores[top], kind="stable")][:k]
        best_docs, best_scores = docs[top], scores[top]
        if len(best_docs) == k:
            least = max(1, int(best_scores[-1]))
    return best_docs, best_scores


def _in_order(ids: list) -> np.ndarray:
    """The place of each document in the order of ids, null last."""
    ranks = np.empty(len(ids), np.int64)
    ranks[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))
    return ranks


def _searcher(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The best documents of one shard for each query of a batch."""
        columns = ["_query", "_id", "score", "opened", "blocks"]
        heads = blocks[blocks["term"].isna()]
        if not len(heads) or not len(queries):
            return pd.DataFrame(columns=columns)
        ids, m = list(heads["ids"].iloc[0]), np.array(heads["m"].iloc[0], np.int64)
        ranks = _in_order(ids)
        of_terms = blocks[blocks["term"].notna()].sort_values(["term", "block"])
        columns_of = {c: of_terms[c].to_numpy(np.int64) for c in ("block", "first", "last", "n", "a", "b", "top")}
        starts, names, data = np.flatnonzero(columns_of["block"] == 0), of_terms["term"].to_numpy(), of_terms["data"].to_numpy()
        postings = {}
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(names)], strict=True):
            postings[names[a]] = Postings({c: x[a:z] for c, x in columns_of.items()}, list(data[a:z]), m)
        rows = []
        for query, words, weights in zip(queries["_query"], queries["_terms"], queries["_weights"], strict=True):
            weighted = [(int(w), postings[t]) for t, w in zip(words, weights, strict=True) if t in postings and w > 0]
            if weighted:
                docs, scores = block_max_wand(weighted, len(ids), k, lambda d: np.argsort(ranks[d], kind="stable"))
                rows += [(query, ids[d], s, sum(p.opened for _, p in weighted), sum(len(p.last) for _, p in weighted)) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(rows, columns=columns)

    return search


def weigh(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * df + 1))).cast("long")


def search_documents(
    docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text", k: int = 20
) -> DataFrame:
    """The ``k`` best documents for each row of ``queries``: ``query id, rank, id, score``.

    A term is a run of characters outside ``[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``
    with A-Z lowered. A posting's impact is ``10**9 * tf div (1000 * tf + 12 * m)``
    with the length factor ``m``; a score is the sum of ``weight * impact`` over
    the query's terms, repeats included. Exact: blocks are skipped only where
    their bound is under the ``k``-th score found so far, and ties go to the
    smaller id.

    Edge cases: null and empty texts have no terms, and such queries no rows;
    each row of either table stands for itself, so repeated documents are found
    each, and repeated queries give a list each; a null document id comes last
    among ties; empty tables give an empty table; columns not named are ignored.

    At scale: a shard has at most ``SHARD_DOCS`` documents, so a task holds the
    blocks of one shard and ``BATCH`` queries (more only if they hash so). The
    index is scanned for the terms that queries have: up to ``BROADCAST_TERMS``
    of them travel to the blocks, more are joined by shuffle. Each shard returns
    ``k`` rows a query, of which each task keeps ``k`` before they meet.
    """
    asked = cut(
        queries.select(F.monotonically_increasing_id().alias("_query"), F.col(query_id_col).alias("_name"), F.regexp_extract_all(ascii_lower(F.coalesce(F.col(query_text_col), F.lit(""))), F.lit(TERM), F.lit(0)).alias("_words"))
        .filter(F.size("_words") > 0)
    )
    batches = max(1, math.ceil(asked.count() / BATCH))
    index, n_docs = build_index(docs, id_col=id_col, text_col=text_col)
    batch = F.pmod(F.xxhash64("_query"), F.lit(batches)).cast("int")
    words = asked.select("_query", batch.alias("_batch"), F.explode("_words").alias("term")).groupBy("_query", "_batch", "term").agg(F.count(F.lit(1)).alias("_times"))
    wanted = cut(words.select("term", "_batch").distinct())
    small = wanted.count() <= BROADCAST_TERMS

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if small else rows

    known = index.filter("term IS NOT NULL")
    found = known.join(sent(wanted), "term")
    weights = cut(known.select("term", "n").join(sent(wanted.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("_df")).select("term", weigh(F.col("_df"), n_docs).alias("_w")))
    lists = words.join(weights, "term").groupBy("_query", "_batch").agg(F.collect_list(F.struct("term", (F.col("_w") * F.col("_times")).alias("w"))).alias("_t"))
    lists = lists.select("_query", "_batch", F.col("_t.term").alias("_terms"), F.col("_t.w").alias("_weights"))
    heads = index.filter("term IS NULL").withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    blocks = found.unionByName(heads).select("shard", "_batch", "term", "block", "first", "last", "n", "a", "b", "top", "data", "ids", "m")
    tasks = heads.select(F.col("shard").alias("_shard"), "_batch").join(lists, "_batch").withColumnRenamed("_batch", "_part")
    kind = docs.schema[id_col].dataType.simpleString()
    best = (
        blocks.groupBy("shard", "_batch").cogroup(tasks.groupBy("_shard", "_part"))
        .applyInPandas(_searcher(k), f"_query long, _id {kind}, score long, opened long, blocks long")
    )
    order = W.partitionBy("_query").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("_query", "_name"), "_query").select(F.col("_name").alias(query_id_col), "rank", F.col("_id").alias(id_col), "score")
