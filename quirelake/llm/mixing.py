"""Mixing of sources to target weights by weighted fair queueing (DataFrame functions only).

Each document, in a shuffled order of its source, gets a virtual finish time:
the words of its source so far over the source's target. The documents of all
sources are sorted by that time and cut off at the total budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, word_count


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """``_source, _S, _target`` of each source; reads ``_source, _size``.

    Sources in code-point order get ``weights`` in turn. A source is full at
    ``max_repeats`` times its size. In order of fullness over weight the full
    sources come first, so running sums show in one pass where the level lies
    that the other sources share. The rows here are sources, not documents.
    """
    sums = sizes.groupBy("_source").agg(F.sum("_size").alias("_S"))
    turn = (F.row_number().over(W.orderBy("_source")) - 1) % len(weights)
    weighed = sums.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("long"))
    cap = F.col("_S") * max_repeats
    order = W.orderBy(cap / F.col("_w"), "_source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("_S").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    levels = weighed.withColumn("_level", left / weight_left).withColumn("_open", cap / F.col("_w") > F.col("_level"))
    shared = F.max(F.when(F.col("_open"), F.struct(-cap / F.col("_w"), F.col("_level").alias("level")))).over(everything)["level"]
    return levels.select("_source", "_S", F.when(F.col("_open"), shared * F.col("_w")).otherwise(cap.cast("double")).alias("_target"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """Choose how often the mix takes each document.

    The budget is the words of all documents. Returns ``id, source, size,
    source_size, target, taken, copies, finish``: words of the document and of
    its source, the source's target, words taken (``copies * size``) and the
    virtual finish time of the first copy.

    Edge cases: a null text has size 0; a null source is a source of its own,
    sorted last; documents of size 0 can be in the mix with taken 0; repeated
    rows are documents of their own; the order depends on ``seed`` and the id,
    then on the text (for rows that repeat an id) and at last on nothing that
    tells equal rows apart, so reruns agree however the table is dealt out;
    rows without an id are shuffled by their text; an empty table gives an
    empty table; columns not named are ignored.

    At scale: no step holds a source or the whole queue in a task. Running sums
    are taken in two levels, over about sqrt(rows) ranges of the shuffled order
    and inside a range; the cut-off is found the same way over ranges of finish
    time. The driver reads only the row count, the budget and the cut-off.
    """
    sizes = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("_source"),  # null sorts last
            word_count(F.col(text_col)).alias("_size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.hex(F.xxhash64(text_col))))).alias("_shuffle"),
            F.xxhash64(text_col, source_col).alias("_text"),
        )
    )
    counted = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    n, budget = max(1, math.ceil(math.sqrt(counted[0]))), counted[1]
    place = F.shiftright(F.conv(F.substring("_shuffle", 1, 8), 16, 10).cast("long") * n, 32)
    placed = sizes.withColumn("_place", place)
    earlier = W.partitionBy("_source").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    ranges = (
        placed.groupBy("_source", "_place")
        .agg(F.sum("_size").alias("_words"))
        .select("_source", "_place", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_base"))
    )
    ordered = W.partitionBy("_source", "_place").orderBy("_shuffle", "_id", "_text", "_size")
    inside = ordered.rowsBetween(W.unboundedPreceding, 0)
    queued = cut(
        placed.withColumns({"_in": F.sum("_size").over(inside), "_nth": F.row_number().over(ordered)})
        .join(ranges, ["_source", "_place"])
        .join(source_targets(sizes, weights, max_repeats), "_source")
        .select("_id", "_source", "_size", "_shuffle", "_nth", "_S", "_target", (F.col("_base") + F.col("_in")).alias("_sofar"))
    )

    def finish(copy: int) -> Column:
        return F.when(F.col("_target") > 0, (copy * F.col("_S") + F.col("_sofar")) / F.col("_target")).otherwise(F.lit(0.0))

    def when(copy: int) -> Column:
        return F.least(F.floor(finish(copy) * n), F.lit(4 * n)).cast("long")

    def key(copy: int) -> Column:
        return F.struct(finish(copy).alias("finish"), F.col("_source").alias("source"), F.col("_shuffle").alias("shuffle"), F.col("_id").alias("id"), F.col("_nth").alias("nth"), F.lit(copy).alias("copy"))

    copies = range(max_repeats)
    entries = queued.select("_size", F.explode(F.array(*[F.struct(when(c).alias("when"), key(c).alias("key")) for c in copies])).alias("_e")).select("_size", "_e.*")
    ends = entries.groupBy("when").agg(F.sum("_size").alias("_words")).withColumn("_end", F.sum("_words").over(W.orderBy("when")))
    edge = ends.filter(F.col("_end") > budget).orderBy("when").select("when", (F.col("_end") - F.col("_words")).alias("_before")).first()
    if edge is None:  # only where there are no words at all
        taken = F.lit(0)
    else:
        running = F.sum("_size").over(W.orderBy("key").rowsBetween(W.unboundedPreceding, 0))
        at_edge = entries.filter(F.col("when") == edge["when"]).withColumn("_sum", running).filter(F.col("_sum") <= budget - edge["_before"])
        last = at_edge.agg(F.max("key").alias("key")).first()["key"]
        until = F.lit(False)
        takes = []
        for c in copies:
            if last is not None:
                until = key(c) <= F.struct(*[F.lit(v).alias(k) for k, v in last.asDict().items()])
            takes.append(F.when((when(c) < edge["when"]) | ((when(c) == edge["when"]) & until), 1).otherwise(0))
        taken = sum(takes[1:], takes[0])
    return queued.withColumn("_copies", taken.cast("long")).select(
        F.col("_id").alias(id_col),
        F.when(F.substring("_source", 1, 1) == "0", F.expr("substring(_source, 2)")).alias(source_col),
        F.col("_size").alias("size"),
        F.col("_S").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
        F.col("_copies").alias("copies"),
        finish(0).alias("finish"),
    )
