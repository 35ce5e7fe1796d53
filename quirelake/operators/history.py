"""Objects over time: entries of the table chain as intervals of revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entry_intervals(entries: DataFrame) -> DataFrame:
    """``file_id, number, type, offset, generation, compressed_in, index_in_stream, first, until``: from which revision an entry counts, and up to which.

    Revisions here count from the oldest, 0; ``until`` is the one that replaces
    the entry, null for the newest. Of several entries of a number in a revision
    that one counts which ``Structure.newest_entries`` takes. An entry that
    repeats the one before it goes on, so an interval is as long as it can be.
    At scale: two sorted passes over the entries of a number of a file.
    """
    same = ("type", "offset", "generation", "compressed_in", "index_in_stream")
    oldest = F.max("revision").over(W.partitionBy("file_id"))
    pick = W.partitionBy("file_id", "number", "revision").orderBy((F.col("type") == "f").cast("int"), "extra", F.col("ordinal").desc())
    one = entries.withColumn("first", oldest - F.col("revision")).withColumn("_k", F.row_number().over(pick)).filter("_k = 1")
    order = W.partitionBy("file_id", "number").orderBy("first")
    value = F.struct(*same)
    changed = one.withColumn("_before", F.lag(value).over(order)).filter(~value.eqNullSafe(F.col("_before")))
    return changed.select("file_id", "number", *same, "first", F.lead("first").over(order).alias("until"))


def at_revision(intervals: DataFrame, revision: int) -> DataFrame:
    """The entries in use in ``revision`` (0 the oldest): those whose interval holds it."""
    holds = (F.col("first") <= revision) & (F.col("until").isNull() | (F.col("until") > revision))
    return intervals.filter(holds & (F.col("type") != "f"))


def revision_changes(intervals: DataFrame) -> DataFrame:
    """``file_id, revision, number, change``: what each revision adds, changes or frees.

    A number that was never in use, or was free before, is ``added``.
    """
    order = W.partitionBy("file_id", "number").orderBy("first")
    used = F.col("type") != "f"
    before = F.coalesce(F.lag(used).over(order), F.lit(False))
    change = F.when(used & ~before, "added").when(used, "changed").when(before, "freed")
    return intervals.withColumn("change", change).filter("change IS NOT NULL").select("file_id", F.col("first").alias("revision"), "number", "change")


def revision_diff(intervals: DataFrame, older: int, newer: int) -> DataFrame:
    """``file_id, number, change`` from ``older`` to ``newer``, whatever lies between."""
    same = F.struct("type", "offset", "generation", "compressed_in", "index_in_stream")
    sides = [at_revision(intervals, r).select("file_id", "number", same.alias(name)) for r, name in ((older, "_old"), (newer, "_new"))]
    both = sides[0].join(sides[1], ["file_id", "number"], "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "freed").when(F.col("_old") != F.col("_new"), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select("file_id", "number", "change")
