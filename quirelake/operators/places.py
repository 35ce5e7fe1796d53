"""Places in a file resolved to what starts there: an as-of join over ranges of blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolved(places: DataFrame, headers: DataFrame, place: str, target: str) -> DataFrame:
    """``places`` with ``target``, the header whose blanks hold ``place``, or null.

    ``headers(file_id, target, clear)`` have ranges of places from which only
    blanks and comments lead to them; ranges of a file don't overlap. A place
    takes the last range that begins at it or before it, if it ends at it or
    after it. At scale: one shuffle of places and ranges by file, in which they
    are sorted; nothing is joined pair by pair, and no bytes are read.
    """
    kept = [c for c in places.columns if c != "file_id"]
    ranges = headers.select("file_id", target, F.explode("clear").alias("_c")).select(
        "file_id", F.col("_c.low").alias("_at"), F.lit(0).alias("_side"), F.struct(F.col("_c.high").alias("high"), F.col(target).alias("target")).alias("_range"), F.lit(None).cast(places.select(F.struct(*kept)).schema[0].dataType).alias("_row")
    )
    asked = places.select("file_id", F.col(place).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(ranges.schema["_range"].dataType).alias("_range"), F.struct(*kept).alias("_row"))
    before = W.partitionBy("file_id").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    found = ranges.unionByName(asked).withColumn("_last", F.last("_range", ignorenulls=True).over(before)).filter("_side = 1")
    return found.select("file_id", "_row.*", F.when(F.col("_at") <= F.col("_last.high"), F.col("_last.target")).alias(target))
