"""Removal of lines that many documents share (DataFrame functions only).

Lines are exploded and normalised, the documents of each line hash are counted,
lines over the threshold go, and each text is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, ascii_lower, cut

#: Partitions over which the lines of a very common key are dealt.
SALTS = 32


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITESPACE)))


def _hashes(key: Column) -> list[Column]:
    """128 bits in two fixed-width columns."""
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit("line"), key).alias("_h2")]


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, but for the copy in the largest id.

    A line is what stands between ``\\n``; its key is the line without
    ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lowered. Keys shorter than
    ``min_chars`` code points always stay. The document with the largest id
    that holds a key keeps all its lines of that key.

    Returns ``id, *carry, text, n_lines, n_dropped``, one row for each input row.

    Edge cases: a null or empty text is one empty line and comes back as ``""``;
    rows that share an id are one document where documents are counted, and all
    keep their lines if that id is the largest; rows without an id are one
    document, below all others; an empty table gives an empty table; columns
    not named are ignored.

    At scale: the distinct keys of a row are found inside it, and the count is
    two shuffles with map-side partial aggregates: by key and document, which
    spreads a key that everyone has, and by key. Keys with over a thousandth of all repeated lines,
    of which there can't be more than a thousand, are broadcast, and their lines
    are dealt over ``SALTS`` partitions for the lookup. The join of positions is
    an equi-join on the document; texts are shuffled once.
    """
    lines = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_fp"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("_lines"),
    )
    long_enough = lambda k: F.length(k) >= min_chars
    repeated = cut(
        lines.select("_id", F.explode(F.array_distinct(F.filter(F.transform("_lines", _key), long_enough))).alias("_key"))
        .select("_id", *_hashes(F.col("_key")))
        .groupBy("_h1", "_h2")
        .agg(F.count_distinct(F.struct("_id")).alias("_n"), F.max("_id").alias("_keeper"))
        .filter(F.col("_n") >= min_docs)
    )
    common = max(1000, (repeated.agg(F.sum("_n")).first()[0] or 0) // 1000)
    hot = repeated.filter(F.col("_n") > common).select("_h1", "_h2", F.lit(True).alias("_hot"))
    salted = repeated.withColumn("_salt", F.explode(F.when(F.col("_n") > common, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    dropped = (
        lines.select("_id", "_fp", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", "_fp", "_pos", _key(F.col("_line")).alias("_key"))
        .filter(long_enough(F.col("_key")))
        .select("_id", "_fp", "_pos", *_hashes(F.col("_key")))
        .join(F.broadcast(hot), ["_h1", "_h2"], "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", "_pos"), F.lit(SALTS)).cast("int")).otherwise(0))
        .join(salted, ["_h1", "_h2", "_salt"])
        .filter(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_fp")
        .agg(F.collect_set("_pos").alias("_drop"))
        .withColumnsRenamed({"_id": "_id2", "_fp": "_fp2"})
    )
    joined = lines.join(dropped.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_fp") == F.col("_fp2")), "left")
    n = F.size("_lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("_drop")), lambda i: F.get(F.col("_lines"), i))
    return joined.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        F.array_join(F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(kept), "\n").alias(text_col),
        n.cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
    )
