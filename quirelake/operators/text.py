"""Text of pages: ToUnicode maps, shown strings with their fonts, visual elements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions.syntax import items, name_value, number_value, string_bytes
from quirelake.functions.text import cmap_of, decoded_codes, encoded_text
from quirelake.functions.udfs import arrow_udf, portions

from .objects import decoded
from .content import scoped
from .resources import drawn_xobjects

_SHOWS = ("Tj", "TJ", "'", '"')


def parsed_map_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``cmap_of`` of each row, in small batches: a map's codes take many times the room of its bytes."""
    for column in batches:
        for part in portions(cmap_of, column):
            yield pd.DataFrame(part.tolist(), columns=["codes", "spaces", "warnings"])


parsed_cmap = arrow_udf("struct<codes:array<struct<code:bigint,width:int,text:string>>,spaces:array<struct<width:int,first:bigint,last:bigint>>,warnings:array<string>>")(parsed_map_batches)


def cmaps(found: DataFrame, of_fonts: DataFrame) -> DataFrame:
    """``file_id, to_unicode, codes, spaces, warnings, error`` of the maps that fonts name; a map is read once a file."""
    named = of_fonts.filter("to_unicode IS NOT NULL").select("file_id", F.col("to_unicode").alias("object_id")).distinct()
    rows = decoded(named.join(found.select("file_id", "object_id", "entries", "stream"), ["file_id", "object_id"]))
    return rows.withColumn("_m", parsed_cmap("decoded")).select("file_id", F.col("object_id").alias("to_unicode"), "_m.*", "error")


def cmap_entries(of_cmaps: DataFrame) -> DataFrame:
    return of_cmaps.select("file_id", "to_unicode", F.explode("codes").alias("c")).select("file_id", "to_unicode", "c.*")


def codespace_ranges(of_cmaps: DataFrame) -> DataFrame:
    """``file_id, to_unicode, width, first, last``, the widest first."""
    widest = F.sort_array("spaces", asc=False)
    return of_cmaps.select("file_id", "to_unicode", F.posexplode(widest).alias("ordinal", "s")).select("file_id", "to_unicode", "ordinal", "s.*")


def cmap_warnings(of_cmaps: DataFrame) -> DataFrame:
    """``file_id, warning_id, severity, category`` of maps that can't be decoded, and of their damaged entries."""
    broken = of_cmaps.filter("error IS NOT NULL").select("file_id", F.concat(F.lit("warn:cmap-decode:"), "to_unicode").alias("warning_id"), F.lit("info").alias("severity"))
    damaged = of_cmaps.select("file_id", F.explode("warnings").alias("warning_id"), F.lit("warn").alias("severity"))
    return broken.unionByName(damaged).withColumn("category", F.lit("encoding"))


def shown_strings(ops: DataFrame) -> DataFrame:
    """A row for each string that a page shows: ``file_id, page_number, sequence, part, operator, font, size, scale, raw``.

    Font, size and scale are those of the last ``Tf`` and ``Tz`` before it that
    no ``Q`` has taken back (100 for none). The items of a ``TJ`` are its strings in order; one
    without strings gives a row with null ``raw``.
    """
    operand = lambda k: F.try_element_at("operands", F.lit(k))
    set_font = F.when(F.col("operator") == "Tf", F.struct(name_value(operand(1)).alias("font"), number_value(operand(2)).alias("size")))
    set_scale = F.when(F.col("operator") == "Tz", F.coalesce(number_value(operand(1)), F.lit(100.0)))
    state = scoped(scoped(ops, set_font, "_f"), set_scale, "_z").filter(F.col("operator").isin(*_SHOWS))
    strings = F.when(F.col("operator") == "TJ", F.filter(items(operand(1)), lambda x: x.startswith("(") | x.startswith("<"))).otherwise(F.array(F.when(F.col("operator") == '"', operand(3)).otherwise(operand(1))))
    rows = state.select("file_id", "page_number", "sequence", "op_id", "operator", "_f.font", F.coalesce("_f.size", F.lit(0.0)).alias("size"), (F.coalesce("_z", F.lit(100.0)) / 100).alias("scale"), F.posexplode_outer(strings).alias("part", "_s"))
    return rows.select("file_id", "page_number", "sequence", F.coalesce("part", F.lit(0)).alias("part"), "op_id", "operator", "font", "size", "scale", string_bytes("_s").alias("raw"))


def string_texts(strings: DataFrame, of_fonts: DataFrame, of_cmaps: DataFrame) -> DataFrame:
    """``strings`` with ``text``: by the font's ToUnicode map if it has entries, else by its encoding.

    At scale: strings of fonts without a map never leave their row. The others
    meet their map in a group of one map of one file.
    """
    font = of_fonts.select("file_id", "page_number", F.col("name").alias("font"), "encoding", "to_unicode")
    rows = strings.join(font, ["file_id", "page_number", "font"], "left").withColumn("text", encoded_text(F.col("raw"), F.col("encoding")))
    maps = of_cmaps.filter("size(codes) > 0").select("file_id", "to_unicode", "codes", "spaces")
    mapped = rows.join(maps.select("file_id", "to_unicode"), ["file_id", "to_unicode"], "left_semi")
    others = rows.join(maps.select("file_id", "to_unicode"), ["file_id", "to_unicode"], "left_anti")

    def apply(part: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if len(part) and len(of):
            codes = {c["code"]: c["text"] for c in of["codes"].iloc[0]}
            spaces = sorted(((s["width"], s["first"], s["last"]) for s in of["spaces"].iloc[0]), key=lambda s: -s[0])
            widths = sorted({c["width"] for c in of["codes"].iloc[0]} | {s[0] for s in spaces}, reverse=True)
            part["text"] = [None if x is None else decoded_codes(bytes(x), codes, widths, spaces) for x in part["raw"]]
        return part

    renamed = maps.select(F.col("file_id").alias("_file"), F.col("to_unicode").alias("_map"), "codes", "spaces")
    done = mapped.groupBy("file_id", "to_unicode").cogroup(renamed.groupBy("_file", "_map")).applyInPandas(apply, mapped.schema)
    return others.select(mapped.columns).unionByName(done)


def text_runs(texts: DataFrame) -> DataFrame:
    """``file_id, page_number, sequence, op_id, text, width, height, low``: a run for each operator that shows text.

    Sizes in text space: half an em a UTF-16 unit, at least 0.1 wide; an empty
    ``TJ`` counts as one unit; a run begins a fifth of the size below its line.
    Nothing is shown at size 0.
    """
    joined = texts.groupBy("file_id", "page_number", "sequence", "op_id", "operator", "size", "scale").agg(F.array_sort(F.collect_list(F.struct("part", F.coalesce("text", F.lit("")).alias("text"), F.col("raw").isNull().alias("none")))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda x: x.text), "")
    units = F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2)
    counted = F.when((F.col("operator") == "TJ") & (units == 0), 1).when(F.col("_p")[0]["none"], 1).otherwise(units)
    return joined.filter("size <> 0").select(
        "file_id", "page_number", "sequence", "op_id", text.alias("text"), F.greatest(F.lit(0.1), counted * 0.5 * F.col("size") * F.col("scale")).alias("width"), F.col("size").alias("height"), (F.col("size") * -0.2).alias("low")
    )


def visual_elements(runs: DataFrame, ops: DataFrame, of_xobjects: DataFrame) -> DataFrame:
    """``file_id, page_number, element_id, kind, z_index, op_id, preview``: text runs, images and forms in drawing order."""
    drawn = drawn_xobjects(ops, of_xobjects).filter("object_id IS NOT NULL")
    kind = F.when(F.col("subtype") == "Form", "form").otherwise("image")
    parts = [
        runs.select("file_id", "page_number", "sequence", "op_id", F.lit("text").alias("_k"), F.col("text").alias("preview")),
        drawn.select("file_id", "page_number", "sequence", "op_id", kind.alias("_k"), F.concat(F.lit("/"), "name").alias("preview")),
        ops.filter("operator = 'BI/EI'").select("file_id", "page_number", "sequence", "op_id", F.lit("image").alias("_k"), F.lit(None).cast("string").alias("preview")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    page, same = W.partitionBy("file_id", "page_number").orderBy("sequence"), W.partitionBy("file_id", "page_number", "_k").orderBy("sequence")
    number = F.row_number().over(same) - 1
    return rows.select(
        "file_id", "page_number", F.concat(F.lit("page:"), "page_number", F.lit(":vis:"), "_k", F.lit(":"), number).alias("element_id"),
        F.when(F.col("_k") == "text", "text-run").when(F.col("_k") == "form", "form-xobject").otherwise("image").alias("kind"), (F.row_number().over(page) - 1).alias("z_index"), "op_id", "preview",
    )
