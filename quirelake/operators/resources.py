"""Resources of pages: fonts, XObjects, properties and what else a page names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.syntax import entries, items, name_value, ref_id
from quirelake.functions.values import refs_within

from .objects import filters_of, int_of, name_of, numbers_of, rect_of, ref_of, value_of

_E = "entries"
#: Font subtypes that are known.
FONT_SUBTYPES = ("Type0", "Type1", "Type3", "MMType1", "TrueType", "CIDFontType0", "CIDFontType2")


def _held(found: DataFrame, name: str) -> DataFrame:
    return found.select("file_id", F.col("object_id").alias(name), "entries", "stream", F.lit(True).alias("_known"))


def page_resources(found: DataFrame, of_pages: DataFrame) -> DataFrame:
    """``file_id, page_number, entries``: the resource dictionary of each page, in place or behind a reference."""
    rows = of_pages.select("file_id", "page_number", "resources", "resource_dict").join(_held(found, "resources").select("file_id", "resources", F.col("entries").alias("_ref")), ["file_id", "resources"], "left")
    return rows.withColumn("entries", F.coalesce(entries("resource_dict"), "_ref")).filter("entries IS NOT NULL").select("file_id", "page_number", "entries")


def named(found: DataFrame, resources: DataFrame, category: str) -> DataFrame:
    """``file_id, page_number, name, value``: entries of ``category`` (a dictionary in place or behind a reference)."""
    value = resources.select("file_id", "page_number", value_of(_E, category).alias("_v")).filter("_v IS NOT NULL").withColumn("_id", ref_id(F.col("_v")))
    rows = value.join(_held(found, "_id").select("file_id", "_id", F.col("entries").alias("_ref")), ["file_id", "_id"], "left")
    return rows.select("file_id", "page_number", F.explode(F.coalesce("_ref", entries("_v"))).alias("name", "value"))


def reference_map(found: DataFrame, resources: DataFrame, category: str) -> DataFrame:
    """``file_id, page_number, name, object_id``: for ExtGState, ColorSpace, Pattern and Shading; values in place are left out."""
    return named(found, resources, category).withColumn("object_id", ref_id(F.col("value"))).filter("object_id IS NOT NULL").drop("value")


def properties(found: DataFrame, resources: DataFrame) -> DataFrame:
    """``file_id, page_number, name, entries`` of property lists, in place or behind a reference."""
    rows = named(found, resources, "Properties").withColumn("_id", ref_id(F.col("value")))
    held = rows.join(_held(found, "_id").select("file_id", "_id", F.col("entries").alias("_ref")), ["file_id", "_id"], "left")
    return held.withColumn("entries", F.coalesce("_ref", entries("value"))).filter("entries IS NOT NULL").select("file_id", "page_number", "name", "entries")


def proc_sets(resources: DataFrame) -> DataFrame:
    """``file_id, page_number, ordinal, name`` of procedure sets; other values than names are left out."""
    rows = resources.select("file_id", "page_number", F.posexplode(items(value_of(_E, "ProcSet"))).alias("ordinal", "_v"))
    return rows.select("file_id", "page_number", "ordinal", name_value(F.col("_v")).alias("name")).filter("name IS NOT NULL")


def fonts(found: DataFrame, resources: DataFrame) -> DataFrame:
    """``file_id, page_number, name, object_id, subtype, base_font, encoding, to_unicode, embedded`` of indirect fonts."""
    slots = reference_map(found, resources, "Font")
    rows = slots.join(_held(found, "object_id").select("file_id", "object_id", "entries"), ["file_id", "object_id"], "left")
    coding = value_of(_E, "Encoding")
    rows = rows.withColumns({"_coding": coding, "_id": ref_id(coding)}).join(_held(found, "_id").select("file_id", "_id", F.col("entries").alias("_ref")), ["file_id", "_id"], "left")
    reach = embedded_fonts(found).withColumn("embedded", F.lit(True))
    subtype = name_of(_E, "Subtype")
    return rows.join(reach, ["file_id", "object_id"], "left").select(
        "file_id", "page_number", "name", "object_id", F.when(subtype.isin(*FONT_SUBTYPES), subtype).otherwise("Unknown").alias("subtype"), name_of(_E, "BaseFont").alias("base_font"),
        F.coalesce(name_value(F.col("_coding")), name_of(F.coalesce("_ref", entries("_coding")), "BaseEncoding")).alias("encoding"), ref_of(_E, "ToUnicode").alias("to_unicode"), F.coalesce("embedded", F.lit(False)).alias("embedded"),
    )


def embedded_fonts(found: DataFrame) -> DataFrame:
    """``file_id, object_id`` of objects from which ``FontDescriptor`` and ``DescendantFonts`` lead to a font file.

    A Type 0 font reaches one over a descendant and its descriptor, so three
    steps back from the objects that hold a font file find all of them.
    """
    holds = [value_of(_E, k).isNotNull() for k in ("FontFile", "FontFile2", "FontFile3")]
    steps = F.concat_ws(" ", *[F.coalesce(value_of(_E, k), F.lit("")) for k in ("FontDescriptor", "DescendantFonts")])
    links = found.select("file_id", "object_id", F.explode(refs_within(steps)).alias("_to"))
    inside = found.filter(steps.rlike("/FontFile[23]?(?![A-Za-z0-9])")).select("file_id", "object_id")
    reach = found.filter(holds[0] | holds[1] | holds[2]).select("file_id", "object_id").unionByName(inside)
    for _ in range(3):
        back = links.join(reach.withColumnRenamed("object_id", "_to"), ["file_id", "_to"], "left_semi").select("file_id", "object_id")
        reach = reach.unionByName(back).distinct()
    return reach


def xobjects(found: DataFrame, resources: DataFrame) -> DataFrame:
    """``file_id, page_number, name, object_id, subtype, width, height, color_space, bits, filters, bbox, matrix`` of indirect XObjects."""
    rows = reference_map(found, resources, "XObject").join(_held(found, "object_id"), ["file_id", "object_id"], "left")
    subtype = name_of(_E, "Subtype")
    form = subtype == "Form"
    matrix = numbers_of(_E, "Matrix")
    return rows.select(
        "file_id", "page_number", "name", "object_id", F.when(subtype.isin("Image", "Form", "PS"), subtype).otherwise("Unknown").alias("subtype"), int_of(_E, "Width").alias("width"), int_of(_E, "Height").alias("height"),
        name_of(_E, "ColorSpace").alias("color_space"), int_of(_E, "BitsPerComponent").alias("bits"), F.when(F.col("stream").isNotNull(), filters_of(_E)).otherwise(F.array().cast("array<string>")).alias("filters"),
        F.when(form, rect_of(_E, "BBox")).alias("bbox"), F.when(form & (F.size(matrix) >= 6), F.slice(matrix, 1, 6)).alias("matrix"),
    )


def drawn_xobjects(ops: DataFrame, of_xobjects: DataFrame) -> DataFrame:
    """Each ``Do`` with the XObject that its name stands for on the page; ``object_id`` is null where the page has none."""
    drawn = ops.filter("operator = 'Do'").withColumn("name", name_value(F.try_element_at("operands", F.lit(1)))).filter("name IS NOT NULL")
    return drawn.join(of_xobjects, ["file_id", "page_number", "name"], "left")


def missing_xobjects(ops: DataFrame, of_xobjects: DataFrame) -> DataFrame:
    """``file_id, warning_id, severity, category`` of operations that draw what their page does not name."""
    lost = drawn_xobjects(ops, of_xobjects).filter("object_id IS NULL")
    return lost.select("file_id", F.concat(F.lit("warn:do-missing:"), "op_id").alias("warning_id"), F.lit("warn").alias("severity"), F.lit("structure").alias("category"))
