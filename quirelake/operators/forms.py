"""Form fields and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import latin1
from quirelake.functions.syntax import entries, items, ref_id, string_bytes
from quirelake.functions.values import listed_refs

from .objects import name_of, value_of
from .trees import preorder

_E = "entries"


def form_fields(found: DataFrame, tree: DataFrame) -> DataFrame:
    """``file_id, ordinal, object_id, name, full_name, field_type, value, signed`` of terminal fields, in order.

    A field with ``/Kids``, even an empty array, is not terminal. Full names
    join the names from the root with dots; a field without a name goes by the
    full one. Types aren't inherited; a value counts only as a string; a
    signature is signed if its value is a reference.
    """
    acro = tree.select("file_id", F.col("acroform").alias("object_id")).join(found.select("file_id", "object_id", "entries"), ["file_id", "object_id"])
    roots = acro.select("file_id", F.posexplode(items(value_of(_E, "Fields"))).alias("root", "_v")).select("file_id", ref_id(F.col("_v")).alias("node"), "root").filter("node IS NOT NULL")
    first = roots.groupBy("file_id", "node").agg(F.min("root").alias("root"))
    text = lambda key: latin1(string_bytes(value_of(_E, key)))
    nodes = found.filter("entries IS NOT NULL AND stream IS NULL").join(acro.select("file_id"), "file_id", "left_semi").select("file_id", F.col("object_id").alias("node"), "entries", text("T").alias("partial"), value_of(_E, "Kids").alias("_kids"))
    order = preorder(nodes.join(first, ["file_id", "node"], "left").select("file_id", "node", "root", F.when(F.col("_kids").startswith("["), listed_refs("_kids")).alias("kids"), "partial"), path="partial")
    kind = name_of(_E, "FT")
    known = F.when(kind.isin("Tx", "Btn", "Ch", "Sig"), kind).otherwise("Unknown")
    leaves = order.withColumnRenamed("path", "full_name").join(nodes.filter("_kids IS NULL OR NOT startswith(_kids, '[')"), ["file_id", "node"])
    return leaves.select(
        "file_id", F.col("place").alias("ordinal"), F.col("node").alias("object_id"), F.when(F.coalesce("partial", F.lit("")) != "", F.col("partial")).otherwise(F.col("full_name")).alias("name"), "full_name", known.alias("field_type"),
        F.nullif(text("V"), F.lit("")).alias("value"), ((known == "Sig") & F.coalesce(ref_id(value_of(_E, "V")).isNotNull(), F.lit(False))).alias("signed"),
    )


def form_counts(fields: DataFrame) -> DataFrame:
    """``file_id, form_fields, signatures``."""
    return fields.groupBy("file_id").agg(F.count(F.lit(1)).alias("form_fields"), F.count_if(F.col("signed")).alias("signatures"))


def file_flags(found: DataFrame, tree: DataFrame) -> DataFrame:
    """``file_id, tagged, acro_form, xfa, javascript``: whether what the catalog names is there, and what it holds."""
    def held(key: str) -> DataFrame:
        target = found.select("file_id", F.col("object_id").alias(key), F.coalesce("entries", entries(F.lit("<<>>"))).alias(f"_{key}"))
        return tree.select("file_id", key).join(target, ["file_id", key]).select("file_id", f"_{key}")

    rows = tree.select("file_id")
    for key in ("structtreeroot", "acroform", "names"):
        rows = rows.join(held(key), "file_id", "left")
    return rows.select(
        "file_id", F.col("_structtreeroot").isNotNull().alias("tagged"), F.col("_acroform").isNotNull().alias("acro_form"),
        F.coalesce(F.map_contains_key("_acroform", "XFA"), F.lit(False)).alias("xfa"), F.coalesce(F.map_contains_key("_names", "JavaScript"), F.lit(False)).alias("javascript"),
    )
