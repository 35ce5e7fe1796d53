"""The logical structure: elements in reading order, their marked content, and where it stands on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions import latin1
from quirelake.functions.syntax import entries, int_value, items, ref_id, string_bytes
from quirelake.functions.values import inner_elements

from .objects import name_of, ref_of, value_of
from .trees import preorder

_E = "entries"


def _elements(found: DataFrame) -> DataFrame:
    """``file_id, object_id, entries`` of objects and of the dictionaries that stand in place below their ``/K``, which have the id of the object with their path."""
    inner = found.filter(value_of(_E, "K").isNotNull()).select("file_id", "object_id", F.explode(inner_elements("dictionary")).alias("_i"))
    return found.select("file_id", "object_id", "entries").unionByName(inner.select("file_id", F.concat("object_id", "_i.path").alias("object_id"), entries("_i.text").alias("entries")))


def _kids(found: DataFrame) -> DataFrame:
    """``file_id, node, ordinal, value, target, inner``: what stands under ``/K`` of ``_elements``; ``inner`` are the entries of an item, in place or behind its reference."""
    k = value_of(_E, "K")
    rows = found.filter(k.isNotNull()).select("file_id", F.col("object_id").alias("node"), k.startswith("[").alias("_many"), F.posexplode(F.coalesce(items(k), F.array(k))).alias("ordinal", "value"))
    in_place = F.when(F.col("value").startswith("<<"), F.concat("node", F.lit("/K"), F.when(F.col("_many"), F.concat(F.lit("/"), F.col("ordinal").cast("string"))).otherwise("")))
    held = found.select("file_id", F.col("object_id").alias("target"), F.col("entries").alias("inner"))
    return rows.withColumn("target", F.coalesce(ref_id(F.col("value")), in_place)).join(held, ["file_id", "target"], "left").select("file_id", "node", "ordinal", "value", "target", "inner")


def struct_children(found: DataFrame) -> DataFrame:
    """``file_id, node, ordinal, kind, mcid, target, page``: marked content and objects under structure elements.

    A number is a marked-content id; an MCR needs one, an OBJR an object, else
    they are left out.
    """
    rows = _kids(_elements(found))
    kind, page = name_of(F.col("inner"), "Type"), ref_of(F.col("inner"), "Pg")
    number = int_value(F.col("value"))
    shaped = rows.select(
        "file_id", "node", "ordinal", F.when(number.isNotNull() | (kind == "MCR"), "mcid").when(kind == "OBJR", "objr").alias("kind"),
        F.coalesce(number, F.when(kind == "MCR", int_value(value_of(F.col("inner"), "MCID")))).alias("mcid"), F.when(kind == "OBJR", ref_of(F.col("inner"), "Obj")).alias("target"), F.when(number.isNull(), page).alias("page"),
    )
    return shaped.filter("kind = 'mcid' AND mcid IS NOT NULL OR kind = 'objr' AND target IS NOT NULL")


def struct_nodes(found: DataFrame, tree: DataFrame) -> DataFrame:
    """``file_id, node_id, object_id, parent, place, depth, type, title, alt, lang, actual_text`` in reading order.

    If the root has a single element, that is the first node; else a
    ``Document`` node stands for the root itself. Elements without a type are
    of type ``Span``, the first node ``Document``. An element written in place
    within another one has that one's id with its path, as ``obj:6:0/K/1``.
    """
    found = _elements(found)
    kids = _kids(found).filter(F.col("target").isNotNull() & (~F.coalesce(name_of(F.col("inner"), "Type"), F.lit("")).isin("MCR", "OBJR")))
    listed = kids.groupBy("file_id", "node").agg(F.array_sort(F.collect_list(F.struct("ordinal", "target"))).alias("_k")).select("file_id", "node", F.col("_k.target").alias("kids"))
    counted = found.withColumn("_k", value_of(_E, "K")).select("file_id", F.col("object_id").alias("node"), "entries", F.coalesce(F.size(items("_k")), F.when(F.col("_k").isNotNull(), 1)).alias("_n"))
    of_root = tree.select("file_id", F.col("structtreeroot").alias("node")).join(counted, ["file_id", "node"]).join(listed, ["file_id", "node"], "left").filter("_n > 0")
    single = (F.col("_n") == 1) & (F.size("kids") == 1)
    first = of_root.select("file_id", F.when(single, F.col("kids")[0]).otherwise(F.col("node")).alias("node"), F.lit(0).alias("root"))
    nodes = counted.filter("entries IS NOT NULL").join(of_root.select("file_id"), "file_id", "left_semi").join(listed, ["file_id", "node"], "left").join(first, ["file_id", "node"], "left")
    order = preorder(nodes)
    text = lambda key: latin1(string_bytes(value_of(_E, key)))
    rows = order.join(counted.select("file_id", "node", "entries"), ["file_id", "node"])
    return rows.select(
        "file_id", F.concat(F.lit("struct:"), "node").alias("node_id"), F.col("node").alias("object_id"), "parent", "place", "depth", F.coalesce(name_of(_E, "S"), F.when(F.col("depth") == 0, "Document").otherwise("Span")).alias("type"),
        text("T").alias("title"), text("Alt").alias("alt"), text("Lang").alias("lang"), text("ActualText").alias("actual_text"),
    )


def struct_rows(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """``file_id, row, depth, kind, label, mcid``: the structure as an indented list, marked content below its element."""
    elements = nodes.select("file_id", "object_id", "place", F.lit(-1).alias("ordinal"), "depth", F.lit("elem").alias("kind"), F.col("type").alias("label"), F.lit(None).cast("long").alias("mcid"))
    below = children.join(nodes.select("file_id", F.col("object_id").alias("node"), "place", "depth"), ["file_id", "node"])
    leaves = below.select("file_id", F.col("node").alias("object_id"), "place", "ordinal", (F.col("depth") + 1).alias("depth"), "kind", F.coalesce(F.concat(F.lit("mcid:"), "mcid"), "target").alias("label"), "mcid")
    row = F.row_number().over(W.partitionBy("file_id").orderBy("place", "ordinal")) - 1
    return elements.unionByName(leaves).select("file_id", row.alias("row"), "object_id", "depth", "kind", "label", "mcid")


def first_operations(marked: DataFrame) -> DataFrame:
    """``file_id, page_number, mcid, op_id``: the first operation within each marked-content id of a page."""
    return marked.filter("mcid IS NOT NULL").groupBy("file_id", "page_number", "mcid").agg(F.min_by("op_id", "sequence").alias("op_id"))


def located(children: DataFrame, of_pages: DataFrame) -> DataFrame:
    """``children`` with the ``page_number`` that their page reference stands for."""
    return children.join(of_pages.select("file_id", F.col("object_id").alias("page"), "page_number"), ["file_id", "page"], "left")
