"""The document tree, the page tree with what pages inherit, and the contents of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions import latin1, rotation
from quirelake.functions.syntax import entries, int_value, items, ref_id, string_bytes
from quirelake.functions.values import listed_refs

from .objects import decoded, name_of, rect_of, ref_of, refs_of, value_of
from .trees import preorder

_E = "entries"
_INHERITED = ("_media", "_crop", "_rotate", "_resources")
_ROOTS = ("Pages", "Metadata", "Outlines", "AcroForm", "StructTreeRoot", "Names")


def document_tree(found: DataFrame, trailers: DataFrame | None = None) -> DataFrame:
    """``file_id, catalog, pages, metadata, outlines, acroform, structtreeroot, names, info`` of each file.

    The catalog is the ``Root`` of ``trailers(file_id, entries)``, the newest
    trailer of each file; without trailers it is the last catalog in the file.
    """
    named = [ref_of(_E, k).alias(k.lower()) for k in _ROOTS]
    catalogs = found.filter(name_of(_E, "Type") == "Catalog")
    if trailers is None:
        last = W.partitionBy("file_id").orderBy(F.col("start").desc())
        rows = catalogs.withColumn("_k", F.row_number().over(last)).filter("_k = 1")
        return rows.select("file_id", F.col("object_id").alias("catalog"), *named, F.lit(None).cast("string").alias("info"))
    roots = trailers.select("file_id", ref_of(_E, "Root").alias("catalog"), ref_of(_E, "Info").alias("info")).filter("catalog IS NOT NULL")
    held = found.select("file_id", F.col("object_id").alias("catalog"), "entries")
    rows = roots.join(held, ["file_id", "catalog"], "left").select("file_id", "catalog", *named, "info")
    return rows.withColumn("pages", F.coalesce("pages", "catalog"))


def pages(found: DataFrame, trailers: DataFrame | None = None) -> DataFrame:
    """``file_id, page_number, object_id``, boxes, ``rotation, user_unit, resources, resource_dict, contents, annotations`` of each page.

    ``resources`` is the reference and ``resource_dict`` the text of a
    dictionary in place; either comes from the nearest node that has one, and
    hides the other one from further up. MediaBox defaults to four zeros. Pages
    are numbered from 1 in document order; only nodes of type Pages have kids.
    """
    tree = document_tree(found, trailers).select("file_id", F.col("pages").alias("node"), F.lit(0).alias("root"))
    nodes = found.select("file_id", F.col("object_id").alias("node"), "entries", name_of(_E, "Type").alias("type")).filter(F.col("type").isin("Page", "Pages"))
    shaped = nodes.join(tree, ["file_id", "node"], "left").select(
        "file_id", "node", "root", "type", F.when(F.col("type") == "Pages", refs_of(_E, "Kids")).alias("kids"),
        *[value_of(_E, k).alias(c) for k, c in zip(("MediaBox", "CropBox", "Rotate", "Resources"), _INHERITED, strict=True)],
    )
    order = preorder(shaped, _INHERITED)
    own = nodes.filter("type = 'Page'").select(
        "file_id", "node", *[rect_of(_E, k).alias(c) for k, c in (("BleedBox", "bleed_box"), ("TrimBox", "trim_box"), ("ArtBox", "art_box"))],
        refs_of(_E, "Contents").alias("contents"), refs_of(_E, "Annots").alias("annotations"),
    )
    number = F.row_number().over(W.partitionBy("file_id").orderBy("place"))
    given = F.create_map(*[x for c in _INHERITED for x in (F.lit(c), F.col(c))])
    return order.join(own, ["file_id", "node"]).select(
        "file_id", number.alias("page_number"), F.col("node").alias("object_id"), F.coalesce(rect_of(given, "_media"), F.array(*[F.lit(0.0)] * 4)).alias("media_box"), rect_of(given, "_crop").alias("crop_box"),
        "bleed_box", "trim_box", "art_box", rotation(F.coalesce(int_value(F.col("_rotate")), F.lit(0))).alias("rotation"), F.lit(1.0).alias("user_unit"),
        ref_id(F.col("_resources")).alias("resources"), F.when(F.col("_resources").startswith("<<"), F.col("_resources")).alias("resource_dict"), "contents", "annotations",
    )


def page_warnings(found: DataFrame) -> DataFrame:
    """``file_id, warning_id, severity, category``: kids of page-tree nodes that the file does not define."""
    kids = found.filter(name_of(_E, "Type") == "Pages").select("file_id", F.explode(refs_of(_E, "Kids")).alias("object_id")).distinct()
    missing = kids.join(found.select("file_id", "object_id"), ["file_id", "object_id"], "left_anti")
    return missing.select("file_id", F.concat(F.lit("warn:pages-missing:"), "object_id").alias("warning_id"), F.lit("warn").alias("severity"), F.lit("structure").alias("category"))


def _content_parts(found: DataFrame, of_pages: DataFrame) -> DataFrame:
    """A row for each content stream of a page, in order; a reference to an array stands for its items."""
    listed = found.filter(F.col("dictionary").startswith("[")).select("file_id", F.col("object_id").alias("_ref"), listed_refs("dictionary").alias("_refs"))
    refs = of_pages.select("file_id", "page_number", F.posexplode("contents").alias("_at", "_ref")).join(listed, ["file_id", "_ref"], "left")
    flat = refs.select("file_id", "page_number", "_at", F.posexplode(F.coalesce("_refs", F.array("_ref"))).alias("_in", "object_id"))
    held = found.select("file_id", "object_id", "entries", "stream", F.lit(True).alias("_known"))
    return decoded(flat.join(held, ["file_id", "object_id"], "left"))


def page_contents(found: DataFrame, of_pages: DataFrame) -> DataFrame:
    """``file_id, page_number, content, parts``: decoded content streams of each page, joined by a line end.

    Streams that are missing or cannot be decoded are left out;
    ``content_warnings`` names them. A page without streams has empty content.
    """
    parts = _content_parts(found, of_pages).filter("decoded IS NOT NULL").groupBy("file_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("_at", "_in", "decoded"))).alias("_p"))
    whole = F.encode(F.array_join(F.transform("_p", lambda x: latin1(x.decoded)), "\n"), "ISO-8859-1")
    joined = of_pages.select("file_id", "page_number").join(parts, ["file_id", "page_number"], "left")
    return joined.select("file_id", "page_number", F.coalesce(whole, F.lit(b"")).alias("content"), F.coalesce(F.size("_p"), F.lit(0)).alias("parts"))


def content_warnings(found: DataFrame, of_pages: DataFrame) -> DataFrame:
    """``file_id, warning_id, severity, category`` of content streams that are missing, no streams or not decoded."""
    rows = _content_parts(found, of_pages)
    problem = F.when(F.col("_known").isNull(), "contents-missing").when(F.col("stream").isNull(), "contents-not-stream").when(F.col("decoded").isNull(), "contents-decode")
    named = rows.select("file_id", "object_id", problem.alias("_p")).filter("_p IS NOT NULL").distinct()
    return named.select("file_id", F.concat_ws(":", F.lit("warn"), "_p", "object_id").alias("warning_id"), F.lit("warn").alias("severity"), F.when(F.col("_p") == "contents-decode", "stream").otherwise("structure").alias("category"))


def embedded_files(found: DataFrame, tree: DataFrame) -> DataFrame:
    """``file_id, ordinal, name, object_id``: pairs of the name tree of embedded files, without its kids."""
    held = found.select("file_id", F.col("object_id").alias("_id"), "entries")
    names = tree.select("file_id", F.col("names").alias("_id")).join(held, ["file_id", "_id"]).select("file_id", value_of(_E, "EmbeddedFiles").alias("_v"))
    by_ref = names.select("file_id", ref_id(F.col("_v")).alias("_id"), "_v").join(held, ["file_id", "_id"], "left")
    listed = by_ref.select("file_id", items(value_of(F.coalesce("entries", entries("_v")), "Names")).alias("_n"))
    pairs = listed.filter(F.size("_n") >= 2).select("file_id", "_n", F.explode(F.sequence(F.lit(0), F.size("_n") - 2, F.lit(2))).alias("_at"))
    read = pairs.select("file_id", (F.col("_at") / 2).cast("int").alias("ordinal"), latin1(string_bytes(F.col("_n")[F.col("_at")])).alias("name"), ref_id(F.col("_n")[F.col("_at") + 1]).alias("object_id"))
    return read.filter("name <> '' AND object_id IS NOT NULL")


def page_step(number: int, step: int, count: int) -> int:
    """The page ``step`` pages on from ``number``, held within 1 and ``count``."""
    return max(1, min(number + step, count))
