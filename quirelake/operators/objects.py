"""Objects, references and streams of PDF files, as DataFrames.

Input is ``files(file_id, content)``. A pass over the bytes finds where objects
lie; everything else is projections and joins of their rows. Damaged files give
fewer rows, or null values, and never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions import latin1, object_id
from quirelake.functions.filters import decode_stream
from quirelake.functions.scan import object_places
from quirelake.functions.syntax import entries, int_value, items, name_value, number_value, ref_id
from quirelake.functions.values import listed_refs, refs_within, value_rows

#: Object kinds by /Type.
KINDS = {
    "Catalog": "catalog", "Pages": "pages", "Page": "page", "Font": "font", "FontDescriptor": "fontDescriptor", "Encoding": "encoding", "ExtGState": "extGState",
    "Pattern": "pattern", "Shading": "shading", "Annot": "annot", "StructTreeRoot": "structTreeRoot", "StructElem": "structElem", "Metadata": "metadata",
    "EmbeddedFile": "embeddedFile", "Outlines": "outlines", "Filespec": "embeddedFile", "Filespecifier": "embeddedFile", "XRef": "xrefStream", "ObjStm": "objectStream",
}
#: Kinds of XObjects by /Subtype.
XOBJECT_KINDS = {"Image": "xobjectImage", "Form": "xobjectForm"}
#: Short names of stream filters.
SHORT_FILTERS = {"A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "Fl": "FlateDecode", "LZW": "LZWDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode", "RL": "RunLengthDecode"}

_NAME = r"^/([^\x00\t\n\x0c\r ()<>\[\]{}/%]+)"


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def value_of(found: Column, key: str) -> Column:
    """The text under ``key`` of an entries map, or null."""
    return F.try_element_at(found, F.lit(key))


def name_of(found: Column, key: str) -> Column:
    return name_value(value_of(found, key))


def ref_of(found: Column, key: str) -> Column:
    return ref_id(value_of(found, key))


def number_of(found: Column, key: str) -> Column:
    return number_value(value_of(found, key))


def int_of(found: Column, key: str) -> Column:
    return int_value(value_of(found, key))


def refs_of(found: Column, key: str) -> Column:
    """The object ids under ``key`` (one reference, or an array of them without what nests in it), in order."""
    return listed_refs(value_of(found, key))


def numbers_of(found: Column, key: str) -> Column:
    """The numbers of the array under ``key`` as doubles, or null."""
    text = value_of(found, key)
    listed = F.filter(F.split(F.regexp_replace(text, r"[\[\]\x00\t\n\x0c\r ]+", " "), " "), lambda x: x != "")
    return F.when(text.startswith("["), F.filter(F.transform(listed, number_value), lambda x: x.isNotNull()))


def rect_of(found: Column, key: str) -> Column:
    """The first four numbers under ``key``, or null where there are fewer."""
    n = numbers_of(found, key)
    return F.when(F.size(n) >= 4, F.slice(n, 1, 4))


def definitions(files: DataFrame) -> DataFrame:
    """Every object definition: ``file_id, ordinal, start, end, number, generation, object_id, closed, broken, newest, clear, dictionary, entries, stream``.

    ``stream`` holds raw bytes, null for objects without one; ``dictionary`` is
    the text of the value, ``entries`` its keys if it is a dictionary; ``closed``
    tells whether ``endobj`` follows, ``broken`` whether the value or the stream
    has no end of its own, ``clear`` from which places only blanks and comments
    lead to the header. Bytes are cut out inside a file's row, so
    no copy of a file is made for each of its objects.
    """
    places = object_places("content")
    data = lambda o: F.when(o.stream_start >= 0, F.substring("content", (o.stream_start + 1).cast("int"), (o.stream_end - o.stream_start).cast("int")))
    cut_out = F.transform("_places", lambda o: F.struct(o.number.alias("number"), o.generation.alias("generation"), o.start.alias("start"), o.end.alias("end"), o.value.alias("dictionary"), o.closed.alias("closed"), o.broken.alias("broken"), o.newest.alias("newest"), o.clear.alias("clear"), data(o).alias("stream")))
    rows = files.select("file_id", "content", places.alias("_places")).select("file_id", F.posexplode(cut_out).alias("ordinal", "o")).select("file_id", "ordinal", "o.*")
    return rows.withColumns({"object_id": object_id(F.col("number"), F.col("generation")), "entries": entries("dictionary")})


def newest(rows: DataFrame, keys: tuple[str, ...] = ("file_id", "number"), order: str = "ordinal") -> DataFrame:
    """Of the rows of a key the last one: a later revision replaces an earlier one."""
    last = W.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank")


def classified(found: DataFrame) -> DataFrame:
    """``found`` with ``kind`` and ``hint``, which the entries and the presence of a stream decide."""
    kind, subtype = name_of(F.col("entries"), "Type"), name_of(F.col("entries"), "Subtype")
    streamed = F.col("stream").isNotNull()
    of_type = F.coalesce(lookup(KINDS, kind), F.when(kind == "XObject", F.coalesce(lookup(XOBJECT_KINDS, subtype), F.lit("other"))))
    return found.withColumn("kind", F.coalesce(of_type, F.when(streamed, "contentStream").otherwise("other"))).withColumn(
        "hint", F.when(subtype.isNotNull(), F.concat(F.coalesce(kind, F.lit("Stream")), F.lit(" / "), subtype)).otherwise(kind)
    )


def objects(files: DataFrame) -> DataFrame:
    """The newest definition of each object with ``kind`` and ``hint``, by a scan of the bytes.

    This is what a file without a usable cross-reference table holds;
    ``xref.live_objects`` goes by the tables where they can be read.
    """
    return classified(definitions(files).filter("newest"))


def find_objects(found: DataFrame, query: str) -> DataFrame:
    """Objects whose id, kind, hint or number contains ``query`` (lower-cased), by number and generation."""
    q = F.lit(query.lower())
    fits = F.contains("object_id", q) | F.contains("kind", q) | F.coalesce(F.contains(F.lower("hint"), q), F.lit(False)) | F.contains(F.col("number").cast("string"), q)
    return found.filter(fits).orderBy("file_id", "number", "generation")


def object_window(found: DataFrame, first: int, rows: int, overscan: int = 8) -> DataFrame:
    """The objects of each file in the viewport that starts at row ``first`` (from 0), with ``overscan`` rows around it."""
    place = F.row_number().over(W.partitionBy("file_id").orderBy("number", "generation")) - 1
    return found.withColumn("row", place).filter(F.col("row").between(max(0, first - overscan), first + rows + overscan - 1))


def object_detail(files: DataFrame, limit: int = 2048) -> DataFrame:
    """``objects`` with ``raw_text``: up to ``limit`` bytes of the definition as Latin-1, with a line of dots where it goes on.

    The texts of a file are cut out of its row together, so no copy of a file
    is made for each of its objects.
    """
    found = objects(files)
    spans = found.groupBy("file_id").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))

    def raw(o: Column) -> Column:
        n = o["end"] - o["start"]
        text = latin1(F.substring("content", (o["start"] + 1).cast("int"), F.least(n, F.lit(limit)).cast("int")))
        return F.struct(o["start"].alias("start"), F.when(n > limit, F.concat(text, F.lit("\n…"))).otherwise(text).alias("raw_text"))

    texts = files.select("file_id", "content").join(spans, "file_id").select("file_id", F.explode(F.transform("_spans", raw)).alias("_t")).select("file_id", "_t.*")
    return found.join(texts, ["file_id", "start"])


def nested_values(found: DataFrame) -> DataFrame:
    """``file_id, object_id, ordinal, path, kind, value``: the values of objects and all that nests in them, in order."""
    rows = found.select("file_id", "object_id", F.posexplode(value_rows("dictionary")).alias("ordinal", "v"))
    return rows.select("file_id", "object_id", "ordinal", "v.path", "v.kind", "v.value")


def edges(found: DataFrame) -> DataFrame:
    """``file_id, src_id, ordinal, dst_id``: references in an object's value, in order."""
    return found.select("file_id", F.col("object_id").alias("src_id"), F.posexplode(refs_within("dictionary")).alias("ordinal", "dst_id"))


def missing_references(found: DataFrame) -> DataFrame:
    """Edges to objects that the file does not define."""
    known = found.select("file_id", F.col("object_id").alias("dst_id"))
    return edges(found).join(known, ["file_id", "dst_id"], "left_anti")


def filters_of(found: Column) -> Column:
    """Names of the stream filters in order, short names written out."""
    listed = value_of(found, "Filter")
    names = F.when(listed.startswith("/"), F.array(name_value(listed))).when(listed.startswith("["), F.transform(F.regexp_extract_all(listed, F.lit(r"/[^\x00\t\n\x0c\r ()<>\[\]{}/%]+"), 0), name_value))
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.coalesce(lookup(SHORT_FILTERS, x), x))


def decoded(found: DataFrame) -> DataFrame:
    """``found`` with ``filters, decoded, error``; parameters are aligned to the filters, ``/DP`` stands in for ``/DecodeParms``."""
    parms = F.coalesce(value_of(F.col("entries"), "DecodeParms"), value_of(F.col("entries"), "DP"))
    listed = found.withColumn("filters", filters_of(F.col("entries"))).withColumn("_parms", F.when(parms.startswith("["), items(parms)).otherwise(F.array(parms)))
    done = listed.withColumn("_d", decode_stream("stream", "filters", "_parms"))
    return done.withColumns({"decoded": F.col("_d.bytes"), "error": F.col("_d.error")}).drop("_d", "_parms")


def streams(found: DataFrame) -> DataFrame:
    """``file_id, object_id, filters, raw, decoded, error`` of the objects that have a stream."""
    return decoded(found.filter("stream IS NOT NULL")).select("file_id", "object_id", "filters", F.col("stream").alias("raw"), "decoded", "error")


def stream_by_id(found: DataFrame, file_id: str, object_id: str) -> DataFrame:
    """The stream of one object, or a row whose ``error`` says that it is missing or has none."""
    wanted = found.sparkSession.createDataFrame([(file_id, object_id)], "file_id string, object_id string")
    rows = decoded(wanted.join(found.select("file_id", "object_id", "entries", "stream", F.lit(True).alias("_known")), ["file_id", "object_id"], "left"))
    missing = F.when(F.col("_known").isNull(), "object not found").when(F.col("stream").isNull(), "not a stream")
    return rows.select("file_id", "object_id", "filters", F.col("stream").alias("raw"), "decoded", F.coalesce(missing, "error").alias("error"))


#: Labels of object kinds.
CHIPS = {
    "catalog": "Catalog", "pages": "Pages", "page": "Page", "font": "Font", "fontDescriptor": "FontDesc", "encoding": "Enc", "xobjectImage": "Image", "xobjectForm": "Form",
    "extGState": "ExtGS", "colorSpace": "ColorSp", "pattern": "Pattern", "shading": "Shading", "annot": "Annot", "structTreeRoot": "StructTree", "structElem": "StructEl",
    "metadata": "Meta", "embeddedFile": "File", "outlines": "Outline", "acroForm": "AcroForm", "signature": "Sig", "contentStream": "ContentStm", "objectStream": "ObjStm",
    "xrefStream": "XRefStm", "resources": "Resources",
}


def kind_chip(kind: Column) -> Column:
    return F.coalesce(lookup(CHIPS, kind), F.lit("Obj"))
