"""PDF files rendered from the driver's tables, so that SQL on the tables says what the engine must find."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions.udfs import arrow_udf, portions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pdf(body: Column) -> Column:
    """Bytes of a file with ``body`` (Latin-1 text of objects, tables and trailers) between header and end."""
    return F.encode(F.concat(F.lit("%PDF-1.7\n"), body, F.lit("\nstartxref\n9\n%%EOF\n")), "ISO-8859-1")


def one_object(number: Column | int, body: Column | str) -> Column:
    number = F.lit(number) if isinstance(number, int) else number
    body = F.lit(body) if isinstance(body, str) else body
    return F.concat(number.cast("string"), F.lit(" 0 obj\n"), body, F.lit("\nendobj\n"))


def stream_object(number: int, dictionary: Column | str, data: Column) -> Column:
    dictionary = F.lit(dictionary) if isinstance(dictionary, str) else dictionary
    return one_object(number, F.concat(F.lit("<< "), dictionary, F.lit(" /Length "), F.length(data).cast("string"), F.lit(" >>\nstream\n"), data, F.lit("\nendstream")))


def text_files(docs: DataFrame) -> DataFrame:
    """One page a document, one ``Tj`` a line."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-8")), F.lit("> Tj")))
    content = F.concat(F.lit("BT /F1 12 Tf\n"), F.array_join(lines, "\nT*\n"), F.lit("\nET"))
    body = F.concat(
        one_object(1, "<< /Type /Catalog /Pages 2 0 R >>"),
        one_object(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>"),
        one_object(3, "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources 9 0 R >>"),
        stream_object(4, "", content),
        one_object(5, "<< /Type /Font /Subtype /Type1 >>"),
    )
    return docs.select(F.col("doc_id").cast("string").alias("file_id"), pdf(body).alias("content"))


def encoded_one(text: str | None, way: int) -> str:
    """A text's bytes as they are, Flate, ASCIIHex or Flate in ASCII85, as Latin-1 characters."""
    b = (text or "").encode()
    b = zlib.compress(b) if way in (1, 3) else b.hex().encode() + b">" if way == 2 else b
    return (base64.a85encode(b) + b"~>" if way == 3 else b).decode("latin-1")


@arrow_udf("string")
def _encoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield from portions(encoded_one, *columns)


def filter_files(docs: DataFrame) -> DataFrame:
    """The text as one stream: plain, Flate, ASCIIHex or Flate in ASCII85, by id."""
    way = F.pmod("doc_id", F.lit(4)).cast("int")
    names = F.element_at(F.array(*map(F.lit, ("", "/Filter /FlateDecode", "/Filter /ASCIIHexDecode", "/Filter [/ASCII85Decode /FlateDecode]"))), way + 1)
    return docs.select(F.col("doc_id").cast("string").alias("file_id"), pdf(stream_object(1, names, _encoded("text", way))).alias("content"))


def operator_pages(events: DataFrame, block: int | None = None) -> DataFrame:
    """``file_id, page_number, content``: an operator an event; a page a user, or one for each ``block`` of event ids of a user."""
    op = F.expr("CASE event_type WHEN 'view' THEN 'q' WHEN 'click' THEN 'Q' WHEN 'purchase' THEN 'BT' WHEN 'error' THEN 'ET' ELSE cast(event_id AS string) || ' w' END")
    ops = F.array_sort(F.collect_list(F.struct("event_id", op.alias("op"))))
    page = F.floor(F.col("event_id") / block) + 1 if block else F.lit(1)
    return events.groupBy(F.col("user_id").cast("string").alias("file_id"), page.alias("page_number")).agg(ops.alias("ops")).select("file_id", "page_number", F.encode(F.array_join("ops.op", "\n"), "ISO-8859-1").alias("content"))


def revision_files(orders: DataFrame) -> DataFrame:
    """``f-n``, a file for each of 50 groups of customers and 200 objects; a revision an order year, which defines the object once for each order."""
    number, year = F.col("o_orderkey") % 200 + 10, F.year("o_orderdate")
    text = one_object(F.col("n"), F.concat(F.lit("<< /Key "), F.col("k").cast("string"), F.lit(" >>")))
    rows = orders.select((F.col("o_custkey") % 50).alias("f"), year.alias("y"), number.alias("n"), F.col("o_orderkey").alias("k"))
    parts = F.array_sort(F.collect_list(F.struct("y", "k", text.alias("t"))))
    return rows.groupBy(F.concat_ws("-", "f", "n").alias("file_id")).agg(parts.alias("p")).select("file_id", pdf(F.array_join("p.t", "")).alias("content"))


def page_tree_files(region: DataFrame, nation: DataFrame, supplier: DataFrame, block: int = 10_000) -> DataFrame:
    """``r-n-b``, a file a nation and block of supplier keys: the region sets MediaBox and Rotate, the nation overrides Rotate, suppliers are the pages."""
    r, n, s = F.col("r_regionkey") + 10, F.col("n_nationkey") + 100, F.col("s_suppkey") + 1000
    ref = lambda c: F.concat(c.cast("string"), F.lit(" 0 R"))
    text = one_object(s, F.when(F.col("s_acctbal") < 0, "<< /Type /Page /MediaBox [0 0 100 200] >>").otherwise("<< /Type /Page >>"))
    kids = supplier.groupBy(F.col("s_nationkey").alias("k"), F.floor(F.col("s_suppkey") / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct(s.alias("id"), text.alias("t")))).alias("p"))
    rows = kids.join(nation, kids.k == nation.n_nationkey).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    of_region = F.concat(F.lit("<< /Type /Pages /Rotate "), (F.col("r_regionkey") * 180).cast("string"), F.lit(" /MediaBox [0 0 "), (F.col("r_regionkey") + 500).cast("string"), F.lit(" 800] /Kids ["), ref(n), F.lit("] >>"))
    of_nation = F.concat(F.lit("<< /Type /Pages"), F.when(F.col("n_nationkey") % 3 == 0, " /Rotate 90").otherwise(""), F.lit(" /Kids ["), F.array_join(F.transform("p.id", ref), " "), F.lit("] >>"))
    body = F.concat(
        one_object(1, "<< /Type /Catalog /Pages 2 0 R >>"), one_object(2, F.concat(F.lit("<< /Type /Pages /Kids ["), ref(r), F.lit("] >>"))), one_object(r, of_region), one_object(n, of_nation), F.array_join("p.t", "")
    )
    return rows.select(F.concat_ws("-", "r_regionkey", "n_nationkey", "b").alias("file_id"), pdf(body).alias("content"))


def damaged_files(labels: DataFrame) -> DataFrame:
    """Small files without header, startxref or end marker, by id."""
    head, body = "%PDF-1.4\n", "1 0 obj\n<< /Type /Catalog >>\nendobj\n"
    kinds = [head + body + "startxref\n9\n%%EOF\n", body + "startxref\n9\n%%EOF\n", head + body + "%%EOF\n", head + body + "startxref\n9\n"]
    text = F.element_at(F.array(*map(F.lit, kinds)), F.pmod("doc_id", F.lit(4)).cast("int") + 1)
    return labels.select("doc_id").distinct().select(F.col("doc_id").cast("string").alias("file_id"), F.encode(text, "ISO-8859-1").alias("content"))


def xref_files(customer: DataFrame, block: int = 10_000) -> DataFrame:
    """``n-b``, a table a nation and block of customer keys that goes on counting where the block before ends: one entry a customer, free where the balance is negative."""
    row = F.concat(F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit(" 00000 "), F.when(F.col("c_acctbal") < 0, "f").otherwise("n"), F.lit(" "))
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row"))))
    keys = [F.col("c_nationkey").alias("n"), F.floor(F.col("c_custkey") / block).alias("b")]
    earlier = W.partitionBy("n").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    first = customer.groupBy(*keys).count().select("n", "b", (F.coalesce(F.sum("count").over(earlier), F.lit(0)) + 5).alias("first"))
    body = F.concat(F.lit("xref\n"), F.col("first").cast("string"), F.lit(" "), F.size("r").cast("string"), F.lit("\n"), F.array_join("r.row", "\n"), F.lit("\ntrailer\n<< /Size 1 >>"))
    return customer.groupBy(*keys).agg(rows.alias("r")).join(first, ["n", "b"]).select(F.concat_ws("-", "n", "b").alias("file_id"), pdf(body).alias("content"))
