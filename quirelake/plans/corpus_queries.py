"""Queries over rendered files with tables, object streams, forms, structures, fonts and damage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions import latin1
from quirelake.functions.syntax import string_bytes
from quirelake.functions.text import encoded_text
from quirelake.operators.content import explained, marked_content, operations, tokens_of
from quirelake.operators.files import all_warnings
from quirelake.operators.forms import form_counts, form_fields
from quirelake.operators.objects import decoded, edges, int_of, object_window, objects
from quirelake.operators.pages import content_warnings, document_tree, page_contents, page_warnings, pages
from quirelake.operators.resources import drawn_xobjects, fonts, missing_xobjects, page_resources, xobjects
from quirelake.operators.structure import first_operations, located, struct_children, struct_nodes
from quirelake.operators.text import cmaps, shown_strings, string_texts, text_runs
from quirelake.operators.xref import Structure
from quirelake.session import checkpointed

from . import corpora as fc
from . import fixtures as fx


def _part(name: str, at: int):
    return F.split_part(F.col(name), F.lit("-"), F.lit(at))


def xref_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = Structure(fc.chained_files(fx.table(spark, sf_dir, "orders")).persist()).live_objects().filter("number > 1")
    return live.select(_part("file_id", 1).cast("long").alias("file"), _part("file_id", 2).cast("long").alias("block"), "number", int_of("entries", "Key").alias("order_key"))


def xref_free_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Structure(fc.chained_files(fx.table(spark, sf_dir, "orders")).persist()).newest_entries().filter("type = 'f'")
    return newest.groupBy(_part("file_id", 1).cast("long").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def xref_revision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = Structure(fc.chained_files(fx.table(spark, sf_dir, "orders")).persist()).bodies()
    return bodies.groupBy("file_id").agg((F.count(F.lit(1)) - 1).alias("updates"))


def objstm_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = Structure(fc.packed_files(fx.table(spark, sf_dir, "part")).persist()).live_objects().filter("in_object_stream IS NOT NULL")
    return live.select(_part("file_id", 1).alias("brand"), int_of("entries", "Part").alias("part_key"), int_of("entries", "Size").alias("size"))


def objstm_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = Structure(fc.packed_files(fx.table(spark, sf_dir, "part")).persist()).skipped()
    return skipped.groupBy(_part("file_id", 1).alias("brand")).agg(F.sum("n").alias("n"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects(fc.form_files(fx.table(spark, sf_dir, "customer"))).persist()
    return form_fields(found, document_tree(found))


def form_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("object_id", r"obj:(\d+):", 1).cast("long") - 1000
    return _fields(spark, sf_dir).select(_part("file_id", 1).cast("long").alias("nation"), number.alias("cust_key"), "full_name", "field_type", "value", "signed")


def form_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = form_counts(_fields(spark, sf_dir))
    return counts.groupBy(_part("file_id", 1).cast("long").alias("nation")).agg(F.sum("form_fields").alias("form_fields"), F.sum("signatures").alias("signatures"))


def _conversation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    found = objects(fc.conversation_files(fx.table(spark, sf_dir, "conversations"))).persist()
    tree = document_tree(found)
    return found, tree, pages(found).persist(), struct_nodes(found, tree)


def struct_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, nodes = _conversation(spark, sf_dir)
    return nodes.groupBy("type", "depth").agg(F.count(F.lit(1)).alias("n"))


def mcid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, of_pages, nodes = _conversation(spark, sf_dir)
    marked = marked_content(checkpointed(operations(page_contents(found, of_pages))))
    shown = marked.filter("operator = 'Tj'").select("file_id", "page_number", "mcid", F.sha2(string_bytes(F.col("operands")[0]), 256).alias("text_sha256"))
    placed = located(struct_children(found), of_pages).filter("kind = 'mcid'").join(nodes.select("file_id", F.col("object_id").alias("node"), "type"), ["file_id", "node"])
    return placed.join(shown, ["file_id", "page_number", "mcid"]).select(F.col("file_id").cast("long").alias("conv_id"), F.col("mcid").alias("turn"), F.col("type").alias("role"), "text_sha256")


def mcid_first_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, of_pages, _ = _conversation(spark, sf_dir)
    first = first_operations(marked_content(checkpointed(operations(page_contents(found, of_pages)))))
    return first.select(F.col("file_id").cast("long").alias("conv_id"), F.col("mcid").alias("turn"), "op_id")


def _texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = objects(files).persist()
    of_pages = pages(found).persist()
    of_fonts = checkpointed(fonts(found, page_resources(found, of_pages)))
    strings = checkpointed(shown_strings(checkpointed(operations(page_contents(found, of_pages)))))
    return string_texts(strings, of_fonts, checkpointed(cmaps(found, of_fonts))), of_fonts


def cmap_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, _ = _texts(fc.mapped_files(fx.table(spark, sf_dir, "benchmark")))
    joined = texts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "sequence", "part", "text"))).alias("t"))
    return joined.select(F.col("file_id").cast("long").alias("item_id"), F.sha2(F.array_join("t.text", ""), 256).alias("text_sha256"))


def text_run_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, _ = _texts(fc.mapped_files(fx.table(spark, sf_dir, "benchmark")))
    return text_runs(texts).groupBy(F.col("file_id").cast("long").alias("item_id")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("width"), 3).alias("width"))


def fonts_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects(fc.mapped_files(fx.table(spark, sf_dir, "benchmark"))).persist()
    return fonts(found, page_resources(found, pages(found))).groupBy("name", "subtype", "base_font", "encoding", "embedded").agg(F.count(F.lit(1)).alias("n"))


def literal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects(fc.literal_files(fx.table(spark, sf_dir, "documents"))).persist()
    shown = operations(page_contents(found, pages(found))).filter("operator = chr(39)").select("file_id", "sequence", string_bytes(F.col("operands")[0]).alias("line"))
    lines = shown.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("sequence", "line"))).alias("l"))
    return lines.select(F.col("file_id").cast("long").alias("doc_id"), "n_lines", F.sha2(F.encode(F.array_join(F.transform("l.line", latin1), "\n"), "ISO-8859-1"), 256).alias("text_sha256"))


def page_content_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects(fc.literal_files(fx.table(spark, sf_dir, "documents"))).persist()
    return content_warnings(found, pages(found)).select(F.col("file_id").cast("long").alias("doc_id"), "warning_id", "severity")


def xobject_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects(fc.literal_files(fx.table(spark, sf_dir, "documents"))).persist()
    listed = xobjects(found, page_resources(found, pages(found)))
    return listed.groupBy("name", "subtype", "width", "height", "color_space", "bits").agg(F.count(F.lit(1)).alias("n"))


def resource_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects(fc.literal_files(fx.table(spark, sf_dir, "documents"))).persist()
    of_pages = pages(found)
    drawn = drawn_xobjects(operations(page_contents(found, of_pages)), xobjects(found, page_resources(found, of_pages)))
    return drawn.groupBy("name", "object_id").agg(F.count(F.lit(1)).alias("n"))


def do_missing_xobject(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects(fc.literal_files(fx.table(spark, sf_dir, "documents"))).persist()
    of_pages = pages(found)
    lost = missing_xobjects(operations(page_contents(found, of_pages)), xobjects(found, page_resources(found, of_pages)))
    return lost.select(F.col("file_id").cast("long").alias("doc_id"), "warning_id")


def object_kinds_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(fc.typed_files(fx.table(spark, sf_dir, "labels"))).groupBy("kind", "hint").agg(F.count(F.lit(1)).alias("n"))


def object_page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = object_window(objects(fc.typed_files(fx.table(spark, sf_dir, "labels"))), first=20, rows=10)
    return shown.select("file_id", F.col("row").cast("long").alias("row"), (F.col("number") - 1).alias("doc_id"))


def recovery_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    structure = Structure(fc.broken_files(fx.table(spark, sf_dir, "labels")).persist())
    counted = structure.live_objects().groupBy("file_id").agg(F.count(F.lit(1)).alias("objects"))
    return structure.recovery().join(counted, "file_id", "left").groupBy("recovery", "objects").agg(F.count(F.lit(1)).alias("n"))


def warning_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_warnings(fc.broken_files(fx.table(spark, sf_dir, "labels")).persist())
    name = F.regexp_extract("warning_id", r"^warn:([a-z-]+)", 1)
    return found.groupBy(name.alias("warning"), "severity", "category", "stage").agg(F.count(F.lit(1)).alias("n"))


def page_kids_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_warnings(objects(fc.broken_files(fx.table(spark, sf_dir, "labels"))).persist()).groupBy("warning_id").agg(F.count(F.lit(1)).alias("n"))


def op_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = explained(operations(fx.operator_pages(fx.table(spark, sf_dir, "events"), 10_000)))
    return said.select(F.col("file_id").cast("long").alias("user_id"), "explanation").groupBy("explanation").agg(F.count(F.lit(1)).alias("n"))


def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(fx.operator_pages(fx.table(spark, sf_dir, "events"), 10_000)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def encoding_winansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of a name in upper and lower case, with one byte of the upper half, in WinAnsi."""
    byte = F.expr("unhex(lpad(hex(160 + c_custkey % 96), 2, '0'))")
    rows = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_key"), F.encode(F.concat(F.col("c_name"), latin1(byte)), "ISO-8859-1").alias("raw"))
    return rows.select("cust_key", encoded_text(F.col("raw"), F.lit("WinAnsiEncoding")).alias("text"))


def stream_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decoded(objects(fx.filter_files(fx.table(spark, sf_dir, "documents"))).filter("stream IS NOT NULL"))
    return found.groupBy(F.array_join("filters", "+").alias("filters")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("decoded")).alias("bytes"))


def ref_edges_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects(fc.conversation_files(fx.table(spark, sf_dir, "conversations")))
    degree = edges(found).groupBy("file_id", "dst_id").agg(F.count(F.lit(1)).alias("degree"))
    return degree.filter("dst_id = 'obj:3:0'").select(F.col("file_id").cast("long").alias("conv_id"), "degree")


def struct_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, nodes = _conversation(spark, sf_dir)
    row = F.row_number().over(W.partitionBy("file_id").orderBy("place")) - 1
    return nodes.select(F.col("file_id").cast("long").alias("conv_id"), row.cast("long").alias("row"), F.col("depth").cast("long").alias("depth"), "type")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        xref_newest_wins, xref_free_objects, xref_revision_counts, objstm_claimed, objstm_skipped, form_field_values, form_signatures, struct_roles, struct_flatten, mcid_text, mcid_first_operations, cmap_decode, text_run_widths,
        fonts_embedded, literal_lines, page_content_missing, xobject_catalog, resource_usage, do_missing_xobject, object_kinds_all, object_page_window, recovery_modes, warning_rollup, page_kids_missing, op_explanations,
        token_histogram, encoding_winansi, stream_filters, ref_edges_degree,
    )
}

_LAST = """SELECT o_custkey % 50 AS file, o_orderkey // 100000 AS block, o_orderkey % 200 + 10 AS number,
  arg_max(o_orderkey, year(o_orderdate) * 1000000000 + o_orderkey) AS order_key, arg_max(o_orderstatus, year(o_orderdate) * 1000000000 + o_orderkey) AS status FROM orders GROUP BY ALL"""
_IDS = "(SELECT DISTINCT doc_id FROM labels)"
_TYPE_ROWS = ", ".join(
    f"({i}, '{kind}', {hint})"
    for i, (kind, hint) in enumerate(
        [
            ("catalog", "'Catalog'"), ("pages", "'Pages'"), ("page", "'Page'"), ("font", "'Font / Type1'"), ("fontDescriptor", "'FontDescriptor'"), ("encoding", "'Encoding'"), ("extGState", "'ExtGState'"), ("pattern", "'Pattern'"),
            ("shading", "'Shading'"), ("annot", "'Annot / Link'"), ("structTreeRoot", "'StructTreeRoot'"), ("structElem", "'StructElem'"), ("metadata", "'Metadata'"), ("embeddedFile", "'EmbeddedFile'"), ("outlines", "'Outlines'"),
            ("embeddedFile", "'Filespec'"), ("xobjectImage", "'XObject / Image'"), ("xobjectForm", "'XObject / Form'"), ("other", "'XObject / PS'"), ("other", "'Other'"), ("contentStream", "NULL"), ("other", "NULL"),
        ]
    )
)

ORACLE_SQL = {
    "xref_newest_wins": f"SELECT file, block, number, order_key FROM ({_LAST}) WHERE status <> 'F'",
    "xref_free_objects": f"SELECT file, count(*) AS n FROM ({_LAST}) WHERE status = 'F' GROUP BY file",
    "xref_revision_counts": "SELECT (o_custkey % 50) || '-' || (o_orderkey // 100000) AS file_id, count(DISTINCT year(o_orderdate)) AS updates FROM orders GROUP BY ALL",
    "objstm_claimed": "SELECT p_brand AS brand, p_partkey AS part_key, p_size::BIGINT AS size FROM part WHERE p_size % 7 <> 0",
    "objstm_skipped": "SELECT p_brand AS brand, count(*)::BIGINT AS n FROM part WHERE p_size % 7 = 0 GROUP BY 1",
    "form_field_values": """SELECT c_nationkey::BIGINT AS nation, c_custkey AS cust_key, c_mktsegment || '.' || c_name AS full_name, CASE WHEN c_acctbal < 0 THEN 'Sig' ELSE 'Tx' END AS field_type,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS value, c_acctbal < 0 AS signed FROM customer""",
    "form_signatures": "SELECT c_nationkey::BIGINT AS nation, count(*)::BIGINT AS form_fields, count(*) FILTER (c_acctbal < 0)::BIGINT AS signatures FROM customer GROUP BY 1",
    "struct_roles": "SELECT role AS type, 1 AS depth, count(*) AS n FROM conversations GROUP BY 1 UNION ALL SELECT 'Document', 0, count(DISTINCT conv_id) FROM conversations",
    "struct_flatten": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS "row", 1::BIGINT AS depth, role AS type FROM conversations UNION ALL SELECT DISTINCT conv_id, 0, 0, 'Document' FROM conversations""",
    "mcid_text": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, sha256(coalesce(text, '')) AS text_sha256 FROM conversations",
    "mcid_first_operations": "SELECT conv_id, t AS turn, 'page:1:op:' || (3 * t + 3) AS op_id FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t FROM conversations)",
    "cmap_decode": "SELECT item_id, sha256(text) AS text_sha256 FROM benchmark WHERE text <> ''",
    "text_run_widths": "SELECT item_id, (length(text) + 39) // 40 AS runs, round(length(text) * 5.0::DOUBLE, 3) AS width FROM benchmark WHERE text <> ''",
    "fonts_embedded": "SELECT 'F1' AS name, 'Type0' AS subtype, 'Mapped' AS base_font, 'Identity-H' AS encoding, true AS embedded, count(*) AS n FROM benchmark",
    "literal_lines": "SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "page_content_missing": "SELECT doc_id, 'warn:contents-missing:obj:99:0' AS warning_id, 'warn' AS severity FROM documents WHERE doc_id % 10 = 0",
    "xobject_catalog": "SELECT 'Im' AS name, 'Image' AS subtype, 4::BIGINT AS width, 2::BIGINT AS height, 'DeviceGray' AS color_space, 8::BIGINT AS bits, count(*) AS n FROM documents",
    "resource_usage": "SELECT name, object_id, (SELECT count(*) FROM documents) AS n FROM (VALUES ('Im', 'obj:6:0'), ('None', NULL)) t(name, object_id)",
    "do_missing_xobject": "SELECT doc_id, 'warn:do-missing:page:1:op:3' AS warning_id FROM documents",
    "object_kinds_all": f"SELECT kind, hint, count(*) AS n FROM {_IDS} JOIN (VALUES {_TYPE_ROWS}) t(k, kind, hint) ON doc_id % 22 = k GROUP BY ALL",
    "object_page_window": f"""SELECT (doc_id // 10000)::VARCHAR AS file_id, "row", doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 10000 ORDER BY doc_id) - 1 AS "row" FROM {_IDS}) WHERE "row" BETWEEN 12 AND 37""",
    "recovery_modes": f"""SELECT recovery, 3::BIGINT AS objects, count(*) AS n FROM {_IDS}
JOIN (VALUES (0, 'none'), (1, 'no-startxref'), (2, 'empty-xref'), (3, 'partial-scan')) t(k, recovery) ON doc_id % 4 = k GROUP BY ALL""",
    "warning_rollup": f"""SELECT warning, severity, category, stage, count(*) AS n FROM {_IDS} JOIN (VALUES
  (1, 'startxref-missing', 'warn', 'structure', 0), (1, 'eof-missing', 'warn', 'structure', 0), (2, 'xref-failed', 'error', 'xref', 1), (2, 'xref-empty', 'warn', 'xref', 1), (3, 'xref-failed', 'error', 'xref', 1),
  (3, 'xref-partial-recovery', 'info', 'xref', 1), (0, 'pages-missing', 'warn', 'structure', 2), (1, 'pages-missing', 'warn', 'structure', 2), (2, 'pages-missing', 'warn', 'structure', 2), (3, 'pages-missing', 'warn', 'structure', 2)
) t(k, warning, severity, category, stage) ON doc_id % 4 = k GROUP BY ALL""",
    "page_kids_missing": f"SELECT 'warn:pages-missing:obj:9:0' AS warning_id, count(*) AS n FROM {_IDS}",
    "op_explanations": """SELECT CASE event_type WHEN 'view' THEN 'Save the graphics state.' WHEN 'click' THEN 'Restore the graphics state.' WHEN 'purchase' THEN 'Begin a text object.' WHEN 'error' THEN 'End the text object.'
  ELSE 'Set the line width to ' || event_id || '.' END AS explanation, count(*) AS n FROM events GROUP BY 1""",
    "token_histogram": "SELECT kind, n FROM (SELECT 'keyword' AS kind, count(*) AS n FROM events UNION ALL SELECT 'number', count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase', 'error')) FROM events) WHERE n > 0",
    "encoding_winansi": "SELECT c_custkey AS cust_key, c_name || CASE WHEN c_custkey % 96 = 0 THEN ' ' ELSE chr((160 + c_custkey % 96)::INTEGER) END AS text FROM customer",
    "stream_filters": """SELECT CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'FlateDecode' WHEN 2 THEN 'ASCIIHexDecode' ELSE 'ASCII85Decode+FlateDecode' END AS filters, count(*) AS n,
  sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY 1""",
    "ref_edges_degree": "SELECT conv_id, count(*) + 1 AS degree FROM conversations GROUP BY 1",
}
