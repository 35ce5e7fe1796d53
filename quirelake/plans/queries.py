"""The queries over rendered PDF files, and the SQL that says what they must find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions import file_size, hexdump, project_rect
from quirelake.functions.syntax import string_bytes
from quirelake.operators.content import nesting, operations
from quirelake.operators.files import file_facts, warnings
from quirelake.operators.objects import definitions, edges, find_objects, missing_references, newest, number_of, objects, streams
from quirelake.operators.pages import pages
from quirelake.operators.xref import xref_rows

from . import corpus_queries, structure_queries
from . import fixtures as fx


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects(fx.text_files(fx.table(spark, sf_dir, "documents")))
    contents = found.filter("kind = 'contentStream'").select("file_id", F.lit(1).alias("page_number"), F.col("stream").alias("content"))
    shown = operations(contents).filter("operator = 'Tj'").select("file_id", "sequence", string_bytes(F.col("operands")[0]).alias("line"))
    lines = shown.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("sequence", "line"))).alias("l"))
    return lines.select(F.col("file_id").cast("long").alias("doc_id"), "n_lines", F.sha2(F.array_join(F.transform("l.line", lambda x: F.decode(x, "UTF-8")), "\n"), 256).alias("text_sha256"))


def object_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(fx.text_files(fx.table(spark, sf_dir, "documents"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def object_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects(fx.text_files(fx.table(spark, sf_dir, "documents")))
    return find_objects(found, "type1").select(F.col("file_id").cast("long").alias("doc_id"), "number", "hint")


def object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(objects(fx.text_files(fx.table(spark, sf_dir, "documents")))).groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("n"))


def missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_references(objects(fx.text_files(fx.table(spark, sf_dir, "documents")))).groupBy("dst_id").agg(F.count(F.lit(1)).alias("n"))


def op_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations(fx.operator_pages(fx.table(spark, sf_dir, "events"), 10_000)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def op_nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = nesting(operations(fx.operator_pages(fx.table(spark, sf_dir, "events"))))
    return ops.select(F.col("file_id").cast("long").alias("user_id"), F.col("sequence").cast("long").alias("sequence"), "operator", F.col("depth").cast("long").alias("depth"))


def newest_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = newest(definitions(fx.revision_files(fx.table(spark, sf_dir, "orders"))))
    return last.select(F.split_part("file_id", F.lit("-"), F.lit(1)).cast("long").alias("file"), "number", number_of("entries", "Key").cast("long").alias("order_key"))


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages count on from file to file; only the files' numbers of pages meet in one task."""
    files = fx.page_tree_files(*(fx.table(spark, sf_dir, t) for t in ("region", "nation", "supplier")))
    found = pages(objects(files))
    earlier = W.orderBy(F.transform(F.split("file_id", "-"), lambda x: x.cast("long"))).rowsBetween(W.unboundedPreceding, -1)
    before = found.groupBy("file_id").count().select("file_id", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    return found.join(before, "file_id").select(
        (F.col("page_number") + F.col("before")).cast("long").alias("page_number"), "object_id", F.col("media_box")[2].cast("long").alias("width"), F.col("media_box")[3].cast("long").alias("height"), F.col("rotation").cast("long").alias("rotation")
    )


def stream_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams(objects(fx.filter_files(fx.table(spark, sf_dir, "documents"))))
    return found.select(F.col("file_id").cast("long").alias("doc_id"), F.size("filters").cast("long").alias("n_filters"), F.sha2("decoded", 256).alias("sha256"))


def hex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "pages").select("page_id", F.explode(hexdump(F.encode("html", "UTF-8"))).alias("r"))
    return rows.select("page_id", "r.offset", "r.hex")


def file_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warnings(fx.damaged_files(fx.table(spark, sf_dir, "labels"))).groupBy("warning_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_facts(fx.damaged_files(fx.table(spark, sf_dir, "labels"))).groupBy("pdf_version", "eof_markers").agg(F.count(F.lit(1)).alias("n"))


def xref_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = xref_rows(fx.xref_files(fx.table(spark, sf_dir, "customer")))
    return rows.select(F.split_part("file_id", F.lit("-"), F.lit(1)).cast("long").alias("nation"), F.col("number").cast("long").alias("number"), "type", "offset")


def overlay_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles that show up at ``s_suppkey`` from the left and from the bottom, by supplier on pages of another rotation, box offset and pixel size."""
    s = fx.table(spark, sf_dir, "supplier")
    key, turn = F.col("s_suppkey").cast("double"), F.pmod("s_suppkey", F.lit(4)) * 90
    scale = F.pow(F.lit(2.0), F.pmod("s_suppkey", F.lit(3)) - 1)  # pixels a unit
    wide, high = (F.lit(792.0) + F.pmod("s_suppkey", F.lit(5)) * 100), F.lit(792.0)
    ox, oy = F.pmod("s_suppkey", F.lit(7)) * 10.0, F.pmod("s_suppkey", F.lit(11)) * -3.0
    # what is wanted, in units of the page as it is shown
    x, y, w, h, full_w, full_h = (c / scale for c in (key, key, F.lit(20.0), F.lit(10.0), wide, high))
    lying = turn.isin(90, 270)
    left = F.when(turn == 90, full_h - y - h).when(turn == 180, full_w - x - w).when(turn == 270, y).otherwise(x)
    low = F.when(turn == 90, x).when(turn == 180, full_h - y - h).when(turn == 270, full_w - x - w).otherwise(y)
    page = (ox, oy, F.when(lying, full_h).otherwise(full_w), F.when(lying, full_w).otherwise(full_h))
    rect = (ox + left, oy + low, F.when(lying, h).otherwise(w), F.when(lying, w).otherwise(h))
    box = project_rect(page, rect, (wide, high), turn)
    return s.select("s_suppkey", *[c.alias(n) for c, n in zip(box, "xywh", strict=True)])


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("html")
    return fx.table(spark, sf_dir, "pages").select("page_id", F.when(n < 1024, file_size(n)).otherwise(F.lit("KB or more")).alias("label"))


def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole label of every page (``size_labels`` names only those under 1 KB)."""
    return fx.table(spark, sf_dir, "pages").select("page_id", file_size(F.octet_length("html")).alias("label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        text_lines, object_kinds, object_search, object_edges, missing_refs, op_categories, op_nesting_depth, newest_objects, page_tree, stream_hashes, hex_rows, file_warnings, file_versions, xref_entries, overlay_boxes, size_labels, file_sizes,
    )
} | corpus_queries.QUERIES | structure_queries.QUERIES

_OPS = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence,
  CASE event_type WHEN 'view' THEN 'q' WHEN 'click' THEN 'Q' WHEN 'purchase' THEN 'BT' WHEN 'error' THEN 'ET' ELSE 'w' END AS operator FROM events"""

ORACLE_SQL = {
    "text_lines": "SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "object_kinds": "SELECT kind, (SELECT count(*) FROM documents) AS n FROM (VALUES ('catalog'), ('pages'), ('page'), ('contentStream'), ('font')) t(kind)",
    "object_search": "SELECT doc_id, 5::BIGINT AS number, 'Font / Type1' AS hint FROM documents",
    "object_edges": "SELECT src_id, dst_id, (SELECT count(*) FROM documents) AS n FROM (VALUES ('obj:1:0', 'obj:2:0'), ('obj:2:0', 'obj:3:0'), ('obj:3:0', 'obj:2:0'), ('obj:3:0', 'obj:4:0'), ('obj:3:0', 'obj:9:0')) t(src_id, dst_id)",
    "missing_refs": "SELECT 'obj:9:0' AS dst_id, count(*) AS n FROM documents",
    "op_categories": f"SELECT CASE WHEN operator IN ('BT', 'ET') THEN 'text-object' ELSE 'graphics-state' END AS category, count(*) AS n FROM ({_OPS}) GROUP BY 1",
    "op_nesting_depth": f"""WITH ops AS ({_OPS}),
step AS (SELECT *, coalesce(lag((operator IN ('q', 'BT'))::INT) OVER o, 0) - (operator IN ('Q', 'ET'))::INT AS step FROM ops WINDOW o AS (PARTITION BY user_id ORDER BY sequence)),
levels AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY sequence) AS level FROM step)
SELECT user_id, sequence, operator, (level - least(0, min(level) OVER (PARTITION BY user_id ORDER BY sequence)))::BIGINT AS depth FROM levels""",
    "newest_objects": """SELECT o_custkey % 50 AS file, o_orderkey % 200 + 10 AS number, arg_max(o_orderkey, year(o_orderdate) * 1000000000 + o_orderkey) AS order_key
FROM orders GROUP BY ALL""",
    "page_tree": """SELECT row_number() OVER (ORDER BY r_regionkey, n_nationkey, s_suppkey) AS page_number, 'obj:' || (s_suppkey + 1000) || ':0' AS object_id,
  CASE WHEN s_acctbal < 0 THEN 100 ELSE r_regionkey + 500 END::BIGINT AS width, CASE WHEN s_acctbal < 0 THEN 200 ELSE 800 END::BIGINT AS height,
  CASE WHEN n_nationkey % 3 = 0 THEN 90 ELSE r_regionkey * 180 % 360 END::BIGINT AS rotation
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "stream_hashes": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END::BIGINT AS n_filters, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "hex_rows": """WITH b AS (SELECT page_id, lower(hex(encode(html))) AS h FROM pages WHERE html <> ''),
r AS (SELECT page_id, h, unnest(range(0, least(4096, len(h) // 2), 16)) AS pos FROM b)
SELECT page_id, printf('%08x', pos) AS "offset", regexp_replace(trim(regexp_replace(substr(h, pos * 2 + 1, least(32, 8192 - pos * 2)), '(..)', '\\1 ', 'g')), ' +$', '') AS hex FROM r""",
    "file_warnings": """SELECT warning_id, severity, count(*) AS n FROM (SELECT DISTINCT doc_id FROM labels)
JOIN (VALUES (1, 'warn:header-missing', 'error'), (2, 'warn:startxref-missing', 'warn'), (3, 'warn:eof-missing', 'warn')) w(k, warning_id, severity) ON doc_id % 4 = k GROUP BY ALL""",
    "file_versions": """SELECT CASE doc_id % 4 WHEN 1 THEN 'unknown' ELSE '1.4' END AS pdf_version, CASE doc_id % 4 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS eof_markers, count(*) AS n
FROM (SELECT DISTINCT doc_id FROM labels) GROUP BY ALL""",
    "xref_entries": """SELECT c_nationkey::BIGINT AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 4 AS number,
  CASE WHEN c_acctbal < 0 THEN 'f' ELSE 'n' END AS type, c_custkey AS "offset" FROM customer""",
    "overlay_boxes": "SELECT s_suppkey, s_suppkey::DOUBLE AS x, 792.0::DOUBLE - s_suppkey - 10 AS y, 20.0::DOUBLE AS w, 10.0::DOUBLE AS h FROM supplier",
    "size_labels": "SELECT page_id, CASE WHEN strlen(html) < 1024 THEN strlen(html) || ' B' ELSE 'KB or more' END AS label FROM pages",
    "file_sizes": """WITH b AS (SELECT page_id, strlen(html)::BIGINT AS n FROM pages),
t AS (SELECT *, (n * 20 + 1024) // 2048 AS kb, (n * 200 + 1048576) // 2097152 AS mb FROM b)
SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (kb // 10) || '.' || (kb % 10) || ' KB' ELSE (mb // 100) || '.' || lpad((mb % 100)::VARCHAR, 2, '0') || ' MB' END AS label FROM t""",
} | corpus_queries.ORACLE_SQL | structure_queries.ORACLE_SQL
