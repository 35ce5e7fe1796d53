import zlib

from pyspark.sql import functions as F

from quirelake.functions import file_size, fingerprint, hexdump, operator_category, rotation
from quirelake.functions.filters import decode
from quirelake.functions.syntax import string_bytes
from quirelake.operators.content import nesting, operations
from quirelake.operators.files import file_facts, warnings
from quirelake.operators.objects import definitions, edges, objects, streams
from quirelake.operators.pages import pages
from quirelake.operators.xref import xref_rows

TREE = b"""%PDF-1.7
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /MediaBox [0 0 595 842] /Rotate 90 /Resources 9 0 R /Kids [3 0 R 4 0 R 2 0 R] >> endobj
3 0 obj << /Type /Page >> endobj
4 0 obj << /Type /Page /MediaBox [0 0 612 792] /Rotate 0 >> endobj
startxref
9
%%EOF"""


def files(spark, **contents):
    return spark.createDataFrame([(k, v) for k, v in contents.items()], "file_id string, content binary")


def test_pages_inherit_and_cycles_end(spark):
    found = {r.object_id: r for r in pages(objects(files(spark, a=TREE, empty=b"", junk=b"\xff(")) ).collect()}
    assert found["obj:3:0"].media_box == [0, 0, 595, 842] and found["obj:3:0"].rotation == 90 and found["obj:3:0"].resources == "obj:9:0"
    assert found["obj:4:0"].media_box == [0, 0, 612, 792] and found["obj:4:0"].rotation == 0 and found["obj:4:0"].page_number == 2


def test_newest_definition_wins_and_references(spark):
    f = files(spark, a=b"1 0 obj\n<< /A 2 0 R >>\nendobj\n1 0 obj\n<< /A 3 0 R /B [4 0 R 5 1 R] >>\nendobj")
    assert definitions(f).count() == 2
    assert [r.dst_id for r in edges(objects(f)).orderBy("ordinal").collect()] == ["obj:3:0", "obj:4:0", "obj:5:1"]


def test_streams_and_filters(spark):
    data = zlib.compress(bytes([0, 10, 20, 30, 40, 2, 1, 2, 3, 4]))
    f = files(spark, a=b"1 0 obj\n<< /Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 4 >> >>\nstream\n" + data + b"\nendstream\nendobj", b=b"1 0 obj\n<< /Filter /DCTDecode >>\nstream\nxx\nendstream\nendobj")
    found = {r.file_id: r for r in streams(objects(f)).collect()}
    assert bytes(found["a"].decoded) == bytes([10, 20, 30, 40, 11, 22, 33, 44])
    assert found["b"].decoded is None and "DCTDecode" in found["b"].error
    assert decode(b"dab>", ["AHx"], {}) == b"\xda\xb0"
    assert decode(bytes([1, 1, 1, 1]), [], {}) == bytes([1, 1, 1, 1])


def test_facts_and_warnings(spark):
    f = files(spark, good=TREE, bare=b"nothing")
    facts = {r.file_id: r for r in file_facts(f).collect()}
    assert facts["good"].pdf_version == "1.7" and facts["good"].startxref == 9 and facts["good"].eof_markers == 1
    assert {(r.file_id, r.warning_id) for r in warnings(f).collect()} == {("bare", "warn:header-missing"), ("bare", "warn:startxref-missing"), ("bare", "warn:eof-missing")}


def test_xref_rows(spark):
    f = files(spark, a=b"xref\n0 2\n0000000000 65535 f \n0000000017 00000 n \n7 1\n0000000099 00001 n \ntrailer << >>")
    assert [(r.number, r.type, r.offset, r.generation) for r in xref_rows(f).orderBy("ordinal").collect()] == [(0, "f", 0, 65535), (1, "n", 17, 0), (7, "n", 99, 1)]


def test_operations_and_depth(spark):
    rows = spark.createDataFrame([("a", 1, b"Q q 2 w BT /F1 12 Tf % note\n(a\\) (b)) Tj <4869> Tj ET Q")], "file_id string, page_number int, content binary")
    ops = nesting(operations(rows)).orderBy("sequence").collect()
    assert [o.operator for o in ops] == ["Q", "q", "w", "BT", "Tf", "Tj", "Tj", "ET", "Q"]
    assert [o.depth for o in ops] == [0, 0, 1, 1, 2, 2, 2, 1, 0]
    assert ops[4].operands == ["/F1", "12"] and ops[4].op_id == "page:1:op:4" and ops[5].operands == ["(a\\) (b))"]
    shown = spark.createDataFrame([("<4869>",), ("(a\\) b)",)], "t string").select(string_bytes(F.col("t")).alias("b")).collect()
    assert [bytes(r.b) for r in shown] == [b"Hi", b"a) b"]


def test_small_functions(spark):
    row = spark.range(1).select(
        file_size(F.lit(1536)).alias("size"), rotation(F.lit(-90)).alias("turn"), rotation(F.lit(45)).alias("odd"), operator_category(F.lit("T*")).alias("known"), operator_category(F.lit("zz")).alias("new"),
        fingerprint(F.lit(b"abc")).alias("print"), hexdump(F.lit(b"0123456789abcdefg\n")).alias("dump"),
    ).first()
    assert (row["size"], row.turn, row.odd, row.known, row.new) == ("1.5 KB", 270, 0, "text-positioning", "unknown")
    assert row["print"].startswith("3:") and row.dump[1]["offset"] == "00000010" and row.dump[1]["ascii"] == "g."
