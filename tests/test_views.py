import hashlib

from pyspark.sql import functions as F

from quirelake.functions.text import encoded_text
from quirelake.operators.content import explained, operand_text, operations, printable, string_literal
from quirelake.operators.files import all_warnings, eof_markers, file_info
from quirelake.operators.objects import kind_chip, object_detail, objects, stream_by_id
from quirelake.operators.pages import document_tree, embedded_files, page_step
from quirelake.operators.structure import struct_children, struct_nodes, struct_rows
from quirelake.plans.render import Writer
from quirelake.plans.views import Corpus, register_functions
from quirelake.sources import read_pdfs, stream_pdfs
from quirelake.streaming import append_tables, latest_files


def whole_file():
    w = Writer()
    w.add(1, "<< /Type /Catalog /Pages 2 0 R /AcroForm 20 0 R /Names 30 0 R /StructTreeRoot 40 0 R /Metadata 9 0 R >>")
    w.add(2, "<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 612 792] /Resources 4 0 R >>")
    w.add(3, "<< /Type /Page /Contents 5 0 R /Rotate 450 /Annots [8 0 R] >>")
    w.add(4, "<< /Font << /F1 6 0 R >> /XObject << /Fm 7 0 R >> /Properties << /M << /MCID 3 >> >> /ProcSet [/PDF 5 /Text] >>")
    w.stream(5, "", b"BT /F1 10 Tf /P /M BDC [(a) -5 (b\\351)] TJ EMC (c) Tj ET /Fm Do BI /W 1 ID x EI", flate=True)
    w.add(6, "<< /Type /Font /Subtype /Odd /Encoding /WinAnsiEncoding >>")
    w.stream(7, "/Type /XObject /Subtype /Form /BBox [0 0 5 6] /Matrix [1 0 0 1 2 3]", b"q Q")
    w.add(20, "<< /Fields [21 0 R 21 0 R] >>")
    w.add(21, "<< /T (form) /Kids [22 0 R 23 0 R 21 0 R] >>")
    w.add(22, "<< /T (name) /FT /Tx /V (Ada) >>")
    w.add(23, "<< /FT /Sig /V 24 0 R >>")
    w.add(30, "<< /EmbeddedFiles << /Names [(a.txt) 31 0 R (b.txt) 5] >> /JavaScript << >> >>")
    w.add(40, "<< /Type /StructTreeRoot /K [41 0 R 42 0 R] >>")
    w.add(41, "<< /S /H1 /T (head) /K 3 >>")
    w.add(42, "<< /K [<< /Type /MCR >> << /Type /OBJR /Obj 7 0 R /Pg 3 0 R >> << /Type /MCR /MCID 4 /Pg 3 0 R >>] >>")
    return w.close("/Root 1 0 R /Encrypt << /V 1 >>")


def test_tables_and_views(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(whole_file())
    (tmp_path / "in" / "b.pdf").write_bytes(b"junk (")
    files = read_pdfs(spark, str(tmp_path / "in"))
    corpus = Corpus(files)
    assert "pdf_pages" in corpus.create_views()
    page = spark.sql("SELECT * FROM pdf_pages").collect()
    assert len(page) == 1 and page[0].rotation == 90 and page[0].annotations == ["obj:8:0"] and page[0].resources == "obj:4:0"
    info = {r.file_id.rsplit("/", 1)[1]: r for r in file_info(files).collect()}
    a, b = info["a.pdf"], info["b.pdf"]
    assert (a.encrypted, a.tagged, a.acro_form, a.xfa, a.javascript, a.form_fields, a.signatures, a.embedded_files, a.pages, a.recovery) == (True, True, True, False, True, 2, 1, 1, 1, "none")
    assert (b.encrypted, b.pages, b.objects, b.recovery, b.pdf_version) == (False, 0, 0, "no-startxref", "unknown")
    fields = spark.sql("SELECT full_name, name, field_type, value, signed FROM pdf_form_fields ORDER BY ordinal").collect()
    assert [tuple(r) for r in fields] == [("form.name", "name", "Tx", "Ada", False), ("form", "form", "Sig", None, True)]
    runs = spark.sql("SELECT text, width, height FROM pdf_text_runs ORDER BY sequence").collect()
    assert [(r.text, r.width, r.height) for r in runs] == [("abé", 15.0, 10.0), ("c", 5.0, 10.0)]
    elements = spark.sql("SELECT element_id, kind FROM pdf_visual_elements ORDER BY z_index").collect()
    assert [tuple(r) for r in elements] == [("page:1:vis:text:0", "text-run"), ("page:1:vis:text:1", "text-run"), ("page:1:vis:form:0", "form-xobject"), ("page:1:vis:image:0", "image")]
    assert [(r.operator, r.mcid) for r in spark.sql("SELECT operator, mcid FROM pdf_operations ORDER BY sequence").collect()][2:5] == [("BDC", None), ("TJ", 3), ("EMC", 3)]
    found = corpus.objects
    assert [(r.name, r.object_id) for r in embedded_files(found, corpus.document_tree).collect()] == [("a.txt", "obj:31:0")]
    nodes = struct_nodes(found, document_tree(found))
    assert [(r.type, r.title, r.depth) for r in nodes.orderBy("place").collect()] == [("Document", None, 0), ("H1", "head", 1), ("Span", None, 1)]
    rows = struct_rows(nodes, struct_children(found)).orderBy("row").collect()
    assert [(r.kind, r.label, r.depth) for r in rows] == [("elem", "Document", 0), ("elem", "H1", 1), ("mcid", "mcid:3", 2), ("elem", "Span", 1), ("objr", "obj:7:0", 2), ("mcid", "mcid:4", 2)]
    assert {r.warning_id for r in all_warnings(files).collect()} == {"warn:header-missing", "warn:startxref-missing", "warn:eof-missing"}
    register_functions(spark)
    token = spark.sql("SELECT t.kind, t.token FROM VALUES (CAST('/A (b) 1' AS BINARY)) v(c), LATERAL pdf_tokens(c) t").collect()
    assert [tuple(r) for r in token] == [("name", "/A"), ("string", "(b)"), ("number", "1")]
    assert spark.sql("SELECT operator FROM pdf_operations(CAST('1 w q' AS BINARY))").count() == 2

    stream = stream_pdfs(spark, str(tmp_path / "in"))
    append_tables(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["pdf_pages"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "pdf_pages")).count() == 1
    assert latest_files(files).count() == 2


def test_points_and_text(spark):
    f = spark.createDataFrame([("a", whole_file())], "file_id string, content binary")
    found = objects(f)
    read = lambda i: stream_by_id(found, "a", i).first()
    assert bytes(read("obj:5:0").decoded)[:2] == b"BT" and read("obj:6:0").error == "not a stream" and read("obj:99:0").error == "object not found"
    detail = {r.number: r.raw_text for r in object_detail(f, limit=20).collect()}
    assert detail[1] == "1 0 obj\n<< /Type /Ca\n…" and whole_file()[eof_markers(f).first().start :][:5] == b"%%EOF"
    row = spark.range(1).select(
        printable(F.lit(b"a\x00" * 40)).alias("p"), string_literal(F.lit(b"a(b)\\")).alias("s"), string_literal(F.lit(b"\x00" * 40)).alias("h"), kind_chip(F.lit("page")).alias("c"), kind_chip(F.lit("x")).alias("o"),
        operand_text(F.array(*map(F.lit, ("/N", "(s)", "[1]", "<< /A 1 >>", "5")))).alias("t"),
        *[encoded_text(F.lit(bytes(range(256))), F.lit(e).cast("string")).alias(n) for e, n in (("WinAnsiEncoding", "win"), ("MacRomanEncoding", "mac"), (None, "none"))],
    ).first()
    assert row.p == "(" + "a·" * 32 + "…)" and row.s == "(a\\(b\\)\\\\)" and row.h == "<" + "0" * 64 + "…>" and (row.c, row.o) == ("Page", "Obj") and row.t == "/N (…) […] <<…>> …"
    for b in range(256):
        win = bytes([b]).decode("cp1252", "ignore") if b >= 0x20 and b != 0x7F else ""
        mac = bytes([b]).decode("mac_roman") if 0x20 <= b < 0xAB and b != 0x7F else "·"
        assert row.win[b] == ((win or "·") if b != 0xA0 else " ") and row.mac[b] == mac and row.none[b] == (chr(b) if 0x20 <= b < 0x7F else "·")
    said = explained(operations(spark.createDataFrame([("a", 1, b"2 w 1 0 0 1 5 6 cm (hi) Tj /F1 9 Tf zz")], "file_id string, page_number int, content binary")))
    assert [r.explanation for r in said.orderBy("sequence").collect()] == ["Set the line width to 2.", "Multiply the transformation matrix by [1 0 0 1 5 6].", "Show the text (hi).", "Set the font /F1.", "Operator zz is not documented."]
    assert (page_step(1, -1, 3), page_step(3, 1, 3), page_step(2, 1, 3)) == (1, 3, 3) and hashlib.sha256(b"").hexdigest()
