"""Damaged and extreme files give rows or nulls, never an error."""

import zlib

import pytest

from quirelake.functions.filters import decode, inflate
from quirelake.functions.scan import objects_of
from quirelake.functions.syntax import entries_of, items_of, lex, operations_of, string_of
from quirelake.functions.text import cmap_of, decoded_codes
from quirelake.operators.content import marked_content, operations
from quirelake.operators.files import file_facts
from quirelake.operators.objects import definitions, objects, streams
from quirelake.operators.pages import page_contents, pages
from quirelake.operators.xref import Structure


def files(spark, **contents):
    return spark.createDataFrame(list(contents.items()), "file_id string, content binary")


def test_long_literal_strings(spark):
    text = "x(" + "a" * 1_000_000 + ")" + "(" * 3000 + ")" * 3000
    rows = spark.createDataFrame([("a", 1, f"BT ({text}) Tj ET".encode())], "file_id string, page_number int, content binary")
    found = operations(rows).filter("operator = 'Tj'").first()
    assert string_of(found.operands[0]) == text.encode()


def test_strings_names_and_numbers():
    assert string_of(r"(a\(b\)\n\r\t\b\f\\\101\7\q" + "\\\r\nz\r\ny)") == b"a(b)\n\r\t\b\x0c\\A\x07qz\ny"
    assert string_of("<4 8 6>") == b"H`" and string_of("/x") is None
    assert entries_of("<< /A#20B /C#44 /N 1 /N 2 /D << /N 3 >> /R 1 0 R /L [1 [2] (>>)] >>") == {"A B": "/C#44", "N": "2", "D": "<< /N 3 >>", "R": "1 0 R", "L": "[1 [2] (>>)]"}
    assert items_of("[1 0 R 2 (a) <</K 1>> [3]]") == ["1 0 R", "2", "(a)", "<</K 1>>", "[3]"]
    assert [k for k, _, _ in lex("-.5 +1 1.2.3 1e5 true null /A#G0 } ) <zz> << ] (open")] == ["number", "number", "keyword", "keyword", "true", "null", "error", "keyword", "error", "error", "hex", "open", "close", "error"]


def test_inline_images_are_one_operation():
    found = operations_of("q BI /W 1 /H 1 ID \x00 EI\x01\x02 q Q ( EI Q 1 w")
    assert [x[0] for x in found] == ["q", "BI/EI", "Q", "w"] and found[1][1] == [] and found[3][1] == ["1"]


def test_stream_extents():
    head = b"1 0 obj << /Length %d >> stream\r\n%b\r\nendstream endobj 2 0 obj 5 endobj"
    inner = b"endobj\r\n7 0 obj << >> endobj endstream\n"
    for length in (len(inner), 3):
        found = objects_of(head % (length, inner))
        kept = found[0]["stream_end"] - found[0]["stream_start"]
        assert [x["number"] for x in found][:1] == [1] and found[-1]["number"] == 2
        assert kept == len(inner)  # an end on a line of its own comes before one after a blank
    assert objects_of(b"1 0 obj << >> stream\nab endstream endobj")[0]["stream_end"] == 23
    assert objects_of(b"1 0 obj << >> stream\nabc") [0]["stream_end"] == 24 and not objects_of(b"1 0 obj << >>")[0]["closed"]


def test_extreme_numbers(spark):
    bad = b"""%PDF-1.4 \n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 3 0 R [4 0 R]] /MediaBox [0 0 1] >> endobj
3 0 obj << /Type /Page /Rotate 99999999999 /MediaBox [0 0 99999999999999999999 1e5 7 8] /Contents 5 0 R >> endobj
5 0 obj << /Filter /FlateDecode /DecodeParms << /Predictor 99999999999 /Columns 0 >> >> stream
x
endstream endobj 99999999999999999999 0 obj 1 endobj
trailer << /Info << /A << >> >> /Encrypt 9 0 R >> xref\n0 1\n0000000000 65535 f \ntrailer << /D << >> /Encrypt 9 0 R >> startxref 99999999999999999999 %%EOF"""
    f = files(spark, a=bad)
    facts = file_facts(f).first()
    assert facts.pdf_version == "1.4" and facts.encrypted and facts.startxref is None
    found = objects(f)
    page = pages(found).collect()
    assert len(page) == 1 and page[0].rotation == 0 and page[0].media_box == [0, 0, 1e20, 7]
    assert streams(found).first().error and page_contents(found, pages(found)).first().content == b""
    assert Structure(f).live_objects().count() == 4 and definitions(f).count() == 4


def test_filters():
    whole = zlib.compress(b"abc" * 100)
    assert inflate(whole + b"trailing") == b"abc" * 100
    for data in (whole[:-3], b"raw"):
        with pytest.raises((ValueError, zlib.error)):
            inflate(data)
    for parms in ({"Predictor": 2, "Columns": 0}, {"Predictor": 12, "Columns": 10**15}, {"Predictor": 2, "BitsPerComponent": 4}):
        with pytest.raises(ValueError):
            decode(whole, ["Fl"], parms)
    assert decode(zlib.compress(bytes([1, 1, 1, 2, 2, 2])), ["FlateDecode"], [{"Predictor": 2, "Columns": 3}]) == bytes([1, 2, 3, 2, 4, 6])
    rows = [(0, [5, 6, 7]), (1, [1, 1, 1]), (2, [1, 1, 1]), (3, [2, 2, 2]), (4, [1, 1, 1]), (9, [3, 3, 3])]
    above, want = [0, 0, 0], []
    for kind, raw in rows:
        out = []
        for i, x in enumerate(raw):
            left, up, corner = (out[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            guess = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(guess - v))
            out.append((x + {1: left, 2: up, 3: (left + up) // 2, 4: paeth}.get(kind, 0)) & 255)
        want += out
        above = out
    data = b"".join(bytes([k, *raw]) for k, raw in rows)
    assert decode(zlib.compress(data + b"\x01\x02"), ["FlateDecode"], [{"Predictor": 15, "Columns": 3}]) == bytes(want)


def test_chain_of_tables(spark):
    one = b"%PDF-1.5\n1 0 obj << /Type /Catalog >> endobj\n2 0 obj (old) endobj\n"
    table = b"xref\n0 3\n0000000000 65535 f \n%010d 00000 n \n%010d 00000 n \nbad row\ntrailer << /Root 1 0 R >>\n" % (9, one.index(b"2 0 obj"))
    base = one + table
    two = base + b"2 0 obj (new) endobj\n"
    second = two + b"xref\n2 1\n%010d 00000 n \ntrailer << /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (len(base), len(one), len(two))
    freed = second + b"\nxref\n2 1\n0000000000 00001 f \ntrailer << /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (len(two), len(second) + 1)
    looped = one + table.replace(b"/Root", b"/Prev %d /Root" % len(one)) + b"startxref\n%d" % len(one)
    lost = one + table.replace(b"/Root", b"/Prev 3 /Root") + b"startxref\n%d" % len(one)
    f = files(spark, second=second, freed=freed, looped=looped, lost=lost, none=one)
    s = Structure(f)
    live = {(r.file_id, r.number): r.dictionary for r in s.live_objects().collect()}
    assert live[("second", 2)] == "(new)" and ("freed", 2) not in live and live[("looped", 2)] == "(old)" and live[("none", 2)] == "(old)"
    assert {r.file_id: r.recovery for r in s.recovery().collect()} == {"second": "none", "freed": "none", "looped": "none", "lost": "partial-scan", "none": "no-startxref"}
    named = {(r.file_id, r.warning_id.split(":")[1]) for r in s.warnings().collect()}
    assert ("lost", "xref-failed") in named and ("second", "xref-entry-malformed") in named and ("none", "xref-failed") not in named
    bad = [r for r in s.entries().collect() if r.malformed]
    assert {(r.number, r.type, r.generation) for r in bad} == {(3, "f", 65535)}


def test_marked_content_is_innermost(spark):
    stream = b"EMC /P << /MCID 1 >> BDC a BMC /P /M BDC b EMC c EMC d EMC e EMC f"
    ops = operations(spark.createDataFrame([("a", 1, stream)], "file_id string, page_number int, content binary"))
    named = spark.createDataFrame([("a", 1, "M", {"MCID": "7"})], "file_id string, page_number int, name string, entries map<string,string>")
    got = [(r.operator, r.mcid) for r in marked_content(ops, named).orderBy("sequence").collect()]
    # an explicit stack says what must come out
    stack, want = [], []
    for op in ("EMC", "BDC1", "a", "BMC", "BDC7", "b", "EMC", "c", "EMC", "d", "EMC", "e", "EMC", "f"):
        want.append((op[:3] if op[:3] == "BDC" else op, stack[-1] if stack else None))
        if op == "EMC":
            stack[-1:] = []
        elif op[0] == "B":
            stack.append(int(op[3:]) if op[3:] else None)
    assert got == want


def test_cmaps():
    codes, spaces, warned = cmap_of(b"1 begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange 2 beginbfchar <41> <0061> <8001> <d83dde00> (x) <00> endbfchar 2 beginbfrange <50> <52> <0030> <60> <61> [<0041> <00420043>] endbfrange")
    table = {c: t for c, _, t in codes}
    assert table == {0x41: "a", 0x8001: "😀", 0x50: "0", 0x51: "1", 0x52: "2", 0x60: "A", 0x61: "BC"} and len(warned) == 1 and warned[0].startswith("warn:cmap-bfchar:")
    ordered = sorted(spaces, key=lambda s: -s[0])
    assert decoded_codes(b"\x41\x80\x01\x90\x00\x52\x99", table, [2, 1], ordered) == "a😀�2�"
    assert len(cmap_of(b"1 beginbfrange <00000000> <ffffffff> <0000> endbfrange")[0]) == 65_536
