"""Inexact offsets, values without an end, nested values, scopes of text state, diagnostics, reachability and revisions."""

import random
import time

from pyspark.sql import functions as F

from quirelake.functions.scan import members_of, objects_of, tables_of
from quirelake.functions.syntax import faults_of, name_value
from quirelake.functions.values import inner_elements_of, listed_refs_of, refs_of_value, value_rows_of
from quirelake.operators.content import operations, scoped
from quirelake.operators.graph import reachable
from quirelake.operators.history import at_revision, entry_intervals, revision_changes, revision_diff
from quirelake.operators.objects import object_detail
from quirelake.operators.places import resolved
from quirelake.operators.xref import Structure


def test_places_against_a_plain_search(spark):
    rng = random.Random(4)
    headers, places = [], []
    for f in range(4):
        at = 0
        for n in range(30):
            low = at + rng.randint(3, 9)
            at = low + rng.randint(0, 4)
            headers.append((f, n, [(low, at)] if n % 3 else [(low, at), (low - 1, low - 1)]))
        places += [(f, rng.randint(0, at + 5), k) for k in range(200)]
    h = spark.createDataFrame(headers, "file_id long, header long, clear array<struct<low:bigint,high:bigint>>")
    p = spark.createDataFrame(places, "file_id long, place long, k long")
    got = {(r.file_id, r.k): r.header for r in resolved(p, h, "place", "header").collect()}
    assert got == {(f, k): next((n for g, n, c in headers if g == f and any(a <= x <= b for a, b in c)), None) for f, x, k in places}


def test_values_end_where_the_next_object_begins():
    found = objects_of(b"1 0 obj (open 2 0 obj << /A [1 endobj 3 0 obj <41 endobj 4 0 obj [5 0 R] endobj 5 0 obj 6 0 R endobj 6 0 obj << /L 1 >> stream\nno end endobj 7 0 obj } endobj")
    assert [(x["number"], x["value"], x["broken"]) for x in found] == [
        (1, "(open", True), (2, "<< /A [1", True), (3, "<41", True), (4, "[5 0 R]", False), (5, "6 0 R", False), (6, "<< /L 1 >>", True), (7, "}", True),
    ]
    for body in (b"(x endobj", b"<< >> stream\nabc endstreamx endobj", b"<< >> stream\nabc endstream endobj"):
        start = time.time()
        assert len(objects_of(b"".join(b"%d 0 obj %b\n" % (i, body) for i in range(6000)))) == 6000
        assert time.time() - start < 3


def test_tables_on_one_line_and_damaged_pairs():
    assert tables_of(b"xref 0 1\n0000000000 65535 f \ntrailer << /A 1 >>")[0]["rows"].startswith("0 1")
    assert [(m["number"], m["broken"]) for m in members_of(b"1 0 2 3 3 2 (a)(b)", 3, 12)] == [(1, False), (2, False), (3, True)]
    assert [m["broken"] for m in members_of(b"1 0 (a)", 2, 4)] == [False, True]


def test_nested_values():
    rows = value_rows_of("<< /A#20B [1 0 R 2 (x (1 0 R) y) <</C#2F /D#7e>>] % 9 0 R\n/E } 5 >> trailing 7 0 R")
    assert [(r[0], r[1], r[2]) for r in rows] == [
        ("", "dict", None), ("/A B", "array", None), ("/A B/0", "ref", "obj:1:0"), ("/A B/1", "number", "2"), ("/A B/2", "string", "x (1 0 R) y"), ("/A B/3", "dict", None), ("/A B/3/C~1", "name", "D~"),
        ("", "error", "}"), ("/E", "number", "5"),
    ]
    assert refs_of_value("[01 00 R (2 0 R) [3 0 R] 4 0 Rx]") == ["obj:1:0", "obj:3:0"]
    assert listed_refs_of("[1 0 R [2 0 R] 3 0 R]") == ["obj:1:0", "obj:3:0"] and listed_refs_of("07 0 R") == ["obj:7:0"] and listed_refs_of("(7 0 R)") == listed_refs_of(None) == []
    assert inner_elements_of("<< /K [<< /K << /S /A >> >> 3] /X << /K 1 >> >>") == [("/K/0", "<< /K << /S /A >> >>"), ("/K/0/K", "<< /S /A >>")]
    assert value_rows_of(None) == value_rows_of("") == []


def test_escaped_names(spark):
    names = ["/Page", "/Pa#67e", "/A#2", "/#E9#", "/", "(x)", None]
    got = [r.n for r in spark.createDataFrame(list(enumerate(names)), "i int, v string").select("i", name_value(F.col("v")).alias("n")).orderBy("i").collect()]
    assert got == ["Page", "Page", "A#2", "é#", "", None, None]


def test_scopes_against_a_stack(spark):
    rng = random.Random(6)
    pages, want = [], {}
    for page in range(6):
        lines, stack, now = [], [], None
        for k in range(150):
            op = rng.choice(["q", "Q", "Tf", "Tj", "w"])
            if op == "q":
                stack.append(now)
            elif op == "Q" and stack:
                now = stack.pop()
            elif op == "Tf":
                now = f"/F{k}"
            lines.append({"Tf": f"/F{k} 1 Tf", "Tj": "(x) Tj", "w": "1 w"}.get(op, op))
            want[(page, k)] = now if op == "Tj" else "-"
        pages.append(("f", page, "\n".join(lines).encode()))
    ops = operations(spark.createDataFrame(pages, "file_id string, page_number int, content binary"))
    found = scoped(ops, F.when(F.col("operator") == "Tf", F.col("operands")[0]), "font")
    assert {(r.page_number, r.sequence): r.font if r.operator == "Tj" else "-" for r in found.collect()} == want


def test_content_faults():
    assert faults_of("q } (open") == [("content-parse", 2), ("content-parse", 4)]
    assert faults_of("BI /W 1 ID }( EI Q") == [] and faults_of("q BI /W 1 ID abc") == [("inline-image-ei", 2)] and faults_of(None) == []


def test_reachability_on_cycles_and_chains(spark):
    links = [("a", f"n{i}", f"n{i + 1}") for i in range(50)] + [("a", "n50", "n0"), ("a", "x", "n3"), ("b", "r", "r"), ("b", "r", "gone")]
    got = reachable(spark.createDataFrame(links, "file_id string, src_id string, dst_id string"), spark.createDataFrame([("a", "n0"), ("b", "r")], "file_id string, object_id string"))
    assert {(r.file_id, r.object_id): r.distance for r in got.collect()} == {("a", f"n{i}"): i for i in range(51)} | {("b", "r"): 0, ("b", "gone"): 1}


def test_intervals_of_revisions(spark):
    # revision 0 is the newest here
    rows = [("f", 1, "n", 10, 2), ("f", 1, "n", 10, 1), ("f", 1, "n", 50, 0), ("f", 2, "n", 20, 2), ("f", 2, "f", 0, 1), ("f", 3, "n", 30, 0), ("f", 4, "f", 0, 2)]
    entries = spark.createDataFrame([(f, n, t, o, 0, None, None, r, 0, n) for f, n, t, o, r in rows], "file_id string, number long, type string, offset long, generation int, compressed_in long, index_in_stream long, revision int, extra int, ordinal int")
    intervals = entry_intervals(entries)
    assert {(r.number, r["first"], r.until) for r in intervals.collect()} == {(1, 0, 2), (1, 2, None), (2, 0, 1), (2, 1, None), (3, 2, None), (4, 0, None)}
    assert {r.number for r in at_revision(intervals, 0).collect()} == {1, 2} and {r.number for r in at_revision(intervals, 2).collect()} == {1, 3}
    assert {(r.revision, r.number, r.change) for r in revision_changes(intervals).collect()} == {(0, 1, "added"), (0, 2, "added"), (1, 2, "freed"), (2, 1, "changed"), (2, 3, "added")}
    assert {(r.number, r.change) for r in revision_diff(intervals, 0, 2).collect()} == {(1, "changed"), (2, "freed"), (3, "added")}


def test_structure_of_inexact_and_damaged_files(spark):
    head = b"%PDF-1.4\n"
    one, two, three = b"1 0 obj << /Type /Catalog >> endobj\n", b" % c\n \n2 0 obj (two) endobj\n", b"3 0 obj (open endobj\n"
    body = head + one + two + three
    rows = b"xref\n0 4\n0000000000 65535 f \n%010d 00000 n \n%010d 00000 n \n%010d 00000 n \n" % (4, len(head + one), len(head + one + two))
    early = body + b" \n" + rows + b"trailer << /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % len(body)
    wrong = body + rows.replace(b"%010d" % len(head + one), b"%010d" % len(head)) + b"lost\ntrailer << /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % len(body)
    cut_off = body + rows[: rows.index(b"n ") + 2] + b"\nstartxref %d" % len(body)
    s = Structure(spark.createDataFrame([("early", early), ("wrong", wrong), ("cut", cut_off)], "file_id string, content binary"))
    live = {(r.file_id, r.number) for r in s.live_objects().filter("file_id <> 'cut'").collect()}
    named = {(r.file_id, r.warning_id.removeprefix("warn:")) for r in s.warnings().collect()}
    assert live == {("early", 2), ("wrong", 1)}  # place 4 lies within the comment of the header
    assert {("early", "object-parse:1:0"), ("early", "object-parse:3:0"), ("wrong", "xref-mismatch:2:0")} <= named
    assert any(f == "wrong" and w.startswith("xref-subsection-header") for f, w in named) and not any(f == "early" and w.startswith("xref-failed") for f, w in named)


def test_details_are_cut_in_the_row_of_a_file(spark):
    files = spark.createDataFrame([("a", b"1 0 obj (x) endobj 2 0 obj [1] endobj")], "file_id string, content binary")
    assert {r.number: r.raw_text for r in object_detail(files, 12).collect()} == {1: "1 0 obj (x) \n…", 2: "2 0 obj [1] \n…"}
