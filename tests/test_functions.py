from decimal import ROUND_HALF_UP, Decimal
from itertools import product

from pyspark.sql import functions as F

import quirelake.plans.queries as queries
from quirelake.functions import file_size, hex_lines, hexdump, hidden_bytes, is_object_id, is_operation_id, is_page_id, object_id_parts, project_rect, severity_tone


def test_file_size_against_brute_force(spark):
    sizes = [0, 1, 1023, 1024, 1075, 1280, 1536, 1792, 60127, 1024**2 - 1, 1024**2, 1024**2 + 5243, 1024**2 * 9 // 8, 10**8 + 7, *range(1000, 400_000, 4999)]

    def label(n):
        if n < 1024:
            return f"{n} B"
        unit, places, name = (1024, "0.1", "KB") if n < 1024**2 else (1024**2, "0.01", "MB")
        return f"{(Decimal(n) / unit).quantize(Decimal(places), ROUND_HALF_UP)} {name}"

    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", file_size(F.col("n")).alias("label")).collect()
    assert {r.n: r.label for r in got} == {n: label(n) for n in sizes}


def projected(box, rect, pixels, turn):
    bx, by, bw, bh = box
    wide, high = (bh, bw) if turn in (90, 270) else (bw, bh)
    points = []
    for x, y in product((rect[0] - bx, rect[0] + rect[2] - bx), (rect[1] - by, rect[1] + rect[3] - by)):
        px, py = {0: (x, bh - y), 90: (y, x), 180: (bw - x, y), 270: (bh - y, bw - x)}[turn]
        points.append((px * pixels[0] / max(1, wide), py * pixels[1] / max(1, high)))
    xs, ys = zip(*points)
    return [min(xs), min(ys), max(1, max(xs) - min(xs)), max(1, max(ys) - min(ys))]


def test_project_rect_against_brute_force(spark):
    boxes = [(0.0, 0.0, 612.0, 792.0), (-30.0, 50.0, 200.0, 400.0), (0.0, 0.0, 0.0, 0.0)]
    rects = [(10.0, 20.0, 30.0, 40.0), (100.0, 300.0, -50.0, 0.1)]
    cases = list(product(boxes, rects, [(612.0, 792.0), (300.0, 1000.0)], (0, 90, 180, 270)))
    rows = spark.createDataFrame([(i, *b, *r, *p, t) for i, (b, r, p, t) in enumerate(cases)], "i int, bx double, by double, bw double, bh double, x double, y double, w double, h double, pw double, ph double, t int")
    c = [F.col(n) for n in rows.columns]
    got = {r.i: r.a for r in rows.select("i", F.array(*project_rect(tuple(c[1:5]), tuple(c[5:9]), tuple(c[9:11]), c[11])).alias("a")).collect()}
    for i, case in enumerate(cases):
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[i], projected(*case), strict=True)), case


def test_overlay_query_reaches_every_rotation(spark, monkeypatch):
    seen = []

    def spy(box, rect, pixels, turn):
        seen.append((turn, pixels, box))
        return project_rect(box, rect, pixels, turn)

    monkeypatch.setattr(queries, "project_rect", spy)
    path = "/root/testdata/sf0.01"
    queries.overlay_boxes(spark, path).collect()
    turn, pixels, box = seen[0]
    varied = spark.read.parquet(f"{path}/supplier.parquet").select(turn.alias("t"), pixels[0].alias("p"), box[0].alias("x"), (pixels[1] / box[3]).alias("s")).agg(*[F.count_distinct(c) for c in "tpxs"]).first()
    assert varied[0] == 4 and min(varied) > 1


def test_hexdump_of_whole_values(spark):
    data = bytes(i * 7 % 256 for i in range(10_001))
    row = spark.createDataFrame([(data, b"ab")], "d binary, s binary").select(hexdump(F.col("d"), None).alias("all"), hexdump(F.col("d")).alias("cut"), hidden_bytes(F.col("d")).alias("left"), hidden_bytes(F.col("s")).alias("none")).first()
    assert b"".join(bytes.fromhex(r.hex) for r in row["all"]) == data and row["all"][-1].offset == "00002710"
    assert len(row.cut) == 256 and (row.left, row.none) == (5905, 0)


def test_ids_tones_and_hex_lines(spark):
    ids = ["obj:1:0", "page:2", "page:2:op:3", "obj:1", "xpage:2", None]
    row = spark.createDataFrame([(i,) for i in ids], "v string").select("v", is_object_id(F.col("v")).alias("o"), is_page_id(F.col("v")).alias("p"), is_operation_id(F.col("v")).alias("op"), object_id_parts(F.col("v")).alias("n"))
    got = {r.v: (r.o, r.p, r.op, r.n and tuple(r.n)) for r in row.collect()}
    assert got == {"obj:1:0": (True, False, False, (1, 0)), "page:2": (False, True, False, None), "page:2:op:3": (False, False, True, None), "obj:1": (False, False, False, None), "xpage:2": (False, False, False, None), None: (None, None, None, None)}
    assert [r[0] for r in spark.createDataFrame([("error",), ("warn",), ("info",)], "s string").select(severity_tone(F.col("s"))).collect()] == ["danger", "warning", "info"]
    lines = spark.createDataFrame([(b"0123456789abcdef\x00z" + b"y" * 20,)], "b binary").select(hex_lines(F.col("b"), 18).alias("l")).first().l
    assert lines == ["00000000  30 31 32 33 34 35 36 37  38 39 61 62 63 64 65 66  0123456789abcdef", "00000010  00 7a" + " " * 45 + ".z", "… 20 more bytes"]
