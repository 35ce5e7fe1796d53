"""Plain dictionaries are read by one pattern, as token by token; chains of files without streams are known without their objects."""

import random
import re

import pytest

from quirelake.functions import scan, syntax
from quirelake.operators import xref
from quirelake.plans.render import Writer

PIECES = ["<<", ">>", "/A", "/B#41", "/Type", "/", " ", "\n", "1", "07", "2.5", "-3", "0", "R", "Rx", "null", "endobj", "stream", "obj", "(x)", "<41>", "[", "]", "%c\n", "/C-d", ">", "\xb2"]


def test_same_as_token_by_token(monkeypatch):
    rng = random.Random(3)
    texts = ["<<>>", "<< /Key 5 >>", "<</A/B/C 1 0 R/A 2>>", "<< /A 1 0 R >> x", "<< /A 1 0 >>", "<< /A >>", "<</A 1/B 2 0 R>>", "<</A 1 0 Rx>>", "<</A 1>", "<< /A 12(x) >>", " \n<</A 3>>\nstream"]
    texts += ["<<" + "".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(9))) + rng.choice([">>", " >> endobj", ""]) for _ in range(6000)]
    fast = [(scan._value_end(x, 0), syntax.entries_of(x)) for x in texts]
    assert sum(bool(syntax.PLAIN.match(x)) for x in texts) > 50
    never = re.compile(r"(?!)")
    monkeypatch.setattr(syntax, "PLAIN", never)
    monkeypatch.setattr(scan, "PLAIN", never)
    slow = [(scan._value_end(x, 0), syntax.entries_of(x)) for x in texts]
    assert [x for x, a, b in zip(texts, fast, slow, strict=True) if a != b] == []


@pytest.mark.parametrize("streamed", [False, True])
def test_chain_reads_objects_of_files_with_streams_only(spark, streamed):
    w = Writer()
    w.add(1, "<< /Type /Catalog >>")
    data = w.close_with_stream(2, {}, "/Root 1 0 R") if streamed else w.close("/Root 1 0 R")
    structure = xref.Structure(spark.createDataFrame([("f", bytearray(data)), ("none", None)], "file_id string, content binary").persist())
    assert structure.streams.count() == streamed and structure.bodies().count() == 1
    assert sorted(r.number for r in structure.live_objects().collect()) == ([1, 2] if streamed else [1])
    read = {r.file_id for r in structure.definitions.filter("stream IS NOT NULL").select("file_id").collect()}
    assert read == ({"f"} if streamed else set())
    plans = structure.streams._jdf.queryExecution().analyzed().toString().lower()
    assert re.search(r"contains[(,] *content", plans)
