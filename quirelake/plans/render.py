"""Small PDF files written row by row for the queries: objects, streams, tables and object streams with true places."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.operators.runs import by_key


class Writer:
    """Bytes of one file. Numbers of objects are the caller's; places are kept for the tables."""

    def __init__(self) -> None:
        self.data = bytearray(b"%PDF-1.7\n")
        self.places: dict[int, int] = {}

    def add(self, number: int, body: str | bytes) -> None:
        self.places[number] = len(self.data)
        self.data += b"%d 0 obj\n%b\nendobj\n" % (number, body.encode("latin-1") if isinstance(body, str) else body)

    def stream(self, number: int, dictionary: str, data: bytes, flate: bool = False) -> None:
        data = zlib.compress(data) if flate else data
        named = f"<< {dictionary}{' /Filter /FlateDecode' if flate else ''} /Length {len(data)} >>\nstream\r\n"
        self.add(number, named.encode("latin-1") + data + b"\nendstream")

    def table(self, rows: Iterable[tuple[int, str, int]], trailer: str, previous: int | None = None) -> int:
        """A table of ``(number, type, offset)`` and its trailer, as the file's newest one; returns its place."""
        place = len(self.data)
        self.data += b"xref\n"
        for number, kind, offset in sorted(rows):
            self.data += b"%d 1\n%010d %05d %b \n" % (number, offset, 0, kind.encode())
        prev = "" if previous is None else f" /Prev {previous}"
        self.data += f"trailer\n<< {trailer}{prev} >>\nstartxref\n{place}\n%%EOF\n".encode("latin-1")
        return place

    def close(self, trailer: str) -> bytes:
        """A table of all objects, and the bytes."""
        self.table([(n, "n", at) for n, at in self.places.items()], trailer)
        return bytes(self.data)

    def close_with_stream(self, number: int, packed: dict[int, tuple[int, int]], trailer: str) -> bytes:
        """A cross-reference stream of all objects; ``packed`` has ``(object stream, index)`` by number."""
        place = len(self.data)
        rows = {n: (1, at, 0) for n, at in self.places.items()} | {number: (1, place, 0)} | {n: (2, *where) for n, where in packed.items()}
        numbers = sorted(rows)
        firsts = [n for n in numbers if n - 1 not in rows]
        counts = [next(k for k in range(1, len(numbers) + 1) if n + k not in rows) for n in firsts]
        index = " ".join(f"{n} {c}" for n, c in zip(firsts, counts, strict=True))
        data = b"".join(bytes([rows[n][0]]) + rows[n][1].to_bytes(4, "big") + rows[n][2].to_bytes(2, "big") for n in numbers)
        self.stream(number, f"/Type /XRef /W [1 4 2] /Index [{index}] /Size {max(numbers) + 1} {trailer}", data, flate=True)
        self.data += b"startxref\n%d\n%%%%EOF\n" % place
        return bytes(self.data)


def object_stream(writer: Writer, number: int, members: list[tuple[int, str]]) -> None:
    heads, bodies, at = [], [], 0
    for n, body in members:
        heads.append(f"{n} {at}")
        bodies.append(body)
        at += len(body.encode("latin-1")) + 1
    first = " ".join(heads) + "\n"
    writer.stream(number, f"/Type /ObjStm /N {len(members)} /First {len(first)}", (first + "\n".join(bodies)).encode("latin-1"), flate=True)


def literal(data: bytes) -> str:
    """A literal string: parentheses that match stay, others and backslashes are escaped, line ends written by name."""
    text = data.decode("latin-1").replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")
    depth, balanced = 0, True
    for c in re.findall(r"[()]", text):
        depth += 1 if c == "(" else -1
        balanced &= depth >= 0
    return f"({text})" if balanced and not depth else "(" + text.replace("(", "\\(").replace(")", "\\051") + ")"


def rendered(rows: DataFrame, keys: dict[str, Column], render: Callable[[list[dict]], bytes]) -> DataFrame:
    """``file_id, content``: a file for each group of ``keys``, whose values joined by ``-`` are its id."""

    schema = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("content", T.BinaryType())])
    named = rows.withColumn("_file", F.concat_ws("-", *[c.cast("string") for c in keys.values()]))
    return by_key(named, "_file", lambda group: [(group[0]["_file"], render(group))], schema)
