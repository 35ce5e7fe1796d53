"""Places of objects and cross-reference tables in a file's bytes, as Arrow UDFs.

A UDF gives places and short texts only; what lies there is cut out, joined and
decoded by DataFrame operations.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd

from .syntax import PLAIN, entries_of, lex, unclosed
from .udfs import arrow_udf, portions

_BLANKS = "\x00\t\n\x0c\r "
_WS = r"[\x00\t\n\x0c\r ]"
_HEADER = re.compile(rf"(?<![0-9])(\d{{1,10}}){_WS}+(\d{{1,5}}){_WS}+obj(?![A-Za-z0-9])")
_RESYNC = re.compile(rf"endobj|{_HEADER.pattern}")
_REF_AT = re.compile(rf"\d+{_WS}+\d+{_WS}+R(?![A-Za-z0-9])")
_STREAM = re.compile(rf"{_WS}*stream(?:\r\n|\n|\r|(?={_WS}))")
_STREAM_END = re.compile(rf"{_WS}*endstream")
_OBJECT_END = re.compile(rf"{_WS}*endobj")
_TABLE = re.compile(r"(?<![A-Za-z])xref(?:[ \t]*[\r\n]+|[ \t]+(?=[0-9]))")

_CLEAR = "clear:array<struct<low:bigint,high:bigint>>"
PLACES = f"array<struct<number:bigint,generation:int,start:bigint,end:bigint,value:string,stream_start:bigint,stream_end:bigint,closed:boolean,broken:boolean,newest:boolean,{_CLEAR}>>"
TABLES = f"array<struct<offset:bigint,rows:string,trailer:string,{_CLEAR}>>"


def _value_end(text: str, at: int, open_strings: set[int] | None = None) -> tuple[int, bool]:
    """The end of the value at ``at``, and whether it is broken.

    A value that is not closed ends where the next ``endobj``, ``stream`` or
    header of an object stands, so that it does not swallow what follows.
    ``open_strings`` gathers the strings of the text that never end, so that
    the text is searched to its end for one of them only.
    """
    if plain := PLAIN.match(text, at):
        return plain.end(), False
    open_strings = set() if open_strings is None else open_strings
    depth, numbers = 0, []
    for kind, a, b in lex(text, at, open_strings):
        if kind == "error" and b == len(text):
            if text[a] == "(" and a not in open_strings:
                open_strings |= unclosed(text, a)
            m = _RESYNC.search(text, a)
            return (m.start() if m else b), True
        if kind == "hex" and (m := _RESYNC.search(text, a, b)):
            return m.start(), True
        if kind == "keyword":
            word = text[a:b]
            if word == "obj" and len(numbers) > 1:
                return numbers[-2], True
            if not depth or word in ("endobj", "stream"):
                return a, True
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth -= 1
            if depth <= 0:
                return (a, True) if depth else (b, False)
        elif not depth:
            m = _REF_AT.match(text, a) if kind == "number" else None
            return (m.end() if m else b), kind == "error"
        numbers = [*numbers[-1:], a] if kind == "number" else []
    return len(text), True


def _clear(text: str, first: int, at: int) -> list[dict]:
    """Places from ``first`` on with nothing but blanks and comments up to ``at``, as ranges, the one at ``at`` first."""
    ranges = []
    while True:
        low = at
        while low > first and text[low - 1] in _BLANKS:
            low -= 1
        ranges.append(dict(low=low, high=at))
        line = text.rfind("\n", first, low) + 1 or first
        line = text.rfind("\r", line, low) + 1 or line
        at = text.find("%", line, low)
        if at < 0:
            return ranges


class StreamEnds:
    """Places where stream data can end: before ``endstream`` on a line of its own, or after a blank; found in one pass when first asked for."""

    def __init__(self, text: str) -> None:
        self._text, self._found = text, None

    def _search(self) -> None:
        text, at = self._text, -1
        self._found = {"line": ([], []), "blank": ([], [])}
        while (at := text.find("endstream", at + 1)) >= 0:
            before, after = text[at - 1 : at], text[at + 9 : at + 10]
            if before not in _BLANKS or not before or (after.isalnum() and not text.startswith("endobj", at + 9)):
                continue
            end = at
            if before in "\r\n":
                end -= 2 if text[at - 2 : at] == "\r\n" else 1
            else:
                while end and text[end - 1] in _BLANKS:
                    end -= 1
            sure = before in "\r\n" or _OBJECT_END.match(text, at + 9)
            places, ends = self._found["line" if sure else "blank"]
            places.append(at)
            ends.append(end)

    def after(self, at: int) -> tuple[int, int] | None:
        """The end of the data that start at ``at`` and the place after ``endstream``, or None."""
        if self._found is None:
            self._search()
        for places, ends in self._found.values():
            k = bisect.bisect_left(places, at)
            if k < len(places):
                return max(at, ends[k]), places[k] + 9
        return None


def stream_extent(text: str, at: int, length: str | None, ends: StreamEnds) -> tuple[int, int, bool]:
    """End of the data that start at ``at``, where the search goes on, and whether ``endstream`` is missing.

    A literal ``/Length`` counts if ``endstream`` follows there; else the data
    end before the first ``endstream`` that stands on a line of its own or
    before ``endobj``, or after a blank.
    """
    if length and length.isdigit():
        m = _STREAM_END.match(text, at + int(length))
        if m:
            return at + int(length), m.end(), False
    if text.startswith("endstream", at):
        return at, at + 9, False
    found = ends.after(at)
    if found:
        return *found, False
    lost = text.find("endobj", at)
    return (lost, lost, True) if lost >= 0 else (len(text), len(text), True)


def objects_of(content: bytes | None) -> list[dict]:
    """Definitions ``N G obj`` in order; of a number the last one is ``newest``; ``clear`` are the places that lead to one."""
    text = (content or b"").decode("latin-1")
    found: list[dict] = []
    last: dict[int, dict] = {}
    at, ends, open_strings = 0, StreamEnds(text), set()
    while m := _HEADER.search(text, at):
        clear = _clear(text, at, m.start())
        end, broken = _value_end(text, m.end(), open_strings)
        value = text[m.end() : end].strip(_BLANKS)
        data, data_end, at = -1, -1, end
        stream = _STREAM.match(text, end) if value[:2] == "<<" else None
        if stream:
            data = stream.end()
            data_end, at, lost = stream_extent(text, data, (entries_of(value) or {}).get("Length"), ends)
            broken |= lost
        closed = _OBJECT_END.match(text, at)
        at = max(closed.end() if closed else at, m.end())
        row = dict(
            number=int(m[1]), generation=int(m[2]), start=m.start(), end=at, value=value, stream_start=data, stream_end=data_end, closed=bool(closed), broken=broken, newest=True, clear=clear
        )
        if int(m[1]) in last:
            last[int(m[1])]["newest"] = False
        last[int(m[1])] = row
        found.append(row)
    return found


def tables_of(content: bytes | None) -> list[dict]:
    """Classic cross-reference tables: place of ``xref``, the text of the rows, the trailer's dictionary, the blanks that lead to it."""
    text = (content or b"").decode("latin-1")
    found = []
    for m in _TABLE.finditer(text):
        end = text.find("trailer", m.end())
        stop = end if end >= 0 else len(text)
        trailer = text[end + 7 : _value_end(text, end + 7)[0]].strip() if end >= 0 else None
        low = m.start()
        while low and text[low - 1] in _BLANKS:
            low -= 1
        found.append(dict(offset=m.start(), rows=text[m.end() : stop], trailer=trailer, clear=[dict(low=low, high=m.start())]))
    return found


def members_of(data: bytes | None, count: int | None, first: int | None) -> list[dict] | None:
    """Objects of a decoded object stream; a pair without a growing offset is the last row, ``broken`` and without a value, as is a missing pair."""
    if data is None or count is None or first is None:
        return None
    text = data.decode("latin-1")
    numbers = [text[a:b] for kind, a, b in lex(text[: max(0, first)]) if kind == "number"]
    pairs = [(int(float(n)), int(float(o))) for n, o in zip(numbers[::2], numbers[1::2], strict=False)][: max(0, count)]
    found = []
    for index, (number, offset) in enumerate(pairs):
        if index and offset <= pairs[index - 1][1]:
            return [*found, dict(number=number, index=index, value=None, broken=True)]
        start = first + offset
        end, broken = _value_end(text, start)
        found.append(dict(number=number, index=index, value=text[start:end].strip(_BLANKS), broken=broken and end < len(text) or start >= len(text)))
    if len(pairs) < count:
        found.append(dict(number=None, index=len(pairs), value=None, broken=True))
    return found


@arrow_udf(PLACES)
def object_places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in batches:
        yield from portions(objects_of, column)


@arrow_udf(TABLES)
def table_places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in batches:
        yield from portions(tables_of, column)


@arrow_udf("array<struct<number:bigint,index:int,value:string,broken:boolean>>")
def stream_members(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    given = lambda x: None if pd.isna(x) else int(x)
    for columns in batches:
        yield from portions(lambda data, n, first: members_of(data, given(n), given(first)), *columns)
