"""PDF syntax inside a row: tokens, dictionary entries, array items, strings and content operations, as Arrow UDFs.

A value is kept as the text it has in the file (bytes as Latin-1 characters).
Nested values stay text until a query asks for their entries, so no value tree
is built, and every step from one object to another is a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from .udfs import arrow_udf, portions

_DELIMITER = r"\x00\t\n\x0c\r ()<>\[\]{}/%"
#: A literal string is found by counting its parentheses; everything else by this pattern. Blanks and comments match ``skip``.
_TOKEN = re.compile(
    rf"(?P<skip>[\x00\t\n\x0c\r ]+|%[^\r\n]*)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?=[{_DELIMITER}]|$))|(?P<name>/[^{_DELIMITER}]*)|(?P<open><<|\[)|(?P<close>>>|\])"
    rf"|(?P<hex><[^>]*>?)|(?P<string>\()|(?P<error>[{{}})>])|(?P<keyword>[^{_DELIMITER}]+)"
)
_PAREN = re.compile(r"\\.|[()]", re.S)
_ESCAPE = re.compile(r"\\([0-7]{1,3}|\r\n|.)|\r\n?", re.S)
_ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\n": "", "\r": "", "\r\n": ""}
_REF = re.compile(r"^(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R$")
_EI = re.compile(r"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")
_WS = r"[\x00\t\n\x0c\r ]"
_PLAIN_NAME, _PLAIN_VALUE = "/[A-Za-z0-9]++", rf"[0-9]++(?:{_WS}++[0-9]++{_WS}++R)?+(?=[\x00\t\n\x0c\r />])"
#: A dictionary of short names, whole numbers and references only, as most are; its tokens need not be looked at one by one.
PLAIN = re.compile(rf"{_WS}*+<<(?:{_WS}*+{_PLAIN_NAME}(?:{_WS}*+{_PLAIN_NAME}|{_WS}++{_PLAIN_VALUE}))*+{_WS}*+>>")
_PLAIN_ENTRY = re.compile(rf"({_PLAIN_NAME}){_WS}*+({_PLAIN_NAME}|{_PLAIN_VALUE})")
_LIKELY_TEXT = re.compile(r"[\t\n\x0c\r\x20-\x7e]*")


def lex(text: str, start: int = 0, open_strings: set[int] | frozenset[int] = frozenset()) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` of each token; never fails, damaged bytes are ``error`` tokens. ``open_strings`` are known not to end."""
    at, n = start, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "string":
            end = -1 if at in open_strings else _string_end(text, end)
            if end < 0:
                kind, end = "error", n
        elif kind == "hex" and (text[end - 1] != ">" or end - at < 2):
            kind = "error"
        elif kind == "keyword" and text[at:end] in ("true", "false", "null"):
            kind = text[at:end]
        elif kind == "name" and re.search(r"#(?![0-9A-Fa-f]{2})", text[at:end]):
            kind, end = "error", at + text[at:end].index("#") + 1
        if kind != "skip":
            yield kind, at, end
        at = end


def _string_end(text: str, at: int) -> int:
    depth = 1
    for m in _PAREN.finditer(text, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return -1


def unclosed(text: str, start: int) -> set[int]:
    """The places from ``start`` on of parentheses that are never closed."""
    held: list[int] = []
    for m in _PAREN.finditer(text, start):
        if m[0] == "(":
            held.append(m.start())
        elif m[0] == ")" and held:
            held.pop()
    return set(held)


def values(text: str, start: int = 0) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` of whole values: a bracketed value is one of kind ``dict`` or ``array``, ``N G R`` one of kind ``ref``."""
    held: list[tuple[str, int, int]] = []
    depth, opened = 0, 0
    for kind, a, b in lex(text, start):
        if kind == "open":
            opened, depth = (a if not depth else opened), depth + 1
        elif kind == "close":
            depth -= 1
            if depth < 0:  # the end of the value around
                break
            if not depth:
                held.append(("dict" if text[opened] == "<" else "array", opened, b))
        elif not depth:
            if kind == "keyword" and text[a:b] == "R" and [x[0] for x in held[-2:]] == ["number", "number"]:
                a = held[-2][1]
                del held[-2:]
                kind = "ref"
            held.append((kind, a, b))
        if not depth and len(held) > 2 and held[-1][0] not in ("number", "keyword"):
            yield from held
            held = []
    yield from held


def name_text(token: str) -> str:
    """A name token without its slash, ``#XX`` decoded."""
    return re.sub("#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), token[1:])


def entries_of(text: str | None) -> dict[str, str] | None:
    """The entries of a dictionary's text; of a repeated key the last one; None if it is no dictionary."""
    if text is None or "<<" not in text:
        return None
    if PLAIN.fullmatch(text):
        return {key[1:]: value for key, value in _PLAIN_ENTRY.findall(text)}
    at = text.index("<<")
    if text[:at].strip(" \t\r\n\x00\x0c"):
        return None
    found, key = {}, None
    for kind, a, b in values(text, at + 2):
        if key is None:
            if kind != "name":
                break
            key = name_text(text[a:b])
        else:
            found[key] = text[a:b]
            key = None
    return found


def items_of(text: str | None) -> list[str] | None:
    """The items of an array's text; None if it is no array."""
    body = (text or "").strip(" \t\r\n\x00\x0c")
    return [body[a:b] for kind, a, b in values(body[:-1], 1) if kind != "error"] if body[:1] == "[" and body[-1:] == "]" else None


def string_of(token: str | None) -> bytes | None:
    """The bytes of a literal or hexadecimal string token; None for anything else."""
    if not token:
        return None
    if token[0] == "(" and token[-1] == ")":
        plain = _ESCAPE.sub(lambda m: "\n" if m[1] is None else chr(int(m[1], 8) & 255) if m[1][0] in "01234567" else _ESCAPED.get(m[1], m[1]), token[1:-1])
        return plain.encode("latin-1", "replace")
    if token[0] == "<" and token[:2] != "<<":
        digits = re.sub("[^0-9A-Fa-f]", "", token)
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    return None


def operations_of(text: str) -> list[tuple[str, list[str], int, int]]:
    """``(operator, operands, start, end)``; an inline image is one ``BI/EI`` without operands, error tokens are dropped."""
    found: list[tuple[str, list[str], int, int]] = []
    at, n = 0, len(text)
    while at < n:
        operands: list[str] = []
        first, restart = -1, n
        depth, opened = 0, 0
        for kind, a, b in lex(text, at):
            first = a if first < 0 else first
            if kind == "open":
                opened, depth = (a if not depth else opened), depth + 1
            elif kind == "close":
                depth = max(0, depth - 1)
                if not depth:
                    operands.append(text[opened:b])
            elif depth or kind == "error":
                continue
            elif kind != "keyword":
                operands.append(text[a:b])
            elif text[a:b] == "BI":
                restart = _image_end(text, b)
                found.append(("BI/EI", [], a, restart))
                break
            else:
                found.append((text[a:b], operands, first, b))
                operands, first = [], -1
        at = restart
    return found


def faults_of(text: str | None) -> list[tuple[str, int]]:
    """``(fault, start)`` of a content stream: damaged tokens outside inline images, and images that no ``EI`` ends."""
    found, at, n = [], 0, len(text or "")
    while at < n:
        restart = n
        for kind, a, b in lex(text, at):
            if kind == "error":
                found.append(("content-parse", a))
            elif kind == "keyword" and text[a:b] == "BI":
                restart = _image_end(text, b)
                if restart == n and not _EI.search(text, max(b, n - 3)):
                    found.append(("inline-image-ei", a))
                break
        at = restart
    return found


def _image_end(text: str, at: int) -> int:
    """The place after the ``EI`` of an inline image: the first one whose next 16 characters look like text."""
    data = re.compile(r"\bID[\x00\t\n\x0c\r ]").search(text, at)
    for m in _EI.finditer(text, data.end() - 1 if data else at):
        after = text[m.end() : m.end() + 16]
        if _LIKELY_TEXT.fullmatch(after):
            return m.end()
    return len(text)


def _udf(kind: str, f):
    @arrow_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield from portions(f, column)

    return apply


#: ``map<string,string>``: the entries of a dictionary's text, or null.
entries = _udf("map<string,string>", entries_of)
#: ``array<string>``: the items of an array's text, or null.
items = _udf("array<string>", items_of)
#: ``binary``: the bytes of a string token, or null.
string_bytes = _udf("binary", string_of)
#: Tokens of a text with their kinds and places.
tokens = _udf("array<struct<kind:string,start:int,end:int,token:string>>", lambda x: None if x is None else [(k, a, b, x[a:b]) for k, a, b in lex(x)])
#: Operations of a content stream's text with their operands and places.
content_operations = _udf("array<struct<operator:string,operands:array<string>,start:int,end:int>>", lambda x: None if x is None else operations_of(x))

#: Damaged tokens and unended inline images of a content stream's text.
content_faults = _udf("array<struct<fault:string,start:int>>", faults_of)


def ref_id(value: F.Column) -> F.Column:
    """``obj:N:G`` of a reference's text, or null."""
    pair = [F.regexp_extract(value, _REF.pattern, k) for k in (1, 2)]
    return F.when(pair[0] != "", F.concat(F.lit("obj:"), F.regexp_replace(pair[0], "^0+(?=.)", ""), F.lit(":"), F.regexp_replace(pair[1], "^0+(?=.)", "")))


def name_value(value: F.Column) -> F.Column:
    """A name's text without the slash, ``#XX`` decoded, or null."""
    byte = lambda x: F.concat(F.char(F.conv(F.substring(x, 1, 2), 16, 10).cast("int")), F.substring(x, 3, 1 << 20))
    parts = F.transform(F.split(value, "#"), lambda x, i: F.when(i == 0, F.substring(x, 2, 1 << 20)).when(x.rlike("^[0-9A-Fa-f]{2}"), byte(x)).otherwise(F.concat(F.lit("#"), x)))
    return F.when(value.startswith("/"), F.when(F.contains(value, F.lit("#")), F.array_join(parts, "")).otherwise(F.substring(value, 2, 1 << 20)))


def number_value(value: F.Column) -> F.Column:
    return F.when(value.rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)$"), value.try_cast("double"))


def int_value(value: F.Column) -> F.Column:
    """An integer, a real cut off towards zero; null for anything else or beyond 64 bits."""
    return number_value(value).try_cast("long")
