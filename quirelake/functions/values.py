"""Nested values as rows, and the references in them, as Arrow UDFs: one pass over the tokens of a value's text."""

from __future__ import annotations

import re

from .syntax import _udf, items_of, lex, name_text, string_of

_BLANK = r"[\x00\t\n\x0c\r ]+"
_REF_AT = re.compile(rf"0*(\d+){_BLANK}0*(\d+){_BLANK}R(?![A-Za-z0-9])")
_IN_PLACE = re.compile(r"(?:/K(?:/\d+)?)+")


def value_rows_of(text: str | None) -> list[tuple[str, str, str | None, int, int]]:
    """``(path, kind, value, start, end)`` of a value and all that nests in it, in order.

    A path is a JSON pointer: keys and indices after slashes, ``~`` and ``/`` in
    keys as ``~0`` and ``~1``; the value itself has the empty path. Names are
    decoded, strings are their bytes as Latin-1 characters, references object
    ids; dictionaries and arrays have no value; damaged bytes are ``error`` rows
    of the container that they stand in.
    """
    rows: list[list] = []
    held: list[list] = []  # row, path, next index (arrays) or key (dictionaries)
    until = 0
    for kind, a, b in lex(text or ""):
        if a < until:
            continue
        top = held[-1] if held else None
        token = text[a:b]
        if kind == "close":
            if top is None:
                break
            rows[held.pop()[0]][4] = b
            if not held:
                break
            continue
        if kind == "error" or (top and top[3] == "dict" and top[2] is None and kind != "name"):
            rows.append([top[1] if top else "", "error", token, a, b])
            continue
        if top and top[3] == "dict" and top[2] is None:
            top[2] = name_text(token).replace("~", "~0").replace("/", "~1")
            continue
        path = "" if top is None else f"{top[1]}/{top[2]}"
        if top:
            top[2] = None if top[3] == "dict" else top[2] + 1
        ref = _REF_AT.match(text, a) if kind == "number" else None
        if kind == "open":
            shape = "dict" if token == "<<" else "array"
            held.append([len(rows), path, None if shape == "dict" else 0, shape])
            rows.append([path, shape, None, a, len(text)])
        elif ref:
            until = ref.end()
            rows.append([path, "ref", f"obj:{ref[1]}:{ref[2]}", a, until])
        elif kind == "name":
            rows.append([path, "name", name_text(token), a, b])
        elif kind in ("string", "hex"):
            rows.append([path, "string", string_of(token).decode("latin-1"), a, b])
        else:
            rows.append([path, {"true": "boolean", "false": "boolean"}.get(kind, kind), token, a, b])
        if not held:
            break
    return [tuple(r) for r in rows]


def refs_of_value(text: str | None) -> list[str]:
    return [r[2] for r in value_rows_of(text) if r[1] == "ref"] if text and "R" in text else []


def listed_refs_of(text: str | None) -> list[str]:
    found = []
    for item in items_of(text) or [text or ""]:
        m = _REF_AT.match(item.strip(" \t\r\n\x00\x0c"))
        found += [f"obj:{m[1]}:{m[2]}"] if m else []
    return found


def inner_elements_of(text: str | None) -> list[tuple[str, str]]:
    """``(path, text)`` of the dictionaries that nest in a value through keys ``K`` and their arrays only."""
    return [(p, text[a:b]) for p, kind, _, a, b in value_rows_of(text) if kind == "dict" and p and _IN_PLACE.fullmatch(p)] if text and "/K" in text else []


#: ``array<struct<path,kind,value,start,end>>``: a value and all that nests in it.
value_rows = _udf("array<struct<path:string,kind:string,value:string,start:int,end:int>>", value_rows_of)
#: ``array<string>``: the object ids anywhere in a value, in order; none of strings and comments.
refs_within = _udf("array<string>", refs_of_value)
#: ``array<string>``: the object id that a value is, or those that are items of the array that it is.
listed_refs = _udf("array<string>", listed_refs_of)
#: ``array<struct<path,text>>``: dictionaries in place below ``/K``.
inner_elements = _udf("array<struct<path:string,text:string>>", inner_elements_of)
