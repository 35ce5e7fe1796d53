"""Bytes of shown strings as text: simple encodings by translation, ToUnicode maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import latin1
from .syntax import lex, string_of

#: Codes of a bfrange at most, so that a damaged one ends; a longer one gives a warning.
MAX_RANGE = 65_536

_HIGH = "".join(map(chr, range(0x80, 0xA0)))
_WIN = "".join(bytes([b]).decode("cp1252", "replace").replace("�", "·") for b in range(0x80, 0xA0))
_MAC = bytes(range(0x80, 0xAB)).decode("mac_roman")


def encoded_text(data: Column, encoding: Column) -> Column:
    """A character a byte by WinAnsi or MacRoman (80-9F and A0-AA only), else ASCII; bytes without one are ``·``."""
    low = r"[\x00-\x1f\x7f]"
    win = F.regexp_replace(F.translate(latin1(data), _HIGH + "\xa0", _WIN + " "), low, "·")
    mac = F.regexp_replace(F.translate(F.regexp_replace(latin1(data), r"[\x00-\x1f\x7f\xab-\xff]", "·"), _HIGH + "".join(map(chr, range(0xA0, 0xAB))), _MAC), low, "·")
    plain = F.regexp_replace(latin1(data), r"(?s)[^\x20-\x7e]", "·")
    return F.when(encoding == "WinAnsiEncoding", win).when(encoding == "MacRomanEncoding", mac).otherwise(plain)


def big_endian(data: Column) -> Column:
    """The number that up to seven bytes write."""
    return F.conv(F.hex(data), 16, 10).try_cast("long")


def utf16(data: bytes) -> str:
    """Text of UTF-16BE bytes; an odd last byte is dropped, a lone surrogate is U+FFFD."""
    return data[: len(data) // 2 * 2].decode("utf-16-be", "replace")


def cmap_of(data: bytes | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]], list[str]]:
    """``(code, width, text)`` entries, ``(width, first, last)`` code spaces and warning ids of a ToUnicode map.

    Of two entries for a code the later one counts.
    """
    text = (data or b"").decode("latin-1")
    found: dict[int, tuple[int, int, str]] = {}
    spaces: list[tuple[int, int, int]] = []
    warned: list[str] = []
    mode, held = "", []
    for kind, a, b in lex(text):
        token = text[a:b]
        if kind == "keyword" and token.startswith("begin"):
            mode, held = token[5:], []
        elif kind == "keyword" and token.startswith("end"):
            mode, held = "", []
        elif mode in ("bfchar", "bfrange", "codespacerange"):
            if held and held[-1][0] == "array":  # an open array of targets
                if kind == "close":
                    _targets(found, held)
                    held = []
                elif kind == "hex":
                    held[-1][1].append(string_of(token))
                continue
            held.append(("array", []) if token == "[" else (kind, string_of(token) if kind == "hex" else None, a))
            if len(held) == 3 or (len(held) == 2 and mode != "bfrange"):
                if held[-1][0] == "array":
                    continue
                wrong = next((x for x in held if x[0] != "hex"), None)
                if wrong:
                    name = {"bfchar": "bfchar", "codespacerange": "codespace"}.get(mode, "bfrange-target" if wrong is held[2 % len(held)] else "bfrange-bounds")
                    warned.append(f"warn:cmap-{name}:{held[0][2]}")
                elif mode == "codespacerange":
                    spaces.append((len(held[0][1]), int.from_bytes(held[0][1], "big"), int.from_bytes(held[1][1], "big")))
                elif mode == "bfchar":
                    code = int.from_bytes(held[0][1], "big")
                    found[code] = (code, len(held[0][1]), utf16(held[1][1]))
                else:
                    first, last, target = int.from_bytes(held[0][1], "big"), int.from_bytes(held[1][1], "big"), held[2][1]
                    if last - first >= MAX_RANGE:
                        warned.append(f"warn:cmap-bfrange-bounds:{held[0][2]}")
                    for code in range(first, min(last, first + MAX_RANGE - 1) + 1):
                        unit = (int.from_bytes(target[-2:], "big") + code - first) & 0xFFFF
                        found[code] = (code, len(held[0][1]), utf16(target[:-2] + unit.to_bytes(2, "big")) if len(target) > 1 else "")
                held = []
    return list(found.values()), spaces, warned


def _targets(found: dict[int, tuple[int, int, str]], held: list[tuple]) -> None:
    if len(held) == 3 and held[0][0] == held[1][0] == "hex":
        first = int.from_bytes(held[0][1], "big")
        for i, target in enumerate(held[2][1]):
            found[first + i] = (first + i, len(held[0][1]), utf16(target))


def decoded_codes(data: bytes, codes: dict[int, str], widths: list[int], spaces: list[tuple[int, int, int]]) -> str:
    """Text of a string by a map, longest codes first; a code without text is U+FFFD over the width of its code space, or one byte."""
    out, at = [], 0
    while at < len(data):
        for w in widths:
            text = codes.get(int.from_bytes(data[at : at + w], "big")) if at + w <= len(data) else None
            if text is not None:
                out.append(text)
                at += w
                break
        else:
            fits = (w for w, a, b in spaces if at + w <= len(data) and a <= int.from_bytes(data[at : at + w], "big") <= b)
            out.append("�")
            at += max(1, next(fits, 1))
    return "".join(out)
