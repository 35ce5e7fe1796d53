"""Column functions over PDF values: text, identifiers, operators, geometry, bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content operators by category.
OPERATORS = {
    "graphics-state": "q Q cm w J j M d ri i gs",
    "path-construct": "m l c v y h re",
    "path-paint": "S s f F f* B B* b b* n",
    "clipping": "W W*",
    "text-object": "BT ET",
    "text-state": "Tc Tw Tz TL Tf Tr Ts",
    "text-positioning": "Td TD Tm T*",
    "text-show": "Tj TJ ' \"",
    "color": "CS cs SC SCN sc scn G g RG rg K k",
    "xobject": "Do",
    "image-inline": "BI ID EI BI/EI",
    "shading": "sh",
    "marked-content": "BMC BDC EMC MP DP",
    "compatibility": "BX EX",
    "type3-font": "d0 d1",
}

_CATEGORY = {op: category for category, ops in OPERATORS.items() for op in ops.split()}


def operator_category(op: Column) -> Column:
    """Category of a content operator; ``unknown`` for others, null for null."""
    return F.when(op.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _CATEGORY.items() for x in kv]), op), F.lit("unknown")))


def latin1(content: Column) -> Column:
    """Bytes as characters of the same number, so that places in the text are byte offsets."""
    return F.decode(content, "ISO-8859-1")


def object_id(number: Column, generation: Column) -> Column:
    return F.concat(F.lit("obj:"), number.cast("string"), F.lit(":"), generation.cast("string"))


def page_id(number: Column) -> Column:
    return F.concat(F.lit("page:"), number.cast("string"))


def operation_id(page: Column, sequence: Column) -> Column:
    return F.concat(page_id(page), F.lit(":op:"), sequence.cast("string"))


def is_object_id(value: Column) -> Column:
    return value.rlike(r"^obj:\d+:\d+$")


def is_page_id(value: Column) -> Column:
    return value.rlike(r"^page:\d+$")


def is_operation_id(value: Column) -> Column:
    return value.rlike(r"^page:\d+:op:\d+$")


def object_id_parts(value: Column) -> Column:
    """``number, generation`` of an object id as a struct, or null."""
    parts = [F.regexp_extract(value, r"^obj:(\d+):(\d+)$", k).try_cast("long") for k in (1, 2)]
    return F.when(is_object_id(value), F.struct(parts[0].alias("number"), parts[1].alias("generation")))


def severity_tone(severity: Column) -> Column:
    return F.when(severity == "error", "danger").when(severity == "warn", "warning").otherwise("info")


def file_size(size: Column) -> Column:
    """``B``, ``KB`` with one decimal or ``MB`` with two."""
    kb, mb = F.format_string("%.1f KB", size / 1024), F.format_string("%.2f MB", size / (1024 * 1024))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, kb).otherwise(mb)


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + 0.5)


def rotation(value: Column) -> Column:
    """A multiple of 90 in 0..270; anything else is 0."""
    turned = F.pmod(value, F.lit(360))
    return F.when(turned.isin(90, 180, 270), turned).otherwise(F.lit(0)).cast("int")


def project_rect(box: tuple[Column, ...], rect: tuple[Column, ...], pixels: tuple[Column, Column], turn: Column) -> list[Column]:
    """``x, y, w, h`` in pixels of a user-space rectangle, for a media box and a page rotation.

    Corners are rotated within the box, flipped (pixels grow downwards) and
    scaled; the result is the box around them, at least one pixel wide and high.
    A box narrower or lower than 1 (a page without MediaBox) scales as one of 1.
    """
    bx, by, bw, bh = box
    x, y, w, h = rect

    def turned(px: Column, py: Column) -> tuple[Column, Column]:
        u, v = px - bx, py - by
        return (
            F.when(turn == 90, v).when(turn == 180, bw - u).when(turn == 270, bh - v).otherwise(u),
            F.when(turn == 90, bw - u).when(turn == 180, bh - v).when(turn == 270, u).otherwise(v),
        )

    corners = [turned(x, y), turned(x + w, y), turned(x, y + h), turned(x + w, y + h)]
    width = F.when(turn.isin(90, 270), bh).otherwise(bw)
    height = F.when(turn.isin(90, 270), bw).otherwise(bh)
    across, down = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    xs, ys = [c[0] * pixels[0] / across for c in corners], [(height - c[1]) * pixels[1] / down for c in corners]
    left, top = F.least(*xs), F.least(*ys)
    one = F.lit(1.0)
    return [left, top, F.greatest(F.greatest(*xs) - left, one), F.greatest(F.greatest(*ys) - top, one)]


def fingerprint(content: Column) -> Column:
    """Length and a hash of the first, middle and last KiB (of everything up to 4 KiB): ``length:hex``."""
    n = F.octet_length(content)
    sample = F.when(n <= 4096, content).otherwise(
        F.concat(F.substring(content, 1, 1024), F.substring(content, (F.floor(n / 2) - 512 + 1).cast("int"), F.lit(1024)), F.substring(content, -1024, 1024))
    )
    return F.concat(n.cast("string"), F.lit(":"), F.substring(F.sha2(sample, 256), 1, 16))


def hidden_bytes(content: Column, limit: int = 4096) -> Column:
    """How many bytes ``hexdump`` with this ``limit`` does not show."""
    return F.greatest(F.octet_length(content) - limit, F.lit(0))


def hexdump(content: Column, limit: int | None = 4096) -> Column:
    """Array of ``offset, hex, ascii`` rows of 16 bytes of the first ``limit`` bytes (of all for None)."""
    shown = content if limit is None else F.substring(content, 1, limit)
    n = F.octet_length(shown)

    def row(start: Column) -> Column:
        part = F.substring(shown, (start + 1).cast("int"), F.lit(16))
        ascii_text = F.regexp_replace(latin1(part), r"(?s)[^\x20-\x7E]", ".")
        return F.struct(
            F.lpad(F.lower(F.hex(start)), 8, "0").alias("offset"), F.regexp_replace(F.lower(F.hex(part)), r"(..)(?=.)", "$1 ").alias("hex"), ascii_text.alias("ascii")
        )

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(16)), row)).otherwise(F.array().cast("array<struct<offset:string,hex:string,ascii:string>>"))


def hex_lines(content: Column, limit: int = 4096) -> Column:
    """``hexdump`` as lines of text: offset, bytes with a wider gap after the eighth, printable characters; at last how many bytes are not shown."""
    lines = F.transform(
        hexdump(content, limit),
        lambda r: F.concat(r["offset"], F.lit("  "), F.rpad(F.when(F.length(r["hex"]) > 23, F.concat(F.substring(r["hex"], 1, 23), F.lit(" "), F.substring(r["hex"], 24, 24))).otherwise(r["hex"]), 50, " "), r["ascii"]),
    )
    more = F.concat(F.lit("… "), hidden_bytes(content, limit).cast("string"), F.lit(" more bytes"))
    return F.when(hidden_bytes(content, limit) > 0, F.concat(lines, F.array(more))).otherwise(lines)
