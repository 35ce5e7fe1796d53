"""Fill-in-the-middle transformation over an index of distinct texts.

Identical texts are grouped by their content, documents are joined back to their
text as id and key, the token boundaries of a text are computed once as an
Elias-Fano list when its first document comes, and each document selects its
seeded cuts from the list.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import text_chunks

#: Partitions over which the copies of one very common text are dealt.
SALTS = 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_HEAD = struct.Struct("<qqB")


def encode(values: np.ndarray) -> bytes:
    """A non-decreasing list of numbers from 0 on, in Elias-Fano form.

    Of each number the low bits stand as they are, and the high bits as a one at
    place ``high part + rank`` of a bit string, about two bits a number.
    """
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0)
    last = int(values[-1])
    low = max(0, (last // n).bit_length() - 1)
    high = np.zeros((last >> low) + n, bool)
    high[(values >> low) + np.arange(n)] = True
    lows = (values[:, None] >> np.arange(low)) & 1
    return _HEAD.pack(n, last, low) + np.packbits(high).tobytes() + np.packbits(lows.astype(bool)).tobytes()


def select(coded: bytes, rank: int) -> int:
    """The number at ``rank`` (from 0): its one is found by counting bits a byte at a time, then its low bits are read."""
    n, last, low = _HEAD.unpack_from(coded)
    size = ((last >> low) + n + 7) // 8
    high = np.frombuffer(coded, np.uint8, size, _HEAD.size)
    ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
    byte = int(np.searchsorted(ones, rank + 1))
    left = rank - (int(ones[byte - 1]) if byte else 0)
    place = byte * 8 + int(np.flatnonzero(np.unpackbits(high[byte : byte + 1]))[left])
    if not low:
        return place - rank
    first = rank * low
    bits = np.unpackbits(np.frombuffer(coded, np.uint8, (first + low - 1) // 8 - first // 8 + 1, _HEAD.size + size + first // 8))[first % 8 :][:low]
    return (place - rank) << low | int(bits @ (1 << np.arange(low)))


def boundaries(column: pa.Array) -> Iterator[np.ndarray]:
    """Ends of the tokens of each text, in code points.

    A token is a run of other characters with the ``[\\x20\\x09-\\x0D]`` before
    it; what of those stands last is a token too. So tokens end where runs of
    other characters end, and at the end of the text.
    """
    for _, _, data, offsets in text_chunks(column):
        space = _SPACE[data]
        ends = ~space
        ends[:-1] &= space[1:]
        filled = np.flatnonzero(np.diff(offsets))
        ends[offsets[filled + 1] - 1] = True
        points = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)
        at = np.flatnonzero(ends)
        places = np.searchsorted(at, offsets)
        before = np.concatenate(([0], points))[offsets]
        for i in range(len(offsets) - 1):
            yield points[at[places[i] : places[i + 1]]] - before[i]


def _texts(rows: DataFrame) -> DataFrame:
    """``_key, _text`` of each distinct text, which all rows of the key must share."""
    one = rows.groupBy("_key").agg(F.collect_set("_text").alias("_texts"))
    text = F.when(F.size("_texts") == 1, F.get("_texts", F.lit(0))).otherwise(F.raise_error(F.lit("two texts have one SHA-256")))
    return one.select("_key", text.alias("_text"))


def _cutter(rate: int, suffix_first: int, sentinels: tuple[str, str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    p, s, m = sentinels

    def made(text: str, n: int, coded: bytes, numbers: tuple[int, ...]) -> tuple[str, int | None, int | None, str]:
        if not n or any(x in text for x in sentinels) or numbers[2] % 100 >= rate:
            return "plain", None, None, text
        one, two = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
        a, b = (select(coded, x - 1) if x else 0 for x in (one, two))
        if numbers[3] % 100 < suffix_first:
            return "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
        return "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, so a list is made where the key changes, and kept until it does again."""
        key, n, coded = None, 0, b""
        for batch in batches:
            keys = batch.column(1).to_pylist()
            new = [i for i, x in enumerate(keys) if x != (keys[i - 1] if i else key)]
            lists = dict(zip(new, boundaries(batch.column(2).take(pa.array(new, pa.int64()))), strict=True))
            rows = []
            for i, (text, *numbers) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 7)), strict=True)):
                if i in lists:
                    n, coded = len(lists[i]), encode(lists[i])
                rows.append((n, *made(text, n, coded, numbers)))
            key = keys[-1] if keys else key
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return cut_all


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that ``output`` was made from, read from the output and its form alone (no two sentinels may overlap)."""
    prefix, suffix, middle = (F.lit(s) for s in sentinels)

    def between(left: Column, right: Column) -> Column:
        start = F.position(left, output) + F.length(left)
        return F.substring(output, start, F.position(right, output) - start)

    tail = F.substring(output, F.position(middle, output) + F.length(middle), F.length(output))
    psm = F.concat(between(prefix, suffix), tail, between(suffix, middle))
    spm = F.concat(between(prefix, middle), tail, between(suffix, prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    rate: int = 50,
    suffix_first: int = 80,
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
) -> DataFrame:
    """Turn ``rate`` per cent of the texts into prefix, suffix and middle, of those ``suffix_first`` per cent with the suffix first.

    The SHA-256 of ``seed:id`` gives a document's numbers: two cuts between
    tokens, whether it is changed, and in which form. Returns ``id, n, form,
    prefix_chars, middle_chars, output``, one row for each input row: tokens,
    ``plain``, ``psm`` or ``spm``, code points of the parts (null if plain).

    Edge cases: a null text is an empty one; an empty text, or one that holds a
    sentinel, stays plain; a null id has the seed with nothing after it; rows
    that repeat an id are cut alike if their texts are the same; an empty table
    gives an empty table; columns not named are ignored.

    At scale: the text of each content is shuffled once, after copies of it have
    met in each task; documents come to it as id and key only, in the order of
    keys, and one Elias-Fano list (some five bits a token) serves them all. A
    group is one text if all its rows are equal as text, not only by their key;
    else the job ends with an error. Copies of a text that more than a thousandth of all rows (1000 at
    least) share, of which there can't be more than a thousand, are dealt over
    ``SALTS`` partitions; the broadcast list of such keys has at most that many.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_key", F.unhex(F.sha2("_text", 256)))
    counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"))
    common = max(1000, docs.count() // 1000)
    hot = cut(counts.filter(F.col("_rows") > common).select("_key", F.lit(True).alias("_hot")))
    marked = rows.join(F.broadcast(hot), "_key", "left")
    usual, often = marked.filter("_hot IS NULL"), marked.filter("_hot")
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    salted = _texts(often).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]
    kind = docs.schema[id_col].dataType.simpleString()

    def cut_up(joined: DataFrame) -> DataFrame:
        given = joined.select("_id", "_key", "_text", *numbers).sortWithinPartitions("_key")
        return given.mapInArrow(_cutter(rate, suffix_first, sentinels), f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")

    made = cut_up(usual.select("_id", "_key").join(_texts(usual), "_key"))
    made = made.unionByName(cut_up(often.select("_id", "_key", salt.alias("_salt")).join(salted, ["_key", "_salt"])))
    return made.withColumnRenamed("_id", id_col)
