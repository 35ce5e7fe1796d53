"""Word and shingle hashes of whole texts, computed with numpy over Arrow batches.

The operators that read word n-grams run these helpers inside ``mapInArrow``
tasks. Nothing here loops over words: a chunk of texts is one byte array, word
boundaries are found on the bytes, and the hash of a word is the difference of
two prefix sums of a polynomial hash (arithmetic modulo 2**64).

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; only A-Z is lowered, so
working on UTF-8 bytes gives the same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer text forms a chunk of its own).
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 3
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BYTE_VALUE = _BYTE_VALUE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit (xor-shift-multiply)."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string or binary column into runs of rows of about ``limit`` bytes.

    Yields ``(first row, end row, bytes, offsets)``; offsets has one entry more
    than there are rows and starts at 0. Null rows have no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, row, start byte, end byte)`` of every word of a chunk, in order."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    inside = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    cuts = inside & ~before
    cuts[firsts] = inside[firsts]
    starts = np.flatnonzero(cuts)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends_mask = inside & ~after
    ends_mask[lasts] = inside[lasts]
    ends = np.flatnonzero(ends_mask) + 1
    up, down = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return h, rows, starts, ends


def shingles(h: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of each run of ``n`` words; a shorter text is one shingle, a text without words none."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(counts) - counts
    factors = [mix(np.array([0x5851F42D4C957F2D + 2 * i], np.uint64))[0] | _U(1) for i in range(n)]
    total = max(0, len(h) - n + 1)
    acc = np.zeros(total, np.uint64)
    for i in range(n):
        acc += mix(h[i : i + total] + _U(i + 1)) * factors[i]
    whole = rows[:total] == rows[n - 1 :] if total else np.zeros(0, bool)
    out_h, out_r = mix(acc[whole]), rows[:total][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = counts[short] > i
            extra[has] += mix(h[first[short[has]] + i] + _U(i + 1)) * factors[i]
        out_h = np.concatenate([out_h, mix(extra + counts[short].astype(np.uint64))])
        out_r = np.concatenate([out_r, short])
    return out_h, out_r


def shingle_sets(h: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as ``(hash, row offsets)``: sorted by row, then by hash."""
    sh, sr = shingles(h, rows, n_rows, n)
    order = np.lexsort((sh, sr))
    sh, sr = sh[order], sr[order]
    keep = np.ones(len(sh), bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])
    sh, sr = sh[keep], sr[keep]
    counts = np.bincount(sr, minlength=n_rows)
    return sh, np.concatenate([[0], np.cumsum(counts)])
