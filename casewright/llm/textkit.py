"""Vectorised tokenising and hashing of whole Arrow text columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, which for UTF-8
are exactly the runs of code points outside that class. A word's hash is a sum
of random 64-bit values by byte and place modulo 2**64, finished by a mixer, so
that a block of many documents is hashed by a few numpy passes. Work goes in
blocks of about a quarter of a megabyte: memory stays bounded however long the batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


_RAW_VALUES = _byte_values()
_LOWER_VALUES = _RAW_VALUES[_LOWER]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES * 2)
        base = 0xD6E8FEB86659FD93
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of a block, given each byte's value; the same for equal bytes anywhere."""
    if not len(values):
        return np.zeros(len(starts), dtype=np.uint64)
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its len+1 offsets; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, next row, bytes, offsets) of about ``limit`` bytes; a longer text comes alone."""
    buf, offs = text_buffer(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_spans(buf: np.ndarray, offs: np.ndarray, members: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word, or of every run of the bytes in ``members``; runs never cross rows."""
    if not len(buf):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    solid = members[buf]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    filled = offs[1:] > offs[:-1]
    before[offs[:-1][filled]] = False
    after[offs[1:][filled] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word in order; ``lower`` folds A-Z."""
    starts, ends, rows = word_spans(buf, offs)
    return span_hashes((_LOWER_VALUES if lower else _RAW_VALUES)[buf], starts, ends), rows


def word_hash(word: str, lower: bool = True) -> int:
    """The hash that ``words`` gives to one word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    found, _ = words(raw, np.array([0, len(raw)], dtype=np.int64), lower)
    return int(found[0])


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words; a shorter, non-empty text is one run of all its words."""
    counts = np.bincount(rows, minlength=n_rows)
    if len(hashes) >= width:
        run = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
        for k in range(width):
            run = run * np.uint64(_ODD) + hashes[k : len(hashes) - width + 1 + k]
        same = rows[: len(run)] == rows[width - 1 :]
        run, at = mix(run[same] + np.uint64(width)), rows[: len(run)][same]
    else:
        run, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width)) if whole_if_short else ()
    if len(short):
        first = np.cumsum(counts) - counts
        extra = []
        for row in short:
            value = 0
            for h in hashes[first[row] : first[row] + counts[row]].tolist():
                value = (value * _ODD + h) & 0xFFFFFFFFFFFFFFFF
            extra.append((value + int(counts[row])) & 0xFFFFFFFFFFFFFFFF)
        run = np.concatenate([run, mix(np.array(extra, dtype=np.uint64))])
        at = np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        run, at = run[order], at[order]
    return run, at


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ordered by row and value; rows come in ascending order."""
    if not len(values):
        return values, rows
    order = np.lexsort((values, rows)) if len(np.unique(rows)) > 1 else np.argsort(values)
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]


def row_bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """n_rows+1 offsets of each row's entries in a list ordered by row."""
    return np.searchsorted(rows, np.arange(n_rows + 1))
