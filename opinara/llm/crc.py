"""CRC-32 of many byte spans at once, as matrices of spans of equal length."""

from __future__ import annotations

import zlib

import numpy as np

# Fixed value of CRC-32: the reflected polynomial.
POLYNOMIAL = 0xEDB88320
MATRIX_BYTES = 1_000_000  # of one matrix
WIDEST = 512  # bytes of a row; longer spans are few in any run and are read one by one

ALL = np.uint32(0xFFFFFFFF)
EIGHT = np.uint32(8)


def _table() -> np.ndarray:
    """What one byte does to the state."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1))
    return table


TABLE = _table()


def span_crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of ``data[start[i]:end[i]]`` for every ``i``, in their order.

    ``before``: CRC-32 of the bytes that precede each span. Spans may overlap, repeat or
    be empty. Those of equal length stand as rows of one matrix; all states take its
    columns one after another.
    """
    before = np.zeros(len(start), np.uint32) if before is None else before.astype(np.uint32)
    result = np.empty(len(start), dtype=np.uint32)
    lengths = end - start
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        width = int(lengths[group[0]]) if len(group) else 0
        if width > WIDEST:
            for i in group:
                result[i] = zlib.crc32(data[start[i] : end[i]], int(before[i]))
            continue
        if width == 0:
            result[group] = before[group]
            continue
        places = np.arange(width)[:, None]
        step = max(1, MATRIX_BYTES // width)
        for low in range(0, len(group), step):
            take = group[low : low + step]
            state = before[take] ^ ALL
            for column in data.take(start[take] + places):  # one column a byte position
                state = TABLE.take(state.astype(np.uint8) ^ column, mode="clip") ^ (state >> EIGHT)
            result[take] = state ^ ALL
    return result
