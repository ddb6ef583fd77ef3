"""Arrow string columns as flat numpy code-point arrays, and back.

A column becomes ``(cps, off)``: all code points end to end (uint32) and the row
offsets into them (int64, one more than rows).  Conversions are whole-buffer
operations; no call is made per row.  Null rows are empty here; callers keep
the column's validity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Arrow's 32-bit string offsets end here; larger outputs use large_string.
_MAX_STRING = 2**31 - 1


def to_codepoints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat code points and row offsets of a string column (nulls as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    first, last = int(off[0]), int(off[-1])
    if last == first:
        return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[first:last]
    if not (raw & 0x80).any():
        return raw.astype(np.uint32), off - first
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.zeros(last - first + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    return cps, heads[off - first]


def from_codepoints(cps: np.ndarray, off: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """String column of flat code points; ``nulls`` marks rows to be null."""
    cps = np.ascontiguousarray(cps, np.uint32)
    text = cps.tobytes().decode("utf-32-le", "replace")
    data = text.encode("utf-8", "replace")
    if len(data) == len(cps):
        at = off.astype(np.int64)
    else:
        ends = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000), out=ends[1:])
        at = ends[off]
    valid = None
    if nulls is not None and nulls.any():
        valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    if len(data) > _MAX_STRING:
        return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(at), pa.py_buffer(data), valid)
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data), valid)


def null_mask(col: pa.Array) -> np.ndarray:
    return col.is_null().to_numpy(zero_copy_only=False)


def row_of(off: np.ndarray) -> np.ndarray:
    """Row number of each code point."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def take_rows(cps: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen rows, end to end."""
    lens = (off[1:] - off[:-1])[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    idx = np.repeat(off[:-1][rows] - out[:-1], lens) + np.arange(out[-1])
    return cps[idx], out
