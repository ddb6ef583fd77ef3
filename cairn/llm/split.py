"""Splitting oversized items at natural boundaries (problem 3).

Method: pointer doubling.  Every place of a text points to its successor: the
farthest legal cut whose piece, with the overlap before it, stays within the
limit, at the strongest kind of boundary there is in the far half of the piece.
Squaring the successor table again and again gives the 2nd, 4th, 8th ...
successor of every place, and from these all cuts of the greedy walk at once,
for all texts of an Arrow batch side by side.

Pieces: a text is taken without spaces, tabs and line breaks at either end; its
pieces are within ``most`` code points each; every piece after the first begins
exactly ``overlap`` code points before the end of the one before.  A cut never
parts CR from LF, a mark from its letter, or a joined emoji.

Defined results: null texts and texts of blanks give no piece; a text within the
limit gives one piece; redelivered rows count once; ``overlap`` must be smaller
than ``most``.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .workspace import slices

_MAX = 0x110000
# Characters that end a sentence or a clause, and those that may close it.
SENTENCE, CLAUSE, CLOSING = ".!?…。！？；", ",;:，、：", "\"'”’»)]）」』】"
#: Kinds of boundaries, strongest first: paragraph, line, sentence, clause, word.
KINDS = 5


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    stuck = np.zeros(_MAX, bool)  # never begins a piece: marks, joiners, selectors, skin tones
    for c in (*range(0x300, 0x3200), *range(0xFE00, 0xFE30), *range(0x1D100, 0x1D300)):
        stuck[c] = ud.category(chr(c))[0] == "M"
    stuck[[0x200C, 0x200D]] = True
    stuck[0x1F3FB:0x1F400] = True
    kind = np.zeros(_MAX, np.uint8)
    for s, k in ((SENTENCE, 1), (CLAUSE, 2), (CLOSING, 3)):
        kind[[ord(c) for c in s]] = k
    for c in (0x20, 0x09, 0x3000, 0xA0):
        kind[c] = 4
    kind[[0x0A, 0x0D, 0x2028, 0x2029]] = 5
    kind[0x4E00:0xA000] = 6
    return stuck, kind


def boundaries(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(KINDS, n + 1) whether a cut before each place is a boundary of each kind, and whether a cut is allowed at all."""
    stuck, table = _tables()
    n = len(cps)
    k = table[cps]
    allowed = np.ones(n + 1, bool)
    allowed[:n] = ~stuck[cps]
    allowed[1:n] &= ~((cps[:-1] == 0x200D) | ((cps[:-1] == 0x0D) & (cps[1:] == 0x0A)))
    out = np.zeros((KINDS, n + 1), bool)
    if not n:
        return out, allowed
    idx = np.arange(n)
    blank = (k == 4) | (k == 5)
    # the last place before p that isn't blank, and before that isn't closing either
    solid = np.maximum.accumulate(np.where(~blank, idx, -1))
    breaks = np.cumsum(np.where((k == 5) & ~((cps == 0x0A) & (np.append(0, cps[:-1]) == 0x0D)), 1, 0))
    p = idx  # cut after place p, before p + 1
    next_solid = np.append(~blank[1:], True)
    after = p[next_solid]  # a boundary stands where blanks end
    seen = solid[after]
    n_breaks = breaks[after] - np.where(seen >= 0, breaks[np.maximum(seen, 0)], 0)
    end = after + 1
    out[0, end[n_breaks >= 2]] = True
    out[1, end[n_breaks >= 1]] = True
    core = np.maximum.accumulate(np.where(~blank & (k != 3), idx, -1))[after]
    last = np.where(core >= 0, k[np.maximum(core, 0)], 0)
    gap = seen < after
    wide = np.where(core >= 0, cps[np.maximum(core, 0)] >= 0x2E80, False)
    out[2, end[(last == 1) & (gap | wide)]] = True
    out[3, end[(last == 2) & (gap | wide)]] = True
    han = np.zeros(len(after), bool)
    han[:-1] = (k[after[:-1]] == 6) & (k[np.minimum(after[:-1] + 1, n - 1)] == 6)
    out[4, end[gap | han]] = True
    out &= allowed
    return out, allowed


def cuts(cps: np.ndarray, off: np.ndarray, most: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every piece's end, in order; places count within ``cps``."""
    n, rows = len(cps), len(off) - 1
    lens = np.diff(off)
    live = np.flatnonzero(lens > 0)
    if not len(live):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # each text has places 0..len: one more than code points
    base = off[:-1] + np.arange(rows)
    size = n + rows
    row = np.repeat(np.arange(rows), lens + 1)
    place = np.arange(size) - base[row]
    bounds = np.zeros((KINDS, size), bool)
    allowed = np.ones(size, bool)
    marks, ok = boundaries(cps)  # boundaries across texts are undone below
    at_ = np.minimum(off[row] + place, n)
    bounds[:], allowed[:] = marks[:, at_], ok[at_]
    bounds[:, place == 0] = False
    end = base + lens
    # farthest place in reach of a piece that ends (with its overlap) at each place
    reach = np.minimum(place - overlap[row] + most[row], lens[row]) + base[row]
    least = np.arange(size) + np.maximum(1, (most[row] - overlap[row]) // 2)

    def choose(hi: np.ndarray, lo: np.ndarray, first: np.ndarray) -> np.ndarray:
        nxt = np.where(hi >= end[first], end[first], -1)
        for k in range(KINDS):
            seen = last[k][hi]
            nxt = np.where((nxt < 0) & (seen >= lo), seen, nxt)
        hard = last_ok[hi]
        return np.where(nxt < 0, np.where(hard >= lo, hard, hi), nxt)

    idx = np.arange(size)
    last = [np.maximum.accumulate(np.where(bounds[k], idx, -1)) for k in range(KINDS)]
    last_ok = np.maximum.accumulate(np.where(allowed, idx, -1))
    succ = choose(reach, least, row)
    succ[end] = end
    first = choose(np.minimum(most[live], lens[live]) + base[live], base[live] + np.maximum(1, (most[live] + 1) // 2), live)
    # squares of the successor table
    tables = [succ]
    longest = int(np.max(np.ceil(lens / np.maximum(1, (most - overlap) // 2))))
    while (1 << len(tables)) <= longest:
        tables.append(tables[-1][tables[-1]])
    found = first
    for t in reversed(tables):
        found = np.unique(np.concatenate([found, t[found]]))
    return row[found], place[found]


def _strip(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each row without blanks (space, tab, line breaks) at its ends."""
    solid = ~np.isin(cps, (0x20, 0x09, 0x0A, 0x0D))
    places = np.flatnonzero(solid)
    row = np.searchsorted(off, places, side="right") - 1
    rows = len(off) - 1
    start, length = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if len(places):
        head = np.ones(len(row), bool)
        head[1:] = row[1:] != row[:-1]
        tail = np.append(head[1:], True)
        start[row[head]] = places[head]
        length[row[tail]] = places[tail] + 1 - start[row[tail]]
    return start, length


def pieces(df: DataFrame, text: str, most: str = "max_chars", overlap: str = "overlap_chars", texts: bool = True) -> DataFrame:
    """Pieces of every text: the other columns, and piece_no (from 0), pieces, start, n_chars (code points of the stripped text), piece.

    ``most`` and ``overlap`` name integer columns.  Without ``texts`` the pieces' text is left null.
    """
    keep = [f for f in df.schema.fields if f.name not in (text, most, overlap)]
    from pyspark.sql import types as T

    schema = T.StructType(keep + [T.StructField("piece_no", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("piece", T.StringType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, [text]):
                cps, off = at.to_codepoints(b.column(text))
                start, length = _strip(cps, off)
                m, o = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (most, overlap))
                if (o >= m).any():
                    raise ValueError("the overlap must be smaller than the limit")
                inner = np.zeros(len(off), np.int64)
                np.cumsum(length, out=inner[1:])
                body = cps[np.repeat(start - inner[:-1], length) + np.arange(inner[-1])]
                row, end = cuts(body, inner, m, o)
                if not len(row):
                    continue
                new = np.ones(len(row), bool)
                new[1:] = row[1:] != row[:-1]
                begin = np.where(new, 0, np.append(0, end[:-1]) - o[row])
                heads = np.flatnonzero(new)
                no = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
                total = np.bincount(row, minlength=len(length))[row]
                size = end - begin
                if texts:
                    out = np.zeros(len(row) + 1, np.int64)
                    np.cumsum(size, out=out[1:])
                    piece = at.from_codepoints(body[np.repeat(inner[row] + begin - out[:-1], size) + np.arange(out[-1])], out)
                else:
                    piece = pa.nulls(len(row), pa.string())
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(f.name).take(pick) for f in keep), pa.array(no.astype(np.int32)), pa.array(total.astype(np.int32)), pa.array(begin), pa.array(size), piece.cast(pa.string())], names)

    return df.where(F.col(text).isNotNull()).mapInArrow(run, schema)
