"""Signatures of texts for near-duplicate search: shared by problems 1 and 2.

A text's alikeness to another is the Jaccard similarity of their sets of word runs,
in reading form.  Texts with one and the same set form a class, known
by a 64-bit fingerprint of the set; search runs over classes, so copies never
meet each other pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .workspace import slices

#: Coordinates of a signature.
K = 64
#: The sketch holds the lowest 3 bits of the first 63 coordinates, 21 to a long.
SKETCHED, FIELDS = 63, 21
_MASK = sum(1 << (3 * i) for i in range(FIELDS))
#: Part of the pairs at the threshold itself that signatures have to find; pairs that are more alike are lost less.
RECALL = 0.9999

SIGNED = [T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), *(T.StructField(f"s{i}", T.LongType()) for i in range(3)), T.StructField("sig", T.BinaryType()), T.StructField("shingles", T.BinaryType())]


def _binary(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def sign(texts: pa.Array, width: int, coords: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Rows that hold at least one shingle, and the columns of SIGNED for them; ``sig`` holds the coordinates asked for."""
    h, off = w.shingle_sets(texts, width)
    n = np.diff(off)
    some = np.flatnonzero(n)
    if not len(some):
        return some, []
    at = off[:-1][some]
    fp = w.mix(np.add.reduceat(w.mix(h), at) + n[some].astype(np.uint64))
    sig = w.minhashes(h, off, K)[some]
    field = (sig[:, :SKETCHED] & 7).astype(np.uint64).reshape(-1, 3, FIELDS)
    sketch = (field << (np.arange(FIELDS, dtype=np.uint64) * np.uint64(3))).sum(axis=2, dtype=np.uint64)
    ends = np.append(at, off[-1])
    return some, [
        pa.array(fp.view(np.int64)),
        pa.array(n[some].astype(np.int32)),
        *(pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(3)),
        _binary(np.ascontiguousarray(sig[:, coords]), np.arange(len(some) + 1) * (4 * len(coords))),
        _binary(h, ends * 8),
    ]


def signed(df: DataFrame, text: str, width: int, coords: np.ndarray) -> DataFrame:
    """``df`` without ``text`` but with the columns of SIGNED; texts without a shingle (null, or under ``width`` words) are left out: they are like nothing."""
    keep = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType(keep + SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        for whole in batches:
            for b in slices(whole, [text]):
                rows, cols = sign(b.column(text), width, coords)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([b.column(f.name).take(pa.array(rows)) for f in keep] + cols, names)

    return df.where(F.col(text).isNotNull()).mapInArrow(run, schema)


def sig_array(col: pa.Array) -> np.ndarray:
    """(rows, coordinates) of a binary column of signatures without nulls."""
    n = len(col)
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1]
    flat = np.frombuffer(col.buffers()[2], np.uint32)[at[0] // 4 : at[-1] // 4]
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def hash_lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat 64-bit hashes of a binary column without nulls, and the row of each."""
    n = len(col)
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    return np.frombuffer(col.buffers()[2], np.uint64)[at[0] // 8 : at[-1] // 8], np.repeat(np.arange(n), np.diff(at) // 8)


def too_few(n: int, p: float, k: int) -> float:
    """Chance that fewer than ``k`` of ``n`` coordinates collide, each with chance ``p``."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))


def least_fields(threshold: float, miss: float) -> int:
    """Fewest colliding fields of the sketch that a pair at ``threshold`` has, but for a chance of ``miss``."""
    p = threshold + (1 - threshold) / 8
    return next(k for k in range(SKETCHED, -1, -1) if too_few(SKETCHED, p, k) <= miss)


def colliding(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many of the sketched coordinates collide, row by row, between packed sketches."""
    out = np.full(len(a[0]), SKETCHED, np.int16)
    for x, y in zip(a, b):
        d = (x ^ y).view(np.uint64)
        d = (d | d >> np.uint64(1) | d >> np.uint64(2)) & np.uint64(_MASK)
        out -= np.bitwise_count(d)
    return out


def alike_sizes(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two sets of these sizes can be alike enough (exact)."""
    return np.minimum(a, b) >= np.maximum(a, b) * threshold


def expand(first: np.ndarray, count: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, first[i] + 0 .. count[i] - 1) in parts of about ``most``."""
    total = np.cumsum(count)
    a = 0
    while a < len(count):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        c = count[a:z]
        i = np.repeat(np.arange(a, z), c)
        yield i, np.repeat(first[a:z] - (np.cumsum(c) - c), c) + np.arange(len(i))
        a = z


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Size of the intersection of two columns of sorted distinct 64-bit hashes, row by row."""
    (ha, ra), (hb, rb) = hash_lists(a), hash_lists(b)
    h, r = np.concatenate([ha, hb]), np.concatenate([ra, rb])
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    return np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=len(a))


@F.arrow_udf(T.IntegerType())
def overlap_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    parts = [overlap(a.slice(i, 4096), b.slice(i, 4096)) for i in range(0, len(a), 4096)]
    return pa.array(np.concatenate(parts).astype(np.int32)) if parts else pa.array([], pa.int32())


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) of class fingerprints with exact alikeness of at least ``threshold``."""
    side = lambda x: classes.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"sh_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.withColumn("common", overlap_udf("sh_a", "sh_b"))
    return both.withColumn("alikeness", F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).where(F.col("alikeness") >= threshold).select("a", "b", "alikeness")


def classes_of(rows: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """One row for each set of shingles: its copies collapse before any pair is made."""
    same = [F.first(c).alias(c) for c in ("n", "s0", "s1", "s2", "sig", "shingles")]
    return rows.groupBy("fp").agg(*same, *(extra or []))
