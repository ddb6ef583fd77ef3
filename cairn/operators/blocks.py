"""Many queries against many texts, block by block: what a task holds is one block of each side, as arrays.

Rows are dealt to blocks by a hash of their id.  Each pair of blocks is one group of
a cogroup; it gives the few best of its block for each query, and the best of all
blocks are the best of all.  Only tokens are shuffled, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of texts and of queries at most, about; the least number of blocks of texts, and the least rows worth a block.
TEXTS, QUERIES, LEAST, WORTH = 32_768, 65_536, 12, 2_048
#: Elements under one maximum when the best of a block are sought.
STRIDE = 64


def grid(texts: DataFrame, n_texts: int, queries: DataFrame, n_queries: int, text_key: str, query_key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_b`` and ``_q``, the numbers of their pair of blocks; each row once for each block of the other side."""
    blocks = max(1, -(-n_texts // TEXTS), min(LEAST, n_texts // WORTH))
    parts = max(1, -(-n_queries // QUERIES))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return texts.withColumn("_b", part(text_key, blocks)).withColumn("_q", each(parts)), queries.withColumn("_q", part(query_key, parts)).withColumn("_b", each(blocks))


def paired(texts: DataFrame, queries: DataFrame, run, schema: str) -> DataFrame:
    """``run`` (texts, queries: Arrow tables, giving one) for each pair of blocks."""
    return queries.groupBy("_b", "_q").cogroup(texts.groupBy("_b", "_q")).applyInArrow(lambda q, t: run(t, q), schema)


def best(found: DataFrame, key: str, k: int) -> DataFrame:
    """(key, top): the ``k`` least structs of the lists ``top`` of each key."""
    return found.groupBy(key).agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))


def lists(column) -> tuple[pa.Array, np.ndarray]:
    """Values of a column of lists, and where each list begins and ends among them."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(a), np.concatenate(([0], np.cumsum(n))).astype(np.int64)


class Postings:
    """Rows (ascending) under each code, with a weight each: sparse, or a whole row of zeros and weights for codes that many rows hold."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_codes: int, n_rows: int):
        by = np.lexsort((rows, codes))
        self.rows, self.weights, self.n = rows[by].astype(np.intp), weights[by], n_rows
        self.at = np.searchsorted(codes[by], np.arange(n_codes + 1))
        self.dense: dict[int, np.ndarray] = {}

    def add(self, to: np.ndarray, code: int, times: float = 1) -> None:
        a, b = self.at[code], self.at[code + 1]
        if (b - a) * 8 < self.n:
            to[self.rows[a:b]] += self.weights[a:b] if times == 1 else self.weights[a:b] * times
            return
        if code not in self.dense:
            row = np.zeros(len(to), to.dtype)
            row[self.rows[a:b]] = self.weights[a:b]
            self.dense[code] = row
        row = self.dense[code]
        np.add(to, row if times == 1 else row * times, out=to)


def room(n: int, dtype=np.float64) -> np.ndarray:
    """Zeros for ``n`` rows, up to a whole number of strides."""
    return np.zeros(max(1, -(-n // STRIDE)) * STRIDE, dtype)


def reaching(scores: np.ndarray, k: int) -> np.ndarray:
    """Places, ascending, of positive scores among which are the ``k`` best and all that tie with them.

    The k-th of the maxima of groups is a bound: k groups have a score that reaches it.
    """
    tops = scores.reshape(STRIDE, -1).max(axis=0)
    bound = np.partition(tops, len(tops) - k)[len(tops) - k] if len(tops) > k else 0.0
    return np.flatnonzero(scores >= bound - 1e-8) if bound > 1e-8 else np.flatnonzero(scores > 0)
