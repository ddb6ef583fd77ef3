"""Mixing sources to target weights (problem 7).

Method: the documents of a source, in pseudorandom order, are laid end to end and
their tokens cut into blocks of fixed length.  A mix gets a number of slots of
one block; each output shard draws how many of its slots come from each source
(multinomial, given the mix's totals, so that a cap holds exactly and not on
average).  The j-th slot of a source in a mix maps to a block by a pseudorandom
permutation of that source's block numbers, a fresh one for each pass, and joins
the block by its number.  A pass uses every block at most once, so a document is
used at most ``max_repeats`` times in all.

A source whose target exceeds max_repeats times its tokens gives all of that, and
the rest of the budget goes to the other sources by weight.

Defined results: documents without source, text or tokens give nothing;
redelivered documents count once; sources of a plan without documents have an
actual share of 0; a mix without tokens comes out empty.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .workspace import slices, written

#: Tokens of a block, and blocks of an output shard.
LENGTH, SHARD = 256, 4096
#: Documents to a part of a source's order: parts are laid end to end by their sums.
PART = 20_000
# Fixed value: how a byte-level BPE text is cut before its merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, tokenizer: str) -> DataFrame:
    """``df`` with n_tokens (int) in place of ``text``; null texts have none.

    ``tokenizer`` is the path of a vocabulary file on the driver; its content, a few
    MB by its nature, goes to the executors.
    """
    from pyspark.sql import types as T

    with open(tokenizer, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary.value)
        for whole in batches:
            for b in slices(whole, [text]):
                n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(n, pa.int32())], [*(f.name for f in keep), "n_tokens"])

    return df.mapInArrow(run, T.StructType(keep + [T.StructField("n_tokens", T.IntegerType())]))


def laid_out(sized: DataFrame, key: str, seed: int = 11) -> DataFrame:
    """(source, key, n_tokens, first): where each document's tokens begin in its source's pseudorandom order.

    A running sum within parts of about PART documents, after a running sum of the
    parts' totals: no task holds a whole source.
    """
    from pyspark.sql import Window

    rows = sized.count()
    parts = max(1, -(-rows // PART))
    d = sized.withColumn("_at", F.xxhash64(F.lit(seed), key)).withColumn("_part", F.pmod("_at", F.lit(parts)))
    sums = d.groupBy("source", "_part").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("source", "_part").orderBy("_at", key).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return d.join(sums, ["source", "_part"]).select("source", key, "n_tokens", (F.col("_base") + F.col("_in")).alias("first"))


def allocate(target: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Shares of sum(target): each at most ``most``; what capped ones leave goes to the rest by weight."""
    out = np.zeros(len(target))
    open_ = target > 0
    left = float(target.sum())
    while left > 1e-9 and open_.any():
        want = np.where(open_, target, 0)
        want = want / want.sum() * left
        over = open_ & (want >= most)
        if not over.any():
            return np.where(open_, want, out)
        out[over] = most[over]
        left -= float(most[over].sum())
        open_ &= ~over
    return out


_ROUNDS = w.mix(np.arange(6, dtype=np.uint64))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, at ``index``: a Feistel network over the next even power of two, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(len(_ROUNDS)):
            left, right = right, left ^ (w.mix(right + k + _ROUNDS[r]) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= size[todo].astype(np.uint64)]
    return x.astype(np.int64)


def hypergeometric(u: float, good: int, bad: int, size: int) -> int:
    """How many of ``size`` draws without replacement are good, for a uniform ``u``: the distribution inverted, alike at every size."""
    low, high = max(0, size - bad), min(good, size)
    n = good + bad
    if low >= high or not n:
        return low
    middle = min(high, max(low, (size + 1) * (good + 1) // (n + 2)))
    # beyond twelve deviations there is less than a double can tell
    reach = 12 + int(12 * math.sqrt(size * (good / n) * (bad / n) * ((n - size) / max(1, n - 1))))
    first, last = max(low, middle - reach), min(high, middle + reach)
    k = np.arange(first, last, dtype=np.float64)
    step = np.log(good - k) + np.log(size - k) - np.log(k + 1) - np.log(bad - size + k + 1)
    log_p = np.append(0.0, np.cumsum(step))
    total = np.cumsum(np.exp(log_p - log_p.max()))
    return first + int(min(np.searchsorted(total, u * total[-1], side="right"), last - first))


@lru_cache(1 << 12)
def _half(totals: tuple[int, ...], size: int, seed: tuple[int, ...]) -> tuple[int, ...]:
    """What of each source's slots goes to the first half of some shards, of ``size`` slots."""
    rng, rest, out = np.random.default_rng(seed), sum(totals), []
    for n in totals:
        rest -= n
        out.append(hypergeometric(rng.random(), n, rest, size))
        size -= out[-1]
    return tuple(out)


def shards_of(slots: int) -> int:
    return -(-slots // SHARD)


def shard_counts(totals: tuple[int, ...], shard: int, seed: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """(first, count) of the slots of each source in a shard, drawn without replacement from the mix's totals."""
    a, z, left, first = 0, shards_of(sum(totals)), tuple(totals), [0] * len(totals)
    while z - a > 1:
        mid = (a + z) // 2
        took = _half(left, min(sum(left), (mid - a) * SHARD), (*seed, a, z))
        if shard < mid:
            z, left = mid, took
        else:
            first = [f + t for f, t in zip(first, took)]
            a, left = mid, tuple(n - t for n, t in zip(left, took))
    return first, list(left)


class Mix:
    """A plan carried out: ``pieces`` and ``shares`` as frames."""

    def __init__(self, documents: DataFrame, plans: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = 23) -> None:
        spark = documents.sparkSession
        wanted = plans.where(F.col("source").isNotNull()).select("source").distinct()
        docs = documents.select(key, "source", text).join(wanted, "source", "left_semi").where(F.col(text).isNotNull())
        self.sized = written(token_counts(docs, text, tokenizer).where("n_tokens > 0").groupBy(key, "source").agg(F.max("n_tokens").alias("n_tokens")), "sized")
        # a plan is a small table by its nature: a row for each source of each mix
        self.plan = [r.asDict() for r in plans.where("mix_name is not null and source is not null and target_weight > 0").groupBy("mix_name", "source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"), F.max("budget_share").alias("budget_share")).collect()]
        have = {r["source"]: r["tokens"] for r in self.sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
        for mix in {p["mix_name"] for p in self.plan}:
            rows = [p for p in self.plan if p["mix_name"] == mix]
            tokens = np.array([have.get(p["source"], 0) for p in rows], float)
            weight = np.array([p["target_weight"] for p in rows])
            target = weight / weight.sum() * tokens.sum() * max(p["budget_share"] for p in rows)
            given = allocate(target, tokens * np.array([p["max_repeats"] for p in rows]))
            for p, n, t, g in zip(rows, tokens, target, given):
                blocks = -(-int(n) // length)
                p |= {"tokens": int(n), "target_tokens": float(t), "target_share": float(t / target.sum()) if target.sum() else float(p["target_weight"] / weight.sum()), "blocks": blocks, "slots": min(round(g / length), blocks * p["max_repeats"])}
        self.length, self.key, self.spark, self.seed = length, key, spark, seed

    def slots(self) -> DataFrame:
        """(mix_name, source, shard, slot, pass, block): every slot with the block it maps to."""
        mixes = []  # as many as the plan has
        for name in sorted({p["mix_name"] for p in self.plan}):
            rows = sorted((p for p in self.plan if p["mix_name"] == name and p["slots"] > 0), key=lambda p: p["source"])
            if rows:
                mixes.append((name, [p["source"] for p in rows], [p["blocks"] for p in rows], tuple(p["slots"] for p in rows), (self.seed, *name.encode())))
        ends = np.cumsum([0, *(shards_of(sum(m[3])) for m in mixes)])
        step = 1 << 16

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i in (x for b in batches for x in b.column("id").to_pylist()):
                m = int(np.searchsorted(ends, i, side="right")) - 1
                name, sources, blocks, totals, seed = mixes[m]
                shard = i - int(ends[m])
                keys = np.random.default_rng(seed).integers(0, 2**62, len(sources)).astype(np.uint64)
                for source, size, key, first, count in zip(sources, blocks, keys, *shard_counts(totals, shard, seed)):
                    for a in range(0, count, step):
                        slot = first + np.arange(a, min(a + step, count))
                        turn, n = slot // size, len(slot)
                        block = permuted(slot % size, np.full(n, size), w.mix(key + turn.astype(np.uint64)))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([source] * n), pa.array(np.full(n, shard, np.int32)), pa.array(slot), pa.array(turn.astype(np.int32)), pa.array(block)], ["mix_name", "source", "shard", "slot", "pass", "block"])

        all_ = int(ends[-1])
        parts = max(1, min(all_, max(self.spark.sparkContext.defaultParallelism, all_ // 64)))
        return self.spark.range(0, all_, 1, parts).mapInArrow(run, "mix_name string, source string, shard int, slot long, pass int, block long")

    def blocks(self) -> DataFrame:
        """(source, block, key, token_from, n_tokens): the pieces of documents in each block."""
        d = laid_out(self.sized, self.key)
        last = (F.col("first") + F.col("n_tokens") - 1)
        d = d.withColumn("block", F.explode(F.sequence((F.col("first") / self.length).cast("long"), (last / self.length).cast("long"))))
        a = F.greatest(F.col("first"), F.col("block") * self.length)
        z = F.least(F.col("first") + F.col("n_tokens"), (F.col("block") + 1) * self.length)
        return d.select("source", "block", self.key, (a - F.col("first")).cast("int").alias("token_from"), (z - a).cast("int").alias("n_tokens"))

    def pieces(self) -> DataFrame:
        """(mix_name, shard, slot, source, pass, block, key, token_from, n_tokens): the mix itself, piece by piece."""
        return self.slots().join(self.blocks(), ["source", "block"]).select("mix_name", "shard", "slot", "source", "pass", "block", self.key, "token_from", "n_tokens")

    def shares(self, pieces: DataFrame) -> DataFrame:
        """For each mix and source: tokens there are, target and actual tokens and shares, and the most uses of a document."""
        plan = self.spark.createDataFrame([(p["mix_name"], p["source"], p["tokens"], p["max_repeats"], p["target_tokens"], p["target_share"]) for p in self.plan], "mix_name string, source string, tokens long, max_repeats int, target_tokens double, target_share double")
        got = pieces.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("actual_tokens"), (F.max("pass") + 1).alias("most_uses"))
        out = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["actual_tokens", "most_uses"])
        total = out.groupBy("mix_name").agg(F.sum("actual_tokens").alias("_all"))
        return out.join(total, "mix_name").withColumn("actual_share", F.coalesce(F.col("actual_tokens") / F.nullif("_all", F.lit(0)), F.lit(0.0))).drop("_all")
