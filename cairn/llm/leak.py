"""Evaluation texts leaking into training text (problem 6).

Method: rare n-gram seeds, then Smith-Waterman alignment.  Of every run of ``RUN``
words of a passage the ``RAREST`` n-grams are seeds, counted over all documents; those
that no document holds are none.  A document that holds a run holds its rarest, and
an edited copy most often one that was left whole.  Documents are scanned for seeds
without a shuffle; each document and item that meet are aligned word by word, which
scores edited copies, and their longest common run is measured exactly.  An alignment
is left out only if the words in common can't reach the score or the run.

Items are a stated query set: they go through all documents in blocks of at
most ``BLOCK`` words, which bounds what is broadcast.

Defined results: null texts and passages, and passages under ``RUN`` words,
leak nothing; redelivered rows give one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .workspace import slices

RUN, GRAM, RAREST = 16, 5, 4
#: Words of the passages that go through all documents at once.
BLOCK = 4_000_000
#: Scores of the alignment, in words.
MATCH, MISMATCH, GAP = 2, -1, -1
RESULT = "item_id long, run_words int, score double, covered double, first_word int, last_word int"


@dataclass
class Items:
    """Passages of a block of items as word hashes, and their seeds."""

    ids: np.ndarray
    words: np.ndarray
    off: np.ndarray
    seeds: np.ndarray
    seed_off: np.ndarray
    seed_item: np.ndarray


def gram_counts(docs: DataFrame, text: str, grams: np.ndarray) -> np.ndarray:
    """In how many documents each of the items' n-grams occurs, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        total = np.zeros(len(g), np.int64)
        for whole in batches:
            for b in slices(whole, [text]):
                h, off = w.shingle_hashes(*w.words_of(b.column(text)), GRAM)
                if not len(h):
                    continue
                at = np.minimum(np.searchsorted(g, h), len(g) - 1)
                k = np.flatnonzero(g[at] == h)
                row = np.searchsorted(off, k, side="right") - 1
                once = np.unique(row * len(g) + at[k])
                total += np.bincount(once % len(g), minlength=len(g))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["place", "n"])

    got = docs.select(text).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(grams), np.int64)
    out[got["place"].to_numpy()] = got["n"].to_numpy()
    return out


def seeded(ids: np.ndarray, words: np.ndarray, off: np.ndarray, docs: DataFrame, text: str) -> Items:
    """Choose as seeds the RAREST n-grams of each run of RUN words that any document holds."""
    h, hoff = w.shingle_hashes(words, off, GRAM)
    grams = np.unique(h)
    counts = gram_counts(docs, text, grams) if len(grams) else np.zeros(0, np.int64)
    found = counts[np.searchsorted(grams, h)] if len(h) else h
    span = RUN - GRAM + 1
    seeds, item = [], []
    for i in range(len(ids)):
        a, b = hoff[i], hoff[i + 1]
        if b - a < span:
            continue
        held = np.where(found[a:b] > 0, found[a:b], np.iinfo(np.int64).max)
        runs = np.lib.stride_tricks.sliding_window_view(held, span)
        order = np.argsort(runs, axis=1, kind="stable")[:, :RAREST] + np.arange(len(runs))[:, None]
        chosen = np.unique(order)
        chosen = a + chosen[found[a + chosen] > 0]
        seeds.append(h[chosen])
        item.append(np.full(len(chosen), i))
    if not seeds:
        z = np.empty(0, np.int64)
        return Items(ids, words, off, np.empty(0, np.uint64), np.zeros(1, np.int64), z)
    s, it = np.concatenate(seeds), np.concatenate(item)
    order = np.lexsort((it, s))
    s, it = s[order], it[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (it[1:] != it[:-1])
    s, it = s[keep], it[keep]
    u, first = np.unique(s, return_index=True)
    return Items(ids, words, off, u, np.append(first, len(s)), it)


def align(doc: np.ndarray, passage: np.ndarray) -> tuple[int, float, int, int]:
    """Smith-Waterman of two word sequences: longest common run, best score, and the words of ``doc`` where it begins (at least) and ends.

    One row for each word of the passage; gaps along a row come from a running maximum.
    """
    n = len(doc)
    slope = -GAP * np.arange(n + 1)
    score = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    run = np.zeros(n + 1, np.int64)
    best, best_run, first, last = 0, 0, 0, 0
    for word in passage:
        same = doc == word
        run[1:] = np.where(same, run[:-1] + 1, 0)
        best_run = max(best_run, int(run.max()))
        diag = score[:-1] + np.where(same, MATCH, MISMATCH)
        up = score[1:] + GAP
        here = np.zeros(n + 1, np.int64)
        here[1:] = np.maximum(np.maximum(diag, up), 0)
        origin = np.arange(n + 1)
        origin[1:] = np.where(here[1:] == 0, np.arange(1, n + 1), np.where(diag >= up, begin[:-1], begin[1:]))
        lifted = here + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score, begin = top - slope, origin[source]
        k = int(score.argmax())
        if score[k] > best:
            best, first, last = int(score[k]), int(begin[k]), k
    return best_run, float(best), first, last


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", least_score: float = 0.5, least_run: int = RUN) -> DataFrame:
    """(doc_id, item_id, run_words, score, covered, first_word, last_word) of leaked items.

    A pair that shares a seed is kept if it shares ``least_run`` consecutive words or its alignment
    reaches ``least_score`` of the passage's own score.  ``covered`` is the part of
    the passage in the longest run.
    """
    spark = docs.sparkSession
    items = items.where(F.col(passage).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage")).distinct()
    # whole blocks of the query set; one block if it is small, as it usually is
    size = items.select((F.size(F.split("passage", r"(?U)[^\p{Alnum}]+")) + F.length(F.regexp_replace("passage", r"[^\p{IsHan}]", ""))).alias("n")).agg(F.coalesce(F.sum(F.col("n")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK))
    out = None
    for i in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).orderBy("item_id").toArrow()
        words, off = w.words_of(got["passage"].combine_chunks().cast("string"))
        part = _scan(docs, seeded(got["item_id"].to_numpy(), words, off, docs, text), doc_id, text, least_score, least_run)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _scan(docs: DataFrame, block: Items, doc_id: str, text: str, least_score: float, least_run: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK words
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {RESULT}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Items = shared.value
        if not len(it.seeds):
            return
        for whole in batches:
            for b in slices(whole, [text]):
                words, woff = w.words_of(b.column(text))
                h, off = w.shingle_hashes(words, woff, GRAM)
                if not len(h):
                    continue
                at = np.minimum(np.searchsorted(it.seeds, h), len(it.seeds) - 1)
                hit = np.flatnonzero(it.seeds[at] == h)
                if not len(hit):
                    continue
                row = np.searchsorted(off, hit, side="right") - 1
                place = hit - off[row]
                s = at[hit]
                n = it.seed_off[s + 1] - it.seed_off[s]
                item = it.seed_item[np.repeat(it.seed_off[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                row, place = np.repeat(row, n), np.repeat(place, n)
                key = row * len(it.ids) + item
                order = np.argsort(key, kind="stable")
                key, place = key[order], place[order]
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                out = []
                for a, z in zip(starts, np.append(starts[1:], len(key))):
                    r, i = divmod(int(key[a]), len(it.ids))
                    p = it.words[it.off[i] : it.off[i + 1]]
                    margin = len(p) + RUN
                    lo, hi = max(0, int(place[a:z].min()) - margin), int(place[a:z].max()) + margin + GRAM
                    doc = words[woff[r] : woff[r + 1]][lo:hi]
                    common = int(np.isin(doc, p).sum())  # no run and no score needs fewer
                    if common < least_run and common < least_score * len(p):
                        continue
                    longest, score, first, last = align(doc, p)
                    if longest >= least_run or score >= least_score * MATCH * len(p):
                        out.append((r, int(it.ids[i]), longest, round(score / (MATCH * len(p)), 6), round(longest / len(p), 6), lo + first, lo + last))
                if out:
                    r, *cols = map(list, zip(*out))
                    types = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column(doc_id).take(pa.array(r)), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return docs.where(F.col(text).isNotNull()).select(doc_id, text).mapInArrow(run, schema)
