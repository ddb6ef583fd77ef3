"""Duplicates by exact normal form and by token similarity against a set of existing texts."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from . import blocks

METHODS = ("cosine", "jaccard", "levenshtein")
#: Longs of a text's token bitmap, and counts of the histogram that orders tokens.
BITMAP, HISTOGRAM = 4, 1 << 18
#: Rows of a block of either side at most, about; the least number of pairs of blocks, and the least rows worth a block.
BLOCK, PAIRED, WORTH = 98_304, 6, 2_048
#: Pairs that are expanded, and pairs that are measured, at once; from LONG rows on, a posting list is read where it lies.
EXPANDED, MEASURED, LONG = 1 << 19, 1 << 14, 128
#: Digests that a task remembers so as to send a text once.
SEEN = 1 << 17


def exact_groups(df: DataFrame, text: str, key: str = "id") -> DataFrame:
    """(digest, copies, first): groups of rows with the same text up to case and blanks, of two or more rows."""
    d = df.where(F.col(text).isNotNull()).select(F.col(key), F.md5(tx.normal_space(text)).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def firsts(df: DataFrame, text: str, key: str = "id") -> DataFrame:
    """Rows that are the first (least key) of their normal form; null texts are kept."""
    d = df.withColumn("_d", F.coalesce(F.md5(tx.normal_space(text)), F.concat(F.lit("null "), F.col(key).cast("string"))))
    heads = d.groupBy("_d").agg(F.min(key).alias(key))
    return d.join(heads, ["_d", key]).drop("_d")


def similarity(method: str, a: Column, b: Column) -> Column:
    """Similarity of two texts; an unknown method means cosine."""
    if method == "levenshtein":
        return sim.edit_similarity(a, b)
    ta, tb = tx.dedup_tokens(a), tx.dedup_tokens(b)
    return sim.jaccard(ta, tb) if method == "jaccard" else sim.token_cosine(ta, tb)


def matches(new: DataFrame, existing: DataFrame, threshold: float = 0.85, method: str = "cosine") -> DataFrame:
    """(id, match_id, similarity): pairs of new and existing rows (id, text) at ``threshold`` or more; by cosine, rows that came again are one."""
    pairs = class_matches(new, existing, threshold, method)
    left, right = _members(new), _members(existing)
    if method not in METHODS[1:]:
        left, right = left.distinct(), right.distinct()
    out = pairs.join(left.select(F.col("digest"), "id"), "digest")
    return out.join(right.select(F.col("digest").alias("match"), F.col("id").alias("match_id")), "match").select("id", "match_id", "similarity")


def matches_within(df: DataFrame, threshold: float) -> DataFrame:
    """(id, match_id, similarity): pairs of rows (id, text) with different ids whose edit similarity is ``threshold`` or more, the lesser id first."""
    pairs, held = _by_length(df, None, threshold), _members(df)
    out = pairs.join(held.select("digest", "id"), "digest").join(held.select(F.col("digest").alias("match"), F.col("id").alias("match_id")), "match")
    same = F.col("digest") == F.col("match")
    return out.where((F.col("id") < F.col("match_id")) | ~same & (F.col("id") > F.col("match_id"))).select(F.least("id", "match_id").alias("id"), F.greatest("id", "match_id").alias("match_id"), "similarity")


def _digest() -> Column:
    return F.unhex(F.md5("text"))


def _members(df: DataFrame) -> DataFrame:
    return df.where(F.col("text").isNotNull()).select("id", _digest().alias("digest"))


def _distinct(df: DataFrame) -> DataFrame:
    """(digest, text): each text once, so that copies never meet pairwise."""
    return df.where(F.col("text").isNotNull()).groupBy(_digest().alias("digest")).agg(F.first("text").alias("text"))


def class_matches(new: DataFrame, existing: DataFrame, threshold: float, method: str) -> DataFrame:
    """(digest, match, similarity): pairs of distinct texts of two sides (id, text) at ``threshold`` or more.

    Token methods meet on prefixes of the rarest tokens.  Two sets at Jaccard t share
    one of the |A| - ceil(t |A|) + 1 rarest of each; two count vectors at cosine t
    share a token outside the commonest ones whose squares sum to under t squared of
    the vector's own, since those alone could not make up the cosine.  Bitmaps of the
    tokens bound what a pair can have in common.  Jaccard joins prefixes, shuffled as
    hashes: rarity, which only has to order tokens alike on both sides, comes from a
    histogram of fixed size.  Cosine meets in pairs of blocks, on hashes of the tokens;
    edit similarity does so on lengths and bitmaps.  Candidates are then measured
    exactly, on their tokens.
    """
    a, b = _distinct(new), _distinct(existing)
    if method == "levenshtein":
        return _by_length(a, b, threshold)
    both = _sharing(new, existing, a, b, threshold) if method == "jaccard" else _near_counts(new, existing, a, b, threshold)

    def measured(batches):
        for t in batches:
            value = [_token_similarity(p, q, method) for p, q in zip(t["tokens"].to_pylist(), t["others"].to_pylist())]
            yield pa.RecordBatch.from_arrays([t["digest"], t["match"], pa.array(value, pa.float64())], ["digest", "match", "similarity"])

    return both.select("digest", "match", "tokens", "others").mapInArrow(measured, "digest binary, match binary, similarity double").where(F.col("similarity") >= threshold - 1e-12)


def _near_counts(new: DataFrame, existing: DataFrame, a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(digest, match, tokens, others): pairs of ``a`` and ``b`` whose cosine, by hashes of the tokens, reaches the threshold."""
    x, y = _paired(new, existing, "digest", "tokens")
    pairs = x.cogroup(y).applyInArrow(lambda p, q: _pairs_of_block(p, q, threshold), "digest binary, match binary")
    both = pairs.join(a, "digest").join(b.select(F.col("digest").alias("match"), F.col("text").alias("other")), "match")
    return both.select("digest", "match", tx.dedup_tokens("text").alias("tokens"), tx.dedup_tokens("other").alias("others"))


def _sharing(new: DataFrame, existing: DataFrame, a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(digest, match, tokens, others): pairs of ``a`` and ``b`` that share a token of their prefixes and may reach the threshold of Jaccard."""
    tokens = lambda d: d.select("digest", tx.dedup_tokens("text").alias("tokens"))
    all_ = new.select("text").unionByName(existing.select("text")).where("text is not null")
    place = F.pmod(F.xxhash64("term"), F.lit(HISTOGRAM)).cast("int")
    got = all_.select(F.explode(F.array_distinct(tx.dedup_tokens("text"))).alias("term")).groupBy(place.alias("place")).agg(F.count("*").alias("n")).toArrow()
    rarity = np.zeros(HISTOGRAM, np.int64)
    rarity[got["place"].to_numpy()] = got["n"].to_numpy()
    x, y = _prefix(tokens(a), rarity, threshold).alias("x"), _prefix(tokens(b), rarity, threshold).alias("y")
    pairs = x.join(y, (F.col("x.term") == F.col("y.term")) & _may_reach(threshold)).select(F.col("x.digest").alias("digest"), F.col("y.digest").alias("match")).distinct()
    return pairs.join(tokens(a), "digest").join(tokens(b).select(F.col("digest").alias("match"), F.col("tokens").alias("others")), "match")


def _token_similarity(a: list[str], b: list[str], method: str) -> float:
    """Jaccard or cosine of two token lists."""
    x, y = Counter(a), Counter(b)
    if method == "jaccard":
        common = len(x.keys() & y.keys())
        return common / (len(x) + len(y) - common) if x and y else 0.0
    norm = math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))
    return min(1.0, sum(n * y[t] for t, n in x.items()) / norm) if norm else 0.0


def _may_reach(threshold: float) -> Column:
    """Upper bound of a pair's Jaccard: every bit of one bitmap that the other lacks is a token they don't share."""
    shared = sum((F.bit_count(F.col(f"x.b{i}").bitwiseAND(F.col(f"y.b{i}"))) for i in range(BITMAP)), F.lit(0))
    common = F.least(F.col("x.spare") + shared, F.col("y.spare") + shared)
    return common >= threshold * (F.col("x.all") + F.col("y.all") - common) - 1e-9


def _prefix(tokens: DataFrame, rarity: np.ndarray, threshold: float) -> DataFrame:
    """(digest, term, all, spare, bitmap): hashes of the rarest tokens of each text (digest, tokens) that a pair at the threshold must share one of; ``spare`` is ``all`` less the bits that are set."""

    def run(batches):
        for t in batches:
            values, at = blocks.lists(t["hashes"])
            if not len(values):
                continue
            row = np.repeat(np.arange(t.num_rows), np.diff(at))
            h = values.to_numpy(zero_copy_only=False)
            by = np.lexsort((h, row))
            row, h = row[by], h[by]
            head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]))))
            row, h = row[head], h[head]
            w = np.ones(len(head))
            whole = np.bincount(row, w, t.num_rows)
            bits = np.zeros((t.num_rows, BITMAP), np.uint64)
            bit = h % (64 * BITMAP)
            np.bitwise_or.at(bits, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
            # commonest first: leave out while the sum stays under the share that a pair needs
            spare = whole - np.bitwise_count(bits).sum(axis=1)
            by = np.lexsort((h, -rarity[h % HISTOGRAM], row))
            row, h, w = row[by], h[by], w[by]
            total = np.cumsum(w)
            kept = total - np.concatenate(([0.0], np.cumsum(whole)))[row] >= threshold * whole[row] - 1e-9
            row, h = row[kept], h[kept]
            yield pa.RecordBatch.from_arrays([t["digest"].take(pa.array(row)), pa.array(h), pa.array(whole[row]), pa.array(spare[row]), *(pa.array(bits[row, i].view(np.int64)) for i in range(BITMAP))], ["digest", "term", "all", "spare", *(f"b{i}" for i in range(BITMAP))])

    schema = "digest binary, term long, all double, spare double, " + ", ".join(f"b{i} long" for i in range(BITMAP))
    return tokens.select("digest", F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes")).mapInArrow(run, schema)


def best_cosine(new: DataFrame, existing: DataFrame, threshold: float) -> DataFrame:
    """(digest, similarity): the highest cosine, from ``threshold`` on, that each distinct new text has with an existing one.

    Nothing but tokens is shuffled: distinct tokens of a text as one long each (a hash
    of 48 bits and the count), a text once for each block of the other side.  A pair
    of blocks is measured in place, so neither texts nor pairs are shuffled.
    """
    x, y = _paired(new, existing, "tokens")
    found = x.cogroup(y).applyInArrow(lambda p, q: _best_of_block(p, q, threshold), "digest binary, similarity double")
    return found.groupBy("digest").agg(F.max("similarity").alias("similarity"))


def _paired(new: DataFrame, existing: DataFrame, *held_columns: str):
    """Both sides (digest, tokens), of ``existing`` the given columns, grouped by pairs of blocks; each text once for each block of the other side."""
    n, m = existing.where("text is not null").count(), new.where("text is not null").count()
    parts = max(1, -(-m // BLOCK))
    held = max(1, -(-n // BLOCK), min(-(-PAIRED // parts), n // WORTH))
    deal = lambda k: F.pmod(F.xxhash64("digest"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = _counted(new).select("digest", "tokens", (deal(parts) * held).alias("_q"), each(held).alias("_b")).select((F.col("_q") + F.col("_b")).alias("_g"), "digest", "tokens")
    b = _counted(existing).select(*held_columns, deal(held).alias("_b"), each(parts).alias("_q")).select((F.col("_q") * held + F.col("_b")).alias("_g"), *held_columns)
    return a.groupBy("_g"), b.groupBy("_g")


def _counted(df: DataFrame) -> DataFrame:
    """(digest, tokens): each text with its distinct tokens as longs, hash above count; a task sends a text once, as far as it remembers."""

    def run(batches):
        seen: set[bytes] = set()
        for t in batches:
            digests = t["digest"].to_pylist()
            fresh = []
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    fresh.append(i)
            if len(seen) > SEEN:
                seen.clear()
            t = t.take(pa.array(fresh, pa.int64()))
            values, at = blocks.lists(t["hashes"])
            row, h, n = _counts(np.repeat(np.arange(t.num_rows), np.diff(at)), values.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(16))
            # a count beyond 16 bits is dealt to several longs, which add up again
            times = -(-n // 0xFFFF)
            row, h, n = np.repeat(row, times), np.repeat(h, times), np.minimum(np.repeat(n, times) - 0xFFFF * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)), 0xFFFF)
            tokens = pa.array(((h << np.uint64(16)) | n.astype(np.uint64)).view(np.int64))
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=t.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([t["digest"], pa.ListArray.from_arrays(pa.array(ends), tokens)], ["digest", "tokens"])

    rows = df.where(F.col("text").isNotNull()).select(_digest().alias("digest"), F.transform(tx.dedup_tokens("text"), lambda x: F.xxhash64(x)).alias("hashes"))
    return rows.mapInArrow(run, "digest binary, tokens array<long>")


def _counts(row: np.ndarray, term: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, n): each term of each row once, with its count, or the sum of its ``n``."""
    by = np.lexsort((term, row))
    row, term = row[by], term[by]
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])))[: len(row)])
    total = np.diff(np.append(head, len(row))) if n is None else np.add.reduceat(n[by], head) if len(head) else n
    return row[head], term[head], total


class _Side:
    """Token counts of the texts of a block, terms coded by how common they are (0 the commonest), with norms, bitmaps and prefixes."""

    def __init__(self, row: np.ndarray, code: np.ndarray, n: np.ndarray, rows: int, share: float):
        by = np.lexsort((-code, row))  # rarest first
        self.row, self.code, self.n = row[by], code[by], n[by]
        self.at = np.searchsorted(self.row, np.arange(rows + 1))
        mass = (self.n * self.n).astype(np.float64)
        self.whole = np.bincount(self.row, mass, rows)
        total = np.concatenate(([0.0], np.cumsum(mass)))
        left = total[self.at[1:]][self.row] - total[:-1]
        self.bits = np.zeros((BITMAP, rows), np.uint64)
        bit = self.code % (64 * BITMAP)
        np.bitwise_or.at(self.bits, (bit // 64, self.row), np.uint64(1) << (bit % 64).astype(np.uint64))
        kept = left >= share * self.whole[self.row] - 1e-9
        #: Of the prefix: rows, terms, and the share of the norm that is left from that term on.
        self.head, self.term, self.left = self.row[kept], self.code[kept], (left / self.whole[self.row])[kept]


def _best_of_block(new: pa.Table, existing: pa.Table, threshold: float) -> pa.Table:
    """(digest, similarity): the best cosine of each text of ``new`` (digest, tokens) within ``existing`` (tokens), if it reaches the threshold."""
    best = np.zeros(new.num_rows)
    for p, _, value in _measured_of_block(new, existing, threshold):
        np.maximum.at(best, p, value)
    got = np.flatnonzero(best >= threshold - 1e-12)
    return pa.table([new["digest"].take(pa.array(got)), pa.array(best[got])], schema=pa.schema([("digest", pa.binary()), ("similarity", pa.float64())]))


def _pairs_of_block(new: pa.Table, existing: pa.Table, threshold: float) -> pa.Table:
    """(digest, match): pairs of texts of ``new`` and ``existing`` (digest, tokens) whose cosine reaches the threshold, each once."""
    new, existing = (t.take(pa.array(np.unique(t["digest"].combine_chunks().dictionary_encode().indices.to_numpy(), return_index=True)[1])) if t.num_rows else t for t in (new, existing))
    found = [(p[near], q[near]) for p, q, value in _measured_of_block(new, existing, threshold) if len(near := np.flatnonzero(value >= threshold - 1e-9))]
    p, q = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pa.table([new["digest"].take(pa.array(p)), existing["digest"].take(pa.array(q))], schema=pa.schema([("digest", pa.binary()), ("match", pa.binary())]))


def _measured_of_block(new: pa.Table, existing: pa.Table, threshold: float):
    """Rows of ``new`` and of ``existing``, and their cosines, in arrays: every pair that reaches the threshold, and others.

    Texts meet on prefixes (see ``class_matches``), and only where what is left of both
    from the shared term on can make up the cosine.  A bit that one bitmap has and the
    other lacks is a token lost: counted along the posting lists as they lie, then for
    each side of the pairs left; what remains is measured on its tokens.
    """
    sides = []
    for t in (new, existing):
        values, at = blocks.lists(t["tokens"])
        v = values.to_numpy(zero_copy_only=False).view(np.uint64)
        sides.append(_counts(np.repeat(np.arange(t.num_rows, dtype=np.int32), np.diff(at)), v >> np.uint64(16), (v & np.uint64(0xFFFF)).astype(np.int64)))
    (rx, hx, nx), (ry, hy, ny) = sides
    if not len(rx) or not len(ry):
        return
    terms, code = np.unique(np.concatenate((hx, hy)), return_inverse=True)
    cx, cy = code[: len(hx)], code[len(hx) :]
    # terms of one side only come first in the prefixes, where they cost nothing
    order = np.argsort(-(np.bincount(cx, minlength=len(terms)) * np.bincount(cy, minlength=len(terms))), kind="stable")
    rank = np.empty(len(terms), np.int32)
    rank[order] = np.arange(len(terms), dtype=np.int32)
    share = threshold * threshold
    x, y = _Side(rx, rank[cx], nx, new.num_rows, share), _Side(ry, rank[cy], ny, existing.num_rows, share)
    del sides, rx, hx, nx, ry, hy, ny, cx, cy, code
    by = np.lexsort((-y.left, y.term))
    held, low = y.head[by], 2.0 * y.term[by] + (1.0 - y.left[by])
    begin = np.searchsorted(y.term[by], x.term)
    end = np.maximum(begin, np.searchsorted(low, 2.0 * x.term + (1.0 - share / x.left) + 1e-9, side="right"))
    # lost shares of both sides add up to -2 ln(threshold) at most
    bound = lambda whole: np.minimum(np.floor(-2 * math.log(threshold) * whole + 1e-6), 255).astype(np.uint8)
    words, most, x_most = y.bits[:, held], bound(y.whole)[held], bound(x.whole)
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def settle():
        if pending:
            p, q = (np.concatenate(c) for c in zip(*pending))
            pending.clear()
            p, q = _near(x, y, p, q, share)
            pair = np.unique(p * np.int64(existing.num_rows) + q)
            for at in range(0, len(pair), MEASURED):
                p, q = np.divmod(pair[at : at + MEASURED], existing.num_rows)
                yield p, q, _cosine(x, y, keys, len(terms), p, q)

    keys = y.row * np.int64(len(terms)) + (len(terms) - 1 - y.code)
    size = end - begin
    short = np.flatnonzero((size > 0) & (size < LONG))
    cuts = np.flatnonzero(np.diff(np.cumsum(size[short]) // EXPANDED, prepend=-1)) if len(short) else []
    for part in np.split(short, cuts[1:]):
        k = size[part]
        place = np.repeat(begin[part] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        pending.append((np.repeat(x.head[part], k), held[place]))
        yield from settle()
    waiting = 0
    long = np.flatnonzero(size >= LONG)
    for p, a, b in zip(x.head[long].tolist(), begin[long].tolist(), end[long].tolist()):
        # a sum of 256 counts as 0 here, and is seen in settle()
        lost = reduce(np.add, np.bitwise_count(words[:, a:b] ^ x.bits[:, p, None]))
        near = np.flatnonzero(lost <= np.maximum(most[a:b], x_most[p]))
        if len(near):
            pending.append((np.full(len(near), p), held[a + near]))
            waiting += len(near)
            if waiting > EXPANDED:
                yield from settle()
                waiting = 0
    yield from settle()


def _near(x: _Side, y: _Side, p: np.ndarray, q: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that may reach the threshold by the whole bitmaps."""
    a, b = x.whole[p], y.whole[q]
    lost, gone = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    for i in range(BITMAP):
        u, v = x.bits[i][p], y.bits[i][q]
        lost += np.bitwise_count(u & ~v)
        gone += np.bitwise_count(v & ~u)
    near = np.flatnonzero((a - lost) * (b - gone) >= share * a * b - 1e-9)
    return p[near], q[near]


def _cosine(x: _Side, y: _Side, keys: np.ndarray, terms: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows; ``keys`` are y's rows and terms (of so many) in one number, ascending."""
    size = x.at[p + 1] - x.at[p]
    place = np.repeat(x.at[p] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    key = np.repeat(q, size) * np.int64(terms) + (terms - 1 - x.code[place])
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    product = np.where(keys[at] == key, x.n[place] * y.n[at], 0)
    dot = np.add.reduceat(product, np.cumsum(size) - size)
    return np.minimum(1.0, dot / (np.sqrt(x.whole[p]) * np.sqrt(y.whole[q])))


def _by_length(new: DataFrame, existing: DataFrame | None, threshold: float) -> DataFrame:
    """(digest, match, similarity): at similarity t the shorter is at least t times as long as the longer; ``existing`` None: pairs within ``new``, each once.

    An edit takes away two pairs of neighbouring characters at most, so bitmaps of
    these pairs bound the distance before it is measured.  Bitmaps only are dealt to
    pairs of blocks; texts come back for the few pairs that are left.
    """
    within = existing is None
    a = _distinct(new.where(F.length("text") > 0))
    b = a if within else _distinct(existing.where(F.length("text") > 0))
    rows = [d.where("text is not null").count() for d in ([new] if within else [new, existing])]
    parts = max(1, -(-rows[0] // BLOCK), *([min(PAIRED, rows[0] // WORTH)] if within else []))
    held = parts if within else max(1, -(-rows[1] // BLOCK), min(-(-PAIRED // parts), rows[1] // WORTH))
    deal = lambda k: F.pmod(F.xxhash64("digest"), F.lit(k)).cast("int")
    ones = sum((F.bit_count(f"b{i}") for i in range(BITMAP)), F.lit(0)).alias("ones")
    bits = [f"b{i}" for i in range(BITMAP)]
    group = (F.col("_q") * held + F.col("_b")).alias("_g")
    x = _with_bits(a).withColumn("_q", deal(parts)).withColumn("_b", F.explode(F.sequence(F.col("_q") if within else F.lit(0), F.lit(held - 1))))
    y = _with_bits(b).withColumn("_b", deal(held)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_b") if within else F.lit(parts - 1))))
    x, y = (d.select(group, "digest", "n", ones, *bits, (F.lit(within) & (F.col("_q") == F.col("_b"))).alias("same")) for d in (x, y))
    near = x.groupBy("_g").cogroup(y.groupBy("_g")).applyInArrow(lambda p, q: _near_lengths(p, q, threshold), "digest binary, match binary")
    d = near.join(a, "digest").join(b.select(F.col("digest").alias("match"), F.col("text").alias("other")), "match")
    return d.select("digest", "match", sim.edit_similarity(F.col("text"), F.col("other")).alias("similarity")).where(F.col("similarity") >= threshold)


def _near_lengths(new: pa.Table, existing: pa.Table, threshold: float) -> pa.Table:
    """(digest, match): pairs of two blocks (digest, n, ones, bitmap, same) that may reach the threshold by length and bitmap; of one block with itself, each pair once."""
    sides = []
    for t in (new, existing):
        t = t.sort_by("n")
        n, ones = t["n"].to_numpy().astype(np.int64), t["ones"].to_numpy().astype(np.int64)
        sides.append((t, n, ones, np.stack([t[f"b{i}"].to_numpy().view(np.uint64) for i in range(BITMAP)])))
    (x, m, x_ones, x_bits), (y, n, y_ones, y_bits) = sides
    edits = lambda length: np.floor((1 - threshold) * length + 1e-9).astype(np.int64)
    begin = np.searchsorted(n, threshold * m - 1e-9)
    end = np.searchsorted(n, (m + 1e-9) / threshold, side="right") if threshold > 0 else np.full(len(m), len(n))
    longest = n[end - 1] if len(n) else n
    # what a pair must share at least if its edits are those of the longest text in reach
    least = x_ones - 2 * edits(np.maximum(m, longest)) if len(n) else x_ones
    p_found, q_found = [], []
    for p in np.flatnonzero(begin < end).tolist():
        a, b = begin[p], end[p]
        kind = np.uint8 if x_ones[p] < 256 else np.uint16
        shared = reduce(np.add, (np.bitwise_count(y_bits[i, a:b] & x_bits[i, p]).astype(kind, copy=False) for i in range(BITMAP)))
        q = a + (np.flatnonzero(shared >= least[p]) if least[p] > 0 else np.arange(b - a))
        both, most = shared[q - a].astype(np.int64), 2 * edits(np.maximum(m[p], n[q]))
        q = q[np.maximum(x_ones[p], y_ones[q]) - both <= most]
        if len(q):
            p_found.append(np.full(len(q), p))
            q_found.append(q)
    p, q = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (p_found, q_found))
    found = pa.table({"digest": x["digest"].take(pa.array(p)), "match": y["digest"].take(pa.array(q))}, schema=pa.schema([("digest", pa.binary()), ("match", pa.binary())]))
    if x.num_rows and x["same"][0].as_py():
        found = found.filter(pc.less_equal(found["digest"], found["match"]))
    return found


def _with_bits(d: DataFrame) -> DataFrame:
    """(digest, n, bitmap): the length of each text (digest, text) and a bitmap of its pairs of neighbouring characters."""

    def run(batches):
        for t in batches:
            texts = [x.encode("utf-32-le") for x in t["text"].to_pylist()]
            n = np.array([len(x) // 4 for x in texts], np.int64)
            c = np.frombuffer(b"".join(texts), np.uint32).astype(np.uint64)
            row = np.repeat(np.arange(t.num_rows), n)
            pair = np.flatnonzero(row[1:] == row[:-1])
            bit = ((c[pair] << np.uint64(21) | c[pair + 1]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
            bits = np.zeros((BITMAP, t.num_rows), np.uint64)
            np.bitwise_or.at(bits, ((bit // np.uint64(64)).astype(np.int64), row[pair]), np.uint64(1) << (bit % np.uint64(64)))
            yield pa.RecordBatch.from_arrays([t["digest"], pa.array(n.astype(np.int32)), *(pa.array(w.view(np.int64)) for w in bits)], ["digest", "n", *(f"b{i}" for i in range(BITMAP))])

    return d.select("digest", "text").mapInArrow(run, "digest binary, n int, " + ", ".join(f"b{i} long" for i in range(BITMAP)))


def suggested_action(new: DataFrame, existing: DataFrame, method: str = "cosine") -> DataFrame:
    """(id, similarity, action): skip from 0.95, merge from 0.85, else save."""
    if method in ("jaccard", "levenshtein"):
        best = class_matches(new, existing, 0.85, method).groupBy("digest").agg(F.max("similarity").alias("similarity"))
    else:
        best = best_cosine(new, existing, 0.85)
    d = new.select("id", _digest().alias("digest")).distinct().join(best, "digest", "left")
    return d.select("id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.when(F.col("similarity") >= 0.95, "skip").when(F.col("similarity") >= 0.85, "merge").otherwise("save").alias("action"))


def is_duplicate(new: DataFrame, existing: DataFrame, threshold: float = 0.85, method: str = "cosine") -> DataFrame:
    """(id, is_duplicate): whether any existing text is at least ``threshold`` alike; null texts are no duplicates."""
    held = class_matches(new, existing, threshold, method).select("digest").distinct().withColumn("_hit", F.lit(True))
    return new.select("id", _digest().alias("digest")).distinct().join(held, "digest", "left").select("id", F.coalesce("_hit", F.lit(False)).alias("is_duplicate"))


def merged(df: DataFrame, group: str, text: str, key: str = "id") -> DataFrame:
    """One text for each group: the longest row and every distinct sentence of the group, in order, closed by a full stop."""
    longest = df.groupBy(group).agg(F.max_by(text, F.struct(F.length(text), F.col(key))).alias("longest"))
    parts = df.select(group, F.explode(tx.sentences(text)).alias("s")).groupBy(group).agg(F.array_sort(F.collect_set("s")).alias("parts"))
    return longest.join(parts, group, "left").select(group, "longest", F.when(F.size("parts") > 0, F.concat(F.array_join("parts", "。"), F.lit("。"))).otherwise(F.col("longest")).alias("merged"))
