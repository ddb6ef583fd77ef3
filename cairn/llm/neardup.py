"""Near-duplicate records with small edits (problem 1).

Method: signature-coordinate inverted join.  Every class of equal shingle sets is
posted under its coordinate-value pairs.  Of ``coords`` coordinates a pair at the
threshold shares at least three (but for a chance that the wanted recall allows),
so a class needs only the ``coords - 2`` rarest of its pairs as a prefix: the most
crowded lists are skipped.  Any one total order serves; rarity is a histogram over
all rows.  Postings are brought together by key in one shuffle and lists merged
there: collisions of each pair are counted on packed sketches, pairs under the
match threshold are dropped on the spot, and the rest are verified exactly.  Lists
longer than ``LIST`` (counted exactly) are cut into blocks that meet pair by pair.

``exact`` posts the rarest shingles themselves, as many as the threshold asks for
(prefix filter): nothing is lost, at the price of more and longer lists.

Defined results: null texts and texts of fewer than ``width`` words are like
nothing; redelivered rows (same id) count once; classes of exact copies never
meet pairwise in the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import signatures as sg
from . import words as w
from .workspace import chunked, crossed, written

#: Longest list that meets itself within one step; longer ones are cut into blocks.
LIST = 4096
#: Coordinates that a pair must share: one less than that is how many crowded lists a class may skip.
SHARED = 3
#: Buckets of the rarity histogram: it has a fixed size whatever the data.
RARITY_BITS = 21
_POST = "key long, crowd int, fp long, n int, s0 long, s1 long, s2 long"
_SIDE = 28  # bits of n below the side of a block pair


def coordinates(threshold: float, recall: float) -> int:
    """Fewest coordinates of which a pair at ``threshold`` shares SHARED with the wanted chance."""
    for k in range(SHARED, sg.K + 1):
        if sg.too_few(k, threshold, SHARED) <= (1 - recall) / 2:
            return k
    raise ValueError(f"a threshold of {threshold} is too low for {sg.K} coordinates: use exact=True")


def keys_of(b: pa.RecordBatch, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of a batch of classes end to end, the row of each, and how many each row has; apart for each space."""
    space = w.mix(b.column("space").to_numpy().astype(np.uint64))
    if exact:
        h, row = sg.hash_lists(b.column("shingles"))
    else:
        sig = sg.sig_array(b.column("sig"))
        h, row = (sig.astype(np.uint64) | (np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32))).ravel(), np.repeat(np.arange(len(sig)), sig.shape[1])
    return w.mix(h ^ space[row]), row, np.bincount(row, minlength=b.num_rows)


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def rarity(classes: DataFrame, exact: bool) -> np.ndarray:
    """How many classes post under each bucket of keys: 2**RARITY_BITS counts, a fixed size.

    Every row is counted.  Partial counts are made in each task; only the
    histogram, never keys of documents, reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(_bucket(keys_of(b, exact)[0]), minlength=len(total))
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            x = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(total[x])], ["bucket", "n"])

    got = classes.select("space", "shingles" if exact else "sig").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << RARITY_BITS, np.int32)
    out[got["bucket"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**31 - 1)
    return out


def postings(classes: DataFrame, counts: np.ndarray, threshold: float, exact: bool) -> DataFrame:
    """Rows of _POST: the rarest keys of each class, as many as its prefix needs, but for those that no other class posts."""
    shared = classes.sparkSession.sparkContext.broadcast(counts)  # 2**RARITY_BITS counts: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                keys, row, have = keys_of(b, exact)
                keep = have - np.ceil(threshold * have - 1e-9).astype(np.int64) + 1 if exact else have - SHARED + 1
                crowd = hist[_bucket(keys)]
                order = np.lexsort((keys, crowd, row))
                place = np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)
                order = order[place < keep[row]]
                order = order[crowd[order] > 1]
                pick = pa.array(row[order])
                yield pa.RecordBatch.from_arrays([pa.array(keys[order].view(np.int64)), pa.array(crowd[order]), *(b.column(x).take(pick) for x in ("fp", "n", "s0", "s1", "s2"))], [x.split()[0] for x in _POST.split(", ")])

    return classes.select("space", "fp", "n", "s0", "s1", "s2", "shingles" if exact else "sig").mapInArrow(run, _POST)


def in_blocks(posts: DataFrame) -> DataFrame:
    """(unit, n, fp, s0..s2): postings by list; those of a long list go to every pair of blocks that theirs is in, with their side in ``n``."""
    crowded = posts.where(F.col("crowd") > LIST).groupBy("key").agg(F.count("*").alias("len")).where(F.col("len") > LIST)
    # few keys or many, as a table: Spark broadcasts it only if its size on disk allows
    cut = written(crowded.select("key", F.ceil(F.col("len") / LIST).cast("int").alias("parts")), "long-lists")
    p = posts.join(cut, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    plain = F.array(F.struct(F.col("key").alias("unit"), F.lit(0).alias("side")))
    lo, hi = (lambda d: F.least("own", d)), (lambda d: F.greatest("own", d))
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda d: F.struct(F.xxhash64("key", lo(d), hi(d)).alias("unit"), F.when(d == F.col("own"), 0).when(d > F.col("own"), 1).otherwise(2).alias("side")))
    p = p.withColumn("u", F.explode(F.when(F.col("parts").isNull(), plain).otherwise(blocks)))
    return p.select(F.col("u.unit").alias("unit"), (F.col("n") + F.shiftleft(F.col("u.side"), _SIDE)).alias("n"), "fp", "s0", "s1", "s2")


def merged(units: DataFrame, threshold: float, least: int) -> DataFrame:
    """(a, b) with a < b: pairs that meet in a list with enough colliding fields."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, n, fp, *s = (t[c].to_numpy() for c in ("unit", "n", "fp", "s0", "s1", "s2"))
        side, n = n >> _SIDE, n & ((1 << _SIDE) - 1)
        starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        size = np.diff(np.append(starts, len(unit)))
        end = np.repeat(starts + size, size)
        right = np.repeat(starts + np.add.reduceat((side < 2).astype(np.int64), starts), size)
        first = np.where(side == 0, np.arange(len(unit)) + 1, np.where(side == 1, right, end))
        for i, j in sg.expand(first, end - first):
            k = np.flatnonzero(sg.alike_sizes(n[i], n[j], threshold) & (fp[i] != fp[j]))
            i, j = i[k], j[k]
            k = sg.colliding([x[i] for x in s], [x[j] for x in s]) >= least
            a, b = fp[i[k]], fp[j[k]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            unit = b.column("unit").to_numpy()
            last = int(np.searchsorted(unit, unit[-1]))
            # the last list may go on in the next batch
            if last:
                yield from pairs(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    # lists are at most two blocks long, so what is held between batches is bounded
    return units.repartition("unit").sortWithinPartitions("unit", "n").mapInArrow(run, "a long, b long").distinct()


def class_pairs(classes: DataFrame, threshold: float, recall: float, exact: bool) -> DataFrame:
    """(a, b, alikeness) with a < b: alike pairs of different shingle sets within a space."""
    posts = postings(classes, rarity(classes, exact), threshold, exact)
    found = merged(in_blocks(posts), threshold, 0 if exact else sg.least_fields(threshold, (1 - recall) / 2))
    return sg.verified(found, classes, threshold)


def near_duplicates(df: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = sg.RECALL, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes and links of a frame (space int, id string, text string).

    Returns membership (space, id, fp) and links (a, b, alikeness) between the
    fingerprints of classes, which differ from space to space; copies are members
    of one class.
    """
    coords = np.arange(0 if exact else coordinates(threshold, recall))
    rows = sg.signed(df.select("space", "id", "text"), "text", width, coords).withColumn("fp", F.xxhash64("space", "fp"))
    rows = written(rows, "signed")
    members = rows.select("space", "fp", "id").distinct()
    return members, class_pairs(written(sg.classes_of(rows, [F.first("space").alias("space")]), "classes"), threshold, recall, exact)


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """(space, id_a, id_b, alikeness): pairs of ids, the smaller first.

    Copies pair with each other and with the members of linked classes, by lists
    of bounded length, so that no task has more than its share of the pairs.
    """
    size = members.groupBy("space", "fp").agg(F.count("*").alias("copies"))
    lists = chunked(members.join(size, ["space", "fp"]), ["space", "fp"])
    many = lists.where("copies > 1")
    of = lambda d, x: d.select("space", "fp", F.col("chunk").alias(f"chunk_{x}"), F.col("ids").alias(f"{x}s"))
    inner = of(many, "x").join(of(many, "y"), ["space", "fp"]).where("chunk_x <= chunk_y")
    inner = crossed(inner, ["space", "chunk_x", "chunk_y"]).where((F.col("chunk_x") < F.col("chunk_y")) | (F.col("x") < F.col("y"))).withColumn("alikeness", F.lit(1.0))
    side = lambda c, x, *more: lists.select(F.col("fp").alias(c), F.col("ids").alias(f"{x}s"), *more)
    across = crossed(links.join(side("a", "x", "space"), "a").join(side("b", "y"), "b"), ["space", "alikeness"])
    out = inner.select("space", "x", "y", "alikeness").unionByName(across)
    return out.select("space", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "alikeness")


def with_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each id: its class, how many copies it has there, and how many other classes its class is linked to."""
    ends = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    size = members.groupBy("fp").agg(F.count("*").alias("copies"))
    return members.join(size, "fp").join(ends, "fp", "left").select("space", "id", F.col("fp").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
