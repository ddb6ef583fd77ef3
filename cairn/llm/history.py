"""New batches against all history (problem 2).

Method: prefix-tree hash forest.  Each tree orders the classes of texts by a key
made of two signature coordinates of its own; as many trees as the wanted recall
asks for at the threshold.  The forest lies in a folder as runs, one for each
accepted load or batch: a run holds its entries sorted by key, in blocks, with a
table of fences (first and last key of each block), and its classes sorted by
fingerprint in the same manner.

A batch is searched by ranges: the fences say which blocks its prefixes fall in,
only those blocks are read, and the range of a prefix is located in them by binary
search.  Search begins with whole keys in a few trees, which settles close copies;
what is still open is widened to the one-coordinate prefix of every tree, however
crowded the range.  Candidates are counted on packed sketches inside the block,
and verified exactly, the closest of each entry first.  No run is read beyond the
blocks that ranges or candidates lie in, and none is written again but by ``merge``,
which merges the sorted runs range by range.

Only an entry's first occurrence is searched: later copies of the same set of
words are settled by the class's first batch.

Defined results: null texts and texts of fewer than ``width`` words are never
present; redelivered rows count once; items of one batch don't count against
each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import signatures as sg
from .workspace import table_path, written

#: Trees searched with whole keys before any is widened.
NARROW = 8
#: Bytes of a block of a run, and ranges that meet a block in one step.
BLOCK_BYTES, MEET = 16 << 20, 4096
#: A key: the tree, all of its first coordinate, the upper bits of its second.
FIRST, SECOND = 32, 25
ENTRY = "key long, fp long, batch int, n int, s0 long, s1 long, s2 long"
CLASS = "fp long, batch int, n int, shingles binary"
_names = lambda schema: [x.split()[0] for x in schema.split(", ")]


def trees_for(threshold: float, recall: float) -> int:
    """Trees of which a pair at ``threshold`` shares the prefix in at least one, with the wanted chance."""
    for t in range(1, sg.K // 2 + 1):
        if sg.too_few(t, threshold, 1) <= (1 - recall) / 2:
            return max(t, NARROW)
    raise ValueError(f"a threshold of {threshold} is too low for {sg.K // 2} trees")


def entries(classes: DataFrame) -> DataFrame:
    """Rows of ENTRY: one for each tree and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                keys = tree_keys(b)
                pick = pa.array(np.repeat(np.arange(b.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(b.column(c).take(pick) for c in _names(ENTRY)[1:])], _names(ENTRY))

    return classes.select(*_names(ENTRY)[1:], "sig").mapInArrow(run, ENTRY)


def tree_keys(b: pa.RecordBatch) -> np.ndarray:
    """(rows, trees) keys of a batch with column ``sig``: the first half of its coordinates begin the keys, the others go on."""
    sig = sg.sig_array(b.column("sig")).astype(np.int64)
    t = sig.shape[1] // 2
    return (np.arange(t) << (FIRST + SECOND)) | (sig[:, :t] << SECOND) | (sig[:, t:] >> (32 - SECOND))


# blocks and fences


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path, as Arrow names them, of a file that Spark wrote."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def fenced(spark: SparkSession, df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df`` sorted by ``by`` to path/data in blocks, and their fences to path/fences.

    A key may fill many blocks, so a second column breaks its ties.
    """
    _write(df.repartitionByRange(*by).sortWithinPartitions(*by), f"{path}/data")
    fence(spark, path, by)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("parquet.block.size", BLOCK_BYTES).option("compression", "zstd").parquet(path)


def fence(spark: SparkSession, path: str, by: list[str]) -> None:
    """Write the first and last key of each block of path/data, with the columns that break ties, to path/fences."""
    files = spark.read.parquet(f"{path}/data").inputFiles()
    schema = "file string, part int, low long, low2 long, high long, high2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column("file").to_pylist():
                on, at = opened(f)
                with on.open_input_file(at) as x:
                    whole = pq.ParquetFile(x)
                    for g in range(whole.metadata.num_row_groups):
                        t = whole.read_row_group(g, by)
                        ends = [t[c][k].as_py() for k in (0, -1) for c in (by[0], by[-1])] if t.num_rows else None
                        if ends:
                            yield pa.RecordBatch.from_arrays([pa.array([f.rpartition("/")[2]]), pa.array([g], pa.int32()), *(pa.array([e], pa.int64()) for e in ends)], _names(schema))

    d = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism * 4)))
    d.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{path}/fences")


@dataclass
class Fences:
    """The blocks of some sorted runs: where each lies, and its first and last key, run by run in order of keys."""

    file: list[str]
    part: np.ndarray
    low: np.ndarray
    low2: np.ndarray
    high: np.ndarray
    high2: np.ndarray
    run: np.ndarray  # where each run begins, and the end

    def blocks(self, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(range, block): the blocks that each range of keys lies in."""
        for a, z in zip(self.run[:-1], self.run[1:]):
            first = np.searchsorted(self.high[a:z], lo) + a
            yield from sg.expand(first, np.maximum(np.searchsorted(self.low[a:z], hi, side="right") + a - first, 0))

    def read(self, block: int, columns: list[str]) -> pa.Table:
        on, at = opened(self.file[block])
        with on.open_input_file(at) as x:
            return pq.ParquetFile(x).read_row_group(int(self.part[block]), columns)


def fences(spark: SparkSession, paths: list[str]) -> Fences:
    """Fences of some runs: a row for each block of 16 MB, as small a share of the runs as a catalogue's."""
    t, names = [], []
    for p in paths:
        t.append(spark.read.parquet(f"{p}/fences").orderBy("low", "low2", "high", "high2").toArrow())
        by = {f.rpartition("/")[2]: f for f in spark.read.parquet(f"{p}/data").inputFiles()}
        names += [by[f] for f in t[-1]["file"].to_pylist()]
    col = lambda c: np.concatenate([np.empty(0, np.int64), *(x[c].to_numpy() for x in t)])
    return Fences(names, *(col(c) for c in ("part", "low", "low2", "high", "high2")), np.cumsum([0, *(len(x) for x in t)]))


def located(queries: DataFrame, where: Fences, visit, out: str) -> DataFrame:
    """Rows of ``out`` from ``visit(block, queries)``: ranges of keys (columns lo, hi and others) brought to the blocks they lie in.

    The first ``MEET`` ranges that a task has for a block go to one place, the rest
    by turns to others, so that a crowded block is read and searched by many tasks.
    """
    shared = queries.sparkSession.sparkContext.broadcast(where)
    names = ["block", "turn", *queries.columns]
    schema = f"block long, turn long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in queries.schema)}"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(len(shared.value.file), np.int64)
        for b in batches:
            if b.num_rows:
                for row, block in shared.value.blocks(b.column("lo").to_numpy(), b.column("hi").to_numpy()):
                    order = np.argsort(block, kind="stable")
                    row, block = row[order], block[order]
                    size = np.bincount(block, minlength=len(seen))
                    nth = (seen + size - np.cumsum(size))[block] + np.arange(len(block))
                    seen += size
                    turn = np.where(nth < MEET, 0, 1 + task + (nth // (16 * MEET) << 32))
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(turn), *(b.column(c).take(pa.array(row)) for c in b.schema.names)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = -1, None
        for b in batches:
            block = b.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)] if len(block) else []
            for a, z in zip(edges[:-1], edges[1:]):
                if block[a] != at:
                    at, table = block[a], None  # one block at a time
                    table = shared.value.read(at, visit.columns)
                for i in range(a, z, MEET):
                    yield from visit(table, b.slice(i, min(MEET, z - i)))

    return queries.mapInArrow(route, schema).repartition("block", "turn").sortWithinPartitions("block").mapInArrow(run, out)


class Candidates:
    """Entries of earlier batches in the range of each search that collide with it in enough fields: (a, b, fields)."""

    columns = _names(ENTRY)

    def __init__(self, threshold: float, recall: float) -> None:
        self.threshold, self.least = threshold, sg.least_fields(threshold, (1 - recall) / 2)

    def __call__(self, table: pa.Table, q: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, fp, batch, n, *s = (table[c].to_numpy() for c in self.columns)
        _, qfp, qbatch, qn, *qs = (q.column(c).to_numpy() for c in ["lo", *self.columns[1:]])
        first = np.searchsorted(key, q.column("lo").to_numpy())
        count = np.searchsorted(key, q.column("hi").to_numpy(), side="right") - first
        for i, j in sg.expand(first, count):
            k = np.flatnonzero((batch[j] < qbatch[i]) & sg.alike_sizes(n[j], qn[i], self.threshold))
            i, j = i[k], j[k]
            f = sg.colliding([x[i] for x in qs], [x[j] for x in s])
            k = np.flatnonzero(f >= self.least)
            yield pa.RecordBatch.from_arrays([pa.array(qfp[i[k]]), pa.array(fp[j[k]]), pa.array(f[k].astype(np.int32))], ["a", "b", "fields"])


class Verify:
    """(fp) of candidates (lo = fp of a stored class, a, n, shingles) that are alike enough."""

    columns = _names(CLASS)

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def __call__(self, table: pa.Table, q: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = table["fp"].to_numpy()
        at = np.minimum(np.searchsorted(fp, q.column("lo").to_numpy()), len(fp) - 1)
        i = np.flatnonzero(fp[at] == q.column("lo").to_numpy())
        n, qn = table["n"].to_numpy()[at[i]], q.column("n").to_numpy()[i]
        theirs = table["shingles"].combine_chunks().take(pa.array(at[i]))
        common = sg.overlap(q.column("shingles").take(pa.array(i)), theirs)
        k = i[common >= self.threshold * (n + qn - common)]
        yield pa.RecordBatch.from_arrays([q.column("a").take(pa.array(k))], ["fp"])


class HashForest:
    """Sorted runs of accepted texts in a folder, and searches over them.

    A forest opened on a folder that holds runs goes on from them; threshold,
    width and recall are those it was made with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: float = 0.8, width: int = 5, recall: float = sg.RECALL) -> None:
        self.spark, self.threshold, self.width, self.recall = spark, threshold, width, recall
        self.path = path or table_path(spark, "forest")
        self.trees = trees_for(threshold, recall)
        # coordinates of a signature: those that keys begin with, then those that they go on with
        self.coords = np.concatenate([np.arange(self.trees), (np.arange(self.trees) + sg.K // 2)])
        self._settings()

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _settings(self) -> None:
        own = (self.threshold, self.width, self.recall)
        on, p = self._hadoop(f"{self.path}/settings")
        if on.exists(p):
            r = self.spark.read.parquet(f"{self.path}/settings").first()
            if tuple(r) != own:
                raise ValueError(f"this forest was made with threshold, width, recall = {tuple(r)}, not {own}")
        else:
            self.spark.createDataFrame([own], "threshold double, width int, recall double").coalesce(1).write.parquet(f"{self.path}/settings")

    @property
    def runs(self) -> list[str]:
        """Paths of the whole runs in the folder, oldest first; a merged run stands for those before it."""
        got = [r for r in self._all() if self._hadoop(f"{r}/classes/fences/_SUCCESS")[0].exists(self._hadoop(f"{r}/classes/fences/_SUCCESS")[1])]
        last = max((i for i, r in enumerate(got) if r.endswith("-merged")), default=0)
        return got[last:]

    def _all(self) -> list[str]:
        on, p = self._hadoop(f"{self.path}/runs")
        return [f"{self.path}/runs/{n}" for n in sorted(x.getPath().getName() for x in on.listStatus(p))] if on.exists(p) else []

    def _next(self) -> str:
        """Path for a new run: never one that is there, whole or not."""
        return f"{self.path}/runs/{1 + max([-1, *(int(r.rpartition('/')[2][:6]) for r in self._all())]):06d}"

    def signed(self, df: DataFrame) -> DataFrame:
        """(id, batch, signature): a frame (id string, batch int, text string), signed for this forest."""
        return sg.signed(df.select("id", "batch", "text"), "text", self.width, self.coords)

    def add(self, df: DataFrame) -> DataFrame:
        """Accept a frame (id string, batch int, text string) as a new run; returns its classes."""
        return self._add(self.signed(df))

    def _add(self, rows: DataFrame) -> DataFrame:
        path = self._next()
        classes = written(sg.classes_of(rows, [F.min("batch").cast("int").alias("batch")]), "classes")
        fenced(self.spark, entries(classes), f"{path}/trees", ["key", "fp"])
        fenced(self.spark, classes.select(*_names(CLASS)), f"{path}/classes", ["fp"])
        return classes

    def accept(self, df: DataFrame) -> DataFrame:
        """Accept a frame (id string, batch int, text string) as a new run; returns (id) of those already present in an earlier batch of any run."""
        rows = written(self.signed(df), "signed").select("id", "batch", "fp", "n", "s0", "s1", "s2", "sig", "shingles")
        classes = self._add(rows)
        near = self.search(classes).withColumn("near", F.lit(True))
        out = rows.select("id", "batch", "fp").join(classes.select("fp", F.col("batch").alias("first")), "fp").join(near, "fp", "left")
        return out.where((F.col("first") < F.col("batch")) | F.col("near")).select("id").distinct()

    def search(self, classes: DataFrame) -> DataFrame:
        """(fp): classes of an accepted run that are alike to a class of an earlier batch."""
        where = fences(self.spark, [f"{r}/trees" for r in self.runs])
        theirs = fences(self.spark, [f"{r}/classes" for r in self.runs])
        close = written(self._verified(self._closest(self._candidates(classes, where, narrow=True)), classes, theirs), "close")
        open_ = classes.join(close, "fp", "left_anti")
        found = written(self._candidates(open_, where, narrow=False).groupBy("a", "b").agg(F.max("fields").alias("fields")), "candidates")
        best = self._closest(found)
        first = written(self._verified(best, classes, theirs), "first")
        rest = found.join(best, ["a", "b"], "left_anti").join(first.select(F.col("fp").alias("a")), "a", "left_anti")
        return close.unionByName(first).unionByName(self._verified(rest, classes, theirs))

    def _candidates(self, classes: DataFrame, where: Fences, narrow: bool) -> DataFrame:
        """(a, b, fields) of searches by whole keys in the first trees, or by the shortest prefix of all trees."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, 4096):
                    b = whole.slice(i, 4096)
                    keys = tree_keys(b)[:, : NARROW if narrow else None]
                    pick = pa.array(np.repeat(np.arange(b.num_rows), keys.shape[1]))
                    lo = hi = keys.ravel()
                    if not narrow:
                        lo, hi = lo >> SECOND << SECOND, lo | ((1 << SECOND) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), *(b.column(c).take(pick) for c in _names(ENTRY)[1:])], ["lo", "hi", *_names(ENTRY)[1:]])

        ranges = classes.select(*_names(ENTRY)[1:], "sig").mapInArrow(run, ENTRY.replace("key long", "lo long, hi long"))
        return located(ranges, where, Candidates(self.threshold, self.recall), "a long, b long, fields int")

    @staticmethod
    def _closest(found: DataFrame) -> DataFrame:
        """(a, b): of each entry the candidate with the most colliding fields."""
        return found.groupBy("a").agg(F.max_by("b", F.struct("fields", "b")).alias("b"))

    def _verified(self, pairs: DataFrame, classes: DataFrame, theirs: Fences) -> DataFrame:
        """(fp) of classes with a verified candidate, found in the stored classes by its fingerprint."""
        q = pairs.join(classes.select(F.col("fp").alias("a"), "n", "shingles"), "a").select(F.col("b").alias("lo"), F.col("b").alias("hi"), "a", "n", "shingles")
        return located(q, theirs, Verify(self.threshold), "fp long").distinct()

    def merge(self, blocks: int = 8) -> None:
        """Merge all runs into one, range by range: a task reads the blocks of its range from every run and merges them; classes keep their first batch."""
        old = self.runs
        if len(old) < 2:
            return
        path = f"{self._next()}-merged"
        for table, schema, by in (("trees", ENTRY, ["key", "fp"]), ("classes", CLASS, ["fp"])):
            where = fences(self.spark, [f"{r}/{table}" for r in old])
            _write(_ranges_merged(self.spark, where, schema, by, blocks), f"{path}/{table}/data")
            fence(self.spark, f"{path}/{table}", by)
        for r in old:
            on, p = self._hadoop(r)
            on.delete(p, True)


def _ranges_merged(spark: SparkSession, where: Fences, schema: str, by: list[str], blocks: int) -> DataFrame:
    """The rows of all runs in order: one partition to a range of about ``blocks`` blocks."""
    order = np.lexsort((where.low2, where.low))[::blocks]
    starts = np.stack([where.low[order], where.low2[order]], axis=1)
    starts = np.unique(starts, axis=0)
    shared = spark.sparkContext.broadcast((where, starts))  # the runs' catalogue

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_, begin = shared.value
        for k in (x for b in batches for x in b.column("id").to_pylist()):
            lo, hi = tuple(begin[k]), tuple(begin[k + 1]) if k + 1 < len(begin) else None
            upto = (w_.high > lo[0]) | (w_.high == lo[0]) & (w_.high2 >= lo[1])
            if hi:
                upto &= (w_.low < hi[0]) | (w_.low == hi[0]) & (w_.low2 < hi[1])
            t = pa.concat_tables([w_.read(i, _names(schema)) for i in np.flatnonzero(upto)])
            a, z = t[by[0]].to_numpy(), t[by[-1]].to_numpy()
            mine = (a > lo[0]) | (a == lo[0]) & (z >= lo[1])
            if hi:
                mine &= (a < hi[0]) | (a == hi[0]) & (z < hi[1])
            i = np.flatnonzero(mine)
            i = i[np.lexsort((t["batch"].to_numpy()[i], z[i], a[i]))]
            i = i[np.append(True, (a[i][1:] != a[i][:-1]) | (z[i][1:] != z[i][:-1]))[: len(i)]]
            yield from t.take(pa.array(i)).combine_chunks().to_batches(1 << 16)

    return spark.range(0, len(starts), 1, max(1, len(starts))).mapInArrow(run, schema)


def already_present(history: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = sg.RECALL) -> DataFrame:
    """(id): items alike to a history text or to an item of a smaller batch.

    ``history`` (id string, text string) counts as before every batch; ``items``
    (id string, batch int, text string) hold batches from 1 on.
    """
    forest = HashForest(items.sparkSession, threshold=threshold, width=width, recall=recall)
    forest.add(history.select("id", F.lit(0).alias("batch"), "text"))
    return forest.accept(items)
