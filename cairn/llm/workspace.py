"""Tables written during a query, in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else its checkpoint folder.

    Only where neither is set and driver and executors are one process (a local
    master) an own folder is made; on a cluster that is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got:
        return got
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        tmp = tempfile.TemporaryDirectory(prefix="cairn-")
        atexit.register(tmp.cleanup)
        _own[key] = f"file://{tmp.name}"
    return _own[key]


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/cairn/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table of the shared folder: lineage ends here, and an executor's loss costs nothing."""
    path = table_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunked(rows: DataFrame, by: list[str], most: int = 1000) -> DataFrame:
    """(by..., copies, chunk, ids): the ids (``id``) of each group of ``copies`` rows, in lists of about ``most``."""
    parts = F.ceil(F.col("copies") / most)
    return rows.withColumn("chunk", F.pmod(F.xxhash64("id"), parts)).groupBy(*by, "copies", "chunk").agg(F.collect_list("id").alias("ids"))


def crossed(lists: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., x, y): each id of ``xs`` with each of ``ys``; pairs of lists are spread before they grow."""
    d = lists.repartition(F.xxhash64("xs", "ys"))
    return d.select(*keep, "ys", F.explode("xs").alias("x")).select(*keep, "x", F.explode("ys").alias("y"))


def slices(batch, columns: list[str], most: int = 1_000_000):
    """Parts of an Arrow batch whose texts hold about ``most`` bytes each; rows are never cut."""
    import numpy as np

    n = batch.num_rows
    if not n:
        return
    size = np.ones(n, np.int64)
    for c in columns:
        import pyarrow.compute as pc

        size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], n)):
        yield batch.slice(a, b - a)
