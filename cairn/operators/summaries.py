"""Counts and summaries of stores, sessions and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profile(ltm: DataFrame, most: int = 5) -> DataFrame:
    """(category, entries, recent): counts by category, and the ids of the last ``most`` entries in order of creation."""
    by = Window.partitionBy("category").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    last = ltm.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= most)
    recent = last.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_r"), F.col("id")))), lambda s: s["id"]).alias("recent"))
    counts = ltm.groupBy("category").agg(F.count("*").alias("entries")).alias("c")
    return counts.join(recent.alias("r"), F.col("c.category").eqNullSafe(F.col("r.category"))).select("c.category", "entries", "recent")


def status(ltm: DataFrame, kb: DataFrame, sessions: DataFrame) -> DataFrame:
    """(metric, value): memories, sensitive memories, knowledge entries by category, active sessions."""
    a = ltm.agg(F.count("*").alias("n"), F.count_if("is_sensitive").alias("s"))
    rows = a.select(F.explode(F.map_from_arrays(F.array(F.lit("ltm_total"), F.lit("ltm_sensitive")), F.array("n", "s"))).alias("metric", "value"))
    by = kb.groupBy("category").agg(F.count("*").alias("value")).select(F.concat(F.lit("kb:"), F.coalesce("category", F.lit("none"))).alias("metric"), "value")
    act = sessions.agg(F.count_if("is_active").alias("value")).select(F.lit("active_sessions").alias("metric"), "value")
    return rows.unionByName(by).unionByName(act)


def coverage(df: DataFrame, by: list[str], score: str = "relevance", least: float = 0.6) -> DataFrame:
    """Share of results at ``least`` or more, variety of tags and categories, and whether they suffice to compose from."""
    # distinct tags are counted, not collected: a group may hold a third of all rows
    each = df.select(*by, F.explode("tags").alias("_tag")).distinct().groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count("*").alias("_tags"))
    d = df.groupBy(*by).agg(F.count("*").alias("results"), F.avg(F.when(F.col(score) >= least, 1.0).otherwise(0.0)).alias("coverage"), F.count_distinct("category").alias("_kinds"), F.avg(score).alias("mean_relevance"))
    same = [d[c].eqNullSafe(each[f"_{c}"]) for c in by]
    d = d.join(each, same, "left").drop(*[f"_{c}" for c in by])
    d = d.withColumn("diversity", F.least(F.lit(1.0), (F.coalesce("_tags", F.lit(0)) + F.col("_kinds")) / (2 * F.col("results")))).drop("_tags", "_kinds")
    d = d.withColumn("composability", 0.6 * F.col("coverage") + 0.4 * F.col("diversity"))
    return d.withColumn("can_compose", F.col("composability") >= 0.65)


def run_statistics(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def per_source(df: DataFrame, source: str = "source") -> DataFrame:
    """(source, items): how many rows each source gave; rows without a source count under null."""
    return df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("items"))
