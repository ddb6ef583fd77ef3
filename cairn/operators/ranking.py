"""Weights of entries, ranking by weight and recency, weight statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the weights 1 to 5, and the weight of an entry without one.
NAMES = {1: "低", 2: "中", 3: "高", 4: "关键", 5: "核心"}
DEFAULT = 2


def weight_name(w: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv)), w)


def adjusted(w: Column, delta: Column) -> Column:
    """A weight moved by ``delta``, kept within 1..5; no weight counts as the default."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(w, F.lit(DEFAULT)) + delta))


def suggested_weight(content: Column, category: Column) -> Column:
    c = F.coalesce(content, F.lit(""))
    return (
        F.when((category == "credential") | c.contains("密码") | c.contains("密钥"), 4)
        .when(category.isin("preference", "decision"), 3)
        .when((category == "goal") | c.contains("我的名字是") | c.contains("我叫"), 3)
        .when(category.isin("project", "technical"), 2)
        .when(category.isin("chat", "general"), 1)
        .otherwise(DEFAULT)
    )


def set_weights(weights: DataFrame, changes: DataFrame) -> DataFrame:
    """Weights (entry_id, weight) after a bulk change: all of it if every weight is within 1..5, else none of it."""
    bad = changes.agg(F.coalesce(F.max((~F.coalesce(F.col("weight").between(1, 5), F.lit(False))).cast("int")), F.lit(0)).alias("_bad"))
    ok = changes.crossJoin(F.broadcast(bad)).where("_bad = 0").select("entry_id", "weight")
    return weights.join(ok.select("entry_id"), "entry_id", "left_anti").unionByName(ok)


def recency(created: Column, as_of: Column) -> Column:
    """1 within 7 days (or in the future), falling from 0.5 to 0 at 30 days, then 0.1; 0.3 without a date."""
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / F.lit(86_400_000_000.0))
    return F.when(created.isNull(), 0.3).when(days <= 7, 1.0).when(days <= 30, 0.5 * (1 - (days - 7) / 23)).otherwise(0.1)


def ranked(df: DataFrame, weights: DataFrame, as_of: Column, boost: bool = True) -> DataFrame:
    """``df`` with weight, weight_name, weight_score, time_score and rank_score = 0.7 weight + 0.3 time, best first."""
    d = df.join(weights.select(F.col("entry_id").alias("id"), "weight"), "id", "left").withColumn("weight", F.coalesce("weight", F.lit(DEFAULT)))
    d = d.withColumn("weight_name", weight_name(F.col("weight"))).withColumn("weight_score", F.col("weight") / 5.0).withColumn("time_score", recency(F.col("created_at"), as_of) if boost else F.lit(0.0))
    return d.withColumn("rank_score", 0.7 * F.col("weight_score") + 0.3 * F.col("time_score")).orderBy(F.col("rank_score").desc(), "id")


def weight_statistics(weights: DataFrame) -> DataFrame:
    """(weight, entries, all_entries, mean): a row for each weight 1..5; an empty store gives no row."""
    spark = weights.sparkSession
    every = spark.range(1, 6).select(F.col("id").cast("int").alias("weight"))
    total = weights.agg(F.count("*").alias("all_entries"), F.avg("weight").alias("mean"))
    counts = weights.groupBy(F.col("weight").cast("int").alias("weight")).agg(F.count("*").alias("entries"))
    d = every.join(counts, "weight", "left").crossJoin(F.broadcast(total)).where("all_entries > 0")
    return d.select("weight", F.coalesce("entries", F.lit(0)).alias("entries"), "all_entries", F.round("mean", 6).alias("mean"))
