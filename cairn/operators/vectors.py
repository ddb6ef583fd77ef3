"""Term-frequency and dense vectors: build, search, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx


def term_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(id, term, tf): counts of blank-separated terms over each vector's length (L2); no global vocabulary is needed."""
    counts = df.select("id", F.explode(tx.blank_tokens(text)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    norm = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, "id").select("id", "term", (F.col("n") / F.col("norm")).alias("tf"))


def search_terms(df: DataFrame, text: str, query: str, k: int, least: float = 0.1) -> DataFrame:
    """(id, score): rows by cosine with a query, ``least`` or more; the query's terms are literals, so one pass without a join."""
    words = query.lower().split()
    weights = {w: words.count(w) for w in words}
    length = sum(n * n for n in weights.values()) ** 0.5
    tokens = tx.blank_tokens(text)
    count = lambda t: F.size(F.filter("_t", tx.equals(t))).cast("double")
    product = sum((count(w) * float(n) for w, n in weights.items()), F.lit(0.0))
    norm = F.sqrt(F.aggregate(F.transform(F.array_distinct("_t"), lambda u: F.pow(F.size(F.filter("_t", lambda x: x == u)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    # rows that hold no query term have a cosine of 0: their norm is never taken
    d = df.select("id", tokens.alias("_t")).where(F.arrays_overlap("_t", F.array(*map(F.lit, weights))) if weights else F.lit(False))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), product / (norm * F.lit(length or 1.0))))
    return d.select("id", score.alias("score")).where(F.col("score") >= least).orderBy(F.col("score").desc(), "id").limit(k)


def search_dense(df: DataFrame, vector: str, query: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(id, score): exact nearest rows to the one vector in ``query`` (column ``query``)."""
    d = df.crossJoin(F.broadcast(query.select("query").limit(1)))  # one row
    return d.select("id", sim.dense_cosine(F.col(vector), F.col("query")).alias("score")).where(F.col("score") >= least).orderBy(F.col("score").desc(), "id").limit(k)
