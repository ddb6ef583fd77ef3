"""Point reads, lists, filters and mutations of record stores.

Ties of every order fall to ``id``.  Redelivered rows (same key) count once.
Mutations return the new state as a frame; writing it is the sources' part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Categories, confidence labels and task types that a store accepts.
LTM_CATEGORIES = ["profile", "preference", "project", "decision", "habit", "credential", "other"]
KB_CATEGORIES = ["personal", "technical", "project", "domain", "reference", "ai-learned"]
CONFIDENCE = ["high", "medium", "low"]
TASK_TYPES = ["conversation", "coding", "project", "research", "writing", "analysis", "general"]


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key."""
    return df.dropDuplicates([key])


def clean_label(c: Column | str) -> Column:
    """A label without blanks at its ends, in lower case."""
    return F.lower(tx.strip(c))


def get(df: DataFrame, id_: str) -> DataFrame:
    return df.where(F.col("id") == id_).limit(1)


def latest(df: DataFrame, category: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first, ``id`` breaking ties; undated rows last."""
    if category is not None:
        df = df.where(F.col("category") == category)
    return df.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(limit)


def index(df: DataFrame) -> DataFrame:
    """Entries without their content."""
    return df.select("id", "title", "category", "tags", "confidence", "confirmed", "created_at", "updated_at")


def summary(df: DataFrame) -> DataFrame:
    return df.select("id", "content", "tags", "created_at")


def confirmed_only(df: DataFrame, on: bool = True) -> DataFrame:
    return df.where(F.coalesce("confirmed", F.lit(False))) if on else df


def checked_ltm(df: DataFrame) -> DataFrame:
    """``valid`` and ``error`` for rows to be saved: content and a known category are needed."""
    error = F.when(F.coalesce(tx.strip("content"), F.lit("")) == "", "content is empty").when(~F.coalesce(F.col("category").isin(*LTM_CATEGORIES), F.lit(False)), "unknown category")
    return df.withColumn("error", error).withColumn("valid", F.col("error").isNull())


def checked_kb(df: DataFrame) -> DataFrame:
    """``valid`` and ``error`` for knowledge-base rows: title, content, category and confidence are checked, title and content stripped."""
    d = df.withColumn("title", tx.strip("title")).withColumn("content", tx.strip("content"))
    error = (
        F.when(F.coalesce("title", F.lit("")) == "", "title is empty")
        .when(F.coalesce("content", F.lit("")) == "", "content is empty")
        .when(~F.coalesce(F.col("category").isin(*KB_CATEGORIES), F.lit(False)), "unknown category")
        .when(~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False)), "unknown confidence")
    )
    return d.withColumn("error", error).withColumn("valid", F.col("error").isNull())


def add_distinct(store: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows whose content isn't there yet up to case and blanks, and all new rows with the id that holds their content."""
    key = F.xxhash64(tx.normal_space("content"))
    s = store.withColumn("_n", tx.normal_space("content")).withColumn("_k", key)
    n = new.withColumn("_n", tx.normal_space("content")).withColumn("_k", key)
    first = s.groupBy("_k", "_n").agg(F.min_by("id", F.struct("created_at", "id")).alias("_held"))
    # two aggregations with partial sums, no window: a content that many rows share stays cheap
    newest = n.groupBy("_k", "_n").agg(F.min_by("id", F.struct("created_at", "id")).alias("_first"))
    joined = n.join(newest.join(first, ["_k", "_n"], "left"), ["_k", "_n"])
    placed = joined.select(*new.columns, F.coalesce("_held", "_first").alias("held_by"))
    return joined.where("_held is null and id = _first").select(*new.columns), placed


def updated(store: DataFrame, changes: DataFrame, columns: list[str], as_of: Column) -> DataFrame:
    """Partial update: a null in ``changes`` keeps the old value; changed rows get ``updated_at`` = ``as_of``."""
    c = changes.select(F.col("id"), *(F.col(x).alias(f"_{x}") for x in columns), F.lit(True).alias("_hit"))
    joined = store.join(c, "id", "left")
    new = {x: F.coalesce(f"_{x}", x) for x in columns} | {"updated_at": F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at"))}
    return joined.select(*(new[x].alias(x) if x in new else F.col(x) for x in store.columns))


def deleted(store: DataFrame, ids: DataFrame, confirm: bool = False) -> DataFrame:
    """The store without ``ids``; must be confirmed."""
    if not confirm:
        raise ValueError("a deletion must be confirmed")
    return store.join(ids.select("id"), "id", "left_anti")


def upserted(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace those of the same key."""
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def migrated(store: DataFrame, legacy: DataFrame) -> DataFrame:
    """The store with legacy rows of unknown ids added; a missing category is ``other``."""
    new = legacy.withColumn("category", F.coalesce("category", F.lit("other")))
    return store.unionByName(new.join(store.select("id"), "id", "left_anti").select(*store.columns))


def shard_name(category: Column | str) -> Column:
    """A file-name part of a category: other than letters, digits, _ and - become _."""
    return F.regexp_replace(tx.col(category), r"[^\p{L}\p{N}_-]", "_")


def without_matching(df: DataFrame, phrase: str, category: str) -> DataFrame:
    """Clean-up: rows of a category that contain a phrase are gone."""
    return df.where(~F.coalesce(F.col("content").contains(phrase) & (F.col("category") == category), F.lit(False)))


def paragraphs(df: DataFrame, text: str, least: int = 100) -> DataFrame:
    """Paragraph chunks: parts between blank lines of at least ``least`` characters; the whole text if there is none.

    Adds chunk_no (from 1) and chunk; a null or blank text gives no row.
    """
    body = tx.strip(F.regexp_replace(text, "\r\n", "\n"))
    parts = F.filter(F.transform(F.split(body, r"\n{2,}"), tx.strip), lambda x: F.length(x) >= least)
    chunks = F.when(F.size(parts) > 0, parts).otherwise(F.array(body))
    d = df.where(F.coalesce(body, F.lit("")) != "")
    return d.select("*", F.posexplode(chunks).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no") + 1)
