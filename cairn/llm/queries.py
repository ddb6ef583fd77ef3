"""Queries over the project's tables for the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import history, leak, mixing, mojibake, neardup, pii, reading, split

#: Alikeness of entries and items, and the width of their word runs, as the data's problems state them.
ALIKE, WIDTH = 0.5, 3
#: Vocabulary file that the mixing queries count tokens with, unless CAIRN_TOKENIZER names another.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1. near-duplicates


def _entries(spark: SparkSession, d: str) -> DataFrame:
    ltm = _table(spark, d, "ltm_entries").select(F.lit(0).alias("space"), "id", F.col("content").alias("text"))
    both = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return ltm.unionByName(_table(spark, d, "kb_entries").select(F.lit(1).alias("space"), "id", both.alias("text")))


def _kind() -> Column:
    return F.when(F.col("space") == 0, "ltm").otherwise("kb").alias("record_kind")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.near_duplicates(_entries(spark, d), ALIKE, WIDTH)
    return neardup.expanded(members, links).select(_kind(), "id_a", "id_b")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each entry with its class of copies and its links at the operator's own settings: runs of five words, 0.8."""
    members, links = neardup.near_duplicates(_entries(spark, d))
    return neardup.with_links(members, links).select(_kind(), "id", "class_id", "copies", "links")


# 2. new batches against history


def _items(spark: SparkSession, d: str) -> DataFrame:
    said = _table(spark, d, "save_suggestions").select(F.col("item_id").alias("id"), F.col("batch_no").alias("batch"), F.col("content").alias("text"))
    queued = _table(spark, d, "stm_sessions").select(F.explode("pending_saves").alias("p")).select(F.col("p.item_id").alias("id"), F.col("p.batch_no").alias("batch"), F.col("p.content").alias("text"))
    return said.unionByName(queued)


def _present(spark: SparkSession, d: str, threshold: float, width: int) -> DataFrame:
    past = _table(spark, d, "ltm_entries").select("id", F.col("content").alias("text"))
    return history.already_present(past, _items(spark, d), threshold, width).select(F.col("id").alias("item_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _present(spark, d, ALIKE, WIDTH)


def p2_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Items that are new at the operator's own settings: runs of five words, 0.8."""
    return _items(spark, d).where(F.col("id").isNotNull()).select(F.col("id").alias("item_id"), F.col("batch").alias("batch_no")).distinct().join(_present(spark, d, 0.8, 5), "item_id", "left_anti")


# 3. splitting


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    a = _table(spark, d, "import_requests").select(F.lit("import_requests.text").alias("field_name"), F.col("request_id").alias("record_id"), "text")
    b = _table(spark, d, "kb_entries").select(F.lit("kb_entries.content").alias("field_name"), F.col("id").alias("record_id"), F.col("content").alias("text"))
    return a.unionByName(b).join(_table(spark, d, "size_limits"), "field_name")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(_oversized(spark, d), "text", texts=False).where("pieces > 1").select("field_name", "record_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(_oversized(spark, d), "text").dropDuplicates(["field_name", "record_id", "piece_no"])


# 4. personal information


def _contents(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, key in (("ltm_entries", "id"), ("kb_entries", "id"), ("session_events", "event_id")):
        part = _table(spark, d, table).select(F.lit(f"{table}.content").alias("field_name"), F.col(key).cast("string").alias("record_id"), "content")
        out = part if out is None else out.unionByName(part)
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _contents(spark, d)
    return pii.found(rows, "content", pii.fitted(rows, "record_id", "content")).distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = _contents(spark, d)
    return pii.redacted(rows, "content", pii.fitted(rows, "record_id", "content")).dropDuplicates(["field_name", "record_id"])


# 5. reading form


def _fields(spark: SparkSession, d: str) -> DataFrame:
    kb = _table(spark, d, "kb_entries")
    parts = [_table(spark, d, "ltm_entries").select(F.lit("ltm_entries.content").alias("field_name"), "id", F.col("content").alias("value"))]
    parts += [kb.select(F.lit(f"kb_entries.{c}").alias("field_name"), "id", F.col(c).alias("value")) for c in ("title", "content")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.same_reading(_fields(spark, d), ["field_name"], "id", "value").select("field_name", "id_a", "id_b")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).withColumn("form", reading.reading_form("value")).dropDuplicates(["field_name", "id"])


# 6. leaks


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the alignments those that hold a run of 16 words, as the case is defined; p6_alignments has edited copies, too."""
    return _leaks(spark, d).where(F.col("run_words") >= leak.RUN).select("doc_id", "item_id").distinct()


def p6_alignments(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


# 7. mixing


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(_table(spark, d, "documents"), _table(spark, d, "mix_plans"), os.environ.get("CAIRN_TOKENIZER", TOKENIZER))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).pieces()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    mix = _mix(spark, d)
    return mix.shares(mix.pieces())


# 8. garbled text


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_restored(spark, d).select("doc_id").distinct()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_accepted, p3_found, p3_pieces, p4_found, p4_redacted, p5_found, p5_forms, p6_found, p6_alignments, p7_mix, p7_shares, p8_found, p8_restored)}


def oracle_sql() -> dict[str, str]:
    """SQL for the one query that SQL expresses over whole tables: which texts are over their limit."""
    blanks = "' ' || chr(9) || chr(10) || chr(13)"
    return {
        "p3_found": f"""
SELECT DISTINCT field_name, record_id FROM (
  SELECT 'import_requests.text' AS field_name, request_id AS record_id, text FROM import_requests
  UNION ALL SELECT 'kb_entries.content', id, content FROM kb_entries) JOIN size_limits USING (field_name)
WHERE length(trim(text, {blanks})) > max_chars""",
    }
