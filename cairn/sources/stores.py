"""Stores as Parquet folders, partitioned by category where there is one; front-matter and JSON readers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LTM = "id string, content string, category string, source string, tags array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, is_sensitive boolean, encrypted_ref string, loaded_at timestamp_ntz"
KB = "id string, title string, content string, category string, tags array<string>, source string, confidence string, confirmed boolean, created_at timestamp_ntz, updated_at timestamp_ntz, loaded_at timestamp_ntz"
EVENTS = "event_id long, session_id string, event_ts timestamp_ntz, event_type string, content string, received_at timestamp_ntz"
ENCRYPTED = "id string, key_name string, category string, ciphertext_hex string, nonce_hex string, salt_hex string, hint string, created_at string, last_accessed string"
WEIGHTS = "entry_id string, weight int"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, schema: str, category: str | None = None) -> DataFrame:
    """A store; a category reads its partition only.  A store that isn't there is empty."""
    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return df.where(F.col("category") == category) if category is not None else df


def write(df: DataFrame, path: str, whole: bool = False) -> None:
    """Write by category: only the partitions that ``df`` holds are replaced, or the whole store."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("category").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("category").parquet(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of entry id to weight."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,int>")).alias("entry_id", "weight"))


def write_weights(weights: DataFrame, path: str) -> None:
    """Weights as Parquet rows: a JSON object would have to pass through one task."""
    weights.select("entry_id", "weight").write.mode("overwrite").parquet(path)


def read_encrypted(spark: SparkSession, path: str) -> DataFrame:
    """Encrypted entries: a JSON list, or an object with ``entries``; a file that is neither gives no row."""
    item = "array<struct<" + ", ".join(f"{a}: {b}" for a, b in (x.split() for x in ENCRYPTED.split(", "))) + ">>"
    raw = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.from_json("value", f"struct<entries: {item}>")["entries"], F.from_json("value", item))
    return raw.select(F.explode(F.filter(rows, lambda x: x["id"].isNotNull())).alias("e")).select("e.*")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector): a JSON object of id to numbers."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("id", "vector"))


def read_front_matter(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows under ``entries`` in the YAML front matter of Markdown files; files without a list give no row, unknown fields are dropped, missing ones null."""
    import yaml

    plain = ", ".join(f"{a} {'string' if b.startswith('timestamp') else b}" for a, b in (x.split(maxsplit=1) for x in schema.split(", ")))
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["value"]:
                parts = text.split("---", 2) if text and text.startswith("---") else []
                try:
                    head = yaml.safe_load(parts[1]) if len(parts) == 3 else None
                except yaml.YAMLError:
                    head = None
                items = head.get("entries") if isinstance(head, dict) else None
                for e in items if isinstance(items, list) else []:
                    if isinstance(e, dict):
                        out.append([str(v) if v is not None and not isinstance(v, (str, bool, list, int, float)) else v for v in (e.get(n) for n in names)])
            yield pd.DataFrame(out, columns=names)

    rows = spark.read.text(path, wholetext=True).mapInPandas(parse, plain)
    return rows.select(*(F.col(a).cast(b) if b.startswith("timestamp") else F.col(a) for a, b in (x.split(maxsplit=1) for x in schema.split(", "))))


def skill_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``df`` with a JSON column parsed by a schema; what can't be parsed is null."""
    return df.withColumn(column, F.from_json(column, schema))


def manifest(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False, indent=2, sort_keys=True)
