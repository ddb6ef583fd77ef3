"""Backups of a store's folder: create, list, restore, delete, retain.  A driver-side utility over files."""

from __future__ import annotations

import json
import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a backup leaves out.
EXCLUDED = ("encrypted.json", "*.pyc", "__pycache__", ".git", "*.log", "*.tmp")


def excluded(path: str, patterns: tuple[str, ...] = EXCLUDED) -> bool:
    """By ending for ``*`` patterns, else by exact name or as a part of the path."""
    name = Path(path).name
    return any(name.endswith(p[1:]) if p.startswith("*") else name == p or p in path for p in patterns)


def excluded_column(path: Column, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    """The same as a column expression."""
    out = F.lit(False)
    for p in patterns:
        out = out | (path.endswith(p[1:]) if p.startswith("*") else path.contains(p))
    return out


def create(source: str, root: str, name: str, at: datetime, by: str = "manual") -> dict:
    """Copy a folder and write its manifest."""
    to = Path(root) / name
    files = [p for p in sorted(Path(source).rglob("*")) if p.is_file() and not excluded(str(p.relative_to(source)))]
    for p in files:
        target = to / p.relative_to(source)
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(p, target)
    meta = {"timestamp": at.isoformat(), "source": source, "backup_name": name, "files": [str(p.relative_to(source)) for p in files], "file_count": len(files), "total_size": sum(p.stat().st_size for p in files), "created_by": by}
    to.mkdir(parents=True, exist_ok=True)
    (to / "backup_metadata.json").write_text(json.dumps(meta, ensure_ascii=False))
    return meta


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(backup_name, timestamp, file_count, total_size), the latest name first."""
    rows = [json.loads(p.read_text()) for p in Path(root).glob("*/backup_metadata.json")]
    d = spark.createDataFrame([(r["backup_name"], r["timestamp"], r["file_count"], r["total_size"]) for r in rows], "backup_name string, timestamp string, file_count long, total_size long")
    return d.orderBy(F.col("backup_name").desc())


def restore(root: str, name: str, target: str, at: datetime) -> int:
    """Put a backup's files in the target's place; the target is backed up first."""
    kept = Path(root) / name
    meta = json.loads((kept / "backup_metadata.json").read_text())
    if Path(target).exists():
        create(target, root, f"before_{name}_{at:%Y%m%d_%H%M%S}", at, "restore")
        shutil.rmtree(target)
    for f in meta["files"]:
        to = Path(target) / f
        to.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(kept / f, to)
    return len(meta["files"])


def delete(root: str, name: str, confirm: bool = False) -> bool:
    """Remove a backup; must be confirmed."""
    if not confirm:
        raise ValueError("a deletion must be confirmed")
    at = Path(root) / name
    if at.is_dir():
        shutil.rmtree(at)
        return True
    return False


def expired(backups: DataFrame, keep_count: int, keep_days: int, as_of: Column) -> DataFrame:
    """Backups (backup_name, timestamp string) beyond the latest ``keep_count`` and older than ``keep_days`` (0 or less: of any age; an unreadable time counts as old)."""
    rank = F.row_number().over(Window.orderBy(F.col("timestamp").desc_nulls_last(), F.col("backup_name").desc()))
    at = F.try_to_timestamp(F.col("timestamp"))
    old = F.lit(True) if keep_days <= 0 else F.coalesce(F.timestamp_diff("DAY", at, as_of) > keep_days, F.lit(True))
    return backups.withColumn("_rank", rank).where((F.col("_rank") > keep_count) & old).drop("_rank")
