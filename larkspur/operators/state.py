"""Incremental scans: files against the state that the last scan left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, mtime, size) that are new or changed."""
    old = state.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
    both = files.join(old, "path", "left")
    same = F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("size").eqNullSafe(F.col("old_size"))
    return both.where(F.col("old_mtime").isNull() | ~same).select(*files.columns)


def pruned(state: DataFrame, files: DataFrame) -> DataFrame:
    """State of files that are still there."""
    return state.join(files.select("path"), "path", "left_semi")


def updated(state: DataFrame, scanned: DataFrame) -> DataFrame:
    """State after a scan; unlike the insert-only original, changed files are
    refreshed, or they would be scanned again for ever."""
    return state.join(scanned.select("path"), "path", "left_anti").unionByName(scanned.select(*state.columns))


def with_counts(files: DataFrame, per_path: DataFrame) -> DataFrame:
    return files.join(per_path, "path", "left").withColumn("findings_count", F.coalesce("n_findings", F.lit(0)).cast("long")).drop("n_findings")
