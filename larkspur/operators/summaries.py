"""Filters, order and sums over findings and items."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.patterns import usable
from larkspur.functions.scoring import FLAGS, RANK
from larkspur.runtime import written

SHOWN_FROM = {"quiet": 99, "normal": RANK["medium"], "verbose": 0}
#: Folders that the search for env files doesn't enter.
SKIPPED_FOLDERS = ("node_modules", ".git", "vendor", "venv", "__pycache__", "target", "build", "dist")


def at_least(findings: DataFrame, confidence: float = 0.3) -> DataFrame:
    return findings.where(F.col("confidence") >= confidence)


def shown(findings: DataFrame, verbosity: str = "normal") -> DataFrame:
    return findings.where(F.col("severity_rank") >= SHOWN_FROM[verbosity])


def in_report_order(findings: DataFrame) -> DataFrame:
    """Severest first, then by path components, then by line."""
    return findings.orderBy(F.desc("severity_rank"), F.split("path", "/"), F.asc_nulls_first("line_number"), "rule_id")


def with_places(findings: DataFrame) -> DataFrame:
    """Findings with their places in the report, from 1. Each task numbers the
    range that it has sorted; counts of the ranges give their first places."""
    number = F.monotonically_increasing_id()
    rows = written(in_report_order(findings).withColumn("__number", number), "report-order")
    task = F.shiftright("__number", 33)
    counts = rows.groupBy(task.alias("__task")).agg(F.count("*").alias("n")).orderBy("__task").collect()
    firsts = [(r["__task"], first) for r, first in zip(counts, accumulate((r.n for r in counts), initial=1), strict=False)]
    firsts = findings.sparkSession.createDataFrame(firsts, "__task long, __first long")
    # one row for each task of the sort
    rows = rows.withColumn("__task", task).join(F.broadcast(firsts), "__task")
    return rows.withColumn("place", F.col("__first") + F.col("__number").bitwiseAND((1 << 33) - 1)).drop("__number", "__task", "__first")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in RANK))


def hidden_count(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity").isin("low", "info")).alias("hidden"))


def per_path(findings: DataFrame) -> DataFrame:
    return findings.groupBy("path").agg(F.count("*").alias("n_findings"))


def bytes_scanned(items: DataFrame) -> DataFrame:
    return items.agg(F.sum(F.octet_length("line")).cast("long").alias("bytes_scanned"))


def files_scanned(items: DataFrame) -> DataFrame:
    """Distinct paths of each source, summed."""
    return items.groupBy("source_type").agg(F.countDistinct("path").alias("n")).agg(F.sum("n").cast("long").alias("files_scanned"))


def ancestors(path: Column) -> Column:
    """A path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def excluded(path: Column, folders: list[str], patterns: list[str]) -> Column:
    """Below one of the folders, or found by a pattern; patterns that can't be compiled are left out.
    A path's ancestors are looked up in the set of folders, so their number doesn't matter."""
    out, names = F.lit(False), sorted({f.rstrip("/") for f in folders})
    if names:
        out = F.exists(ancestors(path), lambda a: a.isin(names))
    for p in usable([FLAGS + p for p in patterns]):
        out = out | path.rlike(p)
    return out


def scan_facts(items: DataFrame) -> DataFrame:
    """One row: files_scanned and files_cached (distinct paths of each source, summed),
    and bytes_scanned, of items with ``source`` and ``cached``."""
    by_source = items.groupBy("source").agg(
        F.countDistinct("path").alias("files"), F.countDistinct(F.when(F.col("cached"), F.col("path"))).alias("cached"), F.sum(F.when(~F.col("cached"), F.octet_length("line"))).alias("bytes")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by_source.agg(total("files").alias("files_scanned"), total("cached").alias("files_cached"), total("bytes").alias("bytes_scanned"))


def in_skipped_folder(path: Column, root: str = "/") -> Column:
    inner = F.split(path.substr(F.lit(len(root.rstrip("/")) + 2), F.length(path)), "/")
    return F.arrays_overlap(F.slice(inner, 1, F.size(inner) - 1), F.array(*map(F.lit, SKIPPED_FOLDERS)))
