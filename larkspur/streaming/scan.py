"""Findings of a stream of lines.

The scan is stateless, so the same plan serves streams; a stream of findings
can also be counted in time windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.rules import BUILT_IN, Rule
from larkspur.operators.detect import findings
from larkspur.operators.lines import text_lines


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files that appear in a folder, whole, as (path, text, seen_at)."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("seen_at"))


def findings_stream(texts: DataFrame, rules: Sequence[Rule] = BUILT_IN) -> DataFrame:
    items = text_lines(texts.withColumn("source_type", F.lit("dotfile")), keep=("path", "source_type"))
    return findings(items, rules)


def counts_by_window(events: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings by severity and time window; late rows are dropped after ``late``."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "severity").agg(F.count("*").alias("n"))
