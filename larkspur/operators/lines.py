"""Texts -> lines with two lines of context on each side, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import CONTEXT, lines, truncated


def with_context(df: DataFrame, entries: Column, keep: list[str], line: str = "line", more: tuple[str, ...] = ()) -> DataFrame:
    """Explode an array of struct<line_number, line> (and ``more``) with its neighbours."""
    df = df.withColumn("__entries", entries)
    at = F.posexplode("__entries").alias("__at", "__entry")
    df = df.select(*keep, "__entries", at)
    first = F.greatest(F.col("__at") - CONTEXT, F.lit(0))
    # slices first: taking the texts of all entries for every row would be quadratic
    texts = lambda start, length: F.slice("__entries", start, length)["line"]
    return df.select(
        *keep,
        F.col("__entry.line_number").cast("int").alias("line_number"),
        F.col("__entry.line").alias(line),
        *(F.col(f"__entry.{c}").alias(c) for c in more),
        texts(first + 1, F.col("__at") - first).alias("context_before"),
        texts(F.col("__at") + 2, F.lit(CONTEXT)).alias("context_after"),
    )


def numbered(texts: Column, cut: bool = True) -> Column:
    """Array of strings -> array of struct<line_number, line>, from 1; without ``cut``, lines stay whole."""
    return F.transform(texts, lambda s, i: F.struct((i + 1).alias("line_number"), (truncated(s) if cut else s).alias("line")))


def text_lines(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("path", "source_type"), cut: bool = True) -> DataFrame:
    """One row for each line of each text. Null and empty texts have none."""
    return with_context(df, numbered(lines(F.col(text)), cut), list(keep))
