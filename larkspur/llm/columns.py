"""Columns of tables that may have any names, names that differ in case only included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_place(df: DataFrame) -> DataFrame:
    """The table with its columns called c0, c1, ... in their order."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def place(names: Sequence[str], name: str) -> int:
    """Where a column is: the first one of exactly that name, else the only one that differs in case."""
    if name in names:
        return list(names).index(name)
    alike = [k for k, n in enumerate(names) if n.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"no column {name!r} among {list(names)}")
    return alike[0]


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The columns that are named, under the names of the keywords: ``picked(docs, doc_id="id")``."""
    own = by_place(df)
    return own.select(*(F.col(f"c{place(df.columns, name)}").alias(key) for key, name in columns.items()))


def with_results(df: DataFrame, names: Sequence[str], results: dict[str, Column]) -> DataFrame:
    """Of a table by place, the columns with the names that they had, but for those that a
    result replaces (in any case), and the results."""
    taken = {r.lower() for r in results}
    own = [(k, n) for k, n in enumerate(names) if n.lower() not in taken]
    out = df.select(*(F.col(f"c{k}") for k, _ in own), *(c.alias(f"r{k}") for k, c in enumerate(results.values())))
    return out.toDF(*(n for _, n in own), *results)
