"""The state of the last scan, as JSON lines: a header, then one line for each file.

Missing or malformed states, and those of another version, count as empty: then
everything is scanned again. On a cluster the path has to be one that executors
see too.
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "path string, mtime bigint, size bigint, findings_count bigint"
VERSION, TOOL_VERSION = 1, "0.1.0"


def save(state: DataFrame, path: str) -> None:
    """Write a state that only its owner can read; rows come task by task. The
    old file stays until the new one is whole, for the new state is made from it."""
    path = os.path.abspath(path)
    os.makedirs(os.path.dirname(path), mode=0o700, exist_ok=True)
    new = f"{path}.new"
    with os.fdopen(os.open(new, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        os.fchmod(f.fileno(), 0o600)
        f.write(json.dumps({"version": VERSION, "tool_version": TOOL_VERSION, "created_at": datetime.now(UTC).isoformat()}) + "\n")
        for row in state.select(F.to_json(F.struct("path", "mtime", "size", "findings_count")).alias("row")).toLocalIterator():
            f.write(row.row + "\n")
    os.replace(new, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    empty = spark.createDataFrame([], STATE)
    try:
        with open(path) as f:
            header = json.loads(f.readline())
        known = header["version"] == VERSION and header["tool_version"] == TOOL_VERSION
    except (OSError, ValueError, KeyError, TypeError):
        return empty
    if not known:
        return empty
    rows = spark.read.text(f"file://{os.path.abspath(path)}").select("value", F.from_json("value", STATE).alias("r"))
    # the header has no path; every other line needs all four fields
    whole = F.col("r.path").isNotNull() & F.col("r.mtime").isNotNull() & F.col("r.size").isNotNull() & F.col("r.findings_count").isNotNull()
    odd = rows.where(~whole & ~F.coalesce(F.col("value").startswith('{"version"'), F.lit(False)))
    return empty if odd.head(1) else rows.where(whole).select("r.*")
